"""Changed symbols of a change and the repository scan for their names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changelens import rules
from changelens.functions import code, diffs, lexer, paths
from changelens.functions.text import as_column, built_once, let
from changelens.operators.grouping import REVIEW, broadcast_if_small, first_per_group, materialize, shuffled, unnest
from changelens.sources import snapshot

FILE = (*REVIEW, "filename")
SYMBOL = (*FILE, "name", "start_line", "change")


def with_blanked(files: DataFrame, grammar: code.Grammar | None = None) -> DataFrame:
    """Adds ``blanked`` and ``commentless`` texts of ``content``; files with code inside their strings go through the lexer, the others through patterns."""
    return (
        files.withColumn("_lexed", lexer.lexed("content", "family"))
        .withColumn("blanked", F.coalesce("_lexed.blanked", code.blank_literals("content", "family", grammar)))
        .withColumn("commentless", F.coalesce("_lexed.commentless", code.blank_comments("content", "family", grammar)))
        .drop("_lexed")
    )


def with_source_facts(files: DataFrame, path: str = "path", grammar: code.Grammar | None = None) -> DataFrame:
    """Adds language, family, blanked text, definitions and imports of ``content``. One row stays one row."""
    known = grammar or code.GRAMMAR
    told = files.withColumn("language", known.language_of(path)).withColumn("family", known.family_of(path))
    return (
        with_blanked(told, grammar)
        .withColumn("definitions", code.definitions("blanked", "family", grammar))
        .withColumn("imports", code.imports("commentless", "blanked", "family", grammar))
    )


def facts_by_content(source_files: DataFrame) -> DataFrame:
    """(repo, sha, path, language, definitions, imports) of every file, each distinct text parsed once and its facts joined back by its hash."""
    found = snapshot.by_content(source_files.select(*REVIEW, "path", "content"))
    # a name with the suffix of the language stands for all places of a text
    named = found.texts.withColumn("path", F.concat(F.lit("file"), paths.suffix_of("language")))
    facts = with_source_facts(named).select("content_id", "language", "definitions", "imports")
    return found.places.join(shuffled(facts), "content_id").drop("content_id")


def is_skippable(definition: Column) -> Column:
    """Names that are too generic or too short to search for."""
    name, method = definition["name"], definition["kind"] == "method"
    constructor = name.isin("__init__", "constructor")
    dunder = name.startswith("__") & name.endswith("__")
    generic = F.lower(name).isin(*rules.GENERIC_METHODS)
    return F.when(method, ~constructor & (dunder | generic)).otherwise(F.length(name) < 3)


def search_name(definition: Column, language: Column) -> Column:
    """Callers of a constructor name its class."""
    same = (language == "java") & (definition["name"] == definition["container"])
    constructor = (definition["kind"] == "method") & (definition["container"] != "") & (
        definition["name"].isin("__init__", "constructor") | F.coalesce(same, F.lit(False))
    )
    return F.when(constructor, definition["container"]).otherwise(definition["name"])


def _between(low: Column, high: Column):
    return lambda n: (low <= n) & (n <= high)


def header_touched(definition: Column, added: Column, gaps: Column) -> Column:
    low, high = definition["start_line"], definition["signature_end_line"]
    return F.exists(added, _between(low, high)) | F.exists(gaps, lambda g: (low <= g["gap_lo"]) & (g["gap_hi"] <= high))


@built_once
def changed_definitions(definitions: str, added: str, gaps: str, removed_names: str, status: str, language: str) -> Column:
    """array<symbol> of the definitions a patch touches, decided inside the row of the file."""
    added, gaps, removed_names = F.col(added), F.col(gaps), F.col(removed_names)
    touched = diffs.touched_lines(added, gaps)

    def brand_new(d: Column) -> Column:
        whole = d["end_line"] - d["start_line"] + 1
        inside = F.size(F.filter(added, _between(d["start_line"], d["end_line"])))
        return ~F.array_contains(removed_names, d["name"]) & (inside == whole)

    def is_changed(d: Column) -> Column:
        type_like = d["kind"].isin("class", "interface", "enum")
        body = F.exists(touched, _between(d["start_line"], d["end_line"]))
        return (
            ~is_skippable(d) & (as_column(status) != "added") & ~brand_new(d)
            & F.when(type_like, header_touched(d, added, gaps)).otherwise(body)
        )

    return F.transform(
        F.filter(as_column(definitions), is_changed),
        lambda d: F.struct(
            d["name"].alias("name"), d["kind"].alias("kind"), d["start_line"].alias("start_line"), d["end_line"].alias("end_line"),
            F.when(header_touched(d, added, gaps), "signature").otherwise("body").alias("change"),
            search_name(d, as_column(language)).alias("search_name"), d["container"].alias("container"),
        ),
    )


def file_symbols(changed_files: DataFrame, source_files: DataFrame) -> DataFrame:
    """One row per changed source file: its touched ``symbols``, the ``removed`` and the ``added`` definition names."""
    usable = changed_files.filter(
        (F.coalesce("patch", F.lit("")) != "") & ~paths.is_sensitive_path("filename") & paths.language_of("filename").isNotNull()
    ).select(*FILE, "status", "patch")
    # texts of changed files only; their definitions are found where the text is read, so no text is shuffled for this
    keys = broadcast_if_small(usable.select(*FILE), 200_000)
    named = source_files.select(*REVIEW, F.col("path").alias("filename"), "content").join(keys, list(FILE), "left_semi")
    told = with_blanked(named.withColumn("family", paths.family(paths.language_of("filename"))))
    head = told.select(*FILE, code.definitions("blanked", "family").alias("definitions"))
    facts = (
        usable.join(shuffled(head), list(FILE), "left")
        .withColumn("definitions", F.coalesce("definitions", F.array().cast(f"array<{code.DEFINITION}>")))
        .withColumn("language", paths.language_of("filename"))
        .withColumn("family", paths.family("language"))
        .withColumn("rows", diffs.patch_rows("patch"))
        .withColumn("added_lines", F.array_distinct(diffs.added_lines("rows")))
        .withColumn("gaps", diffs.deletion_gaps("rows"))
        .withColumn("removed_texts", diffs.removed_texts("patch"))
        .withColumn("added_texts", diffs.added_texts("patch"))
        .withColumn("removed_names", diffs.defined_names("removed_texts", "family"))
        .withColumn("added_names", diffs.defined_names("added_texts", "family"))
    )
    symbols = changed_definitions(
        "definitions", "added_lines", "gaps", "removed_names", "status", "language"
    )
    present = F.transform("definitions", lambda d: d["name"])
    return facts.select(
        *FILE, symbols.alias("symbols"), F.array_except("removed_names", present).alias("removed"), "added_names"
    )


def touched_symbols(per_file: DataFrame) -> DataFrame:
    return per_file.select(*FILE, F.inline("symbols"))


def removed_symbols(per_file: DataFrame, per_file_cap: int | None = None) -> DataFrame:
    """Names of three letters or more that no file of the change defines any more: all, or the first of a file by name."""
    added = per_file.select(*REVIEW, F.explode("added_names").alias("name")).distinct()
    gone = per_file.select(*FILE, F.explode("removed").alias("name")).filter(F.length("name") >= 3).distinct()
    gone = gone.join(shuffled(added), [*REVIEW, "name"], "left_anti")
    kept = gone if per_file_cap is None else first_per_group(gone, FILE, [F.col("name")], per_file_cap)
    return kept.select(
        *FILE, "name", F.lit("function").alias("kind"), F.lit(0).alias("start_line"), F.lit(0).alias("end_line"),
        F.lit("removed").alias("change"), F.col("name").alias("search_name"), F.lit("").alias("container"),
    )


def change_rank(column: str = "change") -> Column:
    rank = F.lit(None).cast("int")
    for name, value in rules.CHANGE_ORDER.items():
        rank = F.when(F.col(column) == name, value).otherwise(rank)
    return rank


def top_symbols(symbols: DataFrame, k: int | None = None) -> DataFrame:
    """Symbols of every file ranked by (signature, removed, body), start line: all, or the first ``k``; ``rank`` is kept."""
    order = [change_rank(), F.col("start_line"), F.col("end_line"), F.col("name")]
    if k is not None:
        return first_per_group(symbols, FILE, order, k, "rank")
    return symbols.withColumn("rank", F.row_number().over(Window.partitionBy(*FILE).orderBy(*order)))


def searched_names(symbols: DataFrame, k: int | None = None) -> DataFrame:
    """The names of every review: all, or the first ``k`` in alphabetical order."""
    names = symbols.select(*REVIEW, F.col("search_name").alias("name")).filter(F.col("name").rlike(rules.IDENTIFIER)).distinct()
    return names if k is None else first_per_group(names, REVIEW, [F.col("name")], k)


@built_once
def located_hits(references: str, definitions: str) -> Column:
    """Uses with the definition around them."""

    def located(r: Column, i: Column) -> Column:
        return let(
            code.enclosing(definitions, r["line"]),
            lambda d: F.struct(
                r["name"].alias("name"), r["line"].alias("line"), r["kind"].alias("kind"), i.alias("order"),
                d["name"].alias("enclosing"), d["start_line"].alias("enclosing_start"), d["end_line"].alias("enclosing_end"),
            ),
        )

    return F.transform(references, located)


def mentions(source_files: DataFrame, names: DataFrame) -> DataFrame:
    """(repo, sha, path, names): the searched names that a file holds as words.

    Every file gives its distinct words, which meet the names in a hash join on (repo, sha, word): the work is words plus names, not their product. Rows are
    narrow; the names are broadcast while there are few, so that the words stay where the text was read.
    """
    wanted = broadcast_if_small(names.select(*REVIEW, "name"), 200_000)
    words = source_files.select(*REVIEW, "path", F.explode(code.identifiers("content")).alias("name"))
    return words.join(wanted, [*REVIEW, "name"]).groupBy(*REVIEW, "path").agg(F.sort_array(F.collect_list("name")).alias("names"))


def scan(
    source_files: DataFrame, names: DataFrame, max_scan: int | None = None, max_parse: int | None = None, grammar: code.Grammar | None = None
) -> DataFrame:
    """Files that mention a searched name, with what the scan learned about them.

    All files of a review count. With ``max_scan`` only its first files by path are looked at, with ``max_parse`` only the first with a mention are
    kept; ``incomplete`` then marks a cut scan. Only files with a mention are parsed; their text is dropped in the same stage: names, uses,
    definitions and imports go on.
    """
    sources = source_files.filter((grammar or code.GRAMMAR).language_of("path").isNotNull())
    found = mentions(sources, names)
    if max_scan is not None or max_parse is not None:
        looked = sources.select(*REVIEW, "path")
        looked = looked if max_scan is None else first_per_group(looked, REVIEW, [F.col("path")], max_scan)
        extent = looked.groupBy(*REVIEW).agg(F.max("path").alias("last_path"))
        found = found.join(shuffled(extent), list(REVIEW)).filter(F.col("path") <= F.col("last_path"))
    else:
        found = found.withColumn("last_path", F.lit(None).cast("string"))
    # a row per file with a mention: broadcast while their names are few, so that no text is shuffled
    wanted = broadcast_if_small(materialize(found), 500_000, F.size("names") + 1)
    mentioning = sources.join(wanted, [*REVIEW, "path"])
    facts = with_source_facts(mentioning, grammar=grammar).withColumn(
        "references", code.references("blanked", "names", "definitions", "imports", "family")
    )
    # "hits" needs all definitions of the file, so it is built before they are cut to the wanted names
    slim = facts.withColumn("hits", located_hits("references", "definitions")).select(
        *REVIEW, "path", "language", "last_path", "hits",
        F.filter("definitions", lambda d: F.array_contains("names", d["name"])).alias("definitions"),
        F.when(F.size("references") > 0, F.col("imports")).otherwise(F.array().cast(f"array<{code.IMPORT}>")).alias("imports"),
    )
    if max_parse is None:
        return slim.withColumn("incomplete", F.lit(False)).drop("last_path")
    kept = first_per_group(slim, REVIEW, [F.col("path")], max_parse, "parsed_rank")
    return kept.withColumn("incomplete", (F.col("parsed_rank") == max_parse) & (F.col("path") < F.col("last_path"))).drop("last_path", "parsed_rank")


def definers(scanned: DataFrame) -> DataFrame:
    """(repo, sha, name, path, start_line) of every definition with a searched name."""
    return scanned.select(*REVIEW, "path", F.explode("definitions").alias("d")).select(
        *REVIEW, F.col("d.name").alias("name"), "path", F.col("d.start_line").alias("start_line")
    )


def hits(scanned: DataFrame) -> DataFrame:
    return unnest(scanned, [*REVIEW, "path", "language"], "hits")
