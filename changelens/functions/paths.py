"""Path predicates, path words, risk score and module names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from changelens import rules
from changelens.functions.text import as_column, built_once, ColumnLike, let


def posix(path: ColumnLike) -> Column:
    return F.translate(as_column(path), "\\", "/")


def basename(path: ColumnLike) -> Column:
    return F.substring_index(posix(path), "/", -1)


def dirname(path: ColumnLike) -> Column:
    return F.regexp_extract(posix(path), "^(.*)/[^/]*$", 1)


def suffix(path: ColumnLike) -> Column:
    """Last extension with its dot, lower case; a leading dot is part of the name."""
    return F.lower(F.regexp_extract(basename(path), r"^\.*[^.].*?(\.[^.]+)$", 1))


def parent_parts(path: ColumnLike) -> Column:
    return let(F.split(posix(path), "/"), lambda parts: F.slice(parts, F.lit(1), F.size(parts) - 1))


def _any_of(values: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(value) for value in values])


@built_once
def language_of(path: ColumnLike) -> Column:
    """Language by suffix; null for anything that is not source code."""
    table = F.create_map(*[F.lit(item) for pair in rules.LANGUAGE_BY_SUFFIX.items() for item in pair])
    return F.try_element_at(table, suffix(path))


@built_once
def suffix_of(language: ColumnLike) -> Column:
    """A suffix by which :func:`language_of` tells the language."""
    by_language = {name: ending for ending, name in rules.LANGUAGE_BY_SUFFIX.items()}
    return F.try_element_at(F.create_map(*[F.lit(item) for pair in by_language.items() for item in pair]), as_column(language))


@built_once
def family(language: ColumnLike) -> Column:
    language = as_column(language)
    return F.when(language.isin(*rules.JS_LANGUAGES), "js").otherwise(language)


@built_once
def should_review(path: ColumnLike) -> Column:
    """False for generated, vendored, binary and lock files."""
    name = F.lower(basename(path))
    return ~(
        name.isin(*rules.SKIP_NAMES)
        | name.rlike(r"\.min\.(js|css)$")
        | suffix(path).isin(*rules.SKIP_SUFFIXES)
        | F.arrays_overlap(parent_parts(path), _any_of(rules.SKIP_DIRS))
    )


@built_once
def is_sensitive_path(path: ColumnLike) -> Column:
    """Files that hold credentials, except samples and templates of them."""
    name = F.lower(basename(path))
    sample = name.rlike("(" + "|".join(rules.SAMPLE_SUFFIXES).replace(".", r"\.") + ")$")
    ending = name.rlike("(" + "|".join(rules.SENSITIVE_SUFFIXES).replace(".", r"\.") + ")$")
    return (name.isin(*rules.SENSITIVE_NAMES) | name.startswith(".env.") | ending) & ~sample


@built_once
def is_test_path(path: ColumnLike) -> Column:
    """A folder or file of a test name, or a file whose name says so before its suffix."""
    parts = F.split(F.lower(posix(path)), "/")
    name = F.element_at(parts, -1)
    stem = F.when(F.element_at(F.split(name, r"\."), -1).rlike("^[a-z0-9]+$"), F.regexp_replace(name, r"\.[^.]*$", ""))
    named = F.exists(_any_of(rules.TEST_ENDINGS), lambda ending: F.endswith(stem, ending)) & F.contains(name, F.lit("."))
    starts = F.startswith(name, F.lit(rules.TEST_START)) & (F.length(name) > len(rules.TEST_START))
    return F.arrays_overlap(parts, _any_of(rules.TEST_PARTS)) | starts | F.coalesce(named, F.lit(False))


def valid_repo(repo: ColumnLike) -> Column:
    repo = as_column(repo)
    return repo.rlike(rules.REPO_PATTERN) & ~F.exists(F.split(repo, "/"), lambda part: part.rlike(r"^\.+$"))


def valid_sha(sha: ColumnLike) -> Column:
    return as_column(sha).rlike(rules.SHA_PATTERN)


def valid_path(path: ColumnLike) -> Column:
    path = as_column(path)
    return path.rlike(rules.REPO_PATH_PATTERN) & ~F.array_contains(F.split(path, "/"), "..") & ~path.startswith("/")


def repo_allowed(repo: ColumnLike, allowed: tuple[str, ...] = ()) -> Column:
    if not allowed:
        return F.lit(True)
    return F.lower(as_column(repo)).isin(*[name.lower() for name in allowed])


#: Between a small letter or digit and a capital, before the last capital of a run, and between a capital and a digit.
CAMEL_BORDER = "(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|(?<=[A-Z])(?=[0-9])"


def path_tokens(path: ColumnLike) -> Column:
    """Distinct lower-case words of a path, split at separators and at camel-case borders."""
    words = F.split(as_column(path), CAMEL_BORDER + "|[^A-Za-z0-9]+")
    return F.array_distinct(F.transform(F.filter(words, lambda word: word != ""), F.lower))


@built_once
def risk_hits(path: ColumnLike) -> Column:
    """Number of risk terms that a path word equals, or starts with when the term has four letters or more."""

    def count(words: Column) -> Column:
        def hit(term: Column) -> Column:
            prefix = (F.length(term) >= 4) & F.exists(words, lambda word: word.startswith(term))
            return F.array_contains(words, term) | prefix

        return F.size(F.filter(_any_of(rules.RISK_TERMS), hit))

    return let(path_tokens(posix(path)), count)


@built_once
def risk_score(path: ColumnLike, additions: ColumnLike, deletions: ColumnLike) -> Column:
    """Higher means review first. Rounded so that sorting does not hang on the last bits of a double."""
    whole = F.lower(posix(path))
    zero = F.lit(0.0)
    config = F.lower(basename(path)).isin(*rules.CONFIG_NAMES) | whole.startswith(".github/workflows/")
    size = (as_column(additions) + as_column(deletions) * 0.5) / 60
    return F.round(
        F.when(suffix(path).isin(*rules.CODE_SUFFIXES), 3.0).otherwise(zero)
        + F.when(config, 3.5).otherwise(zero)
        - F.when(suffix(path).isin(*rules.DOC_SUFFIXES), 2.5).otherwise(zero)
        - F.when(is_test_path(path), 1.5).otherwise(zero)
        + F.least(F.lit(4.0), risk_hits(path).cast("double"))
        + F.least(F.lit(3.0), size.cast("double")),
        6,
    )


# ----------------------------------------------------------------------------- module names ---
def normalize_module_path(path: ColumnLike) -> Column:
    return F.regexp_replace(posix(path), r"^\./", "")


def _suffixes(parts: Column, separator: str) -> Column:
    """Every tail of an array of parts, joined."""
    return F.when(F.size(parts) == 0, F.array().cast("array<string>")).otherwise(
        F.transform(
            F.sequence(F.lit(1), F.size(parts)),
            lambda i: F.array_join(F.slice(parts, i, F.size(parts)), separator),
        )
    )


def without_suffix(path: ColumnLike) -> Column:
    return F.regexp_replace(as_column(path), r"(?<=[^/.])\.[^./]+$", "")


@built_once
def python_modules(path: ColumnLike) -> Column:
    """Dotted names a Python file can be imported by, for every possible source root."""
    parts = F.split(without_suffix(normalize_module_path(path)), "/")
    return let(
        let(parts, lambda p: F.when(F.element_at(p, -1) == "__init__", F.slice(p, F.lit(1), F.size(p) - 1)).otherwise(p)),
        lambda p: _suffixes(p, "."),
    )


@built_once
def js_stem(path: ColumnLike) -> Column:
    endings = "|".join(rules.JS_SUFFIXES).replace(".", r"\.")
    return F.regexp_replace(F.regexp_replace(normalize_module_path(path), f"({endings})$", ""), "/index$", "")


def path_suffixes(path: ColumnLike) -> Column:
    return let(F.split(as_column(path), "/"), lambda parts: _suffixes(parts, "/"))


def dotted_suffixes(path: ColumnLike) -> Column:
    return let(F.split(as_column(path), "/"), lambda parts: _suffixes(parts, "."))


def fold_path(path: ColumnLike) -> Column:
    """Resolve ``.`` and ``..`` parts of a relative path."""

    def step(done: Column, part: Column) -> Column:
        up = (part == "..") & (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1)) != "..")
        return (
            F.when(part.isin("", "."), done)
            .when(up, F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))))
            .otherwise(F.concat(done, F.array(part)))
        )

    parts = F.split(as_column(path), "/")
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def js_resolve(importer: ColumnLike, spec: ColumnLike) -> Column:
    """Stem an import points at: folded for relative specs, bare with a slash for aliases, else null."""
    spec = F.trim(as_column(spec))
    relative = js_stem(fold_path(F.concat_ws("/", dirname(normalize_module_path(importer)), spec)))
    bare = js_stem(F.regexp_replace(spec, "^[@~#]/", ""))
    return F.when(spec.startswith("."), relative).when(bare.contains("/"), bare)
