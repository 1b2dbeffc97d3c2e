"""Languages and credential rules as tables, so that a row adds what code does not know.

A table of rules is small: it is read once, on the driver, to build the expressions every row runs through, and refused beyond :data:`MOST` rows. Order is a
column: patterns of one part are tried by ``place``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from changelens import rules
from changelens.functions.code import GRAMMAR, Family, Grammar

LANGUAGES = "suffix string, language string, family string, layout string"
PATTERNS = "family string, part string, place int, kind string, pattern string, in_type boolean"
SECRETS = "place int, kind string, pattern string"
PARTS = ("comment", "quoted", "plain", "header", "statement", "import")
MOST = 10_000


def _rows(table: DataFrame, *order: str) -> list:
    found = table.limit(MOST + 1).collect()
    if len(found) > MOST:
        raise ValueError(f"a table of more than {MOST} rules")
    return sorted(found, key=lambda row: [row[name] for name in order])


def builtin_languages(spark: SparkSession) -> DataFrame:
    """(suffix, language, family, layout) of the languages that are known; layouts are those of :class:`~changelens.functions.code.Family`."""
    return spark.createDataFrame([(ending, name, family, GRAMMAR.families[family].layout) for ending, (name, family) in GRAMMAR.languages.items()], LANGUAGES)


def builtin_patterns(spark: SparkSession) -> DataFrame:
    """(family, part, place, kind, pattern, in_type): comments, quoted strings, runs of plain text, headers and statements of definitions."""
    rows = []
    for name, how in GRAMMAR.families.items():
        plain = {"comment": how.comments, "quoted": how.quoted, "plain": (how.plain,), "import": how.imports}
        rows += [(name, part, place, None, pattern, False) for part, patterns in plain.items() for place, pattern in enumerate(patterns)]
        typed = {"header": how.headers, "statement": how.statements}
        rows += [(name, part, place, *told) for part, patterns in typed.items() for place, told in enumerate(patterns)]
    return spark.createDataFrame(rows, PATTERNS)


def grammar_of(languages: DataFrame, patterns: DataFrame) -> Grammar:
    """The grammar of two tables: the built-in rows with own ones beside them, or own ones alone.

    Patterns are Java's. A header or statement ends where its block or statement does (``\\z``), its first group is the text that counts as the header, its second
    the name, and ``in_type`` asks for a class around it. The first group of an import is what is imported.
    """
    told = _rows(languages, "family", "suffix")
    asked = _rows(patterns, "family", "part", "place")
    if wrong := {row["part"] for row in asked} - set(PARTS):
        raise ValueError(f"no such part: {sorted(wrong)}")
    of = lambda family, part: [row for row in asked if row["family"] == family and row["part"] == part]
    families = {}
    for row in told:
        name = row["family"]
        texts = {part: tuple(r["pattern"] for r in of(name, part)) for part in ("comment", "quoted", "plain", "import")}
        typed = {part: tuple((r["kind"], r["pattern"], bool(r["in_type"])) for r in of(name, part)) for part in ("header", "statement")}
        plain = {"plain": texts["plain"][0]} if texts["plain"] else {}
        families[name] = Family(row["layout"], texts["comment"] or (r"(?!)",), texts["quoted"] or (r"(?!)",), headers=typed["header"], statements=typed["statement"], imports=texts["import"], **plain)
    return Grammar({row["suffix"]: (row["language"], row["family"]) for row in told}, families)


def builtin_secrets(spark: SparkSession) -> DataFrame:
    """(place, kind, pattern) of the credential rules that are known."""
    return spark.createDataFrame([(place, *rule) for place, rule in enumerate(rules.SECRET_RULES)], SECRETS)


def secret_rules_of(table: DataFrame) -> tuple[tuple[str, str], ...]:
    """Credential rules by place, for ``Options(secret_rules=...)``: the first that matches a place takes it."""
    return tuple((row["kind"], row["pattern"]) for row in _rows(table, "place"))
