"""Credential scan and redaction. Only the kind of a hit leaves these functions, never its value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from changelens import rules
from changelens.functions.text import as_column, built_once, ColumnLike, let

Rules = tuple[tuple[str, str], ...]


def placeholder(kind: str) -> str:
    return f"[REDACTED:{kind}]"


@built_once
def redact(text: ColumnLike, secret_rules: Rules = rules.SECRET_RULES) -> Column:
    """Text with every hit replaced by a placeholder that names the kind."""
    text = as_column(text)
    for kind, pattern in secret_rules:
        text = F.regexp_replace(text, pattern, placeholder(kind))
    return text


def redaction_count(redacted: ColumnLike, original: ColumnLike) -> Column:
    """Number of places that were replaced: placeholders in the result that the original did not have."""
    mark = F.lit(r"\[REDACTED:[a-z_]+\]")
    return F.regexp_count(as_column(redacted), mark) - F.regexp_count(as_column(original), mark)


@built_once
def secret_kinds(text: ColumnLike, secret_rules: Rules = rules.SECRET_RULES) -> Column:
    """Kinds that occur in one line, in rule order; a place counts for the first rule that matches it."""
    original = as_column(text)

    def kinds(redacted: Column) -> Column:
        marks = [(kind, F.lit(r"\Q" + placeholder(kind) + r"\E")) for kind, _ in secret_rules]
        more = [F.when(F.regexp_count(redacted, mark) > F.regexp_count(original, mark), F.lit(kind)) for kind, mark in marks]
        return F.array_compact(F.array(*more))

    return let(redact(original, secret_rules), kinds)
