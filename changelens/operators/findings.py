"""Findings: parsing, validation, anchoring, dedupe, caps, decisions, verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changelens import rules
from changelens.functions import text as tx
from changelens.operators.grouping import REVIEW, first_per_group, ranked, unnest

FILE = (*REVIEW, "filename")
FINDING_FIELDS = ("severity", "category", "line", "title", "detail", "suggestion", "origin")


def severity_rank(column: str = "severity") -> Column:
    rank = F.lit(None).cast("int")
    for value, name in enumerate(rules.SEVERITIES):
        rank = F.when(F.col(column) == name, value).otherwise(rank)
    return rank


def valid_findings(raw: DataFrame) -> DataFrame:
    """Normalise severity and category; drop rows that break an enum, a length or the line bound (never cut them)."""
    cleaned = raw.withColumn("severity", F.lower(tx.strip("severity"))).withColumn("category", F.lower(tx.strip("category")))
    return cleaned.filter(
        F.col("severity").isin(*rules.SEVERITIES)
        & F.col("category").isin(*rules.CATEGORIES)
        & (F.col("line").isNull() | (F.col("line") >= 1))
        & F.length("title").between(1, 200)
        & F.length("detail").between(1, 2000)
        & (F.coalesce(F.length("suggestion"), F.lit(0)) <= 2000)
    )


_ITEM = "severity string, category string, line string, title string, detail string, suggestion string"
# Model output may carry any type. An item is read when its four text fields are text and its suggestion is text or
# null; ``shape`` is the type of the whole item as one string, like "OBJECT<category: STRING, line: BIGINT, ...>".
_TEXT_FIELDS = ("severity", "category", "title", "detail")


def _raw_items(content: str, max_items: int | None) -> Column:
    """array<struct> of the first raw items of a response: parsed once per response and once per item."""

    def item(text: Column) -> Column:
        fields = F.from_json(text, _ITEM)
        shape = F.schema_of_variant(F.try_parse_json(text))
        return tx.let(
            fields, lambda f: F.struct(*[f[name].alias(name) for name in ("severity", "category", "line", "title", "detail", "suggestion")], shape.alias("shape"))
        )

    items = tx.let(tx.json_object_text(content), lambda body: F.from_json(body, "findings array<string>")["findings"])
    return F.transform(items if max_items is None else F.slice(items, 1, max_items), item)


def parse_responses(responses: DataFrame, max_items: int | None = 8) -> DataFrame:
    """Findings of model responses: the first ``max_items`` raw items of every response, or all, each validated on its own.

    ``seq`` is the position in the response; ``origin`` is always ``model``.
    """
    keys = [c for c in responses.columns if c != "content"]
    raw = unnest(responses, keys, _raw_items("content", max_items), "seq")
    number = F.col("line").try_cast("int")
    right = (F.col("line").isNull() | number.isNotNull()) & ~F.col("shape").rlike(r"\bsuggestion: (?!STRING|VOID)")
    for name in _TEXT_FIELDS:
        right = right & F.col("shape").rlike(rf"\b{name}: STRING")
    return valid_findings(
        raw.filter(right).withColumn("line", number).drop("shape").withColumn("origin", F.lit("model"))
    )


def parse_errors(responses: DataFrame) -> DataFrame:
    """Requests that failed or did not return a JSON object."""
    reason = F.when(F.col("error_type").isNotNull(), F.concat(F.lit("request_failed:"), F.col("error_type"))).when(
        tx.json_object_text("content").isNull(), "invalid_json"
    )
    return responses.withColumn("error", reason).filter(F.col("error").isNotNull()).drop("content", "error_type")


def anchor(findings: DataFrame, added: DataFrame) -> DataFrame:
    """A line that is not an added line of the file becomes null; the finding stays."""
    valid = added.select(*FILE, F.col("new_line").alias("line"), F.lit(True).alias("_valid")).distinct()
    return findings.join(valid, [*FILE, "line"], "left").withColumn("line", F.when(F.col("_valid"), F.col("line"))).drop("_valid")


def anchor_in(findings: DataFrame, files: DataFrame) -> DataFrame:
    """Like :func:`anchor`, from a row per file with the array of its ``added`` lines: findings are few, added lines are not spread into rows for them."""
    lines = files.groupBy(*FILE).agg(F.array_distinct(F.flatten(F.collect_list("added"))).alias("_added"))  # repeated rows of a file are one
    valid = F.array_contains("_added", F.col("line"))
    return findings.join(lines, list(FILE), "left").withColumn("line", F.when(valid, F.col("line"))).drop("_added")


def dedupe(findings: DataFrame, cap: int | None = 12) -> DataFrame:
    """One finding per (line, title) of a file, the first in order (rule findings come first); of these all or the first ``cap``."""
    order = F.struct((F.col("origin") != "rule").alias("model"), F.col("seq"), F.col("title"), F.col("severity"))
    key = F.lower(tx.strip("title"))
    fields = F.struct("seq", *FINDING_FIELDS)
    first = findings.withColumn("_title", key).groupBy(*FILE, "line", "_title").agg(F.min_by(fields, order).alias("f"))
    rows = first.select(*FILE, "f.*")
    order = [F.col("origin") != "rule", F.col("seq"), F.col("title")]
    return ranked(rows, FILE, order) if cap is None else first_per_group(rows, FILE, order, cap, "rank")


def verifiable(findings: DataFrame) -> DataFrame:
    return findings.filter((F.col("origin") == "model") & F.col("severity").isin("critical", "major"))


def top_verify(findings: DataFrame, k: int = 10) -> DataFrame:
    order = [severity_rank(), F.col("filename"), F.coalesce("line", F.lit(0)), F.col("seq")]
    return first_per_group(verifiable(findings), REVIEW, order, k, "rank")


def apply_decisions(findings: DataFrame, decisions: DataFrame) -> DataFrame:
    """Refuted findings go, uncertain ones drop one level; anything else keeps the finding as it is."""
    known = decisions.filter(F.col("verdict").isin(*rules.DECISIONS)).select(*FILE, "seq", "verdict")
    lower = F.when(F.col("severity") == "critical", "major").when(F.col("severity") == "major", "minor").otherwise(F.col("severity"))
    checked = F.col("origin") == "model"
    return (
        findings.join(known, [*FILE, "seq"], "left")
        .filter(~(checked & F.coalesce(F.col("verdict") == "refuted", F.lit(False)) & F.col("severity").isin("critical", "major")))
        .withColumn("severity", F.when(checked & (F.col("verdict") == "uncertain") & F.col("severity").isin("critical", "major"), lower).otherwise(F.col("severity")))
        .drop("verdict")
    )


def verify_log(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    known = decisions.filter(F.col("verdict").isin(*rules.DECISIONS)).select(*FILE, "seq", "verdict", F.substring("reason", 1, 300).alias("reason"))
    return candidates.join(known, [*FILE, "seq"], "left").select(
        *FILE, "seq", "title", "severity", F.coalesce("verdict", F.lit("unverified")).alias("verdict"),
        F.coalesce("reason", F.lit("no usable decision")).alias("reason"),
    )


def verify_stats(log: DataFrame) -> DataFrame:
    return log.groupBy(*REVIEW).agg(
        F.count_if(F.col("verdict") == "refuted").alias("dropped"),
        F.count_if(F.col("verdict") == "uncertain").alias("downgraded"),
        F.count_if(F.col("verdict") == "unverified").alias("failed"),
    )


def verdict(targets: DataFrame, findings: DataFrame) -> DataFrame:
    """request_changes on a critical or major finding, comment on any other, approve without findings."""
    worst = findings.groupBy(*REVIEW).agg(F.min(severity_rank()).alias("worst"), F.count(F.lit(1)).alias("n_findings"))
    return targets.join(worst, list(REVIEW), "left").select(
        *targets.columns,
        F.when(F.col("worst") <= 1, "request_changes").when(F.col("worst").isNotNull(), "comment").otherwise("approve").alias("verdict"),
        F.coalesce("n_findings", F.lit(0)).cast("bigint").alias("n_findings"),
    )


def severity_counts(findings: DataFrame) -> DataFrame:
    """Per review one column per severity; the values are fixed, so the pivot needs no pass to find them."""
    counts = findings.groupBy(*REVIEW).pivot("severity", list(rules.SEVERITIES)).agg(F.count(F.lit(1)))
    return counts.na.fill(0)


def counts_line(counts: DataFrame) -> DataFrame:
    shown = F.concat_ws(
        " · ", *[F.when(F.col(s) > 0, F.concat(F.lit(s + " "), F.col(s).cast("string"))) for s in rules.SEVERITIES]
    )
    return counts.select(*REVIEW, shown.alias("counts"))


def report_order() -> list[Column]:
    return [severity_rank(), F.col("filename"), F.coalesce("line", F.lit(0)), F.col("seq")]


def collect_sorted(findings: DataFrame) -> DataFrame:
    """All findings in report order: a range-partitioned sort, so one huge review is sorted by many tasks."""
    return findings.orderBy(*REVIEW, *report_order())


def summary_payload(findings: DataFrame, k: int = 40) -> DataFrame:
    """The first ``k`` findings of a review in report order, one line each."""
    line = F.format_string(
        "- [%s/%s] %s:%s %s", "severity", "category", "filename", F.coalesce(F.col("line").cast("string"), F.lit("-")), "title"
    )
    return first_per_group(findings, REVIEW, report_order(), k, "rank").select(*REVIEW, "rank", line.alias("text"))


def review_complete(responses: DataFrame, rule_findings: DataFrame) -> DataFrame:
    """Files that count as reviewed: some chunk succeeded, or a rule finding exists."""
    bad = F.col("error_type").isNotNull() | tx.json_object_text("content").isNull()
    files = responses.groupBy(*FILE).agg(F.count(F.lit(1)).alias("chunks"), F.count_if(bad).alias("errors"))
    ruled = rule_findings.select(*FILE).distinct().withColumn("_ruled", F.lit(True))
    return files.join(ruled, list(FILE), "left").withColumn(
        "reviewed", (F.col("errors") < F.col("chunks")) | F.coalesce("_ruled", F.lit(False))
    ).drop("_ruled")


def publishable(files: DataFrame) -> DataFrame:
    """Reviews in which something was reviewed, or nothing failed."""
    return files.groupBy(*REVIEW).agg(
        F.count_if("reviewed").alias("reviewed"), F.sum("errors").alias("errors")
    ).withColumn("publish", (F.col("reviewed") > 0) | (F.col("errors") == 0))
