"""Scoring of reviewers: expectations met, false positives, recall and precision."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from changelens import rules
from changelens.operators.findings import severity_rank

CASE = ("case", "run")


def _rank(column: str) -> Column:
    rank = F.lit(None).cast("int")
    for value, name in enumerate(rules.SEVERITIES):
        rank = F.when(F.col(column) == name, value).otherwise(rank)
    return rank


@lru_cache(maxsize=10_000)
def _compiled(pattern: str) -> re.Pattern | None:
    try:
        return re.compile(pattern, re.IGNORECASE)
    except re.error:
        return None


@F.pandas_udf(ArrayType(StringType()))
def _found(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for texts, patterns in batches:
        # a missing pattern, like a broken one, is found nowhere
        yield pd.Series([[p for p in asked if p is not None and (made := _compiled(p)) and made.search(text)] for text, asked in zip(texts, patterns)])


def matches(expectations: DataFrame, findings: DataFrame) -> DataFrame:
    """Pairs of expectation and finding: same case and file, severe enough, pattern found in the text.

    The distinct patterns of a (case, file) travel as one list to its findings, so a finding is read once for all of them and a task compiles each pattern once.
    Patterns are those of the standard library, without case; a broken one matches nothing.
    """
    text = F.concat_ws("\n", "title", "detail", F.coalesce("suggestion", F.lit("")))
    keyed = expectations.withColumnRenamed("file", "filename")
    asked = keyed.groupBy("case", "filename").agg(F.collect_set("pattern").alias("_patterns"))
    read = findings.join(asked, ["case", "filename"]).withColumn("_hits", _found(text, "_patterns")).drop("_patterns")
    pairs = read.filter(F.size("_hits") > 0).join(keyed, ["case", "filename"])
    return pairs.filter(F.array_contains("_hits", F.col("pattern")) & (severity_rank() <= _rank("min_severity"))).drop("_hits")


def score_cases(cases: DataFrame, expectations: DataFrame, findings: DataFrame) -> DataFrame:
    """Per case and run: expected, matched, false positives (critical or major findings that match nothing)."""
    hits = matches(expectations, findings)
    met = hits.select(*CASE, "expectation").distinct().groupBy(*CASE).agg(F.count(F.lit(1)).alias("matched"))
    used = hits.select(*CASE, "filename", "seq").distinct()
    wrong = findings.filter(severity_rank() <= 1).join(used, [*CASE, "filename", "seq"], "left_anti").groupBy(*CASE).agg(
        F.count(F.lit(1)).alias("false_positives")
    )
    expected = expectations.groupBy("case").agg(F.count(F.lit(1)).alias("expected"))
    return (
        cases.join(expected, "case", "left").join(met, list(CASE), "left").join(wrong, list(CASE), "left")
        .na.fill(0, ["expected", "matched", "false_positives"])
    )


def _ratios(df: DataFrame) -> DataFrame:
    reported = F.col("matched") + F.col("false_positives")
    return df.withColumn(
        "recall", F.when(F.col("expected") > 0, F.col("matched") / F.col("expected")).otherwise(1.0)
    ).withColumn("precision", F.when(reported > 0, F.col("matched") / reported).otherwise(1.0))


def summary(scores: DataFrame, *keys: str) -> DataFrame:
    sums = [F.sum(c).alias(c) for c in ("expected", "matched", "false_positives")]
    return _ratios(scores.groupBy(*keys).agg(*sums))


def by_category(scores: DataFrame) -> DataFrame:
    """One row per category and one for all of them, in one pass."""
    sums = [F.sum(c).alias(c) for c in ("expected", "matched", "false_positives")]
    rolled = scores.rollup("category").agg(*sums, F.grouping("category").alias("_all"))
    return rolled.withColumn("category", F.when(F.col("_all") == 1, "TOTAL").otherwise(F.col("category"))).drop("_all")


def compare_configs(scores: DataFrame, configs: list[str]) -> DataFrame:
    """Matched expectations of every case, one column per configuration."""
    return scores.groupBy("case").pivot("config", configs).agg(F.sum("matched")).na.fill(0)
