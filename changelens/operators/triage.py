"""Which files of a change are reviewed: ordered triage, risk order and budgeted selection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changelens import rules
from changelens.functions import diffs, leaks, paths
from changelens.operators.grouping import REVIEW, first_per_group, unnest

FILE = (*REVIEW, "filename")


def triage(files: DataFrame) -> DataFrame:
    """Adds ``reason``: why a file is left out, null for a candidate. The first rule that applies wins."""
    reason = (
        F.when(F.col("status") == "removed", "removed")
        .when(paths.is_sensitive_path("filename"), "sensitive")
        .when(~paths.should_review("filename"), "generated")
        .when(F.coalesce(F.col("patch"), F.lit("")) == "", "no_patch")
    )
    return files.withColumn("reason", reason)


def select_files(candidates: DataFrame, max_files: int, max_total_chars: int, max_file_chars: int) -> DataFrame:
    """Adds score, cost, ``selected`` and ``reason`` (over_file_cap, over_char_budget).

    Greedy in order of (-score, filename): a file that does not fit is skipped and the next one is tried, so a running
    sum cannot express it. What is folded is small and exact however large a review is: of all files with the same cost
    only the first ``max_files`` can ever be taken, because once one of them is skipped the later ones do not fit
    either. The window cut runs before the shuffle, the fold sees at most ``max_files`` rows per distinct cost.
    """
    order = F.struct((-F.col("score")).alias("rank"), F.col("filename").alias("filename"))
    scored = candidates.withColumn("score", paths.risk_score("filename", "additions", "deletions")).withColumn(
        "cost", F.least(F.length("patch"), F.lit(max_file_chars))
    )
    pool = first_per_group(
        scored.select(*FILE, "score", "cost"), [*REVIEW, "cost"], [F.col("score").desc(), F.col("filename")], max_files
    )
    queue = pool.groupBy(*REVIEW).agg(
        F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("rank"), "filename", "cost"))).alias("queue")
    )
    start = F.struct(
        F.lit(0).alias("used"),
        F.array().cast("array<struct<rank:double,filename:string>>").alias("taken"),
    )

    def step(acc, file):
        fits = (F.size(acc["taken"]) < max_files) & (
            (acc["used"] + file["cost"] <= max_total_chars) | (F.size(acc["taken"]) == 0)
        )
        taken = F.array(F.struct(file["rank"].alias("rank"), file["filename"].alias("filename")))
        return F.struct(
            F.when(fits, acc["used"] + file["cost"]).otherwise(acc["used"]).alias("used"),
            F.when(fits, F.concat(acc["taken"], taken)).otherwise(acc["taken"]).alias("taken"),
        )

    plan = queue.select(*REVIEW, F.aggregate("queue", start, step, lambda acc: acc["taken"]).alias("taken"))
    last = F.element_at("taken", -1)
    full = (F.size("taken") >= max_files) & (order > last)
    # decided on narrow rows; the patches join last, by the whole key of a file
    decided = scored.select(*FILE, "score", "cost").join(plan, list(REVIEW), "left").withColumn("selected", F.array_contains(F.col("taken"), order))
    reason = F.when(~F.col("selected"), F.when(full, "over_file_cap").otherwise("over_char_budget"))
    decided = decided.select(*FILE, "score", "cost", "selected", reason.alias("reason")).distinct()
    return candidates.join(decided, list(FILE), "left")


def secret_hits(files: DataFrame, per_file: int | None = None, secret_rules: leaks.Rules = rules.SECRET_RULES) -> DataFrame:
    """(repo, sha, filename, line, kind) for credentials on added rows; distinct, of a file all or the first ``per_file``."""
    rows = F.filter(diffs.patch_rows("patch"), lambda r: r["op"] == "+")
    found = F.flatten(
        F.transform(
            rows,
            lambda r: F.transform(
                leaks.secret_kinds(r["text"], secret_rules), lambda kind: F.struct(r["new_line"].alias("line"), kind.alias("kind"))
            ),
        )
    )
    distinct = F.array_distinct(found)
    kept = distinct if per_file is None else F.slice(distinct, 1, per_file)
    return unnest(files, FILE, kept, "seq")


def secret_findings(hits: DataFrame) -> DataFrame:
    """A critical rule finding per hit; the title names the kind only."""
    return hits.select(
        *FILE, "seq",
        F.lit("critical").alias("severity"), F.lit("security").alias("category"), "line",
        F.concat(F.lit("Possible credential committed: "), F.col("kind")).alias("title"),
        F.lit("A line added here looks like a credential. Revoke it and move it out of the repository.").alias("detail"),
        F.lit(None).cast("string").alias("suggestion"), F.lit("rule").alias("origin"),
    )


def sensitive_file_findings(triaged: DataFrame) -> DataFrame:
    """A critical rule finding per credential file of a change; the content is never read."""
    return triaged.filter(F.col("reason") == "sensitive").select(
        *FILE, F.lit(0).alias("seq"),
        F.lit("critical").alias("severity"), F.lit("security").alias("category"), F.lit(None).cast("int").alias("line"),
        F.concat(F.lit("Sensitive file committed: "), paths.basename("filename")).alias("title"),
        F.lit("Files of this kind hold credentials. Remove it from the history and rotate what it holds.").alias("detail"),
        F.lit(None).cast("string").alias("suggestion"), F.lit("rule").alias("origin"),
    )
