"""What is remembered and recalled, and how reviewers are scored."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changelens.functions import leaks
from changelens.functions import text as tx
from changelens.operators import evaluate as ev
from changelens.operators import memory as mem
from changelens.operators import state as st
from changelens.operators.grouping import first_per_group
from changelens.operators.store import KeyedTable
from changelens.options import DEFAULTS, Options


@dataclass(frozen=True)
class Learned:
    items: DataFrame
    state: DataFrame


def learn(
    documents: DataFrame, comments: DataFrame, reactions: DataFrame, logins: DataFrame, state: DataFrame, me: str, options: Options = DEFAULTS
) -> Learned:
    """Items to retain, from convention documents and trusted ratings only, and the state that remembers them.

    Nothing comes from diffs, messages or other people's comments.
    """
    changed = mem.changed_conventions(documents, state, options.secret_rules)
    conventions = changed.select(
        "repo", F.concat(F.lit("convention:"), "path").alias("document_id"), leaks.redact("content", options.secret_rules).alias("text"),
        "key", F.col("digest").alias("value"), F.lit("conventions").alias("namespace"),
    )
    feedback = mem.learn_feedback(comments, reactions, logins, state, me).withColumn("namespace", F.lit("feedback"))
    items = conventions.unionByName(feedback)
    stamped = items.select("namespace", "key", "value", F.current_timestamp().alias("ts"), F.lit(0).cast("bigint").alias("seq"))
    return Learned(items.select("repo", "document_id", "text"), st.put(state, stamped))


def recall(items: DataFrame, keys: list[str], options: Options = DEFAULTS) -> DataFrame:
    """(keys, memory, n_items): recalled lines within the budget as one text."""
    lines = mem.recall_budget(items, keys, options.recall_items, options.recall_max_tokens, options.secret_rules)
    return mem.memory_text(lines, keys)


def memory_table(spark: SparkSession, path: str, buckets: int = 16) -> KeyedTable:
    """The memory of all repositories: a bank per repository, a row per document."""
    return KeyedTable(spark, path, "type string, text string", buckets)


def retain(table: KeyedTable, items: DataFrame, keep: int | None = None) -> None:
    """Store items (repo, document_id, type, text, ts, seq); a newer one replaces what its document said. ``keep``: so many newest per bank stay."""
    table.put(items.select(tx.bank_id("repo").alias("namespace"), F.col("document_id").alias("key"), "ts", "seq", "type", "text"))
    if keep is not None:
        table.trim(keep)


def forget(table: KeyedTable, documents: DataFrame) -> None:
    """Take (repo, document_id) out of the memory."""
    table.remove(documents.select(tx.bank_id("repo").alias("namespace"), F.col("document_id").alias("key")))


def recall_stored(table: KeyedTable, reviews: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    """(repo, sha, memory, n_items): the newest documents of each review's bank that fit; only the banks that are asked are read."""
    asked = reviews.select("repo", "sha", tx.bank_id("repo").alias("namespace"))
    banks = asked.select("repo", "namespace").distinct()
    order = [F.col("ts").desc(), F.col("seq").desc(), F.col("key")]
    newest = first_per_group(table.read_of(banks), ["namespace"], order, options.recall_items, "pos")
    recalled = recall(newest.join(banks, "namespace"), ["repo"], options)
    return asked.join(recalled, "repo").select("repo", "sha", "memory", "n_items")


@dataclass(frozen=True)
class Evaluation:
    scores: DataFrame
    summary: DataFrame
    categories: DataFrame


def evaluate(cases: DataFrame, expectations: DataFrame, findings: DataFrame, *keys: str) -> Evaluation:
    scores = ev.score_cases(cases, expectations, findings)
    return Evaluation(scores, ev.summary(scores, *keys), ev.by_category(scores))
