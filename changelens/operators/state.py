"""Keyed state: latest value per key, retention, claims and rate limits, as tables of (namespace, key, value, ts)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changelens.operators.grouping import first_per_group

KEY = ("namespace", "key")


def latest(state: DataFrame) -> DataFrame:
    """Newest value per key; one pass with a map-side maximum, no sort."""
    return state.groupBy(*KEY).agg(F.max(F.struct("ts", "seq", "value")).alias("s")).select(
        *KEY, "s.value", F.col("s.ts").alias("ts"), F.col("s.seq").alias("seq")
    )


def put(state: DataFrame, new: DataFrame) -> DataFrame:
    return latest(state.unionByName(new))


def keep_newest(state: DataFrame, k: int) -> DataFrame:
    """The newest ``k`` keys of every namespace."""
    return first_per_group(state, ["namespace"], [F.col("ts").desc(), F.col("seq").desc(), F.col("key")], k)


def claim(targets: DataFrame, claimed: DataFrame) -> DataFrame:
    """The first delivery of every key that was not claimed before."""
    fields = [c for c in targets.columns if c != "key"]
    order = F.struct("received_ts", "event_id", "seq")
    first = targets.groupBy("key").agg(F.min_by(F.struct(*fields), order).alias("t")).select("key", "t.*")
    return first.join(claimed.select("key"), "key", "left_anti")


def open_claims(log: DataFrame) -> DataFrame:
    """Keys whose last entry is a claim; a release frees the key for a redelivery."""
    return latest(log).filter(F.col("value") == "claimed")


def rate_limited(checks: DataFrame, minutes: int = 30) -> DataFrame:
    """Completed checks (repo, second, event_id) that are at least ``minutes`` after the last allowed one of their repo.

    A greedy chain, so it is a fold over time. Time counts in whole seconds and only the first check of a second can be allowed; the others go before
    the shuffle. A repository's seconds pass through a task in order; what is held is the last allowed one.
    """
    seconds = checks.groupBy("repo", F.unix_seconds("ts").alias("second")).agg(F.min("event_id").alias("event_id"))
    ordered = seconds.repartition("repo").sortWithinPartitions("repo", "second")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, last = None, None
        for batch in batches:
            allowed = []
            for row, (repo, second) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if last is None or repo != known or second - last >= minutes * 60:
                    known, last = repo, second
                    allowed.append(row)
            yield batch.take(pa.array(allowed, pa.int64()))

    return ordered.mapInArrow(run, ordered.schema)
