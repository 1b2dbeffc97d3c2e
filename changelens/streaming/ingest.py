"""Structured Streaming over webhook deliveries.

Checks and target extraction are stateless. Claims are Spark's deduplication, without a bound or within a watermark; claims with releases and rate limits
keep a value per key in its state store.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from changelens.functions import text as tx
from changelens.operators.store import KeyedTable
from changelens.options import DEFAULTS, Options
from changelens.sources import events as ev

DELIVERY = "event_id bigint, event string, body binary, signature string, received_ts timestamp"
# A micro-batch's deliveries are compared in so many parts, and so many rows at a time at least.
_BUCKETS, _ROWS = 1024, 10_000


def read_deliveries(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    return spark.readStream.schema(DELIVERY).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def event_targets(deliveries: DataFrame, secret: str, options: Options = DEFAULTS) -> DataFrame:
    """Signed deliveries -> review targets with their key. The same function serves a batch and a stream."""
    signed = deliveries.filter(tx.verify_signature("body", "signature", secret)).drop("signature")
    parsed = ev.read_events(signed, options.max_body_bytes)
    return ev.with_key(ev.event_filter(parsed, options.review_events, options.allowed_repos, options.max_commits_per_push))


def claim_within(targets: DataFrame, delay: str = "1 hour") -> DataFrame:
    """First delivery of a key within the watermark: state is dropped once a key can no longer come back in time."""
    return targets.withWatermark("received_ts", delay).dropDuplicatesWithinWatermark(["key"])


def _earliest(deliveries: pa.Table) -> pa.Table:
    ordered = deliveries.sort_by([(c, "ascending") for c in ("received_ts", "event_id", "seq")])
    numbered = pa.table({"key": ordered["key"], "row": np.arange(ordered.num_rows)})
    return ordered.take(numbered.group_by("key", use_threads=False).aggregate([("row", "min")])["row_min"])


def _first_deliveries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The earliest delivery of every key of a bucket. Held are one of each key so far and as many, or ``_ROWS``, that wait for comparison."""
    held, rows, most = [], 0, _ROWS
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= most:
            held = _earliest(pa.Table.from_batches(held)).to_batches()
            rows = sum(b.num_rows for b in held)
            most = max(_ROWS, 2 * rows)
    yield from _earliest(pa.Table.from_batches(held)).to_batches()


class _Claims(StatefulProcessor):
    """A key is free or claimed. Releases that have arrived are applied first, then the first delivery claims a free key."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.claimed = handle.getValueState("claimed", "event_id bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        released, first = False, None
        for frame in rows:
            for release, at, event_id, seq, target in zip(frame["release"], frame["at"], frame["event_id"], frame["seq"], frame["target"]):
                if release:
                    released = True
                elif first is None or (at, event_id, seq) < first[:3]:
                    first = at, event_id, seq, target
        if released:
            self.claimed.clear()
        if first is not None and not self.claimed.exists():
            self.claimed.update((int(first[1]),))
            yield pd.DataFrame({"target": [first[3]]})

    def close(self) -> None:
        pass


class _Checks(StatefulProcessor):
    """The second of the last allowed check of a repository."""

    def __init__(self, seconds: int) -> None:
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "second bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        checks: dict[int, int] = {}
        for frame in rows:
            for second, event_id in zip(frame["second"].tolist(), frame["event_id"].tolist()):
                checks[second] = min(event_id, checks.get(second, event_id))
        last = self.last.get()[0] if self.last.exists() else None
        allowed = []
        for second in sorted(checks):
            if last is None or second - last >= self.seconds:
                last = second
                allowed.append((key[0], second, checks[second]))
        if allowed:
            self.last.update((last,))
            yield pd.DataFrame(allowed, columns=["repo", "second", "event_id"])

    def close(self) -> None:
        pass


def with_state_store(spark: SparkSession) -> None:
    """Keyed state of any kind needs Spark's store on RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def claims(targets: DataFrame, releases: DataFrame | None = None) -> DataFrame:
    """The deliveries that claim their key: the first one, and the first one after each release (key) of a failed review.

    State is the key, with releases and a number, in the state store and checkpoint of the stream, so a micro-batch costs what arrived, however long the history
    is. What is held of a key in a micro-batch is one delivery. Without releases no claimed key becomes free, so claims are a deduplication; a processor in
    Python, which asks the store key by key, serves releases only.
    """
    with_state_store(targets.sparkSession)
    if releases is None:
        bucket = F.pmod(F.xxhash64("key"), F.lit(_BUCKETS))
        return targets.groupBy(bucket).applyInArrow(_first_deliveries, targets.schema).dropDuplicates(["key"])
    stamp = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
    rows = targets.select(
        "key", F.lit(False).alias("release"), F.unix_micros("received_ts").alias("at"), "event_id", F.col("seq").cast("bigint").alias("seq"), F.to_json(F.struct(*targets.columns), stamp).alias("target")
    )
    zero = F.lit(0).cast("bigint")
    rows = rows.unionByName(releases.select("key", F.lit(True).alias("release"), zero.alias("at"), zero.alias("event_id"), zero.alias("seq"), F.lit("").alias("target")))
    claimed = rows.groupBy("key").transformWithStateInPandas(_Claims(), "target string", "Append", "None")
    return claimed.select(F.from_json("target", targets.schema, stamp).alias("t")).select("t.*")


def rate_limit(checks: DataFrame, minutes: int = 30) -> DataFrame:
    """Completed checks (repo, ts, event_id) that are allowed, at most one per repository and ``minutes``: (repo, second, event_id).

    Time counts as the checks tell it, in the order they arrive; one that arrives late is held against the last allowed one.
    """
    with_state_store(checks.sparkSession)
    rows = checks.select("repo", F.unix_seconds("ts").alias("second"), "event_id")
    return rows.groupBy("repo").transformWithStateInPandas(_Checks(minutes * 60), "repo string, second bigint, event_id bigint", "Append", "None")


def publish_batch(table: KeyedTable, namespace: str, keys: list[str]) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink: the newest body per key goes into a keyed table, of which a micro-batch rewrites the touched partitions only."""

    def run(batch: DataFrame, batch_id: int) -> None:
        table.put(batch.select(F.lit(namespace).alias("namespace"), F.concat_ws("\u001f", *keys).alias("key"), F.col("received_ts").alias("ts"), F.col("event_id").alias("seq"), *keys, "body"))

    return run


def published(table: KeyedTable, namespace: str, keys: list[str]) -> DataFrame:
    """Current bodies."""
    return table.read().filter(F.col("namespace") == namespace).select(*keys, "body")


def run_available(stream: DataFrame, checkpoint: str, batch: Callable[[DataFrame, int], None]) -> None:
    """Work off what is there, then stop."""
    query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
