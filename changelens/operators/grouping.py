"""Top-k per group and reuse of an expensive intermediate table."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Spark prunes row_number() <= k before the shuffle up to this k (spark.sql.optimizer.windowGroupLimitThreshold).
_PRUNED_BEFORE_SHUFFLE = 1000
REVIEW = ("repo", "sha")


def unnest(df: DataFrame, keys: Sequence[str | Column], array: str | Column, position: str | None = None) -> DataFrame:
    """One row per element of a computed array; a struct element becomes columns, another one the column ``item``.

    A plain explode makes Spark test the array for emptiness below it, which would compute an expensive array twice.
    """
    rows = df.select(*keys, F.posexplode_outer(array).alias("_pos", "item")).filter(F.col("_pos").isNotNull())
    names = [k for k in rows.columns if k not in ("_pos", "item")]
    pos = [F.col("_pos").alias(position)] if position else []
    item = "item.*" if rows.schema["item"].dataType.typeName() == "struct" else "item"
    return rows.select(*names, *pos, item)


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def first_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, name: str | None = None, spread: int = 64
) -> DataFrame:
    """The first ``k`` rows of every group in a total order; ``name`` keeps the rank.

    For small ``k`` Spark cuts every map task's group to ``k`` rows before the shuffle, so a hot group never reaches one
    task whole. Beyond that the group is spread over ``spread`` parts first, each cut to ``k`` on its own.
    """
    rank = name or "_rank"
    if k > _PRUNED_BEFORE_SHUFFLE:
        columns = df.columns
        df = df.withColumn("_part", F.pmod(F.xxhash64(*columns), F.lit(spread)))
        df = ranked(df, [*keys, "_part"], order, "_rank_in_part").filter(F.col("_rank_in_part") <= k)
        df = df.drop("_part", "_rank_in_part")
    cut = ranked(df, keys, order, rank).filter(F.col(rank) <= k)
    return cut if name else cut.drop(rank)


def prefix_within(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], cost: Column, budget: int, first_always: bool = False
) -> DataFrame:
    """Rows up to the first one whose running cost exceeds the budget (stop, not skip)."""
    window = Window.partitionBy(*keys).orderBy(*order)
    so_far = window.rowsBetween(Window.unboundedPreceding, 0)
    over = F.sum(cost).over(so_far) > budget
    if first_always:
        over = over & (F.row_number().over(window) > 1)
    flagged = df.withColumn("_over", over)
    return flagged.withColumn("_stopped", F.bool_or("_over").over(so_far)).filter(~F.col("_stopped")).drop("_over", "_stopped")


def shared_folder(spark: SparkSession) -> str:
    """The folder the session names for checkpoints; a local session without one gets a temporary folder."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a shared folder")
            folder = tempfile.mkdtemp(prefix="changelens-checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """Write an intermediate table once, into the checkpoint folder of the session, and read it from there.

    Used where several branches read a costly table: it survives lost executors and is not computed per branch.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()


def shuffled(df: DataFrame) -> DataFrame:
    """A table that grows with the input: its next join is a sort-merge join on both sides.

    The planner guesses sizes from the files read and the types of columns (20 bytes for a text, one element for an array), so it takes exploded keys or texts
    of millions of rows for small and would send them through the driver.
    """
    return df.hint("merge")


def broadcast_if_small(df: DataFrame, max_rows: int, weight: Column | None = None) -> DataFrame:
    """Broadcast a table of narrow rows only after counting that it has at most ``max_rows``; else both sides are shuffled.

    Rows that hold a list count by their ``weight``, the length of the list.
    """
    if weight is None:
        return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else shuffled(df)
    total = df.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    return F.broadcast(df) if total <= max_rows else shuffled(df)
