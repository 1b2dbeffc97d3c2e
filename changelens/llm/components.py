"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changelens.llm.common import materialize


#: Nodes with more than this part of all edges are hot; so there are at most as many of them, and their rows are broadcast.
HOT_PART = 1_000


def _to_smallest(edges: DataFrame, count: int, keep_center: bool) -> DataFrame:
    """Every neighbour of ``a`` (and ``a`` itself, if ``keep_center``) linked with the smallest of them and ``a``; ``count``: about all edges."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("a", "m"))
    limit = max(1_000, 2 * count // HOT_PART)
    least = materialize(least)
    hot = F.broadcast(least.filter(F.col("n") > limit).drop("n"))
    cold = edges.join(hot.select("a"), "a", "left_anti").join(least.filter(F.col("n") <= limit).drop("n"), "a")
    moved = edges.join(hot, "a").unionByName(cold).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))) if keep_center else moved


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the smallest node of its component) for every node of the edges ``a``, ``b`` (longs).

    Each round links larger neighbours, then smaller ones, with the smallest neighbour, until nothing changes; the number of rounds grows with the
    logarithm of a component's size. A node of many edges is pre-aggregated and its join needs no shuffle. Null ends and loops are left out.
    """
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct()
    down = materialize(down)
    nodes = down.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    mark = lambda d: tuple(d.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    before = mark(down)
    while before[0]:
        both = down.unionByName(down.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _to_smallest(both, before[0], keep_center=False).filter("a > b").distinct()
        down = materialize(_to_smallest(large, before[0], keep_center=True).filter("a > b").distinct())
        after = mark(down)
        if after == before:
            break
        before = after
    return nodes.join(down.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("root"))
