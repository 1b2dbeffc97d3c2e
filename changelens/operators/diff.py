"""Diff tables: numbered rows, changed lines, gaps, chunks, excerpts and file comparison."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from changelens.functions import diffs, text
from changelens.operators.grouping import unnest

FILE = ("repo", "sha", "filename")


def explode_patch(files: DataFrame) -> DataFrame:
    """One row per patch row: hunk_id, pos, op, new_line, gap_hi, text."""
    return unnest(files, FILE, diffs.patch_rows("patch"))


def changed_lines(files: DataFrame) -> DataFrame:
    return unnest(files, FILE, F.array_distinct(diffs.added_numbers("patch"))).withColumnRenamed("item", "new_line")


def deletion_gaps(files: DataFrame) -> DataFrame:
    return unnest(files, FILE, diffs.deletion_gaps(diffs.patch_rows("patch")))


def touched_lines(files: DataFrame) -> DataFrame:
    lines = text.let(diffs.patch_rows("patch"), lambda r: diffs.touched_lines(diffs.added_lines(r), diffs.deletion_gaps(r)))
    return unnest(files, FILE, lines).withColumnRenamed("item", "line")


def trim_patches(files: DataFrame, max_chars: int) -> DataFrame:
    return files.withColumn("trimmed", diffs.trim_patch("patch", max_chars)).select(
        *FILE, F.col("trimmed.text").alias("patch"), F.col("trimmed.omitted").alias("omitted")
    )


def chunks(df: DataFrame, column: str, max_chars: int, *keys: str) -> DataFrame:
    return unnest(df, keys, text.chunk_text(column, max_chars), "chunk").withColumnRenamed("item", "text")


def line_diff(base: DataFrame, head: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files, lines) between two trees keyed by (case, path).

    Lines pair up by (text, n-th occurrence): of a text that one side has more often, those beyond the other side's number changed. Only whole texts are shuffled,
    once, by file; everything below needs the rows of one file and stays in its partition.
    """
    keys = ["case", "path"]
    none = F.lit(None).cast("string")
    sides = base.select(*keys, F.col("content").alias("old"), none.alias("new")).unionByName(head.select(*keys, none.alias("old"), F.col("content").alias("new")))
    pair = sides.repartition(*keys).groupBy(*keys).agg(F.max("old").alias("old"), F.max("new").alias("new")).filter(~F.col("old").eqNullSafe(F.col("new")))
    status = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("modified")

    def told(side: str, op: str) -> Column:
        lines = text.split_lines(F.coalesce(side, F.lit("")))
        return F.transform(lines, lambda line, at: F.struct(F.lit(op).alias("op"), (at + 1).alias("line"), line.alias("text")))

    rows = pair.select(*keys, status.alias("status"), F.inline_outer(F.concat(told("old", "-"), told("new", "+"))))
    same = Window.partitionBy(*keys, "text").orderBy("op", "line")  # the added ones come first
    every = same.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    is_new = F.col("op") == "+"
    counted = rows.withColumns({"_at": F.row_number().over(same), "_new": F.count_if(is_new).over(every), "_old": F.count_if(~is_new).over(every)})
    flagged = counted.withColumn("_changed", F.when(is_new, F.col("_at") > F.col("_old")).otherwise(F.col("_at") - F.col("_new") > F.col("_new")))
    changed = flagged.filter(F.col("op").isNotNull() & F.col("_changed")).select(*keys, "op", "line", "text")
    files = flagged.groupBy(*keys, "status").agg(
        F.count_if(is_new & F.col("_changed")).alias("additions"), F.count_if(~is_new & F.col("_changed")).alias("deletions")
    )
    return files, changed


def _longest_increasing(values: list[int]) -> list[int]:
    """Positions of a longest strictly increasing run of ``values``."""
    tops, last, before = [], [], []
    for at, value in enumerate(values):
        pile = bisect_left(tops, value)
        tops[pile : pile + 1], last[pile : pile + 1] = [value], [at]
        before.append(last[pile - 1] if pile else -1)
    run, at = [], last[-1] if last else -1
    while at >= 0:
        run.append(at)
        at = before[at]
    return run[::-1]


def _align(old: list[int], new: list[int]) -> list[tuple[int, int]]:
    """Places (old, new) of equal lines that stay in order.

    Equal lines at both ends stay. Between them the lines that are unique on both sides are anchors, of which a longest run in order stays, and the gaps between
    anchors are aligned in the same way. In a gap without an anchor the n-th occurrences of a line are pairs and a longest run of them stays.
    """
    kept, gaps = [], [(0, len(old), 0, len(new))]
    while gaps:
        a, b, c, d = gaps.pop()
        while a < b and c < d and old[a] == new[c]:
            kept.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and old[b - 1] == new[d - 1]:
            b, d = b - 1, d - 1
            kept.append((b, d))
        if a == b or c == d:
            continue
        mine, theirs = Counter(old[a:b]), Counter(new[c:d])
        at = {line: place for place, line in enumerate(new[c:d], c) if theirs[line] == 1}
        pairs = [(place, at[line]) for place, line in enumerate(old[a:b], a) if mine[line] == 1 and line in at]
        anchors = [pairs[i] for i in _longest_increasing([q for _, q in pairs])]
        if anchors:
            kept += anchors
            edges = [(a - 1, c - 1), *anchors, (b, d)]
            gaps += [(p + 1, r, q + 1, s) for (p, q), (r, s) in zip(edges, edges[1:])]
            continue
        places: dict[int, list[int]] = {}
        for place in range(d - 1, c - 1, -1):
            places.setdefault(new[place], []).append(place)
        pairs = [(place, places[line].pop()) for place, line in enumerate(old[a:b], a) if places.get(line)]
        kept += [pairs[i] for i in _longest_increasing([q for _, q in pairs])]
    return sorted(kept)


_KEPT = StructType([StructField(side, ArrayType(IntegerType())) for side in ("old", "new")])


@F.pandas_udf(_KEPT)
def _aligned(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for olds, news in batches:
        found = [_align(list(old), list(new)) for old, new in zip(olds, news)]
        yield pd.DataFrame({"old": [[p for p, _ in kept] for kept in found], "new": [[q for _, q in kept] for kept in found]})


def aligned_diff(base: DataFrame, head: DataFrame) -> DataFrame:
    """(case, path, op, line, text, moved_line) between two trees: lines that are not in order on both sides.

    Unlike in :func:`line_diff` a line that changed its place is removed there and added here; ``moved_line`` is then its number on the other side (n-th with n-th of
    a text). Lines are aligned on their hashes, file by file; the texts stay in the row.
    """
    keys = ["case", "path"]
    both = base.select(*keys, F.col("content").alias("old")).join(head.select(*keys, F.col("content").alias("new")), keys, "full_outer")
    lines = both.filter(~F.col("old").eqNullSafe(F.col("new"))).select(
        *keys, *[text.split_lines(F.coalesce(side, F.lit(""))).alias(side) for side in ("old", "new")]
    )
    hashes = lambda side: F.transform(side, lambda line: F.xxhash64(line))
    kept = lines.withColumn("kept", _aligned(hashes("old"), hashes("new")))

    def changed(side: str, op: str) -> DataFrame:
        every = F.when(F.size(side) > 0, F.sequence(F.lit(0), F.size(side) - 1)).otherwise(F.array().cast("array<int>"))
        places = F.transform(F.array_except(every, f"kept.{side}"), lambda at: F.struct((at + 1).alias("line"), F.get(F.col(side), at).alias("text")))
        rows = unnest(kept, keys, places)
        nth = F.row_number().over(Window.partitionBy(*keys, "text").orderBy("line"))
        return rows.select(*keys, F.lit(op).alias("op"), "line", "text", nth.alias("nth"))

    removed, added = changed("old", "-"), changed("new", "+")
    on = [*keys, "text", "nth"]
    other = lambda rows: rows.select(*on, F.col("line").alias("moved_line"))
    told = removed.join(other(added), on, "left").unionByName(added.join(other(removed), on, "left"))
    return told.select(*keys, "op", "line", "text", "moved_line")
