"""N-gram Jaccard join: MinHash banding of a fixed depth for candidates, exact similarity for links.

Documents with one set of five-word shingles are one node, whatever their number. A node has a signature of min-hashes in ``trees``
bands: nodes that share the first values of a band are candidates. How many values must match is worked out before any data is read: from the full
``depth`` it is shortened until two documents at the least similarity share a band with the target recall. No tries are built.

Candidates are not emitted as pairs. In every bucket each node is linked with the smallest one; the components of these links hold every candidate pair.
All pairs inside a component are then compared exactly: small components are bundled, large ones are cut into blocks and every pair of blocks is a task
of its own, which returns one row per node (its number of links and the smallest node it is joined with), never pairs. So hot groups of copies cost
nothing, and hot groups of near copies cost comparisons spread over tasks of bounded size, but no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changelens.llm.common import NO_ID, materialize, shingle_hashes, texts, tokens, unused
from changelens.llm.components import HOT_PART, components
from changelens.operators.grouping import broadcast_if_small

BLOCK = 512
BUNDLE = 1_000
BROADCAST_ROWS = 200_000


def matched_depth(trees: int, depth: int, least: float, recall: float) -> int:
    """The longest prefix that pairs of similarity ``least`` share in some tree with probability ``recall``; at least 1."""
    while depth > 1 and 1 - (1 - least**depth) ** trees < recall:
        depth -= 1
    return depth


def _parts(batches: Iterator[pd.DataFrame], rows: int = 500) -> Iterator[pd.DataFrame]:
    """Batches in parts of so many rows, so that only their sets are in memory at once."""
    for batch in batches:
        for first in range(0, len(batch), rows):
            yield batch.iloc[first : first + rows]


def _labels(shingles: np.ndarray, trees: int, depth: int, salt: np.ndarray) -> np.ndarray:
    """Hash of each tree's prefix of the signature of distinct shingles."""
    low = np.full(trees * depth, 0xFFFFFFFF, np.uint32)
    short = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    for part in range(0, len(short), 4096):
        np.minimum(low, (short[part : part + 4096, None] * salt[0] + salt[1]).min(0), out=low)
    rows = low.reshape(trees, depth)
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), seed=tree) - 2**63 for tree, row in enumerate(rows)], np.int64)


def _salts(count: int) -> np.ndarray:
    made = np.random.Generator(np.random.PCG64(20_240_517))
    return np.stack([made.integers(0, 2**31, count, np.uint32) * np.uint32(2) + np.uint32(1), made.integers(0, 2**32, count, np.uint32)])


def _similar(sets: list[np.ndarray], least: float) -> np.ndarray:
    """Which pairs of shingle sets have a Jaccard similarity of ``least`` or more; no set is similar to itself."""
    sizes = np.array([len(s) for s in sets], np.float64)
    _, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes.astype(np.int64))
    shared = count[code] > 1
    owner, code = owner[shared], np.unique(code[shared], return_inverse=True)[1] if shared.any() else code[:0]
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    common = np.zeros((len(sets), len(sets)), np.float32)
    width = 2048
    for first in range(0, int(code[-1]) + 1 if len(code) else 0, width):
        a, b = np.searchsorted(code, [first, first + width])
        table = np.zeros((len(sets), width), np.float32)
        table[owner[a:b], code[a:b] - first] = 1
        common += table @ table.T
    found = common * (1 + least) >= least * (sizes[:, None] + sizes[None, :]) - 1e-6
    np.fill_diagonal(found, False)
    return found


def _roots(near: np.ndarray) -> np.ndarray:
    """The first row of each row's component."""
    label = np.arange(len(near))
    while True:
        lower = np.minimum(label, np.where(near, label[None, :], len(near)).min(1, initial=len(near)))
        lower = lower[lower]
        if (lower == label).all():
            return label
        label = lower


def classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8, size: int = 5, trees: int = 24, depth: int = 8, recall: float = 0.9999,
) -> DataFrame:
    """Per row: ``doc_id``, ``class_id`` (the smallest id that links lead to), ``n_links`` (other rows with a similarity of ``least`` or more).

    Words are lower-case runs of letters and digits; a text of fewer words than a shingle is one shingle. A text without a word, and so a null
    one, is alone: its class is its own id, without links. Repeated rows are copies of each other. A null id takes part; a class of only null ids has a
    null ``class_id``. An empty table gives an empty result; other columns are not read. A link can be missed only if its pair shares no bucket in any
    tree nor a chain of buckets: below ``1 - recall`` at a similarity of exactly ``least``, and far rarer above.
    """
    depth = matched_depth(trees, depth, least, recall)
    salt = _salts(trees * depth)
    own = texts(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("text_key"), shingle_hashes(tokens(F.col("text")), size).alias("s"))

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in _parts(batches):
            sets = [np.unique(np.asarray(values, np.int64).view(np.uint64)) for values in part.s]
            node = [xxhash.xxh64_intdigest(s.tobytes()) - 2**63 if len(s) else None for s in sets]
            yield pd.DataFrame({"doc_id": part.doc_id, "text_key": part.text_key, "node": pd.array(node, "Int64"), "labels": [_labels(s, trees, depth, salt) if len(s) else None for s in sets]})

    signed = own.withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID))).mapInPandas(sign, "doc_id long, text_key long, node long, labels array<long>")
    signed = materialize(signed.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID))))
    nodes = materialize(signed.filter("node IS NOT NULL").groupBy("node").agg(F.count("*").alias("copies"), F.min("doc_id").alias("doc_id"), F.min(F.struct("text_key", "doc_id")).alias("row"), F.first("labels").alias("labels")))
    placed = nodes.select("node", F.explode("labels").alias("bucket"))
    buckets = placed.groupBy("bucket").agg(F.min("node").alias("first"), F.count("*").alias("n")).filter("n > 1")
    together = materialize(components(placed.join(buckets, "bucket").select(F.col("node").alias("a"), F.col("first").alias("b"))))
    members = nodes.drop("labels").join(together, "node").withColumnRenamed("root", "part")
    members = materialize(members.join(together.groupBy(F.col("root").alias("part")).agg(F.count("*").alias("of")), "part"))
    checked = materialize(_checked(own, members, least))
    small = checked.filter(~F.col("cut")).select("node", "links", "root")
    large = checked.filter("cut")
    met = components(large.select(F.col("node").alias("a"), F.col("root").alias("b"))).withColumnRenamed("root", "met")
    counted = large.groupBy("node").agg(F.sum("links").alias("links")).join(met, "node", "left").select("node", "links", F.coalesce("met", "node").alias("root"))
    found = nodes.drop("labels", "row").join(small.unionByName(counted), "node", "left")
    found = materialize(found.select("node", "copies", "doc_id", F.coalesce("root", "node").alias("root"), F.coalesce("links", F.lit(0)).alias("links")))
    named = found.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("n"))
    told = materialize(_with_name(found, materialize(named)).select("node", "class_id", (F.col("copies") - 1 + F.col("links")).alias("n_links")))
    return signed.select("doc_id", "node").join(told, "node", "left").select(
        "doc_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")
    )


def _with_name(found: DataFrame, named: DataFrame) -> DataFrame:
    """``found`` with the ``class_id`` of its root. At most :data:`HOT_PART` roots can have more than that part of the rows: those are broadcast, so the rows of a large class
    stay where they are.
    """
    limit = max(1_000, found.count() // HOT_PART)
    hot = F.broadcast(named.filter(F.col("n") > limit).drop("n"))
    cold = found.join(hot.select("root"), "root", "left_anti").join(named.filter(F.col("n") <= limit).drop("n"), "root")
    return found.join(hot, "root").unionByName(cold)


def _checked(own: DataFrame, members: DataFrame, least: float) -> DataFrame:
    """``node``, ``links`` (rows it is similar to), ``root`` and ``cut`` (whether it is a row of one of several block pairs) from exact comparisons.

    ``members``: ``node``, one ``row`` of it (text_key, doc_id), ``copies``, ``part`` and the part's size ``of``.
    """
    count = members.count()
    bundles = max(1, math.ceil(count / BUNDLE))
    asked = members.select(F.col("row.text_key").alias("of_text"), F.col("row.doc_id").alias("of_doc"), "node", "copies", "part", "of")
    same = (F.col("text_key") == F.col("of_text")) & F.col("doc_id").eqNullSafe(F.col("of_doc"))
    rows = own.join(broadcast_if_small(asked, BROADCAST_ROWS), same).select("node", "copies", "part", "of", "s")

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in _parts(batches):
            distinct = [np.unique(np.asarray(values, np.int64).view(np.uint64)).tobytes() for values in part.s]
            yield part.assign(s=distinct)[[xxhash.xxh64_intdigest(d) - 2**63 == node for d, node in zip(distinct, part.node, strict=True)]]

    sized = rows.mapInPandas(sets, "node long, copies long, part long, of long, s binary").dropDuplicates(["node"])  # repeated rows
    blocks = F.ceil(F.col("of") / BLOCK).cast("int")
    block = F.pmod(F.xxhash64("node"), blocks).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), blocks - 1), lambda other: F.struct(F.least(block, other).alias("i"), F.greatest(block, other).alias("j")))
    placed = sized.withColumn("block", block).withColumn("pair", F.explode(pairs)).withColumn(
        "task", F.when(blocks > 1, F.xxhash64("part", "pair")).otherwise(F.pmod(F.xxhash64("part"), F.lit(bundles)))
    ).select("task", "part", "of", "node", "copies", "block", "pair.i", "pair.j", "s")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, part in group.groupby(["part", "i", "j"], sort=False):
            part = part.sort_values("node")
            near = _similar([np.frombuffer(s, np.uint64) for s in part.s], least)
            block, (i, j) = part.block.to_numpy(), part[["i", "j"]].iloc[0]
            if i != j:
                near &= block[:, None] != block[None, :]
            out.append(pd.DataFrame({"node": part.node, "links": near.astype(np.int64) @ part.copies.to_numpy(np.int64), "root": part.node.to_numpy()[_roots(near)], "cut": part.of > BLOCK}))
        return pd.concat(out)

    return placed.groupBy("task").applyInPandas(compare, "node long, links long, root long, cut boolean")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` without those in the class of a smaller id, all columns kept; rows of a null id stay."""
    name = unused(docs, "_gone")
    gone = classes(docs, id_col, text_col, **options).filter("doc_id > class_id").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, F.col(id_col) == F.col(name), "left_anti")
