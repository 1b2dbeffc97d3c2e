"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact weighted-shingle similarity.

A window is as many words of a document as an item has (or the whole document if it is shorter). Its SimHash is a 64-bit fingerprint of its
five-word shingles, each weighted by how often it occurs. All fingerprints within ``radius`` bits of an item's are found by blocks: of ``BLOCKS``
blocks at least one differs in at most ``radius // BLOCKS`` bits, so every item is filed under each of its blocks' values with up to so many bits
changed, and a window asks with its own blocks' values. Each pair found so is checked by its whole distance, then by the exact similarity: the sum
of the smaller over the sum of the larger weights of all shingles of both.

A window that shares no shingle with any item has similarity 0 and is not fingerprinted. So only documents with an item's shingle are read a second
time; their windows are cut from the hashes of their shingles. The benchmark's tables are broadcast after counting that they are small, else joined by
shuffles. Only DataFrame functions are used; no table is collected.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changelens.llm.common import let, materialize, shingle_hashes, texts, tokens, unused
from changelens.operators.grouping import broadcast_if_small

SHINGLE = 5
BLOCKS = 7
#: A benchmark table of so many narrow rows (under 100 bytes each) is broadcast.
BROADCAST_ROWS = 300_000
LANES, LANE_BITS = 22, 21  # three counters in one long, each up to two million


def simhash(windows: DataFrame, keys: list[str], shingles: str = "shingles") -> DataFrame:
    """``keys`` and ``simhash`` per row of ``windows``: bit ``i`` is set if more than half of the shingles have it. The keys must be distinct."""
    each = windows.select(*keys, F.explode(shingles).alias("h"))

    def lane(j: int) -> Column:
        bits = [F.shiftleft(F.shiftright("h", 3 * j + k).bitwiseAND(1), LANE_BITS * k) for k in range(3) if 3 * j + k < 64]
        out = bits[0]
        for bit in bits[1:]:
            out = out.bitwiseOR(bit)
        return out

    counted = each.groupBy(*keys).agg(F.count("*").alias("_total"), *[F.sum(lane(j)).alias(f"l{j}") for j in range(LANES)])
    fingerprint = F.lit(0).cast("long")
    for i in range(64):
        count = F.shiftright(f"l{i // 3}", LANE_BITS * (i % 3)).bitwiseAND(2**LANE_BITS - 1)
        fingerprint = fingerprint.bitwiseOR(F.when(2 * count > F.col("_total"), F.shiftleft(F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return counted.select(*keys, fingerprint.alias("simhash"))


def _blocks() -> list[tuple[int, int]]:
    """(first bit, number of bits) of each block."""
    at = [64 * i // BLOCKS for i in range(BLOCKS + 1)]
    return [(a, b - a) for a, b in zip(at, at[1:])]


def block_values(fingerprint: Column) -> Column:
    """Array of the blocks' keys: block number and value in one number."""
    return F.array(*[F.shiftrightunsigned(fingerprint, first).bitwiseAND(2**width - 1) + (i << 32) for i, (first, width) in enumerate(_blocks())])


def near_block_values(fingerprint: Column, radius: int) -> Column:
    """The same for every fingerprint of which a block is within ``radius // BLOCKS`` bits."""

    def filed(i: int, first: int, width: int) -> Column:
        masks = [sum(1 << b for b in bits) for n in range(radius // BLOCKS + 1) for bits in combinations(range(width), n)]
        value = F.shiftrightunsigned(fingerprint, first).bitwiseAND(2**width - 1)
        return F.transform(F.lit(masks).cast("array<bigint>"), lambda mask: value.bitwiseXOR(mask) + (i << 32))

    return F.flatten(F.array(*[filed(i, first, width) for i, (first, width) in enumerate(_blocks())]))


def similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard similarity of two shingle arrays, a shingle's weight being its count."""
    count = lambda array, h: F.size(F.filter(array, lambda x: x == h))
    shared = F.array_intersect(a, b)
    common = F.when((F.size(F.array_distinct(a)) == F.size(a)) & (F.size(F.array_distinct(b)) == F.size(b)), F.size(shared)).otherwise(
        F.aggregate(shared, F.lit(0), lambda n, h: n + F.least(count(a, h), count(b, h)))
    )
    return let(common, lambda c: c / (F.size(a) + F.size(b) - c))


def _grams(words: Column, size: int) -> Column:
    """Hashes of all runs of ``size`` words as :func:`shingle_hashes` makes them, also for items shorter than a shingle."""
    if size == SHINGLE:
        return F.filter(shingle_hashes(words), lambda h: F.size(words) >= SHINGLE)
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return let(hashed, lambda h: F.when(F.size(h) >= size, F.transform(F.sequence(F.lit(1), F.size(h) - size + 1), lambda i: F.xxhash64(F.slice(h, i, size)))).otherwise(F.array().cast("array<bigint>")))


def find_leaks(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    least: float = 0.8, radius: int = 20,
) -> DataFrame:
    """``doc_id``, ``item_id``, ``start`` (the window's first word, from 0), ``n_words``, ``similarity`` of the most similar window per pair.

    Pairs from a similarity of ``least`` on; of equal windows the first. Two windows of similarity 0.8 differ in about 10 of 64 bits on average and
    in more than the default ``radius`` once in some thousand times; equal ones in none. Texts are compared as lower-case runs of letters and digits.
    Items without a word match nothing; an item of fewer than five words matches a run of just these words. Null texts are empty. Repeated rows of a
    document give one row per item; a null id is an id. Empty tables give an empty result; other columns are not read.
    """
    item = items.select(F.col(item_col).alias("item_id"), tokens(F.coalesce(F.col(item_text_col), F.lit(""))).alias("words")).filter(F.size("words") > 0)
    item = materialize(item.select("item_id", F.size("words").alias("n"), shingle_hashes(F.col("words")).alias("shingles")).distinct())
    sizes = sorted(row["k"] for row in item.select(F.least("n", F.lit(SHINGLE)).alias("k")).distinct().collect())  # at most five
    vocabulary = item.select(F.explode("shingles").alias("h"), "n").distinct()
    own = texts(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("text_key"), tokens(F.col("text")).alias("words"))

    each = [own.select("doc_id", "text_key", F.size("words").alias("of"), F.posexplode(_grams(F.col("words"), k)).alias("at", "h")) for k in sizes or [SHINGLE]]
    found = each[0]
    for other in each[1:]:
        found = found.unionByName(other)
    # a document shorter than a shingle, and one shorter than the item, has one window: all of it
    hits = found.join(broadcast_if_small(vocabulary, BROADCAST_ROWS), "h").groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("at", "n", "of")).alias("hits"))
    hits = materialize(hits)

    def starts(hit: Column) -> Column:
        last = F.greatest(hit["of"] - hit["n"], F.lit(0))
        first = F.greatest(F.least(hit["at"] - hit["n"] + F.least(hit["n"], F.lit(SHINGLE)), last), F.lit(0))
        return F.transform(F.sequence(first, F.least(hit["at"], last)), lambda s: F.struct(hit["n"].alias("n"), s.alias("start")))

    def window(w: Column) -> Column:
        short = [F.when(w["n"] == k, F.slice(f"g{k}", w["start"] + 1, F.lit(1))) for k in sizes if k < SHINGLE]
        cut = F.coalesce(*short, F.slice(f"g{SHINGLE}", w["start"] + 1, F.least(w["n"], F.col("of")) - SHINGLE + 1))
        return F.struct(w["n"].alias("n"), w["start"].alias("start"), cut.alias("shingles"))

    same = (F.col("d.text_key") == F.col("k.text_key")) & F.col("d.doc_id").eqNullSafe(F.col("k.doc_id"))
    hit_docs = own.alias("d").join(broadcast_if_small(hits, BROADCAST_ROWS // 10).alias("k"), same).select("d.doc_id", "d.text_key", "d.words", "k.hits").dropDuplicates(["doc_id", "text_key"])
    prepared = hit_docs.select(
        "doc_id", "text_key", F.size("words").alias("of"), *[_grams(F.col("words"), k).alias(f"g{k}") for k in sorted({*sizes, SHINGLE})],
        F.array_distinct(F.flatten(F.transform("hits", starts))).alias("windows"),
    )
    windows = materialize(prepared.select("doc_id", "text_key", F.explode(F.transform("windows", window)).alias("w")).select("doc_id", "text_key", "w.*"))
    keys = ["doc_id", "text_key", "n", "start"]
    asked = simhash(windows, keys).select(*keys, "simhash", F.explode(block_values(F.col("simhash"))).alias("block"))
    filed = simhash(item.withColumn("item", F.xxhash64("shingles")), ["item", "item_id", "n"])
    filed = filed.select("item", "item_id", "n", F.col("simhash").alias("item_hash"), F.explode(near_block_values(F.col("simhash"), radius)).alias("block"))
    near = asked.join(broadcast_if_small(materialize(filed), BROADCAST_ROWS), ["n", "block"]).filter(F.bit_count(F.col("simhash").bitwiseXOR(F.col("item_hash"))) <= radius)
    pairs = near.select(*keys, "item", "item_id").distinct()
    told = item.select(F.xxhash64("shingles").alias("item"), "item_id", F.col("shingles").alias("item_shingles"))
    null_safe = [F.col(f"p.{c}").eqNullSafe(F.col(f"w.{c}")) for c in keys]
    checked = pairs.alias("p").join(windows.alias("w"), null_safe[0] & null_safe[1] & null_safe[2] & null_safe[3]).select("p.*", "w.shingles")
    checked = checked.alias("c").join(told.alias("i"), (F.col("c.item") == F.col("i.item")) & F.col("c.item_id").eqNullSafe(F.col("i.item_id")))
    scored = checked.select("c.doc_id", "c.item_id", "c.start", "c.n", similarity(F.col("c.shingles"), F.col("i.item_shingles")).alias("similarity")).filter(F.col("similarity") >= least)
    best = F.max(F.struct("similarity", (-F.col("start")).alias("back"), (-F.col("n")).alias("less")))
    return scored.groupBy("doc_id", "item_id").agg(best.alias("b")).select(
        "doc_id", "item_id", (-F.col("b.back")).alias("start"), (-F.col("b.less")).alias("n_words"), "b.similarity"
    )


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` whose document leaks no item, with all their columns; rows with a null id stay unless a null-id row leaks."""
    name = unused(docs, "_leaked")
    leaked = find_leaks(docs, items, id_col=id_col, **options).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(leaked, F.col(id_col).eqNullSafe(F.col(name)), "left_anti")
