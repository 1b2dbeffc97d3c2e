"""Prefix trie of conversations by van Emde Boas recursion.

Sequences are cut at half of the largest depth, the halves again at theirs, until the parts are one turn high: all cuts of one recursion level lie at the
multiples of a power of two. Every prefix that ends at a cut is named by a 128-bit fingerprint of its turns, so the part above a cut (the upper trie) and
the parts below its named prefixes (the lower forests) are built at once, all levels in one grouping: a node is its depth and its name, and it keeps the
names of the cut prefixes it hangs on, one per level that cuts it off, at most the logarithm of its depth.

Totals of subtrees are then grafted upward along the same cuts. Every node gives its weight to the cut prefixes it hangs on, where the weights of a whole lower
forest add up before anything moves on; and from the highest level down each cut prefix hands what it got to the two halves of the upper trie's
path above it. After as many rounds as there are levels every node has the sum of its subtree. One round moves a node at most once, so the work is
nodes times levels where a sum per ancestor would be nodes times depth. Nodes with one member are left out of this: below them is one chain, nothing is shared.

A conversation's rows stay narrow (fingerprint and length in place of the text) and are dealt once by family; the windows over them stream and spill. Groups of
equal conversations are counted before they are shuffled. The list of conversations that end at a node is hashed in pieces of neighbouring ids that are
put together in order in one pass, so no list is held whole.

Null role or text is empty; rows without a ``conv_id`` belong to no conversation and are left out; rows of equal turn are ordered by fingerprint, null turns
first; repeated rows are turns of their own; an empty table has no conversation and so no root; further columns are ignored; texts may be of any length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changelens.llm.common import filled, materialize

NODE = ("depth", "a", "b")
NAME = "struct<a: bigint, b: bigint>"
#: Ids of conversations that end at a node are put together for so many neighbouring ids at once.
SPAN = 4096
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def narrow(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, the fingerprint of (role, text) and the bytes of the text."""
    role, text = filled("role"), filled("text")
    told = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    mark = F.substring(F.unhex(F.sha2(told, 256)), 1, 16)
    return conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv"), "turn", mark.alias("mark"), F.octet_length(text).cast("long").alias("bytes")
    )


def head_length(conv: Column) -> Column:
    """How many turns a conversation takes over from the first of its family."""
    return (F.crc32(conv.cast("string")) % 9).cast("int")


def sequences(conversations: DataFrame) -> DataFrame:
    """(family, conv, depth, mark, bytes) of whole conversations, with a row of depth 0 for each: every conversation is its own family."""
    rows = narrow(conversations).withColumn("family", F.col("conv"))
    mine = Window.partitionBy("family", "conv").orderBy(F.col("turn").asc_nulls_first(), "mark")
    placed = rows.repartition("family").withColumn("place", F.row_number().over(mine))
    return _with_root(placed, F.array(F.struct("conv", F.col("place").alias("depth"))))


def rebuilt_sequences(conversations: DataFrame) -> DataFrame:
    """Like :func:`sequences`, but every conversation begins with the first turns of conversation ``c - c % 5`` in place of as many of its own."""
    rows = narrow(conversations).withColumn("family", F.col("conv") - F.col("conv") % 5)
    mine = Window.partitionBy("family", "conv").orderBy(F.col("turn").asc_nulls_first(), "mark")
    family = Window.partitionBy("family")
    first = F.col("conv") == F.col("family")
    placed = rows.repartition("family").withColumn("place", F.row_number().over(mine)).select(
        "*", F.collect_set("conv").over(family).alias("convs"), F.coalesce(F.max(F.when(first, F.col("place"))).over(family), F.lit(0)).alias("lead")
    )
    head, place = head_length(F.col("conv")), F.col("place")
    none = F.array().cast("array<struct<conv: bigint, depth: int>>")
    own = F.when(place > head, F.array(F.struct("conv", (place - head + F.least(head, "lead")).alias("depth")))).otherwise(none)
    taken = F.filter("convs", lambda c: head_length(c) >= place)
    given = F.when(first & (place <= 8), F.transform(taken, lambda c: F.struct(c.alias("conv"), place.alias("depth")))).otherwise(none)
    return _with_root(placed, F.concat(own, given))


def _with_root(placed: DataFrame, turns: Column) -> DataFrame:
    root = F.when(F.col("place") == 1, F.array(F.struct("conv", F.lit(0).alias("depth")))).otherwise(F.array().cast("array<struct<conv: bigint, depth: int>>"))
    found = placed.select("family", F.explode(F.concat(root, turns)).alias("t"), "mark", "bytes")
    inside = F.col("t.depth") > 0
    return found.select("family", "t.*", F.when(inside, F.col("mark")).alias("mark"), F.when(inside, F.col("bytes")).otherwise(0).alias("bytes"))


def levels_of(conversations: DataFrame) -> int:
    """Levels of the recursion: the largest depth has so many binary digits (eight turns may be taken over)."""
    longest = conversations.groupBy("conv_id").count().agg(F.max("count")).first()[0]
    return ((longest or 0) + 8).bit_length()


def named(rows: DataFrame, levels: int) -> DataFrame:
    """Adds the name (``a``, ``b``) of the prefix, ``cuts``, the names of the cut prefixes above, outermost first, and ``last``."""
    along = Window.partitionBy("family", "conv").orderBy("depth")
    upto, above = along.rowsBetween(Window.unboundedPreceding, 0), along.rowsBetween(Window.unboundedPreceding, -1)
    part = lambda *seed: F.when(F.col("depth") > 0, F.xxhash64(*seed, "mark", "depth")).otherwise(0)
    with_names = rows.select("*", F.bit_xor(part()).over(upto).alias("a"), F.bit_xor(part(F.lit("b"))).over(upto).alias("b"), F.lead("depth").over(along).isNull().alias("last"))
    name = F.struct("a", "b")
    # the last cut of a level above depth d is at (d - 1) without its lower digits
    cut = lambda k: F.last(F.when(F.col("depth") % (1 << k) == 0, name), ignorenulls=True).over(above)
    higher = with_names.select("*", *[cut(k).alias(f"cut{k}") for k in range(levels)])
    digit = lambda k: F.shiftright(F.col("depth") - 1, k).bitwiseAND(1) == 1
    cuts = F.array_compact(F.array(*[F.when((F.col("depth") > 0) & digit(k), F.col(f"cut{k}")) for k in reversed(range(levels))]))
    return higher.select("conv", *NODE, "bytes", "last", cuts.alias("cuts"))


def nodes_of(rows: DataFrame) -> DataFrame:
    """One row per node: smallest and number of members, bytes of the last text, names of the cut prefixes above."""
    return rows.groupBy(*NODE).agg(
        F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("bytes").alias("bytes"), F.any_value("cuts").alias("cuts")
    )


def parent_key() -> list[Column]:
    """Depth and name of the parent: the innermost cut prefix; the root above depth 1, null above the root."""
    last = F.try_element_at("cuts", F.lit(-1))
    inner = lambda c: F.when(F.col("depth") > 1, last[c]).when(F.col("depth") == 1, F.lit(0)).alias(c)
    return [F.when(F.col("depth") > 0, F.col("depth") - 1).alias("depth"), inner("a"), inner("b")]


def _shifted(depth: Column, k: Column) -> Column:
    return F.call_function("shiftright", depth, k)


def _digits(depth: Column, levels: int) -> Column:
    """Places of the binary ones, highest first."""
    return F.filter(F.array(*[F.lit(k) for k in reversed(range(levels))]), lambda k: _shifted(depth, k).bitwiseAND(1) == 1)


def subtree_totals(weighted: DataFrame, levels: int) -> DataFrame:
    """(depth, a, b, leaves, saved) summed over subtrees; ``weighted`` has a row per node: its key, cuts, leaves and saved."""
    depth = F.col("depth")
    ones = _digits(depth, levels)
    sums = [F.sum(c).alias(c) for c in ("leaves", "saved")]
    # the path to a node is its blocks between cuts; the last block ends at the node, the others at the cut prefixes it hangs on
    block = lambda at, k, name, cuts: F.struct(
        at.cast("int").alias("depth"), k.cast("int").alias("level"), name["a"].alias("a"), name["b"].alias("b"), cuts.alias("cuts")
    )
    cleared = lambda k: F.call_function("shiftleft", _shifted(depth, k), k)
    outer = F.transform(
        F.slice("ones", F.lit(1), F.size("ones") - 1),
        lambda k, i: block(cleared(k), k, F.get("cuts", i), F.lit(None).cast(f"array<{NAME}>")),
    )
    own = F.array(block(depth, F.element_at("ones", -1), F.struct("a", "b"), F.col("cuts")))
    below = weighted.filter(depth > 0).withColumn("ones", ones)
    given = materialize(below.select(F.explode(F.concat(outer, own)).alias("x"), "leaves", "saved").select("x.*", "leaves", "saved"))
    columns = [*NODE, "cuts", "leaves", "saved"]
    got = given.limit(0).select(*columns)
    for level in reversed(range(levels)):
        here = given.filter(F.col("level") == level).select(*columns).unionByName(got)
        summed = here.groupBy(*NODE).agg(F.first("cuts", ignorenulls=True).alias("cuts"), *sums)
        if level == 0:
            got = summed.select(*NODE, "leaves", "saved")
            break
        half = 1 << (level - 1)
        upper = F.get("cuts", F.bit_count(F.shiftright(depth - 1, level - 1)).cast("int") - 1)
        halves = F.array(
            F.struct("depth", "a", "b", "cuts"),
            F.struct((depth - half).alias("depth"), upper["a"].alias("a"), upper["b"].alias("b"), F.lit(None).cast(f"array<{NAME}>").alias("cuts")),
        )
        got = summed.select(F.explode(halves).alias("x"), "leaves", "saved").select("x.*", "leaves", "saved")
    root = weighted.groupBy().agg(*sums).select(F.lit(0).alias("depth"), F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), "leaves", "saved")
    return got.unionByName(root.filter(F.col("leaves").isNotNull()))


def ends_of(rows: DataFrame) -> DataFrame:
    """SHA-256 of the ascending ids of the conversations that end at a node, comma-joined."""
    ended = rows.filter("last").select(*NODE, "conv", F.floor(F.col("conv") / SPAN).alias("span"))
    pieces = ended.groupBy(*NODE, "span").agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids"))
    fields = "depth int, a bigint, b bigint, ends_sha256 string"
    schema = pa.schema([("depth", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("ends_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha, done = None, None, []
        for batch in batches:
            for *node, ids in zip(*(batch.column(c).to_pylist() for c in (*NODE, "ids")), strict=True):
                if node == now:
                    sha.update(f",{ids}".encode())
                    continue
                if now:
                    done.append([*now, sha.hexdigest()])
                now, sha = node, hashlib.sha256(ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)
                done = []
        if now:
            yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip([*now, sha.hexdigest()], schema)], schema=schema)

    return pieces.repartition(*NODE).sortWithinPartitions(*NODE, "span").select(*NODE, "ids").mapInArrow(run, fields)


def trie(rows: DataFrame, levels: int) -> DataFrame:
    """The nodes of the trie over :func:`sequences` or :func:`rebuilt_sequences`.

    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (null for the root), ``n_convs``, ``n_children``, ``n_leaves`` (childless nodes in the subtree),
    ``saved_tokens`` (bytes of last texts that further members share, summed over the subtree), ``ends_sha256`` and the name (``a``, ``b``).
    """
    rows = materialize(named(rows, levels))
    nodes = materialize(nodes_of(rows))
    lone = F.when(F.col("n_convs") == 1, 1).otherwise(0)
    children = nodes.filter(F.col("depth") > 0).select(*parent_key(), lone.alias("lone")).groupBy(*NODE).agg(F.count(F.lit(1)).alias("n_children"), F.sum("lone").alias("n_lone"))
    known = materialize(nodes.join(children, list(NODE), "left").fillna(0, ["n_children", "n_lone"]))
    shared = known.filter(F.col("n_convs") > 1)
    weight = [(F.col("n_lone") + F.when(F.col("n_children") == 0, 1).otherwise(0)).alias("leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved")]
    totals = subtree_totals(shared.select(*NODE, "cuts", *weight), levels)
    full = known.join(totals, list(NODE), "left").join(ends_of(rows), list(NODE), "left")
    above = nodes.select(*[F.col(c).alias(f"p_{c}") for c in NODE], F.col("conv_id").alias("parent_conv_id"))
    keyed = full.select("*", F.struct(*parent_key()).alias("up"))
    joined = keyed.join(above, [F.col(f"up.{c}") == F.col(f"p_{c}") for c in NODE], "left")
    return joined.select(
        "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", F.coalesce("leaves", F.lit(1)).cast("long").alias("n_leaves"),
        F.coalesce("saved", F.lit(0)).cast("long").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256"), "a", "b",
    )
