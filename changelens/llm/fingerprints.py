"""Document fingerprints: one-permutation MinHash with optimal densification, packed low-order bits and bias correction.

Every shingle is hashed once; the top bits of the hash name a bin and a bin keeps its smallest hash. An empty bin takes the value of the first filled
bin in an order of its own (a fixed random permutation per bin), so two texts that fill the same bins borrow alike. The low ``BITS`` bits of every
bin are packed into a hex string. Two unrelated bins agree by chance with probability ``2 ** -BITS``; the likeness takes that out.

Only DataFrame functions are used, and a fingerprint needs no shuffle: a row's shingles are hashed, sorted and reduced to bins inside the row.
"""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changelens.llm.common import let, materialize, shingle_hashes, texts, tokens

BINS, BITS = 256, 4
#: So many places of the order are looked at one by one; if all are empty, the first filled bin of the order is the least of the filled ones.
FIRST_TRIES = 8
#: Rows of a range of ids, and the most ranges there are.
RANGE_ROWS, MOST_RANGES = 500, 20_000


def _orders(bins: int) -> tuple[Column, Column, Column]:
    """Step, start and inverse step of the order in which each bin looks at all bins: an odd step visits every one of a power of two once."""
    made = [random.Random(f"densify {bins} {i}") for i in range(bins)]
    steps = [2 * r.randrange(bins // 2) + 1 for r in made]
    column = lambda values: F.lit(np.array(values, np.int32))
    return column(steps), column([r.randrange(bins) for r in made]), column([pow(a, -1, bins) for a in steps])


def fingerprint(text: Column, size: int = 5, bins: int = BINS) -> Column:
    """Hex digits of the packed bins, ``BITS`` bits each; a text without a word has only zeros. Equal texts have equal fingerprints."""
    width = 64 - int(math.log2(bins))
    nothing = 2**width - 1
    step, start, inverse = _orders(bins)
    empty_bins = F.lit(np.array([(b << width) - 2**63 + nothing for b in range(bins)], np.int64))  # the largest hash of each bin stands for none

    def one_per_bin(ordered: Column) -> Column:
        """The smallest hash of every bin, in the order of the bins."""
        bin_of = lambda h: F.shiftright(h, width)
        return F.filter(ordered, lambda h, i: (i == 0) | (bin_of(h) != bin_of(F.get(ordered, i - 1))))

    filled = lambda h: h.bitwiseAND(nothing) != nothing

    def borrowed(held: Column, kept: Column, i: Column) -> Column:
        a, b, c = F.get(step, i), F.get(start, i), F.get(inverse, i)
        look = lambda k: let(F.get(held, (a * k + b) % bins), lambda h: F.when(filled(h), h))
        turn = lambda h: F.pmod((F.shiftright(h, width).cast("int") + bins // 2 - b) * c, F.lit(bins))
        return F.coalesce(*[look(F.lit(k)) for k in range(FIRST_TRIES)], F.array_min(F.transform(kept, lambda h: F.struct(turn(h), h.alias("h"))))["h"])

    def digits(held: Column) -> Column:
        bits = lambda kept: lambda h, i: F.when(filled(h), h).otherwise(borrowed(held, kept, i)).bitwiseAND(2**BITS - 1)
        low = let(F.filter(held, filled), lambda kept: F.transform(held, bits(kept)))
        return F.array_join(F.transform(low, lambda v: F.lower(F.hex(v))), "")

    def packed(hashes: Column) -> Column:
        ordered = F.sort_array(F.concat(hashes, empty_bins))
        return F.when(F.size(hashes) == 0, F.lit("0" * bins)).otherwise(let(let(ordered, one_per_bin), digits))

    return let(shingle_hashes(tokens(text), size), packed)


def likeness(a: Column, b: Column, bins: int = BINS) -> Column:
    """Estimated Jaccard similarity of two fingerprints' shingle sets: the share of equal digits without the chance ones, 0 to 1."""
    part = lambda s, i: F.conv(F.substring(s, i * 16 + 1, F.lit(16)), 16, -10).cast("long")
    unlike = lambda x: F.bit_count(
        x.bitwiseOR(F.shiftright(x, 1)).bitwiseOR(F.shiftright(x, 2)).bitwiseOR(F.shiftright(x, 3)).bitwiseAND(F.lit(0x1111111111111111))
    )
    count = F.aggregate(F.sequence(F.lit(0), F.lit(bins // 16 - 1)), F.lit(0), lambda n, i: n + let(part(a, i).bitwiseXOR(part(b, i)), unlike))
    chance = 2.0**-BITS
    return F.greatest(F.lit(0.0), ((bins - count) / F.lit(float(bins)) - chance) / (1 - chance))


def _numbers(values: list, kind: str) -> Column:
    """A list of numbers as one constant, however long it is."""
    return F.when(F.lit(bool(values)), F.split(F.lit(",".join(map(repr, values)) or "0"), ",").cast(f"array<{kind}>")).otherwise(F.array().cast(f"array<{kind}>"))


def _smaller(cuts: list[int], key: Column) -> Column:
    """How many of the ascending ``cuts`` are below ``key``, by halving."""
    known, steps = _numbers(cuts, "bigint"), [1 << k for k in reversed(range(len(cuts).bit_length()))]
    if not cuts:
        return F.lit(0).cast("long")
    forward = lambda at, step: F.when(F.get(known, at + step - 1) < key, at + step).otherwise(at)
    return F.aggregate(_numbers(steps, "int"), F.lit(0), forward).cast("long")


def with_next(docs: DataFrame, columns: list[str], range_rows: int = RANGE_ROWS) -> DataFrame:
    """Every row with ``next``, a struct of ``columns`` of the row that follows it by descending ``doc_id``; after the last comes the first.

    Rows of one id follow each other by a hash of their texts; a null id comes last. Ids are cut at their quantiles into ranges of about ``range_rows`` rows (so that a task
    gets many and tasks are alike; more rows each beyond :data:`MOST_RANGES`), which are sorted apart; the first row of a range is also sent to the range before it. What is known of the ranges, a narrow row
    each, is broadcast. So each row moves once and no task sees all.
    """
    key = F.coalesce(F.col("doc_id"), F.lit(-(2**63)).cast("long"))
    parts = max(2, min(MOST_RANGES, math.ceil(docs.count() / range_rows)))
    found = docs.select(F.percentile_approx(key, _numbers([i / parts for i in range(1, parts)], "double"), F.lit(10 * parts)).alias("c")).first()["c"] or []
    cuts = sorted(set(found))  # where the ranges end; an id that ends two of them has ranges of its own, cut by its texts' keys
    often = [c for c, n in Counter(found).items() if n > 1]
    split = F.when(F.array_contains(_numbers(often, "bigint"), key), 64 + 32 + F.shiftright("text_key", 58)).otherwise(F.lit(0).cast("long"))
    ranged = docs.withColumn("range", _smaller(cuts, key) * 128 + split)
    tops = ranged.groupBy("range").agg(F.max(F.struct(key.alias("k"), "text_key")).alias("top"))
    upper = F.lead("range").over(Window.orderBy("range"))  # the first of all goes behind the last
    told = materialize(tops.select("range", "top", F.coalesce(upper, F.min("range").over(Window.partitionBy())).alias("upper")))
    known = ranged.join(F.broadcast(told), "range")
    is_top = (key == F.col("top.k")) & (F.col("text_key") == F.col("top.text_key"))
    own = F.struct(F.col("range").alias("to"), F.lit(0).alias("lent"))
    lent = F.struct(F.col("upper").alias("to"), F.lit(1).alias("lent"))
    sent = known.withColumn("s", F.explode(F.when(is_top, F.array(own, lent)).otherwise(F.array(own)))).withColumns({"to": F.col("s.to"), "lent": F.col("s.lent")})
    window = Window.partitionBy("to").orderBy("lent", F.desc_nulls_last("doc_id"), F.desc("text_key"))
    return sent.withColumn("next", F.lead(F.struct(*columns)).over(window)).filter("lent = 0").drop("range", "top", "upper", "s", "to", "lent")


def edited(text: Column, n_chars: Column, following: Column) -> Column:
    """The text with its last third (rounded down) replaced by as many first code points of another text, or all it has."""
    third = F.floor(n_chars / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), (n_chars - third).cast("int")), F.substring(following, F.lit(1), third))


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id``, ``n_chars``, ``fingerprint`` and ``next`` (its text and fingerprint), plus ``text``.

    Null texts are empty ones; an empty table gives an empty result; the only row follows itself. Repeated rows are fingerprinted each. Other
    columns are not read.
    """
    own = texts(docs, id_col, text_col).withColumn("n_chars", F.length("text").cast("long")).withColumn("text_key", F.xxhash64("text"))
    return with_next(own.withColumn("fingerprint", fingerprint(F.col("text"))), ["text", "fingerprint"])
