"""Best-two-fit packing of token sequences into bins of one capacity.

Documents become token ids and, if longer than the capacity, pieces of just the capacity, of which the first may be shorter. A bin is filled
greedily with the largest piece that still fits; then its smallest piece is taken out again and, if two unpacked pieces fill the gap that leaves more
tightly, they take its place. Pieces of one length are interchangeable, so a bin is found on a table of how many pieces of each length are left;
which document gets which place is settled when the lengths are dealt out.

Pieces that fill a bin alone need no search. The others are dealt by a hash of (document, piece) into blocks of about ``block_pieces`` and every block
is packed by one task: a block has at most about ``block_pieces`` narrow rows at any size of the corpus, and only its last bins are less than full.
"""

from __future__ import annotations

import json
import math
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changelens.llm.common import NO_ID, materialize, texts

#: So many texts are cut into words at once.
SLICE = 500
#: Texts that are not simply words after single spaces.
UNEVEN = re.compile(r" (\s|\Z)|\0")
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


#: The pre-tokens of a byte-level BPE vocabulary. A fixed value.
PRE_TOKENS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Encoder:
    """Token ids of whole texts as little-endian unsigned 32-bit bytes, equal to what the library of the vocabulary file gives.

    The vocabulary's pre-tokens never span the place before a space that a visible character follows, so a text is cut there and the ids of a
    cut word are kept for its next occurrence. At most about ``keep`` words are kept; then the store starts anew. New words go through the merge
    ranks of the same file, which costs a fraction of the library's call; texts with an added token, and files of another kind, go to the library.
    """

    def __init__(self, path: str, keep: int = 400_000) -> None:
        from tokenizers import Tokenizer

        self.tokenizer, self.keep, self.known = Tokenizer.from_file(path), keep, {}
        self.added = re.compile("|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()) or r"(?!)")
        self.ranked = self._ranked(path)

    def _ranked(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            said = json.load(file)
        model, before = said["model"], said.get("pre_tokenizer") or {}
        if model["type"] != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or said.get("normalizer"):
            return None
        merged = [model["vocab"].get("".join(m.split(" ") if isinstance(m, str) else m), -1) for m in model["merges"]]
        if merged != sorted(merged) or -1 in merged:
            return None
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow from 256 on
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
        ranks = {bytes(map(byte_of.__getitem__, token)): rank for token, rank in model["vocab"].items() if not self.added.fullmatch(token)}
        return tiktoken.Encoding("ranked", pat_str=PRE_TOKENS, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode(self, values: list[str]) -> list[bytes]:
        if self.ranked is None:
            return [np.array(found.ids, "<u4").tobytes() for found in self.tokenizer.encode_batch(values, add_special_tokens=False)]
        cut = [self.words(text) for text in values]
        if len(self.known) > self.keep:
            self.known.clear()
        new = list(set().union(*cut) - self.known.keys())
        found = [*map(self.ranked, new)]
        flat = np.fromiter(chain.from_iterable(found), "<u4").tobytes()
        ends = [0, *accumulate(4 * len(ids) for ids in found)]
        self.known.update(zip(new, map(flat.__getitem__, map(slice, ends, ends[1:])), strict=True))
        out = [b"".join(map(self.known.__getitem__, words)) for words in cut]
        for row, text in enumerate(values):
            if self.added.search(text):
                out[row] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return out

    @staticmethod
    def words(text: str) -> list[str]:
        if not UNEVEN.search(text):
            return text.replace(" ", "\0 ").split("\0")
        out = [""]  # runs of white space stay with what is before them
        for number, word in enumerate(text.split(" ")):
            if number and (not word or word[0].isspace()):
                out[-1] += f" {word}"
            else:
                out.append(f" {word}" if number else word)
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Encoder(path)


def cut(ids: bytes, capacity: int) -> Iterator[tuple[int, bytes]]:
    """(start, ids) of the pieces: one, or full ones after a first that holds what is over."""
    n = len(ids) // 4
    ends = range(n % capacity or min(n, capacity), n + 1, capacity)
    start = 0
    for end in ends:
        yield start, ids[4 * start : 4 * end]
        start = end


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row per piece: ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32`` and, if wanted, ``ids`` (array of ints).

    A null or empty text is one piece of the end id. ``tokenizer`` is the path of a vocabulary file that every executor has.
    """

    kept = ", ids: array<int>" if keep_ids else ""

    @F.pandas_udf(f"array<struct<start: bigint, length: bigint, ids_crc32: bigint{kept}>>")
    def make(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        made, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            values, out = batch.tolist(), []
            for first in range(0, len(values), SLICE):
                for ids in made.encode(values[first : first + SLICE]):
                    parts = cut(ids + end, capacity)
                    out.append([{"start": start, "length": len(part) // 4, "ids_crc32": zlib.crc32(part)} | ({"ids": np.frombuffer(part, "<i4")} if keep_ids else {}) for start, part in parts])
            yield pd.Series(out)

    made = texts(docs, id_col, text_col).select("doc_id", F.posexplode(make("text")).alias("piece", "p"))
    return made.select("doc_id", "piece", "p.*")


def best_two_fit(counts: np.ndarray) -> Iterator[tuple[tuple[int, ...], int]]:
    """Bins as (lengths, how many such bins) until ``counts`` (pieces by length, index 0 unused) is used up; ``len(counts) - 1`` is the capacity."""
    left, capacity = counts.copy(), len(counts) - 1
    while True:
        lengths = np.flatnonzero(left)
        if len(lengths) == 0:
            return
        free = left.copy()  # what is left beside this bin
        inside, room = [], capacity
        while room:
            fitting = np.flatnonzero(free[: room + 1])
            if len(fitting) == 0:
                break
            take = int(fitting[-1])
            inside.append(take)
            free[take] -= 1
            room -= take
        if room and len(inside) > 1:
            smallest = inside[-1]
            gap = room + smallest
            pair = _tightest_pair(free, gap)
            if pair and sum(pair) > smallest:
                inside[-1:] = pair
        uses = np.bincount(inside, minlength=capacity + 1)
        times = int((left[uses > 0] // uses[uses > 0]).min())
        left -= times * uses
        yield tuple(inside), times


def _tightest_pair(free: np.ndarray, gap: int) -> list[int]:
    """Two lengths left in ``free`` with the largest sum up to ``gap``; of equal sums the one with the longest piece."""
    here = np.flatnonzero(free[: gap + 1])
    if len(here) == 0:
        return []
    place = np.maximum.accumulate(np.where(free[: gap + 1] > 0, np.arange(min(gap + 1, len(free))), 0))
    partner = place[gap - here]
    same = (partner == here) & (free[here] < 2)
    partner[same] = place[here[same] - 1]
    total = np.where(partner > 0, here + partner, 0)
    best = int(total.argmax())
    return sorted((int(here[best]), int(partner[best])), reverse=True) if total[best] else []


def _pack_block(block: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """``sequence_id`` (from 0 in the block) and ``offset`` for the pieces of one block."""
    block = block.sort_values(["length", "doc_id", "piece", "start"], kind="stable", ignore_index=True)
    lengths = block.length.to_numpy()
    counts = np.bincount(lengths, minlength=capacity + 1)
    next_row = np.concatenate(([0], np.cumsum(counts)[:-1]))
    sequence, offset, number = np.zeros(len(block), np.int64), np.zeros(len(block), np.int64), 0
    for inside, times in best_two_fit(counts):
        at = 0
        for length in inside:
            rows = slice(next_row[length], next_row[length] + times)
            sequence[rows], offset[rows] = np.arange(number, number + times), at
            next_row[length] += times
            at += length
        number += times
    return block.assign(sequence_id=sequence, offset=offset)


def pack(pieces: DataFrame, capacity: int = 1024, block_pieces: int = 25_000) -> DataFrame:
    """``pieces`` (as :func:`pieces` makes them, ``ids`` not needed) with ``sequence_id`` and ``offset``: gapless sequences up to ``capacity``.

    ``pieces`` is read twice, so materialise it before. Sequence ids are unique numbers without further meaning. Repeated rows are pieces
    of their own; an empty table gives an empty result. The result depends on the rows only, not on their order.
    """
    part = pieces.select("doc_id", "piece", "start", "length", "ids_crc32")
    count = part.filter(F.col("length") < capacity).count()
    blocks = max(1, math.ceil(count / block_pieces))
    dealt = part.filter(F.col("length") < capacity).withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID))).withColumn("block", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(blocks)))
    schema = f"{PIECES}, sequence_id long, offset long"

    def run(block: pd.DataFrame) -> pd.DataFrame:
        number = int(block.block.iloc[0])
        packed = _pack_block(block, capacity)
        packed["sequence_id"] = packed.sequence_id * blocks + number
        return packed.drop(columns="block")

    packed = dealt.groupBy("block").applyInPandas(run, schema).withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))
    full = part.filter(F.col("length") == capacity).select("*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(full)


def sequences(pieces: DataFrame, packed: DataFrame) -> DataFrame:
    """The packed token ids: ``sequence_id``, ``ids`` and the ``doc_ids`` and ``starts`` of its parts; a sequence has at most capacity tokens."""
    keys = ["doc_id", "piece", "start", "ids_crc32"]
    one = pieces.select(*keys, "ids").dropDuplicates(keys).alias("o")
    same = [F.col(f"k.{c}").eqNullSafe(F.col(f"o.{c}")) for c in keys]
    joined = packed.alias("k").join(one, same[0] & same[1] & same[2] & same[3]).select("k.sequence_id", "k.offset", "k.doc_id", "o.ids")
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return joined.groupBy("sequence_id").agg(parts.alias("p")).select(
        "sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.doc_id").alias("doc_ids"), F.col("p.offset").alias("starts")
    )


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", block_pieces: int = 25_000) -> DataFrame:
    """Pieces of all documents with their places; see :func:`pieces` and :func:`pack`."""
    return pack(materialize(pieces(docs, tokenizer, capacity, end_id, id_col, text_col)), capacity, block_pieces)
