"""Katz backoff language model: Good-Turing discounted counts, exactly normalised backoff weights, recursive evaluation per token.

A token's probability after a history is its discounted relative frequency if the n-gram was seen, else the history's backoff weight times the
probability after the history without its oldest token; an unseen history is shortened at no cost. The lowest level gives what discounting took from
the words to one unknown word. Counts up to ``LARGE`` are discounted by Good-Turing (by a constant where the counts of counts do not allow it); larger ones
lose as much as a count of ``LARGE`` does, so that every history keeps weight for what did not follow it.

Texts, n-grams and histories are too many for one row each, so rows hold packed arrays. Blocks of texts ask buckets: a block sends, per bucket of
hashed n-grams, its distinct ones with their counts in its training texts; a bucket's task adds up all blocks' and answers each in the order it asked.
Sums over a history (its count, the weight it keeps, the lower-order weight of what followed it) are gathered likewise: an n-gram is entered by one
block only, its owner, and histories are answered with their backoff weight. So the model is a table partitioned by hash, of which a task sees one
bucket, and hot words cost a bucket no more than a row per block. Words, n-grams and histories are known by 56 bits of a hash.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changelens.llm.common import NO_ID, bucket_of, materialize, texts

LARGE = 5
BLOCK_TOKENS = 3_000_000
BUCKET_GRAMS = 2_000_000
START, END = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
TEXTS = "block long, doc_ids array<long>, lengths array<int>, train array<boolean>, held_out array<boolean>, words binary, vocabulary binary, tokens long"
ASKED = "bucket long, block long, kind int, keys binary, counts binary, kept binary, lower binary"
ANSWERED = "block long, bucket long, kind int, counts binary, weights binary"


def _pack(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(values.tobytes())


def _unpack(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def _pack_planes(values: np.ndarray) -> bytes:
    """32-bit numbers, most of them small, as the plane of their lowest bytes, then the higher ones."""
    return _pack(np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T))


def _unpack_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(_unpack(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    mixed = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b + np.uint64(0xD1B54A32D192ED03))
    mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return mixed ^ (mixed >> np.uint64(31))


def _write_keys(keys: np.ndarray) -> bytes:
    """Sorted 48-bit keys of one bucket: their number, their highest bytes as runs of ones that a zero ends (a bit per key and byte), and 5 bytes each."""
    low = keys.astype("<u8").view(np.uint8).reshape(-1, 8)
    runs = np.ones(len(keys) + 256, bool)
    runs[np.cumsum(np.bincount(low[:, 5], minlength=256)) + np.arange(256)] = False
    return np.uint32(len(keys)).tobytes() + np.packbits(runs).tobytes() + low[:, :5].tobytes()


def _read_keys(data: bytes) -> np.ndarray:
    n = int(np.frombuffer(data, "<u4", 1)[0])
    edge = 4 + (n + 256 + 7) // 8
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, edge - 4, 4), count=n + 256) == 0)
    out = np.zeros((n, 8), np.uint8)
    out[:, :5] = np.frombuffer(data, np.uint8, offset=edge).reshape(-1, 5)
    out[:, 5] = np.repeat(np.arange(256), np.diff(ends, prepend=-1) - 1)
    return out.view("<u8").ravel()


def discounts(counts_of_counts: np.ndarray) -> np.ndarray:
    """What a count of 0 to ``LARGE`` loses, from the numbers of n-grams seen 1 to ``LARGE + 1`` times (index 0 unused)."""
    n = counts_of_counts.astype(np.float64)
    constant = n[1] / (n[1] + 2 * n[2]) if n[1] > 0 and n[2] > 0 else 0.5
    lost = np.full(LARGE + 1, constant)
    lost[0] = 0
    if (n[1:] > 0).all():
        tail = (LARGE + 1) * n[LARGE + 1] / n[1]
        r = np.arange(1, LARGE + 1)
        turing = r - r * ((r + 1) * n[r + 1] / (r * n[r]) - tail) / (1 - tail) if tail < 1 else np.zeros(LARGE)
        if ((turing > 0) & (turing < r)).all():
            lost[1:] = turing
    return lost


class _Block:
    """The texts of a block with their n-grams, and what the buckets answered."""

    def __init__(self, row, order: int, bits: int) -> None:
        self.order, self.bits, self.row = order, bits, row
        vocabulary = np.zeros((len(row.vocabulary) // 7, 8), np.uint8)
        vocabulary[:, 1:] = np.frombuffer(row.vocabulary, np.uint8).reshape(-1, 7)
        self.words = vocabulary.view("<u8").ravel()[_unpack_planes(row.words)]
        self.lengths = np.asarray(row.lengths, np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.trained = np.repeat(np.asarray(row.train, bool), self.lengths)
        at = np.arange(len(self.words)) - np.repeat(self.starts, self.lengths)
        self.histories: list[np.ndarray] = []  # by number of tokens, from 1
        for back in range(1, order):
            before = np.full(len(self.words), START)
            before[back:] = self.words[:-back] if back else self.words
            before[at < back] = START
            self.histories.append(before if back == 1 else _mix(before, self.histories[-1]))

    def grams(self, k: int) -> np.ndarray:
        return (self.words if k == 1 else _mix(self.histories[k - 2], self.words)) >> np.uint64(8)

    def distinct(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.unique(keys, return_index=True, return_inverse=True)

    def ask(self, keys: np.ndarray, kind: int, *values: np.ndarray | None) -> list[tuple]:
        """A row per bucket that has some of the sorted keys."""
        bucket = (keys >> np.uint64(56 - self.bits)).astype(np.int64)
        edges = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True]))) if len(keys) else [0]
        values = (*values, *[None] * (3 - len(values)))
        return [
            (int(bucket[a]), self.row.block, kind, _write_keys48(keys[a:b], self.bits), *[None if v is None else _pack(v[a:b]) for v in values])
            for a, b in zip(edges[:-1], edges[1:], strict=True)
        ]


def _write_keys48(keys: np.ndarray, bits: int) -> bytes:
    """The keys without the bits that the bucket tells, if that leaves at most 48; buckets of fewer than 256 hold whole keys."""
    return _write_keys(keys & np.uint64((1 << 48) - 1)) if bits >= 8 else keys.astype("<u8").tobytes()


def model_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held_out: int = 1) -> DataFrame:
    """Blocks of texts: words as numbers of a vocabulary of the block, whose words are hashes; at most about ``BLOCK_TOKENS`` and one text each."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, first = count(), TaskContext.get().partitionId() * 10_000_000
        known: dict[bytes, int] = defaultdict(count(1).__next__)
        rows: list[tuple] = []
        parts: list[np.ndarray] = []
        size = 0

        def block() -> pd.DataFrame:
            ids, train, out, lengths = zip(*rows, strict=True)
            vocabulary = np.array([int(END), *[xxhash.xxh64_intdigest(word) for word in known]], np.uint64)
            words = np.concatenate(parts)
            often = np.argsort(-np.bincount(words, minlength=len(vocabulary)), kind="stable")  # frequent words get small numbers
            rank = np.empty(len(often), np.uint32)
            rank[often] = np.arange(len(often))
            known_by = np.ascontiguousarray(vocabulary[often].astype("<u8").view(np.uint8).reshape(-1, 8)[:, 1:]).tobytes()
            made = (first + next(number), list(ids), list(lengths), list(train), list(out), _pack_planes(rank[words]), known_by, len(words))
            rows.clear(), parts.clear(), known.clear()
            known.default_factory = count(1).__next__
            return pd.DataFrame([made], columns=[c.split()[0] for c in TEXTS.split(", ")])

        for batch in batches:
            for doc_id, text, train, out in zip(batch.doc_id.tolist(), batch.text, batch.train, batch.held_out, strict=True):
                words = text.encode("utf-8", "replace").lower().split()
                part = np.zeros(len(words) + 1, "<u4")  # the end is word 0
                part[:-1] = np.fromiter(map(known.__getitem__, words), np.uint32, len(words))
                parts.append(part)
                rows.append((doc_id, bool(train), bool(out), len(part)))
                size += len(part)
                if size >= BLOCK_TOKENS:
                    yield block()
                    size = 0
        if rows:
            yield block()

    fold = bucket_of("doc_id", folds)
    marked = texts(docs, id_col, text_col).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "text", F.coalesce(fold != held_out, F.lit(False)).alias("train"), F.coalesce(fold == held_out, F.lit(False)).alias("held_out"))
    return marked.mapInPandas(make, TEXTS)


def _asked_grams(blocks: DataFrame, order: int, bits: int) -> DataFrame:
    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                block = _Block(row, order, bits)
                for k in range(1, order + 1):
                    keys, _, where = block.distinct(block.grams(k))
                    found = np.bincount(where, block.trained, len(keys)).astype("<u4")
                    yield pd.DataFrame(block.ask(keys, k, found), columns=ASKED_COLUMNS)

    return blocks.mapInPandas(ask, ASKED)


ASKED_COLUMNS = [c.split()[0] for c in ASKED.split(", ")]
ANSWERED_COLUMNS = [c.split()[0] for c in ANSWERED.split(", ")]


def _gather(rows: pd.DataFrame, bits: int) -> tuple[np.ndarray, list[int], np.ndarray, np.ndarray]:
    """Number of distinct keys, where each row's keys end, which distinct key each is, and its first place."""
    keys = [_read_keys(data) if bits >= 8 else np.frombuffer(data, "<u8") for data in rows["keys"]]
    distinct, first, where = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
    return len(distinct), np.cumsum([len(k) for k in keys]).tolist(), where, first


def _answered_grams(asked: DataFrame, bits: int) -> DataFrame:
    """Whole counts, and in ``weights`` a bit per n-gram that tells its owner; the rows of block -1 hold counts of counts."""

    def answer(group: pd.DataFrame) -> pd.DataFrame:
        out, bucket = [], int(group.bucket.iloc[0])
        for kind, rows in group.sort_values(["kind", "block"]).groupby("kind"):
            size, ends, where, first = _gather(rows, bits)
            total = np.bincount(where, np.concatenate([_unpack(c, "<u4") for c in rows.counts]), size)
            owner = np.zeros(len(where), bool)
            owner[first] = True
            told, begin = total[where].astype("<u4"), 0
            for block, end in zip(rows.block, ends, strict=True):
                out.append((block, bucket, kind, _pack(told[begin:end]), np.packbits(owner[begin:end]).tobytes()))
                begin = end
            seen = total[total > 0]
            summary = np.concatenate((np.bincount(np.minimum(seen, LARGE + 2).astype(np.int64), minlength=LARGE + 3)[: LARGE + 2], [seen.sum(), len(seen)]))
            out.append((-1, bucket, kind, _pack(summary.astype("<i8")), None))
        return pd.DataFrame(out, columns=ANSWERED_COLUMNS)

    return asked.groupBy("bucket").applyInPandas(answer, ANSWERED)


class Levels:
    """What is the same for all n-grams of an order: losses by count, and for words their number, distinct number and the unknown word's weight."""

    def __init__(self, summaries: dict[int, np.ndarray]) -> None:
        self.lost = {k: discounts(s[: LARGE + 2]) for k, s in summaries.items()}
        words = summaries[1]
        self.tokens, self.distinct = int(words[LARGE + 2]), int(words[LARGE + 3])
        seen = words[1 : LARGE + 1]
        left = (seen * self.lost[1][1:]).sum() + (self.distinct - seen.sum()) * self.lost[1][LARGE]
        self.unknown = float(left / self.tokens) if self.tokens else 1.0

    def kept_back(self, k: int, counts: np.ndarray) -> np.ndarray:
        return self.lost[k][np.minimum(counts, LARGE)]


def _probabilities(block: _Block, levels: Levels, told: dict[int, tuple], upto: int) -> np.ndarray:
    """Probability of every token under the model of order ``upto``; ``told``: what buckets answered by kind."""
    keys, _, where = block.distinct(block.grams(1))
    seen = told[1][0][where].astype(np.float64)
    chance = np.where(seen > 0, (seen - levels.kept_back(1, told[1][0])[where]) / max(levels.tokens, 1), levels.unknown)
    for k in range(2, upto + 1):
        _, _, where = block.distinct(block.grams(k))
        _, _, behind = block.distinct(block.histories[k - 2] >> np.uint64(8))
        seen, kept = told[k][0][where].astype(np.float64), levels.kept_back(k, told[k][0])[where]
        of, weight = told[100 + k][0][behind].astype(np.float64), told[100 + k][1][behind].astype(np.float64)
        chance = np.where(seen > 0, (seen - kept) / np.maximum(of, 1), np.where(of > 0, weight, 1.0) * chance)
    return chance


def _told(rows: pd.DataFrame) -> dict[int, tuple]:
    out = {}
    for kind, group in rows.sort_values("bucket").groupby("kind"):
        counts = [_unpack(c, "<u4") for c in group.counts]
        weights = [np.frombuffer(w, "<f4") if kind > 100 else np.unpackbits(np.frombuffer(w, np.uint8), count=len(c)).astype(bool) for w, c in zip(group.weights, counts, strict=True)]
        out[int(kind)] = (np.concatenate(counts), np.concatenate(weights))
    return out


def _asked_histories(blocks: DataFrame, answers: DataFrame, levels: Levels, k: int, order: int, bits: int) -> DataFrame:
    """Every block's histories of ``k - 1`` tokens with what the n-grams that the block owns add to them."""

    def ask(texts_: pd.DataFrame, answered: pd.DataFrame) -> pd.DataFrame:
        if not len(texts_):
            return pd.DataFrame(columns=ASKED_COLUMNS)
        block = _Block(next(texts_.itertuples()), order, bits)
        told = _told(answered)
        lower = _probabilities(block, levels, told, k - 1)
        _, first, _ = block.distinct(block.grams(k))
        seen, owned = told[k]
        own = owned & (seen > 0)
        keys, _, behind = block.distinct(block.histories[k - 2] >> np.uint64(8))
        at = behind[first[own]]
        add = lambda values: np.bincount(at, values, len(keys))
        rows = block.ask(keys, 100 + k, add(seen[own]).astype("<u4"), add(levels.kept_back(k, seen[own])).astype("<f4"), add(lower[first[own]]).astype("<f8"))
        return pd.DataFrame(rows, columns=ASKED_COLUMNS)

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(ask, ASKED)


def _answered_histories(asked: DataFrame, bits: int) -> DataFrame:
    """Counts of histories and their backoff weights: kept-back weight over the lower-order weight of what did not follow."""

    def answer(group: pd.DataFrame) -> pd.DataFrame:
        out, bucket = [], int(group.bucket.iloc[0])
        rows = group.sort_values("block")
        size, ends, where, _ = _gather(rows, bits)
        of = np.bincount(where, np.concatenate([_unpack(c, "<u4") for c in rows.counts]), size)
        kept = np.bincount(where, np.concatenate([_unpack(c, "<f4") for c in rows.kept]), size)
        lower = np.bincount(where, np.concatenate([_unpack(c, "<f8") for c in rows.lower]), size)
        weight = kept / np.maximum(of, 1) / np.maximum(1 - lower, 1e-12)
        begin = 0
        for block, end in zip(rows.block, ends, strict=True):
            part = where[begin:end]
            out.append((block, bucket, int(rows.kind.iloc[0]), _pack(of[part].astype("<u4")), weight[part].astype("<f4").tobytes()))
            begin = end
        return pd.DataFrame(out, columns=ANSWERED_COLUMNS)

    return asked.groupBy("bucket").applyInPandas(answer, ANSWERED)


def score(docs: DataFrame, order: int = 2, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held_out: int = 1) -> DataFrame:
    """Per row: ``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score`` (log10 of the text's probability).

    The model learns from the rows outside the held-out fold (``crc32(id as text) mod folds``); a null id is neither learned from nor held out. A null or
    empty text is one end token. Words that training does not know are one unknown word. ``base_score`` is the text under add-half word counts.
    Repeated rows count each. Without training rows every token is the unknown word, of probability 1. An empty table gives an empty result; other
    columns are not read.
    """
    blocks = materialize(model_texts(docs, id_col, text_col, folds, held_out))
    tokens = blocks.agg(F.sum("tokens").alias("n")).first()["n"] or 0
    bits = min(24, max(0, math.ceil(math.log2(max(1, tokens * order / BUCKET_GRAMS)))))
    bits = bits if bits == 0 else max(8, bits)
    answers = materialize(_answered_grams(_asked_grams(blocks, order, bits), bits))
    sums: dict[int, np.ndarray] = {k: np.zeros(LARGE + 4, np.int64) for k in range(1, order + 1)}
    for row in _summaries(answers).collect():  # a row per order
        sums[row["kind"]] = np.array(row["s"], np.int64)
    levels = Levels(sums)
    answers = answers.filter("block >= 0")
    for k in range(2, order + 1):
        answers = answers.unionByName(materialize(_answered_histories(_asked_histories(blocks, answers, levels, k, order, bits), bits)))

    def final(texts_: pd.DataFrame, answered: pd.DataFrame) -> pd.DataFrame:
        if not len(texts_):
            return pd.DataFrame(columns=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
        row = next(texts_.itertuples())
        block, told = _Block(row, order, bits), _told(answered)
        _, _, where = block.distinct(block.grams(1))
        seen = told[1][0][where].astype(np.float64)
        base = np.log10((seen + 0.5) / (levels.tokens + 0.5 * (levels.distinct + 1)))
        model = np.log10(_probabilities(block, levels, told, order))
        add = lambda values: np.add.reduceat(values, block.starts)
        out = {"doc_id": row.doc_ids, "held_out": row.held_out, "n_tokens": block.lengths, "n_known": add((seen > 0).astype(np.int64))}
        return pd.DataFrame(out | {"train_tokens": levels.tokens, "base_score": add(base), "score": add(model)})

    scored = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(
        final, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
    return scored.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))


def _summaries(answers: DataFrame) -> DataFrame:
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(int(kind), at, int(value)) for kind, counts in zip(batch.kind, batch.counts, strict=True) for at, value in enumerate(_unpack(counts, "<i8"))]
            yield pd.DataFrame(rows, columns=["kind", "at", "value"])

    told = answers.filter("block = -1").select("kind", "counts").mapInPandas(read, "kind int, at int, value long")
    summed = told.groupBy("kind", "at").agg(F.sum("value").alias("value"))
    return summed.groupBy("kind").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]).alias("s"))
