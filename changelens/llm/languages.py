"""Language identification with bit-sliced Bloom filters of character n-grams.

Every language has a Bloom filter of the n-grams that are usual in its documents. The filters have one size and one set of hash functions and lie
beside each other as slices: word ``i`` of the table (several words above 64 languages) holds bit ``i`` of every language's filter. The AND of the words at an n-gram's positions is
the mask of all languages that contain it. Popcounts of the masks' slices over a whole text give a share of known n-grams per language; the share
that a filter's false positives alone would give is taken out; the largest share decides.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changelens.llm.common import bucket_of, texts

SPACE = 32
STEP = np.uint64(0x9E3779B97F4A7C15)
BATCH = 1 << 18


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def letters_of(text: str) -> np.ndarray:
    """Lower-case code points with one space for every run of other characters and at both ends; no letter: empty."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    spaces = ~_letters()[codes]
    kept = np.where(spaces, np.uint32(SPACE), codes)[~spaces | ~np.concatenate(([False], spaces[:-1]))]
    return kept if len(kept) > 1 else kept[:0]


def grams(codes: np.ndarray, sizes: tuple[int, ...]) -> Iterator[tuple[int, np.ndarray]]:
    """For every size the 64-bit hash of the n-gram that starts at each position."""
    wide = codes.astype(np.uint64)
    rolled = wide
    for size in range(1, max(sizes) + 1):
        if size > 1:
            rolled = rolled[:-1] * STEP + wide[size - 1 :] if len(rolled) > 1 else rolled[:0]
        if size in sizes:
            mixed = rolled + np.uint64(size * 0xD1B54A32D192ED03 % 2**64)
            mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            yield size, mixed ^ (mixed >> np.uint64(29))


@dataclass(frozen=True)
class Filters:
    languages: tuple[str, ...]
    sizes: tuple[int, ...]
    hashes: int
    table: np.ndarray

    @staticmethod
    def build(known: dict[str, np.ndarray], sizes: tuple[int, ...], hashes: int = 2, bits_per_gram: int = 16) -> Filters:
        """``known``: the n-gram hashes of each language."""
        largest = max(map(len, known.values()), default=1)
        size = 1 << max(10, int(np.ceil(np.log2(largest * bits_per_gram + 1))))
        table = np.zeros((-(-len(known) // 64) or 1, size), np.uint8 if len(known) <= 8 else np.uint64)
        for slice_, language in enumerate(sorted(known)):
            for at in Filters._places(known[language], size, hashes):
                np.bitwise_or.at(table[slice_ // 64], at, table.dtype.type(1 << slice_ % 64))
        return Filters(tuple(sorted(known)), sizes, hashes, table)

    @staticmethod
    def _places(hashed: np.ndarray, size: int, hashes: int) -> list[np.ndarray]:
        other = (hashed >> np.uint64(32)) | np.uint64(1)
        return [((hashed + np.uint64(k) * other) & np.uint64(size - 1)).astype(np.int64) for k in range(hashes)]

    def shares(self, values: list[np.ndarray]) -> np.ndarray:
        """Per text (as :func:`letters_of` gives it) and language the share of its n-grams that the language has, without false positives."""
        ends = np.cumsum([len(v) for v in values], dtype=np.int64)
        starts = ends - np.array([len(v) for v in values], np.int64)
        found, asked = np.zeros((len(values), len(self.languages))), np.zeros(len(values))
        for size, hashed in grams(np.concatenate(values), self.sizes):
            places = self._places(hashed, self.table.shape[1], self.hashes)
            last = np.maximum(ends - size + 1, starts)  # n-grams that would run into the next text do not count
            asked += last - starts
            for word, slices in enumerate(self.table):
                mask = slices[places[0]]
                for at in places[1:]:
                    mask = mask & slices[at]
                for slice_ in range(64 * word, min(64 * word + 64, len(self.languages))):
                    sums = np.concatenate(([0], np.cumsum((mask >> mask.dtype.type(slice_ % 64)) & mask.dtype.type(1), dtype=np.int64)))
                    found[:, slice_] += sums[np.minimum(last, len(mask))] - sums[np.minimum(starts, len(mask))]
        bit = lambda s: (self.table[s // 64] >> self.table.dtype.type(s % 64)) & self.table.dtype.type(1)
        wrong = np.array([np.mean(bit(s)) for s in range(len(self.languages))]) ** self.hashes
        return np.clip((found / np.maximum(asked, 1)[:, None] - wrong) / np.maximum(1 - wrong, 1e-9), 0, 1)

    def predict(self, values: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language (``und`` without a letter or without any learned language) and score per text."""
        names, scores = ["und"] * len(values), np.zeros(len(values))
        waiting: list[tuple[int, np.ndarray]] = []

        def decide() -> None:
            shares = self.shares([codes for _, codes in waiting]) if waiting else []
            for (row, _), share in zip(waiting, shares, strict=True):
                best = int(share.argmax())  # of equal shares the first name
                names[row] = self.languages[best]
                scores[row] = share[best]
            waiting.clear()

        size = 0
        for row, text in enumerate(values):
            codes = letters_of(text or "")
            if len(codes) and self.languages:
                waiting.append((row, codes))
                size += len(codes)
                if size >= BATCH:
                    decide()
                    size = 0
        decide()
        return names, scores


def per_language(values: dict[str, float], kind: str) -> Column:
    """The value of each row's language."""
    return F.element_at(F.from_json(F.lit(json.dumps(values)), f"map<string, {kind}>"), F.col("lang"))


def fit(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, held_out: int = 2,
    sizes: tuple[int, ...] = (2, 3, 4), usual: float = 0.01, near_best: float = 0.1, max_train: int = 20_000,
) -> Filters:
    """Filters from the documents with a language outside the held-out fold (``crc32(id as text) mod folds``).

    Of each language at most about ``max_train`` documents take part: all if it has fewer, else those whose hashed id falls below their share. So a rare
    language is learned from the same documents however many others there are. A language has an
    n-gram if at least ``usual`` of its documents hold it and the share is at least ``near_best`` of the largest among the languages: so at most
    a document's number of n-grams divided by ``usual`` reach the driver per language, however many documents there are.
    """
    known = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (bucket_of(id_col, folds) != held_out))
    known = known.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    number = {row["lang"]: row["count"] for row in known.groupBy("lang").count().collect()}  # a row per language
    if any(n > max_train for n in number.values()):
        known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(10**12)) < per_language({lang: min(10**12, 10**12 * max_train // n) for lang, n in number.items()}, "long"))
        number = {row["lang"]: row["count"] for row in known.groupBy("lang").count().collect()}

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, group in batch.groupby("lang"):
                own = [np.unique(np.concatenate([h for _, h in grams(letters_of(text), sizes)])) for text in group.text]
                gram, found = np.unique(np.concatenate(own), return_counts=True)
                yield pd.DataFrame({"lang": lang, "gram": gram.view(np.int64), "found": found})

    counted = known.select("lang", "text").mapInPandas(tally, "lang string, gram long, found long").groupBy("lang", "gram").agg(F.sum("found").alias("found"))
    least = per_language({lang: max(2.0, usual * n) for lang, n in number.items()}, "double")
    rows = counted.filter(F.col("found") >= least).toPandas()
    rows["share"] = rows.found / rows.lang.map(number)
    rows = rows[rows.share >= near_best * rows.groupby("gram").share.transform("max")] if len(rows) else rows
    return Filters.build({lang: rows.gram[rows.lang == lang].to_numpy(np.int64).view(np.uint64) for lang in number}, sizes)


def predict_of(filters: Filters, text: Column) -> Column:
    """Struct ``lang_pred``, ``score`` of every whole text; the score is the winner's own share, 0 to 1, whatever other languages there are."""

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            names, scores = filters.predict([v if isinstance(v, str) else None for v in batch])
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    return predict(text)


def identify(docs: DataFrame, filters: Filters, id_col: str = "doc_id", text_col: str = "text", folds: int = 4, held_out: int = 2) -> DataFrame:
    """Per row: ``doc_id``, ``held_out``, ``lang_pred``, ``score``.

    A null or empty text, or one without a letter, is ``und`` with score 0; so is every text if nothing was learned. Of equal shares the first
    name wins. A null id is not held out. Repeated rows are judged each; other columns are not read.
    """
    judged = texts(docs, id_col, text_col).select("doc_id", F.coalesce(bucket_of("doc_id", folds) == held_out, F.lit(False)).alias("held_out"), predict_of(filters, F.col("text")).alias("p"))
    return judged.select("doc_id", "held_out", "p.lang_pred", "p.score")
