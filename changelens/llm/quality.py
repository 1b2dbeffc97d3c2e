"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics come from one pass over the whole text. Trees are grown on a bounded sample of labelled documents (``max_train`` rows of narrow
numbers, so they fit the driver whatever the corpus is), with binned features and Newton leaves, and are flattened into arrays, one row of nodes
per tree, which tasks walk level by level for a whole batch with numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changelens.llm.common import bucket_of, texts

#: Bytes counted together; each group gives its share of all bytes.
GROUPS = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" ", b"\n\t\r", b".", b",", b"!", b"?", b"#*&$%@^~+=", b"|<>{}[]\\_", b"'\"():;-/")
FEATURES = (
    "log_chars", "log_words", "word_length", "word_length_spread", "distinct_words", "repeated_words", "top_word", "log_lines", "distinct_lines",
    "line_length", "capital_words", "odd_words", "first_pair_share", "non_ascii", *(f"group_{i}" for i in range(len(GROUPS))),
)


def statistics(values: list[str]) -> np.ndarray:
    """One row of :data:`FEATURES` per whole text; an empty text gives zeros."""
    table = np.zeros((len(values), len(FEATURES)))
    for row, text in zip(table, values, strict=True):
        words = text.split()
        if not words:
            continue
        counts = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
        total, n = counts.sum(), len(words)
        lengths = np.fromiter(map(len, words), np.int64, n)
        tally: dict[str, int] = {}
        for word in words:
            tally[word] = tally.get(word, 0) + 1
        lines = text.split("\n")
        row[:14] = (
            np.log1p(len(text)), np.log1p(n), lengths.mean(), lengths.std(), len(tally) / n, sum(map(str.__eq__, words, words[1:])) / n,
            max(tally.values()) / n, np.log1p(len(lines)), len(set(lines)) / len(lines), len(text) / len(lines),
            sum(map(str.isupper, words)) / n, 1 - sum(map(str.isalpha, words)) / n, len(set(zip(words, words[1:]))) / n, counts[128:].sum() / total,
        )
        row[14:] = [counts[np.frombuffer(group, np.uint8)].sum() / total for group in GROUPS]
    return table


@dataclass(frozen=True)
class Trees:
    """Complete binary trees: node ``i`` of a tree has the children ``2 i + 1`` and ``2 i + 2``; a node that was not split sends all to the left."""

    start: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def score(self, table: np.ndarray) -> np.ndarray:
        margin, rows = np.full(len(table), self.start), np.arange(len(table))
        depth = int(np.log2(self.leaf.shape[1])) if len(self.leaf) else 0
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(table), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (table[rows, feature[node]] > threshold[node])
            margin += leaf[node - (2**depth - 1)]
        return 1 / (1 + np.exp(-margin))


def grow(table: np.ndarray, label: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.1, bins: int = 64, smooth: float = 1.0, least: int = 5) -> Trees:
    """Boosted trees for the log loss; without rows the score is 0.5, with one class its smoothed share."""
    share = (label.sum() + 0.5) / (len(label) + 1)
    start = float(np.log(share / (1 - share)))
    nodes = 2**depth - 1
    empty = Trees(start, np.zeros((0, nodes), np.int64), np.zeros((0, nodes)), np.zeros((0, nodes + 1)))
    if len(label) == 0 or label.min() == label.max():
        return empty
    edges = [np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1])) for column in table.T]
    binned = np.stack([np.searchsorted(edge, column, side="left") for edge, column in zip(edges, table.T, strict=True)], axis=1)
    margin = np.full(len(label), start)
    out = [[], [], []]
    for _ in range(trees):
        chance = 1 / (1 + np.exp(-margin))
        slope, curve = chance - label, chance * (1 - chance)
        feature, threshold = np.zeros(nodes, np.int64), np.full(nodes, np.inf)
        at = np.zeros(len(label), np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            best = np.full(width, 1e-9)
            cut = np.full(width, -1)
            for f, edge in enumerate(edges):
                if len(edge) == 0:
                    continue
                key, size = (at - first) * (bins + 1) + binned[:, f], width * (bins + 1)
                g, h, c = (np.bincount(key, weight, size).reshape(width, bins + 1).cumsum(1) for weight in (slope, curve, None))
                all_g, all_h, all_c = g[:, -1:], h[:, -1:], c[:, -1:]
                gain = g**2 / (h + smooth) + (all_g - g) ** 2 / (all_h - h + smooth) - all_g**2 / (all_h + smooth)
                gain[(c < least) | (all_c - c < least)] = 0
                gain = gain[:, : len(edge)]
                top = gain.argmax(1)
                better = gain[np.arange(width), top] > best
                best[better] = gain[np.arange(width), top][better]
                feature[first : first + width][better] = f
                cut[better] = top[better]
            threshold[first : first + width] = [edges[feature[first + i]][cut[i]] if cut[i] >= 0 else np.inf for i in range(width)]
            at = 2 * at + 1 + (table[np.arange(len(label)), feature[at]] > threshold[at])
        at -= nodes
        g, h = np.bincount(at, slope, nodes + 1), np.bincount(at, curve, nodes + 1)
        leaf = -rate * g / (h + smooth)
        margin += leaf[at]
        for kept, new in zip(out, (feature, threshold, leaf), strict=True):
            kept.append(new)
    return Trees(start, *map(np.stack, out))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 5, held_out: int = 0, max_train: int = 20_000) -> Trees:
    """Trees from the labelled documents outside the held-out fold (``crc32(id as text) mod folds``).

    At most about ``max_train`` labels take part: all if there are fewer, else those whose hash falls below their share. Null labels and ids are not
    used; of several labels of a document the smallest counts, of several documents with one id the first in the order of their statistics.
    """
    known = labels.filter(F.col(label_col).isNotNull() & (bucket_of(id_col, folds) != held_out)).groupBy(F.col(id_col).alias("doc_id")).agg(F.min(label_col).alias("label"))
    count = known.count()
    if count > max_train:
        known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * max_train / count))
    sample = texts(docs, id_col, text_col).join(F.broadcast(known), "doc_id")  # at most about max_train pairs of numbers

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch.doc_id, "label": batch.label.astype("float64"), "x": list(statistics(batch.text.tolist()))})

    rows = sample.mapInPandas(measure, "doc_id long, label double, x array<double>").groupBy("doc_id").agg(F.min(F.struct("label", "x")).alias("r")).orderBy("doc_id").select("r.*").toPandas()
    return grow(np.array(rows.x.tolist()).reshape(len(rows), len(FEATURES)), rows.label.to_numpy())


def score_of(trees: Trees, text: Column) -> Column:
    """The score of every whole text, 0 to 1 (higher: label 1 likelier); null counts as empty."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(trees.score(statistics(batch.fillna("").tolist())))

    return score(text)


def classify(docs: DataFrame, trees: Trees, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held_out: int = 0, accept: float = 0.3) -> DataFrame:
    """Per row: ``doc_id``, ``held_out``, ``score``, ``predicted`` (1 from a score of ``accept`` on).

    Every row gets a score, also empty and null texts and repeated rows; a null id is not held out. Other columns are not read.
    """
    scored = texts(docs, id_col, text_col).select("doc_id", F.coalesce(bucket_of("doc_id", folds) == held_out, F.lit(False)).alias("held_out"), score_of(trees, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= accept).cast("int"))
