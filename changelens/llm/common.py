"""Column and DataFrame helpers that several operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from changelens.operators.grouping import materialize, shared_folder

__all__ = ["NO_ID", "bucket_of", "filled", "fold_words", "let", "materialize", "read", "shared_folder", "shingle_hashes", "texts", "tokens", "unused"]


#: Stands for a null id where rows pass through pandas, which has no null in a column of exact integers.
NO_ID = -(2**63)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def filled(column: str | Column) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only ``doc_id`` and ``text`` (null: empty), so columns of any other name cannot clash."""
    return docs.select(F.col(id_col).alias("doc_id"), filled(text_col).alias("text"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, also where ``body`` uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def bucket_of(id_col: str, n: int) -> Column:
    """``crc32(id as text) mod n``; null where the id is null."""
    return F.crc32(F.col(id_col).cast("string")) % n


def fold_words(text: Column) -> Column:
    """Lower-case text in which every run of characters that are no letters or digits is one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def tokens(text: Column) -> Column:
    """The words of :func:`fold_words`; no word: an empty array."""
    return let(fold_words(text), lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, " ")))


def shingle_hashes(words: Column, size: int = 5) -> Column:
    """64-bit hashes of all runs of ``size`` words, in order; fewer words make one shingle of all of them, none makes none."""
    word_hash = F.transform(words, lambda w: F.xxhash64(w))
    runs = lambda h: F.transform(
        F.sequence(F.lit(1), F.size(h) - size + 1), lambda i: F.xxhash64(*[F.element_at(h, i + k) for k in range(size)])
    )
    return let(word_hash, lambda h: F.when(F.size(h) >= size, runs(h)).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>")))


def unused(df: DataFrame, name: str) -> str:
    """The name, with underscores in front until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
