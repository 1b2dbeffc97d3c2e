"""The corpus pipeline: from documents to packed training sequences.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept; all but the last return the columns of ``docs``. Handled as
the operators say: null and empty texts (no letter, so the language stage rejects them), repeated rows (copies with one id stay together),
empty tables (empty results), further columns (kept, except by the last stage).
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changelens.llm import decontamination, languages, packing, quality, similar
from changelens.llm.common import read, shared_folder, unused

ACCEPT_QUALITY = 0.3
#: The share of a text's n-grams that the winning language knows, whatever other languages there are.
ACCEPT_LANGUAGE = 0.3


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least :data:`ACCEPT_QUALITY`."""
    trees = quality.fit(docs, read(spark, sf_dir, "labels"))
    return docs.filter(quality.score_of(trees, F.col("text")) >= ACCEPT_QUALITY)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter and a learned language that knows enough of their n-grams; nothing learned: none goes for that reason."""
    filters = languages.fit(docs)
    if not filters.languages:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    name = unused(docs, "_language")
    judged = docs.withColumn(name, languages.predict_of(filters, F.col("text")))
    said = F.col(name)
    return judged.filter((said["lang_pred"] != "und") & (said["score"] >= ACCEPT_LANGUAGE)).drop(name)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each class of similar ones."""
    return similar.one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.clean(docs, read(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of the documents' pieces in sequences of 1024 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_classifier", quality_classifier), ("language_id", language_id), ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination), ("best_fit_packing", best_fit_packing),
]
#: Boosted trees, Bloom filters and a tokenizer are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage kept is a table in the shared folder until the next one is written."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = read(spark, sf_dir, "documents"), None
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            hadoop = spark._jvm.org.apache.hadoop.fs.Path(before)
            hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
        before = path
    return docs
