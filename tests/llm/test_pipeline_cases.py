"""The pipeline on tables with nulls, empty and repeated rows, columns of clashing names, and without rows."""

import random
import shutil

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from changelens.llm import similar

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not __import__("os").path.isdir(DATA), reason="driver tables are not here")


def folder_with(spark, tmp_path, documents):
    for name in ("labels", "benchmark"):
        shutil.copy(f"{DATA}/{name}.parquet", tmp_path / f"{name}.parquet")
    documents.write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def test_clashing_columns_nulls_and_repeated_rows(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    plain = {(r.doc_id, r.piece, r.ids_crc32) for r in corpus_pipeline.run(spark, DATA).collect()}
    odd = spark.createDataFrame([(None, None), (90_001, None), (90_002, ""), (90_003, "\n"), (90_004, "1 2 3")], "doc_id long, text string")
    more = docs.unionByName(odd, allowMissingColumns=True).unionByName(docs.limit(20))
    marked = more.selectExpr("*", "7 AS _language", "'g' AS _gone", "true AS _leaked", "doc_id AS node", "text AS s")
    sf_dir = folder_with(spark, tmp_path, marked)
    frame, current = marked, None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        current = stage(spark, frame, sf_dir)
        assert current.columns == marked.columns, name
        assert current.filter("_language <> 7 OR _gone <> 'g' OR NOT _leaked").count() == 0
        path = str(tmp_path / f"stage-{name}")
        current.write.parquet(path)
        frame = spark.read.parquet(path)
    rows = corpus_pipeline.STAGES[-1][1](spark, frame, sf_dir).collect()
    assert {(r.doc_id, r.piece, r.ids_crc32) for r in rows} == plain  # what was added is no text of a language; repeated rows stay together
    assert len(rows) >= len(plain)


def test_no_documents(spark, tmp_path):
    empty = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    assert corpus_pipeline.run(spark, folder_with(spark, tmp_path, empty)).count() == 0


def test_a_class_beyond_the_broadcast_bound_keeps_its_name(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(i, "the same five words here and more") for i in range(2_500)] + [(10_000 + i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(20))) for i in range(50)]
    near = [(20_000 + i, " ".join([f"t{j}" for j in range(60)] + [f"end{i}"])) for i in range(1_200)]  # each is similar to each
    got = {r.doc_id: (r.class_id, r.n_links) for r in similar.classes(spark.createDataFrame(rows + near, "doc_id long, text string")).collect()}
    assert got[2_499] == (0, 2_499) and got[10_007] == (10_007, 0)
    assert all(got[20_000 + i] == (20_000, 1_199) for i in range(1_200))
