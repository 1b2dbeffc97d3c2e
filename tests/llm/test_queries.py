"""The registered queries and the pipeline over the driver's smallest tables."""

import os
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from changelens.llm import languages, quality
from changelens.llm.queries import ORACLES, QUERIES

duckdb = pytest.importorskip("duckdb")
DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables are not here")


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for name in ("documents", "pages", "benchmark", "labels", "conversations"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return connection


def test_all_and_the_pipeline_are_registered():
    keys = entry.queries().keys()
    assert {re.match(r"op\d+|pipeline|", k)[0] for k in keys} >= {*(f"op{i}" for i in range(1, 14)), "pipeline"}
    assert ORACLES.items() <= entry.oracle_sql().items()


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_query_equals_sql(spark, database, key):
    frame = QUERIES[key](spark, DATA)
    columns = sorted(frame.columns)
    cell = lambda v: round(v, 9) if isinstance(v, float) else v
    relation = database.sql(ORACLES[key])
    names = list(relation.columns)
    assert sorted(names) == columns
    assert Counter(tuple(cell(r[c]) for c in columns) for r in frame.collect()) == Counter(tuple(cell(r[names.index(c)]) for c in columns) for r in relation.fetchall())


def test_held_out_languages_and_qualities(spark, database):
    truth = dict(database.sql("SELECT doc_id, lang FROM documents").fetchall())
    got = [r for r in QUERIES["op6_language_id"](spark, DATA).collect() if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in got) / len(got) > 0.97
    truth = dict(database.sql("SELECT doc_id, quality FROM labels WHERE quality IS NOT NULL").fetchall())
    got = [r for r in QUERIES["op8_quality_classifier"](spark, DATA).collect() if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in got) / len(got) > 0.9


def test_model_beats_the_base_on_held_out_texts(spark):
    rows = [r for r in QUERIES["op9_lm_scoring"](spark, DATA).collect() if r.held_out]
    assert rows and sum(r.score for r in rows) > sum(r.base_score for r in rows) and all(r.score < 0 for r in rows)


def test_pipeline_equals_brute_force(spark, database):
    from tokenizers import Tokenizer

    docs = dict(database.sql("SELECT doc_id, text FROM documents").fetchall())
    frame, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    trees = quality.fit(frame, labels)
    kept = {i: t for i, t in docs.items() if trees.score(quality.statistics([t or ""]))[0] >= corpus_pipeline.ACCEPT_QUALITY}
    assert 0 < len(kept) < len(docs)
    filters = languages.fit(frame.filter(frame.doc_id.isin(sorted(kept))))
    said = {i: filters.predict([t]) for i, t in kept.items()}
    kept = {i: t for i, t in kept.items() if said[i][0] != ["und"] and said[i][1][0] >= corpus_pipeline.ACCEPT_LANGUAGE}
    words = {i: re.sub(r"[\W_]+", " ", (t or "").lower()).split() for i, t in kept.items()}
    runs = lambda w, n=5: [tuple(w[k : k + n]) for k in range(len(w) - n + 1)] or [tuple(w)]
    sets = {i: set(runs(w)) for i, w in words.items()}
    group = {i: i for i in sets}

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in sorted(sets):
        for j in sorted(sets):
            if j < i and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                group[b] = a
    before = len(kept)
    kept = {i: t for i, t in kept.items() if top(i) == i}
    assert len(kept) < before
    leaks = set()
    for _, item in database.sql("SELECT item_id, text FROM benchmark").fetchall():
        target = re.sub(r"[\W_]+", " ", item.lower()).split()
        bag, known = Counter(runs(target)), set(runs(target))
        for i in kept:
            if known & sets[i]:
                for start in range(max(1, len(words[i]) - len(target) + 1)):
                    window = Counter(runs(words[i][start : start + len(target)]))
                    if (window & bag).total() >= 0.8 * (window | bag).total():
                        leaks.add(i)
    assert leaks
    kept = {i: t for i, t in kept.items() if i not in leaks}
    encoder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for i, t in kept.items():
        ids = [*encoder.encode(t, add_special_tokens=False).ids, 2]
        ends = [*range(len(ids) % 1024 or 1024, len(ids), 1024), len(ids)] if len(ids) > 1024 else [len(ids)]
        for number, (start, end) in enumerate(zip([0, *ends], ends)):
            want[i, number, start, end - start, zlib.crc32(np.array(ids[start:end], "<u4").tobytes())] += 1
    rows = corpus_pipeline.run(spark, DATA).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, frame, DATA).columns == frame.columns, name
