"""The language query worked out a second time with plain sets in place of Bloom filters."""

import os
import zlib
from collections import Counter, defaultdict

import pytest

from changelens.llm import languages
from changelens.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"


def grams_of(text):
    kept = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
    if not kept:
        return []
    line = f" {' '.join(kept)} "
    return [line[i : i + n] for n in (2, 3, 4) for i in range(len(line) - n + 1)]


def learned(rows):
    """rows: (text, lang). The n-grams of each language by the rule of the operator."""
    number, found = Counter(), defaultdict(Counter)
    for text, lang in rows:
        number[lang] += 1
        found[lang].update(set(grams_of(text)))
    share = {lang: {g: n / number[lang] for g, n in grams.items() if n >= max(2.0, 0.01 * number[lang])} for lang, grams in found.items()}
    best = Counter()
    for grams in share.values():
        for g, s in grams.items():
            best[g] = max(best[g], s)
    return {lang: {g for g, s in grams.items() if s >= 0.1 * best[g]} for lang, grams in share.items()}


def judged(known, text):
    grams = grams_of(text)
    if not grams or not known:
        return "und", 0.0
    shares = {lang: sum(g in own for g in grams) / len(grams) for lang, own in sorted(known.items())}
    best = max(shares, key=lambda lang: shares[lang])
    return best, shares[best]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables are not here")
def test_query_equals_plain_sets(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang").collect()
    known = learned([(d.text, d.lang) for d in docs if d.lang is not None and d.text is not None and zlib.crc32(str(d.doc_id).encode()) % 4 != 2])
    got = {r.doc_id: r for r in QUERIES["op6_language_id"](spark, DATA).collect()}
    assert len(got) == len(docs)
    for d in docs:
        name, share = judged(known, d.text)
        assert got[d.doc_id].held_out == (zlib.crc32(str(d.doc_id).encode()) % 4 == 2)
        assert got[d.doc_id].lang_pred == name and got[d.doc_id].score == pytest.approx(share, abs=0.02)


def test_ties_repeated_rows_and_long_texts(spark):
    rows = [(i, "abc abd abe " * 4, lang) for i, lang in enumerate(["x", "x", "x", "y", "y", "y", "x", "y", "x", "y", "x", "y"])]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    filters = languages.fit(frame)
    asked = spark.createDataFrame([(1, "abc abd", None), (1, "abc abd", None), (2, "abc " * 100_000, None), (3, "123", None), (None, None, None)], "doc_id long, text string, lang string")
    got = [(r.doc_id, r.lang_pred) for r in languages.identify(asked, filters).collect()]
    assert sorted(got, key=str) == sorted([(1, "x"), (1, "x"), (2, "x"), (3, "und"), (None, "und")], key=str)  # of equal shares the first name
