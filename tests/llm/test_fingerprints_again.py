"""The fingerprint query worked out a second time in plain Python, from the words on."""

import hashlib
import os
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from changelens.llm import fingerprints
from changelens.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"
BINS = 256


def chained(values, seed=42):
    """The engine's hash of several columns: each 64-bit number is hashed with the hash before it as its seed."""
    for value in values:
        seed = xxhash.xxh64_intdigest(value.to_bytes(8, "little"), seed)
    return seed


def hashes_of(text):
    words = re.sub(r"[\W_]+", " ", text.lower()).split()
    named = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]
    if 0 < len(named) < 5:
        return {chained(named)}
    return {chained(named[i : i + 5]) for i in range(len(named) - 4)}


def fingerprint(text):
    bins = {}
    for h in hashes_of(text):
        signed = h - 2**64 if h >= 2**63 else h
        place = (signed >> 56) + BINS // 2
        bins[place] = min(signed, bins.get(place, signed))
    if not bins:
        return "0" * BINS
    out = []
    for at in range(BINS):
        rng = random.Random(f"densify {BINS} {at}")
        step, start = 2 * rng.randrange(BINS // 2) + 1, rng.randrange(BINS)
        tries = [at, *((step * k + start) % BINS for k in range(BINS))]
        out.append(bins[next(t for t in tries if t in bins)] & 15)
    return "".join(f"{v:x}" for v in out)


def likeness(a, b):
    same = sum(x == y for x, y in zip(a, b)) / BINS
    return max(0.0, (same - 1 / 16) / (1 - 1 / 16))


TEXTS = ["", " \n", "one", "one two three four", "a b c d e", "a b c d e a b c d e", "Ünïcode wörds, and — punctuation! 12 34", "w " * 3_000, "x1 y2 " + " ".join(f"t{i}" for i in range(20_000))]


def test_fingerprints_of_hard_texts(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "t string").select("t", fingerprints.fingerprint(F.col("t")).alias("f")).collect()
    assert {r.t: r.f for r in rows} == {t: fingerprint(t) for t in TEXTS}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables are not here")
def test_query_equals_plain_python(spark):
    docs = sorted(((r.doc_id, r.text or "") for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()), reverse=True)
    got = {r.doc_id: r for r in QUERIES["op5_document_fingerprints"](spark, DATA).collect()}
    assert len(got) == len(docs)
    for (doc_id, text), (_, after) in zip(docs, [*docs[1:], docs[0]]):
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        own, other, following = fingerprint(text), fingerprint(edited), fingerprint(after)
        row = got[doc_id]
        assert (row.n_chars, row.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (row.fingerprint, row.edited_fingerprint) == (own, other)
        assert row.near_edited == pytest.approx(likeness(own, other)) and row.near_next == pytest.approx(likeness(own, following))
