"""Budgeted selection against its direct definition, state and streams."""

import json
import random

import pyarrow as pa
from pyspark.sql import functions as F

from changelens.functions import paths
from changelens.operators import state as st
from changelens.operators import triage as tr
from changelens.operators.grouping import first_per_group
from changelens.options import Options
from changelens.plans import review
from changelens.sources import requests as rq
from changelens.streaming import ingest

SCHEMA = "repo string, sha string, filename string, status string, additions int, deletions int, patch string"


def test_selection_equals_the_greedy_walk(spark):
    rng = random.Random(7)
    names = ["src/auth/a", "docs/b", "tests/test_c", "api/router/d", "lib/e"]
    rows = [
        ("r", f"c{i % 5}", f"{rng.choice(names)}{i}.{rng.choice(['py', 'md', 'go'])}", "modified", rng.randint(0, 90), rng.randint(0, 90), "x" * rng.choice([40, 90, 300, 300, 700]))
        for i in range(300)
    ]
    files = spark.createDataFrame(rows, SCHEMA)
    scored = {(r["sha"], r["filename"]): r["s"] for r in files.select("sha", "filename", paths.risk_score("filename", "additions", "deletions").alias("s")).collect()}
    expected = {}
    for sha in {r[1] for r in rows}:
        taken, used = 0, 0
        for row in sorted((r for r in rows if r[1] == sha), key=lambda r: (-scored[sha, r[2]], r[2])):
            cost = min(len(row[6]), 500)
            if taken >= 12:
                expected[sha, row[2]] = "over_file_cap"
            elif used + cost > 3000 and taken:
                expected[sha, row[2]] = "over_char_budget"
            else:
                expected[sha, row[2]] = None
                taken, used = taken + 1, used + cost
    found = {(r["sha"], r["filename"]): r["reason"] for r in tr.select_files(files, 12, 3000, 500).collect()}
    assert found == expected


def test_one_oversized_file_is_still_taken(spark):
    files = spark.createDataFrame([("r", "c", "a.py", "modified", 1, 1, "x" * 100)], SCHEMA)
    assert tr.select_files(files, 5, 50, 24_000).first()["selected"]


def test_large_top_k_is_exact_in_a_hot_group(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 10 == 0, "cold").otherwise("hot").alias("g"), F.col("id").alias("v"))
    kept = first_per_group(rows, ["g"], [F.col("v").desc()], 1200)
    assert {r["g"]: (r["n"], r["low"]) for r in kept.groupBy("g").agg(F.count("*").alias("n"), F.min("v").alias("low")).collect()} == {"cold": (500, 0), "hot": (1200, 3667)}


def test_rate_limit_by_direct_definition(spark):
    rng = random.Random(3)
    rows = [(f"r{i % 3}", rng.randint(0, 40_000), i) for i in range(400)]
    checks = spark.createDataFrame(rows, "repo string, s bigint, event_id bigint").select("repo", F.timestamp_seconds("s").alias("ts"), "event_id")
    expected = set()
    for repo in {r[0] for r in rows}:
        last = None
        for second in sorted({r[1] for r in rows if r[0] == repo}):
            if last is None or second - last >= 1800:
                expected.add((repo, second))
                last = second
    assert {(r["repo"], r["second"]) for r in st.rate_limited(checks).collect()} == expected


CLAIM = "key string, event_id bigint, received_ts timestamp, seq int, pr_number int"


def _arrive(spark, folder, rows, schema, *columns):
    spark.createDataFrame(rows, schema).select(*columns).coalesce(1).write.mode("append").parquet(str(folder))


def test_claims_survive_restart_redelivery_and_release(spark, tmp_path):
    given = "key string, event_id bigint, s bigint, seq int, pr_number int"
    put = lambda rows: _arrive(spark, tmp_path / "in", [(*r, 1, None) for r in rows], given, "key", "event_id", F.timestamp_millis(F.col("s") * 1000 + 1).alias("received_ts"), "seq", "pr_number")
    free = lambda keys: _arrive(spark, tmp_path / "free", [(k,) for k in keys], "key string", "key")
    out = {}

    def run():  # a new query on the old checkpoint, as after a restart
        out.clear()
        stream = ingest.claims(spark.readStream.schema(CLAIM).parquet(str(tmp_path / "in")), spark.readStream.schema("key string").parquet(str(tmp_path / "free")))
        ingest.run_available(stream, str(tmp_path / "checkpoint"), lambda fresh, n: out.update({r["key"]: r for r in fresh.collect()}))
        return {k: r["event_id"] for k, r in out.items()}

    free([])
    put([("a", 3, 30), ("b", 2, 20), ("a", 1, 10)])
    assert run() == {"a": 1, "b": 2}
    assert out["a"]["received_ts"].microsecond == 1000 and out["a"]["pr_number"] is None and out["a"]["seq"] == 1
    put([("a", 4, 5), ("c", 5, 50)])
    assert run() == {"c": 5}
    free(["a", "never"])
    put([("b", 7, 65)])
    assert run() == {}
    put([("a", 6, 70), ("b", 8, 80)])
    assert run() == {"a": 6}
    free(["a"])
    put([("a", 9, 90), ("a", 10, 91)])  # a release and redeliveries in one batch
    assert run() == {"a": 9}


def test_claims_without_releases_are_a_deduplication(spark, tmp_path):
    """F1: no key is asked from Python; of a micro-batch the earliest delivery claims, later ones and those after a restart do not."""
    given = "key string, event_id bigint, s bigint, seq int, pr_number int"
    put = lambda rows: _arrive(spark, tmp_path / "in", rows, given, "key", "event_id", F.timestamp_millis(F.col("s") * 1000 + 1).alias("received_ts"), "seq", "pr_number")

    def run():
        found = []
        stream = ingest.claims(spark.readStream.schema(CLAIM).parquet(str(tmp_path / "in")))
        plan = stream._jdf.queryExecution().analyzed().toString()
        assert "Deduplicate" in plan and "TransformWithState" not in plan and stream.schema.simpleString() == spark.createDataFrame([], CLAIM).schema.simpleString()
        ingest.run_available(stream, str(tmp_path / "checkpoint"), lambda fresh, n: found.extend(fresh.collect()))
        assert all(r["received_ts"].microsecond == 1000 for r in found)
        assert len(found) == len({r["key"] for r in found})
        return {(r["key"], r["event_id"], r["seq"], r["pr_number"]) for r in found}

    put([("a", 3, 30, 1, None), ("b", 2, 20, 1, 7), ("a", 1, 10, 2, None), ("a", 1, 10, 1, 5), ("a", 2, 10, 1, 6), (None, 9, 9, 1, None), (None, 8, 9, 1, None)])
    put([("b", 1, 20, 3, None)])  # two files of one micro-batch
    assert run() == {(None, 8, 1, None), ("a", 1, 1, 5), ("b", 1, 3, None)}
    put([("a", 4, 5, 1, None), ("c", 5, 50, 1, None), ("b", 2, 20, 1, 7), (None, 7, 1, 1, None)])
    assert run() == {("c", 5, 1, None)}
    many = [(f"k{i % 3000}", i, 5000 - i, 1, i) for i in range(6000)]
    put(many)
    assert run() == {(f"k{i - 3000}", i, 1, i) for i in range(3000, 6000)}
    put(many)
    assert run() == set()


def test_one_delivery_of_a_key_is_held(monkeypatch):
    """a bucket's rows are compared on the way, also where one key comes again and again."""
    compared, real = [], ingest._earliest
    monkeypatch.setattr(ingest, "_earliest", lambda rows: compared.append(rows.num_rows) or real(rows))
    monkeypatch.setattr(ingest, "_ROWS", 100)
    rows = [(f"k{i % 7 if i % 9 else i}", 10_000 - i, i, 1) for i in range(5000)]
    parts = (rows[i : i + 10] for i in range(0, 5000, 10))
    batches = (pa.RecordBatch.from_pylist([dict(zip(("key", "received_ts", "event_id", "seq"), r)) for r in p]) for p in parts)
    found = {r["key"]: r["received_ts"] for b in ingest._first_deliveries(batches) for r in b.to_pylist()}
    assert found == {k: min(r[1] for r in rows if r[0] == k) for k in {r[0] for r in rows}}
    assert max(compared) <= 2 * len(found) + 10 and sum(compared) < 4 * len(rows)


def test_rate_limit_across_batches(spark, tmp_path):
    put = lambda rows: _arrive(spark, tmp_path / "in", rows, "repo string, s bigint, event_id bigint", "repo", F.timestamp_seconds("s").alias("ts"), "event_id")

    def run():
        found = []
        stream = ingest.rate_limit(spark.readStream.schema("repo string, ts timestamp, event_id bigint").parquet(str(tmp_path / "in")))
        ingest.run_available(stream, str(tmp_path / "checkpoint"), lambda rows, n: found.extend((r["repo"], r["event_id"]) for r in rows.collect()))
        return sorted(found)

    put([("r", 100, 2), ("r", 0, 1), ("r", 0, 7)])
    assert run() == [("r", 1)]
    put([("r", 1000, 3), ("r", 1800, 4), ("q", 5, 5), ("r", 3600, 6)])
    assert run() == [("q", 5), ("r", 4), ("r", 6)]


def test_answers_are_asked_once_and_failures_again(spark, tmp_path):
    asked = spark.createDataFrame([(str(i), f"p{i % 5}") for i in range(20)] + [("0", "p0")], "request_id string, prompt string")
    log = tmp_path / "log"
    log.mkdir()

    def model(fails):
        def ask(prompt):
            with open(log / prompt, "a") as file:
                file.write(".")
            if prompt in fails:
                raise ValueError("payload")
            return prompt.upper()

        return ask

    count = lambda: {f.name: f.stat().st_size for f in log.iterdir()}
    first = {r.request_id: (r.content, r.error_type, r.run) for r in rq.answer_requests(asked, model({"p1"}), str(tmp_path / "answers"), "a", 3).collect()}
    assert len(first) == 20 and first["2"] == ("P2", None, "a") and first["1"] == (None, "ValueError", "a")
    assert count() == {"p0": 4, "p1": 12, "p2": 4, "p3": 4, "p4": 4}
    again = {r.request_id: (r.content, r.error_type, r.run) for r in rq.answer_requests(asked, model(set()), str(tmp_path / "answers"), "b", 3, 2).collect()}
    assert again["2"] == ("P2", None, "a") and again["1"] == ("P1", None, "b") and count()["p1"] == 16 and count()["p0"] == 4
    assert rq.answer_requests(asked, model(set()), str(tmp_path / "answers"), "b").count() == 20 and count()["p1"] == 20  # a run that is repeated replaces its own


def test_answers_and_report_sink(spark, tmp_path):
    asked = spark.createDataFrame([("1", "ok"), ("2", "bad")], "request_id string, prompt string")

    def model(prompt):
        if prompt == "bad":
            raise TimeoutError("secret payload")
        return '{"findings": []}'

    answers = {r["request_id"]: (r["content"], r["error_type"]) for r in rq.answer_with(asked, model).collect()}
    assert answers == {"1": ('{"findings": []}', None), "2": (None, "TimeoutError")}
    rq.write_eval_report(asked, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).count() == 2


def test_cached_answers_keep_their_chunks(spark):
    finding = lambda f, c, i: {"severity": "minor" if c < 2 or i < 5 else "critical", "category": "bug", "line": None, "title": f"{f} {c} {i}", "detail": "d", "suggestion": None}
    answers = spark.createDataFrame(
        [("r", "c", f, f"key {f}", c, json.dumps({"findings": [finding(f, c, i) for i in range(6)]}), None) for f in "abcd" for c in range(3)],
        "repo string, sha string, filename string, cache_key string, chunk int, content string, error_type string",
    )
    none = spark.createDataFrame([], "repo string, sha string, filename string, seq int, severity string, category string, line int, title string, detail string, suggestion string, origin string")
    files = spark.createDataFrame([("r", "c", f, "@@ -1 +1 @@\n+x") for f in "abcd"], "repo string, sha string, filename string, patch string")
    options = Options(max_findings_per_file=100)
    found = lambda *a: sorted((r.filename, r.seq, r.severity, r.title) for r in review.collect_reviews(*a, options=options, cached=None).findings.collect())
    fresh = found(answers, none, files)
    assert len(fresh) == 4 * 18
    cache = rq.cache_rows(answers.filter("filename IN ('a', 'b')"))
    hits, misses = rq.cache_lookup(answers.select("repo", "sha", "filename", "cache_key").distinct(), cache)
    rest = answers.join(misses.select("filename"), "filename", "left_semi")
    mixed = review.collect_reviews(rest, none, files, options, hits).findings
    assert sorted((r.filename, r.seq, r.severity, r.title) for r in mixed.collect()) == fresh
    failed = answers.withColumn("error_type", F.when(F.expr("filename = 'a' AND chunk = 1"), "Timeout"))
    assert {r.cache_key for r in rq.cache_rows(failed).collect()} == {"key b", "key c", "key d"}


def test_all_chunks_of_a_patch_are_asked(spark):
    patches = {"a.py": 5, "b.go": 60, "c.py": 200}
    patch = lambda n: f"@@ -0,0 +1,{n} @@\n" + "\n".join(f"+line {i} of this file" for i in range(n))
    files = spark.createDataFrame([("en", "c", f, patch(n)) for f, n in patches.items()], "repo string, sha string, filename string, patch string")
    reviews = files.select("repo", "sha").distinct()
    evidence = files.filter("filename LIKE '%.py'").select("repo", "sha", "filename", F.lit("seen").alias("evidence"))
    options, cache = Options(max_chunk_chars=500), spark.createDataFrame([], "cache_key string, findings string")
    asked = review.review_tasks(files, reviews.withColumn("message", F.lit("Change")), evidence, reviews.withColumn("memory", F.lit("- [memory] known")), cache, options).requests
    got = {(r.filename, r.chunk): r for r in asked.collect()}
    texts = {r.filename: r.safe_text for r in rq.review_texts(files, options).collect()}
    for name, text in texts.items():
        want = [""]
        for line in text.split("\n"):  # lines are packed while they fit
            if want[-1] and len(want[-1]) + len(line) + 1 > 500:
                want.append("")
            want[-1] += line + "\n"
        seen = "<impact>\nseen\n</impact>\n" if name.endswith(".py") else ""
        assert [got[name, i].prompt for i in range(len(want))] == [
            f"Review this change and answer in JSON.\nFile: {name} part {i + 1} of {len(want)}\n<message>\nChange\n</message>\n<memory>\n- [memory] known\n</memory>\n{seen}<diff>\n{part[:-1]}\n</diff>"
            for i, part in enumerate(want)
        ]
        assert sum(f == name for f, _ in got) == len(want) and len({r.cache_key for (f, _), r in got.items() if f == name}) == 1
    assert len(got) > 10
