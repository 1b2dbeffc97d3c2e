"""The keyed table, page scans and snapshots on storage."""

import os

from pyspark.sql import functions as F

from changelens.operators import symbols
from changelens.operators.store import KeyedTable
from changelens.sources import pages, snapshot

ROW = "namespace string, key string, s bigint, seq bigint, value string"


def rows(spark, values):
    return spark.createDataFrame(values, ROW).withColumn("ts", F.timestamp_seconds("s"))


def held(table):
    return {(r.namespace, r.key): r.value for r in table.read().collect()}


def stamps(path):
    return {os.path.join(folder, name): os.stat(os.path.join(folder, name)).st_mtime_ns for folder, _, names in os.walk(path) for name in names if name.startswith("part-")}


def test_put_replaces_by_key_and_rewrites_touched_partitions_only(spark, tmp_path):
    path = str(tmp_path / "t")
    table = KeyedTable(spark, path, buckets=4)
    assert held(table) == {}
    table.put(rows(spark, [(f"n/{n}", f"k{k}", 10, k, "one") for n in range(3) for k in range(20)]))
    before = stamps(path)
    change = [("n/1", "k3", 20, 0, "two"), ("n/1", "k4", 5, 0, "late"), ("n/1", "new", 1, 0, "x"), ("n/1", "new", 2, 0, "y")]
    for _ in range(2):  # a change that runs twice
        table.put(rows(spark, change))
    got = held(table)
    assert len(got) == 61 and got["n/1", "k3"] == "two" and got["n/1", "k4"] == "one" and got["n/1", "new"] == "y"
    kept = {p for p, t in before.items() if stamps(path).get(p) == t}
    assert len(kept) >= 8
    assert all("n%2F1" in p for p in before.keys() - kept)  # other namespaces were not written


def test_every_partition_is_one_file(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), buckets=2)
    for number in range(4):
        table.put(rows(spark, [("n", f"k{number}-{k}", number, k, "v") for k in range(10)]))
    assert table.read().count() == 40
    assert all(len(names) <= 1 for names in ([n for n in names if n.endswith(".parquet")] for folder, _, names in os.walk(tmp_path / "t") if "bucket" in folder))


def test_trim_and_remove_equal_a_dictionary(spark, tmp_path):
    values = [(f"n{k % 3}", f"k{k}", (k * 7) % 50, k, str(k)) for k in range(60)]
    table = KeyedTable(spark, str(tmp_path / "t"), buckets=3)
    table.put(rows(spark, values))
    table.trim(5)
    want = {}
    for name in ("n0", "n1", "n2"):
        mine = sorted((v for v in values if v[0] == name), key=lambda v: (-v[2], -v[3], v[1]))
        want |= {(v[0], v[1]): v[4] for v in mine[:5]}
    assert held(table) == want
    gone = [k for k in want if k[0] == "n1"]  # a whole namespace: its partitions are empty then
    table.remove(spark.createDataFrame([*gone, ("n0", "never")], "namespace string, key string"))
    assert held(table) == {k: v for k, v in want.items() if k[0] != "n1"}
    table.put(rows(spark, [("n1", "back", 1, 1, "v")]))
    assert held(table)["n1", "back"] == "v"
    asked = spark.createDataFrame([("n1",), ("other",)], "namespace string")
    assert [r.key for r in table.read_of(asked).collect()] == ["back"]


def test_broken_pages_come_back_as_text(spark, tmp_path):
    good = '{"repo":"o/r","sha":"a","page":1,"message":"m","files":[{"filename":"x.py","status":"added","additions":1,"deletions":0,"patch":null}]}'
    lines = [good, good[:40], "", '{"repo":"o/r","sha":"a","page":"two"}', "no json", '{"repo":"o/r","sha":"b","page":1,"files":[]}']
    (tmp_path / "pages.json").write_text("\n".join(lines))
    scan = pages.read_pages(spark, str(tmp_path / "pages.json"), pages.COMMIT_PAGE)
    assert sorted((r.sha, r.page) for r in scan.pages.select("sha", "page").collect()) == [("a", 1), ("b", 1)]
    assert sorted(r.text for r in scan.broken.collect()) == sorted([good[:40], lines[3], "no json"])
    assert all(r.file.endswith("pages.json") for r in scan.broken.collect()) and scan.broken.count() == 3
    _, files = pages.read_commit_pages(scan.pages, page_size=1)
    assert [r.filename for r in files.collect()] == ["x.py"]


def test_only_the_folders_of_asked_repositories_are_read(spark, tmp_path):
    made = spark.createDataFrame([(f"o/{n}", "s", 1, "m") for n in range(4)], "repo string, sha string, page int, message string")
    pages.write_pages(made.withColumn("files", F.array().cast(pages.FILE_ITEM)), str(tmp_path / "a"))
    scan = pages.read_pages(spark, str(tmp_path / "a"), pages.COMMIT_PAGE, ["o/1", "o/2"])
    assert sorted(r.repo for r in scan.pages.collect()) == ["o/1", "o/2"]
    plan = scan.pages._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [repo" in plan


def test_snapshot_files_on_disk(spark, tmp_path):
    for repo, sha, name, text in (("r1", "a", "x.py", "def f():\n    pass\n"), ("r1", "b", "x.py", "def f():\n    pass\n"), ("r2", "a", "lib/y.js", "function g() {}\n"), ("r2", "a", "z.txt", "no")):
        file = tmp_path / repo / sha / name
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(text)
    members = snapshot.read_members(spark, str(tmp_path))
    loaded = snapshot.load_snapshot(members)
    assert sorted((r.repo, r.sha, r.path) for r in loaded.collect()) == [("r1", "a", "x.py"), ("r1", "b", "x.py"), ("r2", "a", "lib/y.js")]
    assert sorted((r.repo, r.sha) for r in snapshot.read_members(spark, str(tmp_path), "r1", "b").collect()) == [("r1", "b")]
    found = snapshot.by_content(loaded)
    assert found.texts.count() == 2 and found.places.count() == 3
    facts = symbols.facts_by_content(loaded)
    assert sorted((r.repo, r.sha, r.path, r.definitions[0].name) for r in facts.collect()) == [("r1", "a", "x.py", "f"), ("r1", "b", "x.py", "f"), ("r2", "a", "lib/y.js", "g")]
