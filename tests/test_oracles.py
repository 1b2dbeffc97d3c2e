"""All registered queries against their SQL in DuckDB, whole tables at scale 0.01. Several queries run at a time, so the session is kept busy."""

import os
from collections import Counter
from concurrent.futures import ThreadPoolExecutor

import pytest

import __spark_entry__ as entry

duckdb = pytest.importorskip("duckdb")
DATA = os.environ.get("CHANGELENS_ORACLES", "/root/testdata/sf0.01")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ORACLES = {key: sql for key, sql in entry.oracle_sql().items() if not key.startswith("op")}
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables are not here")


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return connection


@pytest.fixture(scope="module")
def rows(spark, request):
    asked = {item.callspec.params["key"] for item in request.session.items if item.module is request.module and hasattr(item, "callspec")}
    queries = entry.queries()

    def run(key):
        frame = queries[key](spark, DATA)
        columns = sorted(frame.columns)
        return columns, Counter(tuple(cell(row[c]) for c in columns) for row in frame.collect())

    with ThreadPoolExecutor(6) as pool:
        yield {key: pool.submit(run, key) for key in sorted(asked)}


def cell(value):
    return round(value, 9) if isinstance(value, float) else value


def test_every_query_has_sql():
    assert {key for key in entry.queries() if not key.startswith("op") and key != "pipeline"} == set(ORACLES)


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_query_equals_sql(rows, database, key):
    columns, found = rows[key].result()
    relation = database.sql(ORACLES[key])
    names = list(relation.columns)
    assert sorted(names) == columns
    assert found == Counter(tuple(cell(row[names.index(c)]) for c in columns) for row in relation.fetchall())
