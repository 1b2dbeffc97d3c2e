"""What lies on shared storage: pages, snapshots, state, memory, answers. Each query writes its files from the given tables and reads them back."""

from pyspark.sql import functions as F

from changelens import fixtures as fx
from changelens.fixtures import with_views
from changelens.operators import symbols
from changelens.operators.grouping import unnest
from changelens.operators.store import KeyedTable
from changelens.plans import learning
from changelens.queries.jobs import kept, scratch
from changelens.queries.registry import query
from changelens.queries.sources import _file_pages, _state
from changelens.sources import pages, snapshot
from changelens.sources import requests as rq

# every fifth page of the archive was cut off in the middle
_CUT = "(cast(substring(sha, 2) AS int) + page) % 5 = 0"


def _archive(spark, d):
    folder = scratch(spark)
    made = _file_pages(spark, d).select("repo", F.to_json(F.struct("sha", "page", "message", "files")).alias("line"), F.expr(_CUT).alias("cut"))
    made.select("repo", F.expr("if(cut, substring(line, 1, cast(length(line) / 2 AS int)), line)").alias("line")).write.partitionBy("repo").text(folder)
    return folder


@query("A1_page_files", with_views("""SELECT repo, sha, filename, status, additions, deletions, patch FROM (SELECT *, doc_id % 200 // 25 + 1 AS page FROM v_changed_files)
WHERE repo IN ('en', 'de') AND (CAST(substring(sha, 2) AS INTEGER) + page) % 5 <> 0""", "v_changed_files"))
def page_files(spark, d):
    """Two repositories of an archive of JSON lines; page sizes differ, so every page counts."""
    folder = _archive(spark, d)
    scan = pages.read_pages(spark, folder, pages.COMMIT_PAGE, ["en", "de"])
    return kept(spark, folder, pages.read_commit_pages(scan.pages, page_size=1)[1])


@query("A1_broken_pages", with_views("""WITH p AS (SELECT repo, sha, CAST(doc_id % 200 // 25 + 1 AS INTEGER) AS page FROM v_changed_files)
SELECT repo, count(DISTINCT (sha, page)) AS broken, true AS cut FROM p WHERE (CAST(substring(sha, 2) AS INTEGER) + page) % 5 = 0 GROUP BY repo""", "v_changed_files"))
def broken_pages(spark, d):
    folder = _archive(spark, d)
    scan = pages.read_pages(spark, folder, pages.COMMIT_PAGE)
    cut = F.startswith("text", F.lit("{")) & F.contains("file", F.lit("repo="))
    return kept(spark, folder, scan.broken.groupBy("repo").agg(F.count(F.lit(1)).alias("broken"), F.bool_and(cut).alias("cut")))


def _twice(spark, d):
    """Every file in two commits, of which the second changes some."""
    files = fx.source_files(spark, d)
    later = files.withColumn("sha", F.lit("c1")).withColumn("content", F.expr("if(crc32(path) % 4 = 0, concat(content, '\\n\\ndef added():\\n    return 1\\n'), content)"))
    return files.unionByName(later)


@query("A5_facts_by_content", with_views("""WITH facts AS (SELECT repo, path, j, name, kind, start_line, end_line FROM f_definitions)
SELECT repo, c.sha, path, name, kind, start_line, end_line FROM facts, (SELECT unnest(['c0', 'c1']) AS sha) c""", "f_definitions"))
def facts_by_content(spark, d):
    """Definitions of all files of two commits; a text that both hold is parsed once."""
    found = unnest(symbols.facts_by_content(_twice(spark, d)), ["repo", "sha", "path"], "definitions")
    return found.filter("name <> 'added'").select("repo", "sha", "path", "name", "kind", "start_line", "end_line")


@query("A5_distinct_contents", with_views("SELECT repo, 'c0' AS sha, path, 1::BIGINT AS n FROM f_modules UNION ALL SELECT repo, 'c1', path, 1 FROM f_modules", "f_modules"))
def distinct_contents(spark, d):
    """Every place has one text, though the second commit adds none for the files it leaves alone."""
    found = snapshot.by_content(_twice(spark, d))
    texts = found.texts.select("content_id", F.lit(1).cast("bigint").alias("n"))
    return found.places.join(texts, "content_id").groupBy("repo", "sha", "path").agg(F.sum("n").alias("n"))


@query("A11_state_table", """WITH l AS (SELECT event_type AS namespace, 'u' || user_id AS key, arg_max(props, (ts, event_id)) AS value, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS seq FROM events GROUP BY 1, 2),
t AS (SELECT *, row_number() OVER (PARTITION BY namespace ORDER BY ts DESC, seq DESC, key) AS n FROM l)
SELECT namespace, key, value, seq FROM t WHERE n <= 50 AND seq % 11 <> 0""")
def state_table(spark, d):
    """Put in three parts, the last of which repeats the first, trim to the newest 50 of a namespace, remove some."""
    table, rows = KeyedTable(spark, scratch(spark)), _state(spark, d)
    for part in (0, 1, 0):
        table.put(rows.filter(F.col("seq") % 2 == part))
    table.trim(50)
    table.remove(table.read().filter("seq % 11 = 0"))
    return kept(spark, table.path, table.read().select("namespace", "key", "value", "seq"))


def _memory(spark, d):
    docs = fx.table(spark, d, "documents").selectExpr("lang AS repo", "doc_id", "'d' || doc_id AS document_id", "'memory' AS type", "split(text, '\\n')[0] AS line")
    item = lambda text, at: docs.select("repo", "doc_id", "document_id", "type", F.expr(text).alias("text"), F.expr(f"timestamp_seconds({at})").alias("ts"), F.lit(0).cast("bigint").alias("seq"))
    table = learning.memory_table(spark, scratch(spark), 4)
    learning.retain(table, item("line", "1000 + doc_id"))
    learning.retain(table, item("'again ' || line", "1000000 + doc_id").filter("doc_id % 3 = 0"))
    learning.retain(table, item("'late'", "1 + doc_id").filter("doc_id % 5 = 0"), keep=200)
    learning.forget(table, docs.filter("doc_id % 7 = 1"))
    return table


MEMORY = """newest AS (SELECT 'changelens-' || lang AS namespace, lang, doc_id, 'd' || doc_id AS key, CASE WHEN doc_id % 3 = 0 THEN 'again ' ELSE '' END || string_split(text, chr(10))[1] AS text,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id % 3 = 0 DESC, doc_id DESC) AS n FROM documents),
kept AS (SELECT * FROM newest WHERE n <= 200 AND doc_id % 7 <> 1)"""


@query("I2_memory_table", f"WITH {MEMORY} SELECT namespace, key, text FROM kept")
def memory_table(spark, d):
    """Documents are retained, replaced by id, kept against an older version, trimmed to the newest of a bank and forgotten."""
    table = _memory(spark, d)
    return kept(spark, table.path, table.read().select("namespace", "key", "text"))


@query("I2_recall_stored", f"""WITH {MEMORY}, r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n) AS pos FROM kept),
m AS (SELECT *, regexp_replace(text, {fx.HEX_SQL}, '[REDACTED:assigned_hex]', 'g') AS x FROM r WHERE pos <= 12),
c AS (SELECT lang, pos, '- [memory] ' || substring(translate(trim(regexp_replace(x, '[\\s\\p{{Z}}]+', ' ', 'g')), '<>', '‹›'), 1, 400) AS line FROM m WHERE trim(regexp_replace(x, '[\\s\\p{{Z}}]+', ' ', 'g')) <> ''),
w AS (SELECT *, sum(length(line)) OVER (PARTITION BY lang ORDER BY pos ROWS UNBOUNDED PRECEDING) AS used FROM c),
s AS (SELECT *, min(pos) FILTER (used > 4500) OVER (PARTITION BY lang) AS stop FROM w)
SELECT lang AS repo, 'c1' AS sha, string_agg(line, chr(10) ORDER BY pos) AS memory, CAST(count(*) AS INTEGER) AS n_items FROM s WHERE (stop IS NULL OR pos < stop) AND lang <> 'de' GROUP BY lang""")
def recall_stored(spark, d):
    reviews = fx.table(spark, d, "documents").filter("lang <> 'de'").selectExpr("lang AS repo", "'c1' AS sha").distinct()
    table = _memory(spark, d)
    return kept(spark, table.path, learning.recall_stored(table, reviews))


@query("I1_answer_requests", """SELECT sha256(doc_id::VARCHAR) AS request_id, 'read ' || length(text) || ' characters' AS content, CASE WHEN doc_id % 7 = 0 THEN '2' ELSE '1' END AS run FROM documents WHERE doc_id % 11 <> 0
UNION ALL SELECT sha256(doc_id::VARCHAR), NULL, '1' FROM documents WHERE doc_id % 11 = 0""")
def answer_requests(spark, d):
    """Two runs over all documents: the first fails for every seventh, both for every eleventh; the second asks only what failed."""
    folder = scratch(spark)
    docs = fx.table(spark, d, "documents").select(F.sha2(F.col("doc_id").cast("string"), 256).alias("request_id"), F.concat_ws(":", "doc_id", "text").alias("prompt"))

    def model(bad):
        def ask(prompt):
            number, text = prompt.split(":", 1)
            if any(int(number) % n == 0 for n in bad):
                raise TimeoutError(text)
            return f"read {len(text)} characters"

        return ask

    rq.answer_requests(docs.unionByName(docs.limit(10)), model((7, 11)), folder, "1")
    return kept(spark, folder, rq.answer_requests(docs, model((11,)), folder, "2").select("request_id", "content", "run"))
