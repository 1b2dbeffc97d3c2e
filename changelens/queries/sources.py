"""Sources and sinks."""

from pyspark.sql import functions as F

from changelens import fixtures as fx
from changelens.fixtures import HEX_SQL, with_views
from changelens.functions import paths
from changelens.functions import text as tx
from changelens.operators import publish, state
from changelens.operators import triage as tr
from changelens.options import Options
from changelens.queries.registry import query
from changelens.sources import events, pages, requests, snapshot

ME = "bot-me"


def _file_pages(spark, d):
    files = fx.changed_files(spark, d).withColumn("page", F.expr("cast(doc_id % 200 div 25 + 1 AS int)"))
    item = F.struct("filename", "status", "additions", "deletions", "patch")
    return files.groupBy("repo", "sha", "page").agg(
        F.array_sort(F.collect_list(item)).alias("files"), F.min(F.concat("repo", F.lit(" "), "sha", F.lit(" "), F.col("page").cast("string"))).alias("message")
    ).withColumn("number", F.expr("cast(substring(sha, 2) AS int)"))


_PAGED = """WITH p AS (SELECT *, CAST(doc_id % 200 // 25 + 1 AS INTEGER) AS page FROM v_changed_files),
s AS (SELECT repo, sha, page, count(*) AS n FROM p GROUP BY ALL),
l AS (SELECT repo, sha, min(page) FILTER (n < 12) AS last_page FROM s WHERE page <= 5 GROUP BY ALL)
SELECT p.repo, p.sha, {number}filename, status, additions, deletions, patch FROM p JOIN l USING (repo, sha)
WHERE page <= 5 AND (last_page IS NULL OR page <= last_page)"""


@query("A1_commit_pages", with_views(_PAGED.format(number=""), "v_changed_files"))
def commit_pages(spark, d):
    return pages.read_commit_pages(_file_pages(spark, d), max_pages=5, page_size=12)[1]


@query("A1_commit_messages", with_views("""SELECT repo, sha, repo || ' ' || sha || ' 1' AS message FROM v_changed_files
WHERE doc_id % 200 < 25 GROUP BY repo, sha""", "v_changed_files"))
def commit_messages(spark, d):
    return pages.read_commit_pages(_file_pages(spark, d), page_size=12)[0]


@query("A2_pull_pages", with_views(_PAGED.format(number="CAST(substring(p.sha, 2) AS INTEGER) AS number, "), "v_changed_files"))
def pull_pages(spark, d):
    return pages.read_pull_pages(_file_pages(spark, d), max_pages=5, page_size=12)


@query("A1_whole_commits", with_views(_PAGED.format(number="").replace("WHERE page <= 5 GROUP", "GROUP").replace("page <= 5 AND", ""), "v_changed_files"))
def whole_commits(spark, d):
    return pages.read_commit_pages(_file_pages(spark, d), page_size=12)[1]


@query("A3_pull_message", """SELECT doc_id, trim('  ' || source || '
' || chr(10) || chr(10) || CASE WHEN doc_id % 7 = 0 THEN '' ELSE text END, ' ' || chr(9) || chr(10)) AS message FROM documents""")
def pull_message(spark, d):
    docs = fx.table(spark, d, "documents")
    return docs.select("doc_id", tx.pr_message(F.concat(F.lit("  "), "source", F.lit("\n")), F.expr("CASE WHEN doc_id % 7 <> 0 THEN text END")).alias("message"))


@query("A4_decode_contents", """SELECT lang AS repo, 'd' || doc_id AS path, text AS content FROM documents
WHERE doc_id % 11 <> 0 AND doc_id % 13 <> 0 AND strlen(text) <= 20000""")
def decode_contents(spark, d):
    docs = fx.table(spark, d, "documents").selectExpr(
        "lang AS repo", "'d' || doc_id AS path", "CASE WHEN doc_id % 11 = 0 THEN 'dir' ELSE 'file' END AS type",
        "CASE WHEN doc_id % 13 = 0 THEN 'none' ELSE 'base64' END AS encoding", "octet_length(text) AS size", "base64(encode(text, 'UTF-8')) AS content",
    )
    return pages.decode_contents(docs, max_bytes=20_000)


@query("A5_load_snapshot", with_views("""WITH m AS (
  SELECT repo, sha, doc_id AS ordinal, filename, strlen(d.text) AS size, CASE WHEN doc_id % 9 = 0 THEN 'link' ELSE 'file' END AS type
  FROM v_changed_files v JOIN documents d USING (doc_id)),
k AS (SELECT * FROM m WHERE type = 'file' AND size <= 9000 AND ordinal % 14 <> 0 AND regexp_matches(filename, '\\.(py|ts|java|js)$')
  AND NOT regexp_matches(filename, '(^|/)(node_modules|dist)/')),
r AS (SELECT *, count(*) OVER w AS n, sum(size) OVER w AS bytes FROM k WINDOW w AS (PARTITION BY repo, sha ORDER BY ordinal ROWS UNBOUNDED PRECEDING)),
x AS (SELECT repo, sha, min(ordinal) AS stop FROM r WHERE n > 12 OR bytes > 30000 GROUP BY ALL)
SELECT repo, sha, filename AS path, CAST(size AS INTEGER) AS size FROM k LEFT JOIN x USING (repo, sha) WHERE stop IS NULL OR ordinal < stop""", "v_changed_files"))
def load_snapshot(spark, d):
    docs = fx.table(spark, d, "documents").select("doc_id", F.octet_length("text").alias("size"))
    members = fx.changed_files(spark, d).join(docs, "doc_id").selectExpr(
        "repo", "sha", "doc_id AS ordinal", "size", "CASE WHEN doc_id % 9 = 0 THEN 'link' ELSE 'file' END AS type",
        "concat('root/', CASE WHEN doc_id % 14 = 0 THEN '../' ELSE '' END, filename) AS name",
    )
    return snapshot.load_snapshot(members, max_files=12, max_file_bytes=9_000, max_total_bytes=30_000).select("repo", "sha", "path", "size")


@query("A6_language_of", with_views("""WITH l AS (SELECT filename, CASE regexp_extract(filename, '(\\.[^.]+)$', 1) WHEN '.py' THEN 'python' WHEN '.ts' THEN 'typescript'
  WHEN '.java' THEN 'java' WHEN '.js' THEN 'javascript' END AS language FROM v_changed_files)
SELECT filename, language, CASE WHEN language IN ('typescript', 'javascript') THEN 'js' ELSE language END AS family FROM l""", "v_changed_files"))
def language_of(spark, d):
    files = fx.changed_files(spark, d).select("filename", paths.language_of("filename").alias("language"))
    return files.withColumn("family", paths.family("language"))


@query("A5_whole_snapshot", with_views("""SELECT repo, sha, filename AS path, CAST(strlen(d.text) AS INTEGER) AS size FROM v_changed_files v JOIN documents d USING (doc_id)
WHERE doc_id % 9 <> 0 AND doc_id % 14 <> 0 AND regexp_matches(filename, '\\.(py|ts|java|js)$') AND NOT regexp_matches(filename, '(^|/)(node_modules|dist)/')""", "v_changed_files"))
def whole_snapshot(spark, d):
    docs = fx.table(spark, d, "documents").select("doc_id", F.octet_length("text").alias("size"))
    members = fx.changed_files(spark, d).join(docs, "doc_id").selectExpr(
        "repo", "sha", "doc_id AS ordinal", "size", "CASE WHEN doc_id % 9 = 0 THEN 'link' ELSE 'file' END AS type",
        "concat('root/', CASE WHEN doc_id % 14 = 0 THEN '../' ELSE '' END, filename) AS name",
    )
    return snapshot.load_snapshot(members).select("repo", "sha", "path", "size")


@query("A7_read_events", with_views("""SELECT event_id, CASE WHEN event = 'ping' THEN 'pong' WHEN broken THEN 'malformed' ELSE 'ok' END AS status,
  CASE WHEN NOT broken THEN repo END AS repo FROM v_events""", "v_events"))
def read_events(spark, d):
    return events.read_events(fx.events(spark, d)).select("event_id", "status", F.col("payload.repository.full_name").alias("repo"))


@query("A8_upsert_comments", with_views("""WITH own AS (SELECT repo, arg_min(id, (seq, id)) AS comment_id FROM v_comments
  WHERE contains(body, '<!-- changelens -->') AND lower(author) = 'bot-me' GROUP BY repo)
SELECT 'org/r' || (doc_id % 9) AS repo, doc_id, comment_id, CASE WHEN comment_id IS NULL THEN 'created' ELSE 'updated' END AS action,
  substring(text, 1, 60000) AS body FROM documents LEFT JOIN own ON own.repo = 'org/r' || (doc_id % 9)""", "v_comments"))
def upsert_comments(spark, d):
    new = fx.table(spark, d, "documents").selectExpr("'org/r' || (doc_id % 9) AS repo", "doc_id", "text AS body")
    return publish.upsert_comments(new, fx.comments(spark, d), ME, ["repo"])


def _comment_pages(spark, d):
    item = F.struct("conv_id", "seq", F.struct("id", "path", "line", "body", "author", "reaction_total").alias("item"))
    listed = fx.comments(spark, d).withColumn("page", F.expr("cast(conv_id div 36 + 1 AS int)"))
    return listed.groupBy("repo", "kind", "page").agg(F.array_sort(F.collect_list(item)).alias("x")).select(
        "repo", "kind", "page", F.transform("x", lambda i: i["item"]).alias("items")
    )


@query("A10_read_comments", with_views("""WITH p AS (SELECT *, CAST(conv_id // 36 + 1 AS INTEGER) AS page FROM v_comments),
s AS (SELECT repo, kind, page, count(*) AS n FROM p GROUP BY ALL),
l AS (SELECT repo, kind, min(page) FILTER (n < 9) AS last_page FROM s WHERE page <= 3 GROUP BY ALL)
SELECT repo, kind, id, path, line, body, author, reaction_total FROM p JOIN l USING (repo, kind) WHERE page <= 3 AND (last_page IS NULL OR page <= last_page)""", "v_comments"))
def read_comments(spark, d):
    return pages.read_listing(_comment_pages(spark, d), ["repo", "kind"], max_pages=3, page_size=9).drop("seq")


@query("A10_read_reactions", """WITH p AS (SELECT 'o/r' || user_id % 40 AS repo, CAST(event_id % 7 + 1 AS INTEGER) AS page, event_type AS content, 'u' || event_id AS login FROM events),
s AS (SELECT repo, page, count(*) AS n FROM p GROUP BY ALL), l AS (SELECT repo, min(page) FILTER (n < 4) AS last_page FROM s GROUP BY repo)
SELECT repo, content, login FROM p JOIN l USING (repo) WHERE last_page IS NULL OR page <= last_page""")
def read_reactions(spark, d):
    events = fx.table(spark, d, "events").selectExpr("concat('o/r', user_id % 40) AS repo", "cast(event_id % 7 + 1 AS int) AS page", "event_type AS content", "concat('u', event_id) AS login")
    listed = events.groupBy("repo", "page").agg(F.collect_list(F.struct("content", "login")).alias("items"))
    return pages.read_listing(listed, ["repo"], page_size=4).drop("seq")


def _state(spark, d):
    return fx.table(spark, d, "events").selectExpr(
        "event_type AS namespace", "concat('u', user_id) AS key", "props AS value", "cast(ts AS timestamp) AS ts", "event_id AS seq"
    )


@query("A11_state_latest", """SELECT event_type AS namespace, 'u' || user_id AS key, arg_max(props, (ts, event_id)) AS value,
  max(event_id) AS seq FROM events GROUP BY event_type, user_id""")
def state_latest(spark, d):
    rows = _state(spark, d)
    return state.put(rows.filter("seq % 2 = 0"), rows.filter("seq % 2 = 1")).select("namespace", "key", "value", "seq")


# the text a request is made from, rebuilt by formula; texts of the tables hold assigned hex credentials, which are redacted
ANNOTATED = """a_rows AS (SELECT doc_id, repo, sha, filename, hunk_id, -1 AS pos, '@@ -' || (hunk_id * 8 - 7) || ',8 +' || (hunk_id * 8 - 7 + 100 * (hunk_id - 1)) || ',8 @@' AS row FROM f_patch_rows GROUP BY ALL
  UNION ALL SELECT doc_id, repo, sha, filename, hunk_id, pos, CASE op WHEN '-' THEN '      - ' WHEN '+' THEN lpad(CAST(new_line AS VARCHAR), 5, ' ') || ' + '
    ELSE lpad(CAST(new_line AS VARCHAR), 5, ' ') || '   ' END || text FROM f_patch_rows)"""


def request_contexts(spark, d):
    files = fx.changed_files(spark, d).filter("patch IS NOT NULL")
    texts = requests.review_texts(files, Options(max_file_chars=10**9))
    messages = files.select("repo", "sha").distinct().withColumn("message", F.concat(F.lit("Change "), "sha"))
    evidence = files.select("repo", "sha", "filename", F.lit("seen").alias("evidence")).filter("filename LIKE '%.py'")
    memory = files.select("repo", "sha").distinct().filter("repo = 'en'").withColumn("memory", F.lit("- [memory] known"))
    return requests.with_context(texts, messages, evidence, memory)


_KEYS = f"""WITH {ANNOTATED},
t AS (SELECT repo, sha, filename, regexp_replace(string_agg(row, chr(10) ORDER BY hunk_id, pos), {HEX_SQL}, '[REDACTED:assigned_hex]', 'g') AS safe_text FROM a_rows GROUP BY ALL),
k AS (SELECT *, sha256('reviewer' || chr(31) || '1' || chr(31) || 'English' || chr(31) || filename || chr(31) || safe_text || chr(31) || 'Change ' || sha || chr(31)
    || CASE WHEN repo = 'en' THEN '- [memory] known' ELSE '' END || chr(31) || CASE WHEN filename LIKE '%.py' THEN 'seen' ELSE '' END || chr(31)) AS cache_key FROM t
)
"""


@query("A13_review_requests", with_views(_KEYS + "SELECT repo, sha, filename, cache_key, safe_text FROM k", "f_patch_rows"))
def review_requests(spark, d):
    return request_contexts(spark, d).select("repo", "sha", "filename", "cache_key", "safe_text")


@query("A13_read_responses", with_views("""SELECT repo, sha, filename, count(*) AS chunks, count(*) FILTER (CASE WHEN failed THEN true ELSE missing END) AS failed FROM (
  SELECT repo, sha, filename, doc_id % 21 = 5 AS failed, doc_id % 6 = 0 AS missing FROM v_changed_files WHERE patch IS NOT NULL) GROUP BY ALL""", "v_changed_files"))
def read_responses(spark, d):
    files = fx.changed_files(spark, d).filter("patch IS NOT NULL")
    asked = files.selectExpr("repo", "sha", "filename", "doc_id AS request_id", "'' AS prompt")
    answers = fx.responses(spark, d).selectExpr("doc_id AS request_id", "content", "error_type").filter("request_id % 6 <> 0 OR error_type IS NOT NULL")
    return requests.read_review_responses(asked, answers).groupBy("repo", "sha", "filename").agg(
        F.count(F.lit(1)).alias("chunks"), F.count_if(F.col("error_type").isNotNull()).alias("failed")
    )
