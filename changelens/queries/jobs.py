"""Streams and whole jobs."""

import uuid

from pyspark.sql import functions as F

from changelens import fixtures as fx
from changelens.fixtures import HEX_SQL, SEVERITY_RANK, with_views
from changelens.functions import text as tx
from changelens.operators import state as st
from changelens.operators.grouping import materialize, shared_folder
from changelens.operators.store import KeyedTable
from changelens.options import Options
from changelens.plans import learning, review
from changelens.queries.aggregates import _RATIOS, _SUMS
from changelens.queries.filters import SECRET, TRIAGE
from changelens.queries.joins import CLAIMS, EVAL, RATED, _owners, eval_tables, feedback_state, ratings, repo_reactions
from changelens.queries.registry import query
from changelens.queries.texts import PARSED
from changelens.queries.windows import SELECTION
from changelens.sources import requests as rq
from changelens.streaming import ingest

BOTH = Options(review_events=("push", "pull_request"))


def scratch(spark):
    """A new folder for one stream run, below the shared checkpoint folder."""
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def kept(spark, folder, rows):
    """The rows, checkpointed, so that the folder they were read from can go."""
    found = materialize(rows)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return found


def deliveries(spark, d):
    """Signed deliveries; every thirteenth signature is wrong."""
    made = fx.events(spark, d).withColumn("mac", tx.hmac_sha256("body", SECRET))
    return made.select(
        "event_id", "event", "body", F.expr("CASE WHEN event_id % 13 = 0 THEN 'sha256=0' ELSE 'sha256=' || mac END").alias("signature"), "received_ts"
    )


@query("H1_event_stream", with_views("SELECT event_id, repo, sha, pr_number, seq FROM f_targets WHERE event_id % 13 <> 0", "f_targets"))
def event_stream(spark, d):
    folder = scratch(spark)
    deliveries(spark, d).write.parquet(f"{folder}/in")
    stream = ingest.event_targets(ingest.read_deliveries(spark, f"{folder}/in"), SECRET, BOTH)
    ingest.run_available(
        stream, f"{folder}/checkpoint", lambda batch, n: batch.select("event_id", "repo", "sha", "pr_number", "seq").write.mode("overwrite").parquet(f"{folder}/out/batch={n}")
    )
    return kept(spark, folder, spark.read.parquet(f"{folder}/out").drop("batch"))


SIGNED = """keyed AS (SELECT lower(repo) || '@' || lower(sha) || '#' || coalesce(pr_number, 0) AS key FROM f_targets WHERE event_id % 13 <> 0)"""


@query("H2_claim_stream", with_views(f"WITH {SIGNED} SELECT DISTINCT key FROM keyed", "f_targets"))
def claim_stream(spark, d):
    """All deliveries arrive twice, the second time after a restart: a key that came out twice would show."""
    folder = scratch(spark)
    sink = lambda fresh, n: fresh.select("key").write.mode("overwrite").parquet(f"{folder}/out/batch={n}")
    for _ in range(2):
        deliveries(spark, d).write.mode("append").parquet(f"{folder}/in")
        stream = ingest.claims(ingest.event_targets(ingest.read_deliveries(spark, f"{folder}/in"), SECRET, BOTH))
        ingest.run_available(stream, f"{folder}/checkpoint", sink)
    return kept(spark, folder, spark.read.parquet(f"{folder}/out").drop("batch"))


@query("H2_claim_within_watermark", with_views(f"WITH {SIGNED} SELECT DISTINCT key FROM keyed", "f_targets"))
def claim_within_watermark(spark, d):
    folder = scratch(spark)
    deliveries(spark, d).write.parquet(f"{folder}/in")
    stream = ingest.claim_within(ingest.event_targets(ingest.read_deliveries(spark, f"{folder}/in"), SECRET, BOTH), "40 days")
    ingest.run_available(stream, f"{folder}/checkpoint", lambda batch, n: batch.select("key").write.mode("overwrite").parquet(f"{folder}/out/batch={n}"))
    return kept(spark, folder, spark.read.parquet(f"{folder}/out").drop("batch"))


def _claim_log(spark, d):
    return fx.table(spark, d, "events").selectExpr(
        "'claims' AS namespace", "user_id || event_type AS key", "CASE WHEN event_id % 3 = 0 THEN 'released' ELSE 'claimed' END AS value", "cast(ts AS timestamp) AS ts", "event_id AS seq"
    )


@query("H3_release_on_failure", """SELECT key, seq FROM (SELECT user_id || event_type AS key, max(event_id) AS seq, arg_max(event_id % 3 <> 0, (ts, event_id)) AS claimed FROM events GROUP BY 1) WHERE claimed""")
def release_on_failure(spark, d):
    return st.open_claims(_claim_log(spark, d)).select("key", "seq")


@query("H3_release_stream", """WITH d AS (SELECT user_id || event_type AS key, event_id % 3 AS wave, ts, event_id FROM events),
f AS (SELECT key, wave, arg_min(event_id, (ts, event_id)) AS event_id FROM d GROUP BY key, wave)
SELECT key, wave, event_id FROM f WHERE NOT EXISTS (
  SELECT 1 FROM f o WHERE o.key = f.key AND o.wave < f.wave AND o.event_id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM f p WHERE p.key = o.key AND p.wave < o.wave AND p.event_id % 2 = 1))""")
def release_stream(spark, d):
    """Deliveries in three waves on one checkpoint; reviews of even events fail, are released and come again with the next wave."""
    folder = scratch(spark)
    events = fx.table(spark, d, "events").selectExpr(
        "user_id || event_type AS key", "event_id % 3 AS wave", "event_id", "cast(ts AS timestamp) + make_interval(0, 0, 0, cast(1000 * (event_id % 3) AS int)) AS received_ts", "1 AS seq"
    )
    given = "key string, wave bigint, event_id bigint, received_ts timestamp, seq int"
    spark.createDataFrame([], "key string").write.parquet(f"{folder}/released")
    for wave in range(3):
        events.filter(F.col("wave") == wave).write.mode("append").parquet(f"{folder}/in")
        stream = ingest.claims(spark.readStream.schema(given).parquet(f"{folder}/in"), spark.readStream.schema("key string").parquet(f"{folder}/released"))
        ingest.run_available(stream, f"{folder}/checkpoint", lambda fresh, n: fresh.select("key", "wave", "event_id").write.mode("overwrite").parquet(f"{folder}/out/batch={n}"))
        failed = spark.read.parquet(f"{folder}/out").filter((F.col("wave") == wave) & (F.col("event_id") % 2 == 0))
        failed.select("key").write.mode("append").parquet(f"{folder}/released")
    return kept(spark, folder, spark.read.parquet(f"{folder}/out").drop("batch"))


@query("H4_rate_limit", """WITH RECURSIVE s AS (SELECT 'o/r' || user_id AS repo, CAST(floor(epoch(ts)) AS BIGINT) AS second, min(event_id) AS event_id FROM events GROUP BY 1, 2),
walk AS (SELECT repo, min(second) AS second FROM s GROUP BY repo
  UNION ALL SELECT w.repo, (SELECT min(s.second) FROM s WHERE s.repo = w.repo AND s.second >= w.second + 21600) FROM walk w WHERE w.second IS NOT NULL)
SELECT s.repo, s.second, s.event_id FROM walk w JOIN s ON s.repo = w.repo AND s.second = w.second""")
def rate_limit(spark, d):
    checks = fx.table(spark, d, "events").selectExpr("'o/r' || user_id AS repo", "cast(ts AS timestamp) AS ts", "event_id")
    return st.rate_limited(checks, minutes=360)


@query("H4_rate_limit_stream", """WITH RECURSIVE s AS (SELECT 'o/r' || user_id AS repo, CAST(floor(epoch(ts)) AS BIGINT) AS second, min(event_id) AS event_id FROM events GROUP BY 1, 2),
walk AS (SELECT repo, min(second) AS second FROM s GROUP BY repo
  UNION ALL SELECT w.repo, (SELECT min(s.second) FROM s WHERE s.repo = w.repo AND s.second >= w.second + 21600) FROM walk w WHERE w.second IS NOT NULL)
SELECT s.repo, s.second, s.event_id FROM walk w JOIN s ON s.repo = w.repo AND s.second = w.second""")
def rate_limit_stream(spark, d):
    """The checks arrive in four runs of one stream, in the order of their time."""
    folder = scratch(spark)
    checks = fx.table(spark, d, "events").selectExpr("'o/r' || user_id AS repo", "cast(ts AS timestamp) AS ts", "event_id")
    bounds = checks.agg(F.percentile_approx(F.unix_seconds("ts"), [0.25, 0.5, 0.75]).alias("b")).select(F.explode("b").alias("b"))
    cuts = [row["b"] for row in bounds.collect()] or [0]
    part = F.array_size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.unix_seconds("ts")))
    dated = checks.withColumn("part", part)
    for number in range(len(cuts) + 1):
        dated.filter(F.col("part") == number).drop("part").write.mode("append").parquet(f"{folder}/in")
        stream = ingest.rate_limit(spark.readStream.schema("repo string, ts timestamp, event_id bigint").parquet(f"{folder}/in"), 360)
        ingest.run_available(stream, f"{folder}/checkpoint", lambda allowed, n: allowed.write.mode("overwrite").parquet(f"{folder}/out/batch={n}"))
    return kept(spark, folder, spark.read.parquet(f"{folder}/out").drop("batch"))


@query("H5_publish_stream", """SELECT repo, arg_max('state of ' || event_id, (ts, event_id)) AS body FROM (SELECT 'o/r' || user_id AS repo, ts, event_id FROM events) GROUP BY repo""")
def publish_stream(spark, d):
    folder = scratch(spark)
    fx.table(spark, d, "events").selectExpr(
        "'o/r' || user_id AS repo", "'state of ' || event_id AS body", "cast(ts AS timestamp) AS received_ts", "event_id"
    ).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema("repo string, body string, received_ts timestamp, event_id bigint").option("maxFilesPerTrigger", 4).parquet(f"{folder}/in")
    table = KeyedTable(spark, f"{folder}/published", "repo string, body string")
    ingest.run_available(stream, f"{folder}/checkpoint", ingest.publish_batch(table, "reports", ["repo"]))
    return kept(spark, folder, ingest.published(table, "reports", ["repo"]))


@query("J1_triage", with_views(f"""WITH {TRIAGE}, {SELECTION} SELECT repo, sha, filename, reason FROM triaged WHERE reason IS NOT NULL
UNION ALL SELECT repo, sha, filename, CASE WHEN selected THEN 'selected' WHEN "full" THEN 'over_file_cap' ELSE 'over_char_budget' END FROM walk""".replace("AS full", 'AS "full"'), "v_changed_files", recursive=True))
def triage_job(spark, d):
    out = review.triage(fx.changed_files(spark, d))
    return out.skipped.unionByName(out.selected.select("repo", "sha", "filename", F.lit("selected").alias("reason")))


@query("A12_eval_report", with_views(f'WITH {EVAL} SELECT "case", run, category, expected, matched, false_positives FROM scores', "v_raw_findings"))
def eval_report(spark, d):
    """The report as it is read back from the JSON sink."""
    folder = scratch(spark)
    rq.write_eval_report(learning.evaluate(*eval_tables(spark, d)).scores, f"{folder}/report")
    told = spark.read.schema("case bigint, run string, category string, expected bigint, matched bigint, false_positives bigint").json(f"{folder}/report")
    return kept(spark, folder, told)


def _contexts(spark, d):
    files = fx.changed_files(spark, d)
    reviews = files.select("repo", "sha").distinct()
    evidence = files.filter("filename LIKE '%.py'").select("repo", "sha", "filename", F.lit("seen").alias("evidence"))
    return reviews.withColumn("message", F.lit("Change")), evidence, reviews.filter("repo = 'en'").withColumn("memory", F.lit("- [memory] known"))


COLLECTED = f"""{PARSED}, a AS (SELECT p.*, CASE WHEN x.new_line IS NOT NULL THEN p.line END AS anchored FROM (SELECT * FROM parsed WHERE doc_id % 21 <> 5) p
  LEFT JOIN (SELECT DISTINCT repo, sha, filename, new_line FROM f_patch_rows WHERE op = '+') x
    ON x.repo = p.repo AND x.sha = p.sha AND x.filename = p.filename AND x.new_line = p.line),
u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo, sha, filename, anchored, lower(trim(title)) ORDER BY seq) AS k FROM a) WHERE k = 1),
collected AS (SELECT repo, sha, filename, severity, category, anchored AS line, title, detail, CAST(NULL AS VARCHAR) AS suggestion, 'model' AS origin, CAST(row_number() OVER (PARTITION BY repo, sha, filename ORDER BY seq) AS INTEGER) AS seq FROM u)"""


def collected(spark, d):
    files = fx.changed_files(spark, d)
    none = spark.createDataFrame([], "repo string, sha string, filename string, seq int, severity string, category string, line int, title string, detail string, suggestion string, origin string")
    return review.collect_reviews(fx.responses(spark, d), none, files, Options(max_file_chars=10**9))


@query("J4_collect_reviews", with_views(f"WITH {COLLECTED} SELECT repo, sha, filename, seq, severity, line, title FROM collected", "v_changed_files", "f_patch_rows", "v_response_items"))
def collect_reviews(spark, d):
    return collected(spark, d).findings.select("repo", "sha", "filename", "seq", "severity", "line", "title")


_ALL = COLLECTED.replace(PARSED, PARSED.replace("AND i < 8 ", ""))


@query("J4_collect_whole", with_views(f"WITH {_ALL} SELECT repo, sha, filename, seq, severity, line, title FROM collected", "v_changed_files", "f_patch_rows", "v_response_items"))
def collect_whole(spark, d):
    """No budget: every item of every answer counts, and a file keeps all its findings."""
    options = Options(max_file_chars=10**9, max_findings_per_chunk=None, max_findings_per_file=None)
    none = spark.createDataFrame([], "repo string, sha string, filename string, seq int, severity string, category string, line int, title string, detail string, suggestion string, origin string")
    found = review.collect_reviews(fx.responses(spark, d), none, fx.changed_files(spark, d), options).findings
    return found.select("repo", "sha", "filename", "seq", "severity", "line", "title")


@query("J4_collect_cached", with_views(f"WITH {COLLECTED} SELECT repo, sha, filename, seq, severity, line, title FROM collected", "v_changed_files", "f_patch_rows", "v_response_items"))
def collect_cached(spark, d):
    """A cache filled from the answers to half of the files must give what all answers give."""
    files, answers = fx.changed_files(spark, d), fx.responses(spark, d).withColumn("chunk", F.lit(0)).withColumn("cache_key", F.concat_ws("#", "repo", "sha", "filename"))
    cache = rq.cache_rows(answers.filter("doc_id % 2 = 0"))
    hits, misses = rq.cache_lookup(answers.select("repo", "sha", "filename", "cache_key", "chunk", "content", "error_type"), cache)
    none = spark.createDataFrame([], "repo string, sha string, filename string, seq int, severity string, category string, line int, title string, detail string, suggestion string, origin string")
    found = review.collect_reviews(misses, none, files, Options(max_file_chars=10**9), hits)
    return found.findings.select("repo", "sha", "filename", "seq", "severity", "line", "title")


VERIFIED = f"""{COLLECTED}, top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo, sha ORDER BY {SEVERITY_RANK}, filename, coalesce(line, 0), seq) AS n FROM collected WHERE severity IN ('critical', 'major')) WHERE n <= 10),
j AS (SELECT c.*, CASE WHEN t.n IS NOT NULL THEN CASE (length(c.title) + c.seq) % 3 WHEN 0 THEN 'refuted' WHEN 1 THEN 'uncertain' END END AS verdict FROM collected c
  LEFT JOIN top t ON t.repo = c.repo AND t.sha = c.sha AND t.filename = c.filename AND t.seq = c.seq),
verified AS (SELECT repo, sha, filename, seq, category, line, title, detail, suggestion, origin, CASE WHEN verdict = 'uncertain' THEN CASE severity WHEN 'critical' THEN 'major' ELSE 'minor' END ELSE severity END AS severity FROM j WHERE coalesce(verdict, '') <> 'refuted')"""


def verified(spark, d, reviews=None):
    found = (reviews or collected(spark, d)).findings
    answers = found.selectExpr("repo", "sha", "filename", "seq", "elt((length(title) + seq) % 3 + 1, 'refuted', 'uncertain', 'confirmed') AS verdict", "'because' AS reason")
    return review.verify(found, answers)


@query("J5_verify", with_views(f"WITH {VERIFIED} SELECT repo, sha, filename, seq, severity FROM verified", "v_changed_files", "f_patch_rows", "v_response_items"))
def verify_job(spark, d):
    return verified(spark, d).findings.select("repo", "sha", "filename", "seq", "severity")


@query("J6_synthesize", with_views(f"""WITH {VERIFIED}, s AS (SELECT repo, sha, count(*) AS n, min({SEVERITY_RANK}) AS worst, count(*) FILTER (severity = 'critical') AS c, count(*) FILTER (severity = 'major') AS ma,
  count(*) FILTER (severity = 'minor') AS mi, count(*) FILTER (severity = 'nit') AS ni FROM verified GROUP BY repo, sha)
SELECT t.repo, t.sha, CASE WHEN worst <= 1 THEN 'request_changes' WHEN n > 0 THEN 'comment' ELSE 'approve' END AS verdict, coalesce(n, 0) AS n_findings,
  concat_ws(' · ', CASE WHEN c > 0 THEN 'critical ' || c END, CASE WHEN ma > 0 THEN 'major ' || ma END, CASE WHEN mi > 0 THEN 'minor ' || mi END, CASE WHEN ni > 0 THEN 'nit ' || ni END) AS counts
FROM (SELECT DISTINCT repo, sha FROM v_changed_files) t LEFT JOIN s ON s.repo = t.repo AND s.sha = t.sha""", "v_changed_files", "f_patch_rows", "v_response_items"))
def synthesize(spark, d):
    return review.synthesize(fx.changed_files(spark, d).select("repo", "sha").distinct(), verified(spark, d).findings)


def _publication(spark, d):
    files = fx.changed_files(spark, d)
    targets = files.select("repo", "sha").distinct()
    reviews, sorted_out = collected(spark, d), review.triage(files)
    comments = targets.filter("sha = 'c1'").selectExpr(
        "repo", "sha", "crc32(repo || sha) AS id", "1 AS seq", "cast(null AS string) AS path", "cast(null AS int) AS line", "'<!-- changelens --> old' AS body", "'Me' AS author"
    )
    heads = targets.selectExpr("repo", "sha", "1 AS rank", "'`f` changed its signature' AS headline")
    return review.publish(targets, verified(spark, d, reviews).findings, reviews.files, comments, heads, sorted_out.skipped, targets.filter("sha = 'c2'"), "me")


@query("J7_publish_actions", with_views("""SELECT repo, sha, CASE WHEN sha = 'c1' THEN 'updated' ELSE 'created' END AS action FROM (SELECT DISTINCT repo, sha FROM v_changed_files)""", "v_changed_files"))
def publish_actions(spark, d):
    return _publication(spark, d).actions.select("repo", "sha", "action")


@query("J7_inline", with_views(f"""WITH {VERIFIED} SELECT repo, sha, filename, line, seq FROM (SELECT *, row_number() OVER (PARTITION BY repo, sha ORDER BY filename, seq) AS n FROM verified WHERE line IS NOT NULL AND sha <> 'c2') WHERE n <= 50""", "v_changed_files", "f_patch_rows", "v_response_items"))
def inline(spark, d):
    return _publication(spark, d).inline.select("repo", "sha", "filename", "line", "seq")


@query("J8_learn", with_views(f"""WITH {RATED}, l AS (SELECT repo, id, kind, marked, lower(author) = 'bot-me' AS own, reaction_total FROM v_comments)
SELECT r.repo, 'feedback:' || r.kind || ':' || comment_id AS document_id FROM ratings r JOIN l ON l.repo = r.repo AND l.kind = r.kind AND l.id = comment_id
WHERE rating IS NOT NULL AND comment_id % 4 <> 0 AND marked AND own AND reaction_total > 0
UNION ALL SELECT lang, 'convention:d' || doc_id FROM documents WHERE doc_id % 3 <> 0""", "v_reactions", "v_comments"))
def learn(spark, d):
    from changelens.operators import memory

    docs = fx.table(spark, d, "documents").selectExpr("lang AS repo", "'d' || doc_id AS path", "text AS content", "doc_id")
    stored = docs.filter("doc_id % 3 = 0").withColumn("digest", memory.digest("content")).selectExpr(
        "'conventions' AS namespace", "concat_ws(':', repo, path) AS key", "digest AS value", "timestamp_seconds(0) AS ts", "cast(0 AS bigint) AS seq"
    ).unionByName(feedback_state(ratings(spark, d)).selectExpr("namespace", "key", "value", "timestamp_seconds(0) AS ts", "cast(0 AS bigint) AS seq"))
    logins = memory.trusted_logins(_owners(spark, d), "Bot-Me", ("U5",))
    learned = learning.learn(docs.drop("doc_id"), fx.comments(spark, d), repo_reactions(spark, d), logins, stored, "bot-me")
    return learned.items.select("repo", "document_id")


@query("J8_recall", f"""WITH l AS (SELECT doc_id, lang AS type, unnest(string_split(text, chr(10))) AS raw, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents),
m AS (SELECT doc_id, type, pos, regexp_replace(raw, {HEX_SQL}, '[REDACTED:assigned_hex]', 'g') AS x FROM l),
c AS (SELECT doc_id, pos, '- [' || type || '] ' || substring(translate(trim(regexp_replace(x, '[\\s\\p{{Z}}]+', ' ', 'g')), '<>', '‹›'), 1, 400) AS line FROM m WHERE pos < 12 AND trim(regexp_replace(x, '[\\s\\p{{Z}}]+', ' ', 'g')) <> ''),
w AS (SELECT *, sum(length(line)) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS used FROM c),
s AS (SELECT *, min(pos) FILTER (used > 4500) OVER (PARTITION BY doc_id) AS stop FROM w)
SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS memory, CAST(count(*) AS INTEGER) AS n_items FROM s WHERE stop IS NULL OR pos < stop GROUP BY doc_id""")
def recall(spark, d):
    items = fx.table(spark, d, "documents").select("doc_id", F.col("lang").alias("type"), F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    return learning.recall(items, ["doc_id"])


@query("J9_evaluate", with_views(f"WITH {EVAL}, s AS (SELECT category, {_SUMS} FROM scores GROUP BY category) SELECT *, {_RATIOS} FROM s", "v_raw_findings"))
def evaluate_job(spark, d):
    return learning.evaluate(*eval_tables(spark, d), "category").summary


@query("J10_ingest", with_views(f"WITH {CLAIMS} SELECT key, event_id FROM claims", "f_targets"))
def ingest_job(spark, d):
    """The batch form of the ingest: all deliveries are signed right here."""
    made = fx.events(spark, d).withColumn("signature", F.concat(F.lit("sha256="), tx.hmac_sha256("body", SECRET)))
    found = ingest.event_targets(made.select("event_id", "event", "body", "signature", "received_ts"), SECRET, BOTH)
    return st.claim(found, found.limit(0).select("key")).select("key", "event_id")
