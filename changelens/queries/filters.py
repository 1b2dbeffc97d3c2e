"""Filters and predicates."""

from pyspark.sql import functions as F

from changelens import fixtures as fx
from changelens import rules
from changelens.fixtures import with_views
from changelens.functions import paths
from changelens.functions import text as tx
from changelens.operators import findings as fd
from changelens.operators import publish, symbols
from changelens.operators import triage as tr
from changelens.queries.registry import query
from changelens.sources import events

_PATHS = "SELECT filename AS path FROM v_changed_files UNION ALL SELECT regexp_replace(url, '^https?://', '') FROM pages"


def _paths(spark, d):
    urls = fx.table(spark, d, "pages").select(F.regexp_replace("url", "^https?://", "").alias("path"))
    return fx.changed_files(spark, d).select(F.col("filename").alias("path")).union(urls)


def _sql_list(values):
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


_BASE = f"""p AS ({_PATHS}), b AS (SELECT path, lower(regexp_extract(path, '[^/]*$')) AS name FROM p)"""
REVIEWABLE = f"""NOT (name IN {_sql_list(rules.SKIP_NAMES)} OR regexp_matches(name, '\\.min\\.(js|css)$')
  OR regexp_extract(name, '[^.].*?(\\.[^.]+)$', 1) IN {_sql_list(rules.SKIP_SUFFIXES)}
  OR len(list_intersect(string_split(path, '/')[:-2], {list(rules.SKIP_DIRS)})) > 0)"""
SENSITIVE = f"""((name IN {_sql_list(rules.SENSITIVE_NAMES)} OR name LIKE '.env.%' OR regexp_matches(name, '\\.(pem|key|p12)$'))
  AND NOT regexp_matches(name, '\\.(example|sample|template)$'))"""


@query("B1_should_review", with_views(f"WITH {_BASE} SELECT path, {REVIEWABLE} AS keep FROM b", "v_changed_files"))
def should_review(spark, d):
    return _paths(spark, d).select("path", paths.should_review("path").alias("keep"))


@query("B2_sensitive_path", with_views(f"""WITH b AS (SELECT path, lower(regexp_extract(path, '[^/]*$')) AS name FROM
  (SELECT filename || CASE doc_id % 4 WHEN 0 THEN '.example' WHEN 1 THEN '' WHEN 2 THEN '/.env.production' ELSE '/id_rsa' END AS path FROM v_changed_files))
SELECT path, {SENSITIVE} AS sensitive FROM b""", "v_changed_files"))
def sensitive_path(spark, d):
    files = fx.changed_files(spark, d).selectExpr("filename || elt(cast(doc_id % 4 + 1 AS int), '.example', '', '/.env.production', '/id_rsa') AS path")
    return files.select("path", paths.is_sensitive_path("path").alias("sensitive"))


@query("B3_test_path", with_views(f"""WITH {_BASE} SELECT path, list_has_any(string_split(lower(path), '/'), ['test', 'tests', '__tests__', 'spec', 'e2e']) OR regexp_matches(lower(regexp_extract(path, '[^/]*$')), '^test_.') OR regexp_matches(lower(path), '(_|[.])test[.][a-z0-9]+$|[.]spec[.][a-z0-9]+$') AS is_test FROM b""", "v_changed_files"))
def test_path(spark, d):
    return _paths(spark, d).select("path", paths.is_test_path("path").alias("is_test"))


TRIAGE = f"""triaged AS (SELECT *, CASE WHEN status = 'removed' THEN 'removed' WHEN {SENSITIVE} THEN 'sensitive' WHEN NOT {REVIEWABLE} THEN 'generated'
    WHEN patch IS NULL THEN 'no_patch' END AS reason FROM (SELECT *, filename AS path, lower(regexp_extract(filename, '[^/]*$')) AS name FROM v_changed_files))"""


@query("B4_triage", with_views(f"WITH {TRIAGE} SELECT repo, sha, filename, reason FROM triaged", "v_changed_files"))
def triage(spark, d):
    return tr.triage(fx.changed_files(spark, d)).select("repo", "sha", "filename", "reason")


@query("B5_event_filter", with_views("SELECT event_id, repo, sha, pr_number, seq FROM f_targets", "f_targets"))
def event_filter(spark, d):
    parsed = events.read_events(fx.events(spark, d))
    return events.event_filter(parsed, ("push", "pull_request")).select("event_id", "repo", "sha", "pr_number", "seq")


@query("B6_repo_allowed", with_views("SELECT event_id, lower(repo) IN ('org/r1', 'org/r5') AS allowed FROM v_events", "v_events"))
def repo_allowed(spark, d):
    return fx.table(spark, d, "events").select(
        "event_id", paths.repo_allowed(F.expr("'Org/r' || (user_id % 12)"), ("org/R1", "ORG/r5")).alias("allowed")
    )


@query("B7_valid_names", """WITH n AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN lang || '/' || source WHEN 1 THEN lang || '/..' WHEN 2 THEN source WHEN 3 THEN '.a/' || lang
    WHEN 4 THEN lang || '/' || source || '/x' ELSE lang || '/.' END AS repo,
  CASE doc_id % 4 WHEN 0 THEN md5(text) WHEN 1 THEN substring(md5(text), 1, 6) WHEN 2 THEN upper(md5(text)) ELSE 'g' || md5(text) END AS sha,
  CASE doc_id % 5 WHEN 0 THEN 'src/' || source || '.py' WHEN 1 THEN '/' || source WHEN 2 THEN 'a/../' || source WHEN 3 THEN 'a b/' || source ELSE 'a/..' || source END AS path FROM documents)
SELECT doc_id, regexp_matches(repo, '^[A-Za-z0-9_.-]{1,100}/[A-Za-z0-9_.-]{1,100}$') AND NOT regexp_matches(repo, '(^|/)\\.+(/|$)') AS repo_ok,
  regexp_matches(sha, '^[0-9a-fA-F]{7,64}$') AS sha_ok,
  regexp_matches(path, '^[A-Za-z0-9_.@/-]{1,200}$') AND NOT regexp_matches(path, '(^|/)\\.\\.(/|$)') AND NOT starts_with(path, '/') AS path_ok FROM n""")
def valid_names(spark, d):
    named = fx.table(spark, d, "documents").selectExpr(
        "doc_id",
        "CASE doc_id % 6 WHEN 0 THEN lang || '/' || source WHEN 1 THEN lang || '/..' WHEN 2 THEN source WHEN 3 THEN '.a/' || lang WHEN 4 THEN lang || '/' || source || '/x' ELSE lang || '/.' END AS repo",
        "CASE doc_id % 4 WHEN 0 THEN md5(text) WHEN 1 THEN substring(md5(text), 1, 6) WHEN 2 THEN upper(md5(text)) ELSE 'g' || md5(text) END AS sha",
        "CASE doc_id % 5 WHEN 0 THEN 'src/' || source || '.py' WHEN 1 THEN '/' || source WHEN 2 THEN 'a/../' || source WHEN 3 THEN 'a b/' || source ELSE 'a/..' || source END AS path",
    )
    return named.select("doc_id", paths.valid_repo("repo").alias("repo_ok"), paths.valid_sha("sha").alias("sha_ok"), paths.valid_path("path").alias("path_ok"))


SECRET = "0123456789abcdef-webhook"


def _hmac_sql(column: str) -> str:
    """HMAC by its definition over the hex text of both padded keys."""
    key = SECRET.encode().ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in key).hex(), bytes(b ^ 0x5C for b in key).hex()
    return f"sha256(unhex('{outer}' || sha256(unhex('{inner}' || hex(encode({column}))))))"


@query("B8_verify_signature", f"""SELECT doc_id, doc_id % 3 = 0 AS valid, {_hmac_sql('text')} AS hmac FROM documents""")
def verify_signature(spark, d):
    body = F.encode("text", "UTF-8")
    docs = fx.table(spark, d, "documents").withColumn("hmac", tx.hmac_sha256(body, SECRET))
    header = F.expr("CASE doc_id % 3 WHEN 0 THEN 'sha256=' || hmac WHEN 1 THEN 'sha1=' || hmac ELSE 'sha256=' || reverse(hmac) END")
    return docs.select("doc_id", tx.verify_signature(body, header, SECRET).alias("valid"), "hmac")


@query("B9_own_marked_comment", with_views("SELECT id, contains(body, '<!-- changelens -->') AND lower(author) = 'bot-me' AS own FROM v_comments", "v_comments"))
def own_marked(spark, d):
    return fx.comments(spark, d).select("id", publish.own_marked("BOT-ME").alias("own"))


_NAMES = ("Render", "__eq__", "__init__", "ab", "constructor", "to_string")


@query("B10_skippable", with_views("""SELECT repo, j, CASE WHEN j % 2 = 0 THEN CASE j % 7 WHEN 0 THEN true WHEN 1 THEN true WHEN 5 THEN true ELSE false END
  ELSE j % 7 = 3 END AS skip FROM f_modules""", "f_modules"))
def skippable(spark, d):
    """Even modules hold methods, odd ones functions; seven names take turns."""
    name = F.coalesce(F.get(F.array(*[F.lit(n) for n in _NAMES]), F.expr("cast(j % 7 AS int)")), F.concat(F.lit("sym_"), "j"))
    kind = F.expr("CASE WHEN j % 2 = 0 THEN 'method' ELSE 'function' END")
    defs = fx.modules(spark, d).select(F.concat(F.lit("r"), "n").alias("repo"), "j", F.struct(name.alias("name"), kind.alias("kind")).alias("d"))
    return defs.select("repo", "j", symbols.is_skippable(F.col("d")).alias("skip"))


@query("B11_valid_anchor", with_views("""SELECT f.repo, f.sha, f.filename, f.seq, CASE WHEN a.new_line IS NOT NULL THEN f.line END AS line FROM v_findings f
LEFT JOIN (SELECT DISTINCT repo, sha, filename, new_line FROM f_patch_rows WHERE op = '+') a
  ON a.repo = f.repo AND a.sha = f.sha AND a.filename = f.filename AND a.new_line = f.line""", "v_findings", "v_changed_files", "f_patch_rows"))
def valid_anchor(spark, d):
    from changelens.operators import diff

    found = fd.valid_findings(fx.raw_findings(spark, d))
    added = diff.changed_lines(fx.changed_files(spark, d))
    return fd.anchor(found, added).select("repo", "sha", "filename", "seq", "line")


@query("B12_clean_names", """SELECT doc_id, n FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS n FROM documents)
WHERE regexp_matches(n, '^([\\pL_][\\pL\\p{Nd}\\pM_$]*|[$][\\pL\\p{Nd}\\pM_$]*)$')""")
def clean_names(spark, d):
    words = fx.table(spark, d, "documents").select("doc_id", F.explode(F.split("text", " ")).alias("n"))
    return words.filter(F.col("n").rlike(rules.IDENTIFIER))


@query("B13_valid_finding", with_views("SELECT repo, sha, filename, seq, severity, category, line, title FROM v_findings", "v_findings"))
def valid_finding(spark, d):
    return fd.valid_findings(fx.raw_findings(spark, d)).select("repo", "sha", "filename", "seq", "severity", "category", "line", "title")


@query("B14_verifiable", with_views("SELECT repo, sha, filename, seq, severity FROM v_findings WHERE origin = 'model' AND severity IN ('critical', 'major')", "v_findings"))
def verifiable(spark, d):
    return fd.verifiable(fd.valid_findings(fx.raw_findings(spark, d))).select("repo", "sha", "filename", "seq", "severity")


@query("B15_comment_has_reactions", with_views("""SELECT repo, kind, id FROM v_comments WHERE reaction_total > 0 AND lower(author) = 'bot-me' AND marked""", "v_comments"))
def comment_has_reactions(spark, d):
    from changelens.operators import memory

    return memory.rated_comments(fx.comments(spark, d), "bot-me").select("repo", "kind", "id")
