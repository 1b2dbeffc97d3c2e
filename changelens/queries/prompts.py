"""Whole texts: requests to a model, impact evidence and reports, each built a second time in SQL from the formulas of the views."""

from pyspark.sql import functions as F

from changelens import fixtures as fx
from changelens.fixtures import HEX_SQL, SEVERITY_RANK, with_views
from changelens.operators import findings as fd
from changelens.operators import publish
from changelens.plans import review
from changelens.plans.impact import impact
from changelens.queries.aggregates import KEPT
from changelens.queries.filters import TRIAGE
from changelens.queries.jobs import VERIFIED, _contexts, _publication
from changelens.queries.joins import TIER_VIEWS, run_impact
from changelens.queries.registry import query
from changelens.queries.sources import ANNOTATED, request_contexts
from changelens.queries.texts import _MENTION, _TAGS
from changelens.queries.windows import SELECTION, SHOWN
from changelens.sources import requests as rq

NL = "chr(10)"
#: A limit that no text reaches.
WHOLE = 10**9


def safe_texts(limit: int) -> str:
    """CTEs up to ``safe``: trimmed, numbered and redacted text per file with a patch. A first hunk that is longer than the limit keeps its whole lines in front."""
    return f"""{ANNOTATED},
hk AS (SELECT doc_id, hunk_id, '@@ -' || (hunk_id * 8 - 7) || ',8 +' || (hunk_id * 8 - 7 + 100 * (hunk_id - 1)) || ',8 @@' || {NL} || string_agg(op || text, {NL} ORDER BY pos) AS t FROM f_patch_rows GROUP BY doc_id, hunk_id),
hn AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n, sum(length(t) + 1) OVER (PARTITION BY doc_id) - 1 AS total FROM hk),
hs AS (SELECT *, CASE WHEN hunk_id <= (n + 1) // 2 THEN 2 * (hunk_id - 1) ELSE 2 * (n - hunk_id) + 1 END AS step FROM hn),
hr AS (SELECT *, sum(length(t) + 1) OVER (PARTITION BY doc_id ORDER BY step ROWS UNBOUNDED PRECEDING) <= {limit} AS fits FROM hs),
hd AS (SELECT doc_id, any_value(total) AS total, any_value(n) AS n, count(*) FILTER (fits) AS fitting FROM hr GROUP BY doc_id),
hx AS (SELECT r.doc_id, r.hunk_id, CASE WHEN d.total <= {limit} OR r.fits THEN 1000000000 ELSE length(regexp_replace(substring(t, 1, {limit}), '[^\\n]', '', 'g')) END AS kept
  FROM hr r JOIN hd d USING (doc_id) WHERE d.total <= {limit} OR r.fits OR (d.fitting = 0 AND r.hunk_id = 1)),
safe AS (SELECT repo, sha, filename, a.doc_id, regexp_replace(string_agg(row, {NL} ORDER BY a.hunk_id, pos), {HEX_SQL}, '[REDACTED:assigned_hex]', 'g') AS safe_text,
    any_value(CASE WHEN d.total <= {limit} THEN '' WHEN d.n > greatest(d.fitting, 1) THEN ' (truncated, ' || (d.n - greatest(d.fitting, 1)) || ' hunk(s) left out)' ELSE ' (truncated)' END) AS cut
  FROM a_rows a JOIN hx x ON x.doc_id = a.doc_id AND x.hunk_id = a.hunk_id JOIN hd d ON d.doc_id = a.doc_id WHERE pos + 1 < kept GROUP BY ALL)"""


def requests_sql(limit: int, message: str, only: str, columns: str, head: str = "WITH ") -> str:
    """All requests of the files in ``only``: their texts in chunks of 12,000 characters with the key and the prompt around them."""
    return f"""{head}{safe_texts(limit)},
told AS (SELECT *, {message} AS message, CASE WHEN repo = 'en' THEN '- [memory] known' ELSE '' END AS memory, CASE WHEN filename LIKE '%.py' THEN 'seen' ELSE '' END AS evidence FROM safe WHERE {only}),
keyed AS (SELECT *, sha256('reviewer' || chr(31) || '1' || chr(31) || 'English' || chr(31) || filename || chr(31) || safe_text || chr(31) || message || chr(31) || memory || chr(31) || evidence || chr(31)) AS cache_key FROM told),
cl AS (SELECT doc_id, i, substring(x, 1, 12000) AS x FROM (SELECT doc_id, unnest(string_split(safe_text, {NL})) AS x, unnest(range(1, len(string_split(safe_text, {NL})) + 1)) AS i FROM keyed WHERE length(safe_text) > 12000)),
cf AS (SELECT doc_id, i, x, 0 AS chunk, length(x) + 1 AS size FROM cl WHERE i = 1
  UNION ALL SELECT l.doc_id, l.i, l.x, CASE WHEN f.size + length(l.x) + 1 > 12000 THEN f.chunk + 1 ELSE f.chunk END,
    CASE WHEN f.size + length(l.x) + 1 > 12000 THEN length(l.x) + 1 ELSE f.size + length(l.x) + 1 END FROM cf f JOIN cl l ON l.doc_id = f.doc_id AND l.i = f.i + 1),
parts AS (SELECT doc_id, CAST(chunk AS INTEGER) AS chunk, string_agg(x, {NL} ORDER BY i) AS part FROM cf GROUP BY doc_id, chunk UNION ALL SELECT doc_id, 0, safe_text FROM keyed WHERE length(safe_text) <= 12000),
asked AS (SELECT k.*, p.chunk, p.part, CAST(count(*) OVER (PARTITION BY k.doc_id) AS INTEGER) AS chunks FROM keyed k JOIN parts p USING (doc_id)),
made AS (SELECT *, sha256(cache_key || chr(31) || chunk) AS request_id, 'Review this change and answer in JSON.' || {NL} || 'File: ' || filename || ' part ' || (chunk + 1) || ' of ' || chunks || cut || {NL}
  || '<message>' || {NL} || message || {NL} || '</message>' || {NL} || CASE WHEN memory <> '' THEN '<memory>' || {NL} || memory || {NL} || '</memory>' || {NL} ELSE '' END
  || CASE WHEN evidence <> '' THEN '<impact>' || {NL} || evidence || {NL} || '</impact>' || {NL} ELSE '' END || '<diff>' || {NL} || part || {NL} || '</diff>' AS prompt FROM asked)
SELECT {columns} FROM made"""


@query("C32_render_prompt", with_views(requests_sql(WHOLE, "'Change ' || sha", "true", "repo, sha, filename, cache_key, chunk, chunks, request_id, prompt"), "f_patch_rows", recursive=True))
def render_prompt(spark, d):
    return rq.emit_review_requests(request_contexts(spark, d))


_TRIAGED = f"WITH {TRIAGE}, {SELECTION}, ".replace("AS full", 'AS "full"')


@query("J3_review_tasks", with_views(
    requests_sql(24_000, "'Change'", "(repo, sha, filename) IN (SELECT repo, sha, filename FROM walk WHERE selected)", "repo, sha, filename, chunk, chunks, cache_key, sha256(prompt) AS prompt_sha256", _TRIAGED),
    "v_changed_files", "f_patch_rows", recursive=True,
))
def review_tasks(spark, d):
    """All chunks of all selected files, each with the key of its file and the hash of its prompt."""
    messages, evidence, memory = _contexts(spark, d)
    cache = spark.createDataFrame([], "cache_key string, findings string")
    selected = review.triage(fx.changed_files(spark, d)).selected
    asked = review.review_tasks(selected, messages, evidence, memory, cache).requests
    return asked.select("repo", "sha", "filename", "chunk", "chunks", "cache_key", F.sha2("prompt", 256).alias("prompt_sha256"))


def _seen(spark, d):
    return fx.changed_files(spark, d).filter("filename LIKE '%.py'").select("repo", "sha", "filename", F.lit("seen").alias("evidence"))


@query("C32_verify_prompt", with_views(f"""WITH {safe_texts(24_000)},
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo, sha ORDER BY {SEVERITY_RANK}, filename, coalesce(line, 0), seq) AS n FROM v_findings WHERE origin = 'model' AND severity IN ('critical', 'major')) WHERE n <= 10),
rows AS (SELECT t.repo, t.sha, t.filename, t.seq, t.line, unnest(string_split(safe_text, {NL})) AS x, unnest(range(len(string_split(safe_text, {NL})))) AS i FROM top t JOIN safe USING (repo, sha, filename)),
near AS (SELECT *, abs(TRY_CAST(nullif(regexp_extract(x, '^\\s*(\\d+)[ +]', 1), '') AS INTEGER) - line) <= 15 AS near FROM rows),
ends AS (SELECT repo, sha, filename, seq, min(i) FILTER (near) AS low, max(i) FILTER (near) AS high FROM near GROUP BY ALL),
code AS (SELECT repo, sha, filename, seq, substring(string_agg(x, {NL} ORDER BY i), 1, 4000) AS code FROM near JOIN ends USING (repo, sha, filename, seq) WHERE CASE WHEN low IS NULL THEN i < 60 ELSE i BETWEEN low AND high END GROUP BY ALL)
SELECT t.repo, t.sha, t.filename, t.seq, CAST(n AS INTEGER) AS rank, 'Is this finding right? Answer confirmed, refuted or uncertain, with a reason, in JSON.' || {NL} || 'File: ' || t.filename || {NL} || 'Finding: [' || severity || '/' || category || '] ' || title || {NL}
  || 'Line: ' || coalesce(CAST(line AS VARCHAR), 'unknown') || {NL} || '<detail>' || {NL} || detail || {NL} || '</detail>' || {NL}
  || CASE WHEN t.filename LIKE '%.py' THEN '<impact>' || {NL} || 'seen' || {NL} || '</impact>' || {NL} ELSE '' END
  || CASE WHEN coalesce(code, '') <> '' THEN '<code>' || {NL} || code || {NL} || '</code>' ELSE '<code/>' END AS prompt
FROM top t LEFT JOIN code USING (repo, sha, filename, seq)""", "v_findings", "f_patch_rows"))
def verify_prompt(spark, d):
    found = fd.valid_findings(fx.raw_findings(spark, d))
    return rq.emit_verify_requests(found, fx.changed_files(spark, d).filter("patch IS NOT NULL"), _seen(spark, d)).drop("request_id")


@query("C32_read_decisions", with_views(f"""WITH top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo, sha ORDER BY {SEVERITY_RANK}, filename, coalesce(line, 0), seq) AS n FROM v_findings WHERE origin = 'model' AND severity IN ('critical', 'major')) WHERE n <= 10)
SELECT repo, sha, filename, seq, CASE length(title) % 4 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'refuted' ELSE 'uncertain' END AS verdict, 'line ' || coalesce(CAST(line AS VARCHAR), 'unknown') AS reason
FROM top WHERE length(title) % 4 <> 3 AND length(title) % 5 <> 0""", "v_findings"))
def decisions(spark, d):
    """Requests answered by a stand-in that reads the prompt: some answers fail, some are no decision."""
    found = fd.valid_findings(fx.raw_findings(spark, d))
    asked = rq.emit_verify_requests(found, fx.changed_files(spark, d).filter("patch IS NOT NULL"), _seen(spark, d))
    size = F.length(F.regexp_extract("prompt", r"\nFinding: \[\w+/\w+\] ([^\n]*)", 1))
    line = F.regexp_extract("prompt", r"\nLine: (\w+)", 1)
    said = F.when(size % 4 == 0, " Confirmed ").when(size % 4 == 1, "REFUTED").when(size % 4 == 2, "uncertain").otherwise("perhaps")
    answers = asked.select(
        "request_id", F.concat(F.lit('Well: {"verdict": "'), said, F.lit('", "reason": "line '), line, F.lit('"} so far')).alias("content"),
        F.when(size % 5 == 0, "Timeout").alias("error_type"),
    )
    return rq.read_decisions(asked, answers)


@query("C32_summary_prompt", with_views(f"""WITH listed AS (SELECT repo, sha, string_agg('- [' || severity || '/' || category || '] ' || filename || ':' || coalesce(CAST(line AS VARCHAR), '-') || ' ' || title, {NL} ORDER BY n) AS findings FROM (
  SELECT *, row_number() OVER (PARTITION BY repo, sha ORDER BY {SEVERITY_RANK}, filename, coalesce(line, 0), seq) AS n FROM v_findings) WHERE n <= 40 GROUP BY repo, sha)
SELECT repo, sha, 'Sum up this review in a few sentences and answer in JSON.' || {NL} || '<message>' || {NL} || 'Change ' || sha || {NL} || '</message>' || {NL} || '<findings>' || {NL} || findings || {NL} || '</findings>' AS prompt,
  'n=' || length(findings) AS summary FROM listed""", "v_findings"))
def summary_prompt(spark, d):
    """The requests, with what is read back from the answers of a stand-in."""
    messages = fx.changed_files(spark, d).select("repo", "sha").distinct().withColumn("message", F.concat(F.lit("Change "), "sha"))
    asked = rq.emit_summary_requests(fd.valid_findings(fx.raw_findings(spark, d)), messages)
    size = F.length(F.regexp_extract("prompt", r"(?s)<findings>\n(.*)\n</findings>\z", 1))
    answers = asked.select("request_id", F.concat(F.lit('{"summary": "n='), size.cast("string"), F.lit('"}')).alias("content"), F.lit(None).cast("string").alias("error_type"))
    return asked.join(rq.read_summaries(asked, answers), ["repo", "sha"]).select("repo", "sha", "prompt", "summary")


# ----------------------------------------------------------------------------- impact evidence ---
#: Lines of the module files by formula.
LINES = f"""f_lines AS (
  SELECT repo, path, 1 AS line, 'from ' || {fx._module_name('t')} || ' import sym_' || t AS text FROM f_modules
  UNION ALL SELECT repo, path, 2, CASE WHEN shadows OR u = j THEN 'import os' WHEN j % 10 = 4 AND j >= 10 THEN 'from pkg0.mod20 import sym_0' ELSE 'from ' || {fx._module_name('u')} || ' import sym_' || u END FROM f_modules
  UNION ALL SELECT repo, path, 11, 'def sym_' || j || '(a, b):' FROM f_modules UNION ALL SELECT repo, path, 12, '    \"\"\"Combine both parts.\"\"\"' FROM f_modules
  UNION ALL SELECT repo, path, 13, '    left = sym_' || t || '(a)' FROM f_modules UNION ALL SELECT repo, path, 14, '    right = sym_' || u || '(b)' FROM f_modules
  UNION ALL SELECT repo, path, 15, '    return left + right' FROM f_modules
  UNION ALL SELECT repo, path, CASE WHEN shadows THEN 22 ELSE 18 END, 'def late_' || j || '():' FROM f_modules WHERE late
  UNION ALL SELECT repo, path, CASE WHEN shadows THEN 23 ELSE 19 END, '    return old_' || (j - 3) || '(1)' FROM f_modules WHERE late)"""
EVIDENCE = f"""{KEPT}, {SHOWN}, {LINES},
listed AS (SELECT s.*, coalesce(s.enclosing_start, s.line) AS low, CASE WHEN s.enclosing_start IS NULL THEN s.line WHEN s.enclosing_start = 11 THEN 15 ELSE s.enclosing_start + 1 END AS high
  FROM (SELECT w.*, CASE WHEN w.enclosing IS NOT NULL THEN w.at_line END AS enclosing_start FROM shown w) s),
code AS (SELECT l.repo, l.filename, l.name, l.change, l.rank, string_agg('  | ' || lpad(CAST(f.line AS VARCHAR), 5, ' ') || CASE WHEN f.line = l.line THEN '>' ELSE ' ' END || '| ' || f.text, {NL} ORDER BY f.line) AS code
  FROM listed l JOIN f_lines f ON f.repo = l.repo AND f.path = l.path AND f.line BETWEEN l.low AND l.high GROUP BY ALL),
caller AS (SELECT l.repo, l.filename, l.name, l.change, l.rank, '* ' || l.path || ' line ' || l.line || ': ' || l.use_kind || CASE WHEN l.sites > 1 THEN ' x' || l.sites ELSE '' END
  || CASE WHEN l.enclosing IS NULL THEN ' outside any definition' ELSE ' inside `' || l.enclosing || '`' END || ' {{' || CASE WHEN l.in_changed_file THEN 'part of this change' ELSE 'untouched' END
  || CASE WHEN l.link = 'imports' THEN ', linked by import' ELSE '' END || '}}' || {NL} || c.code AS text FROM listed l JOIN code c USING (repo, filename, name, change, rank)),
callers_of AS (SELECT repo, filename, name, change, count(*) AS listed, string_agg(text, {NL} ORDER BY rank) AS texts FROM caller GROUP BY ALL),
tested AS (SELECT repo, filename, name, change, string_agg(path, ' ' ORDER BY path) AS tests FROM (SELECT *, row_number() OVER (PARTITION BY repo, filename, name, change ORDER BY path) AS n
  FROM (SELECT DISTINCT repo, filename, name, change, path FROM tiers WHERE is_test)) WHERE n <= 3 GROUP BY ALL),
section AS (SELECT k.*, row_number() OVER (PARTITION BY repo, filename ORDER BY CASE change WHEN 'signature' THEN 0 WHEN 'removed' THEN 1 ELSE 2 END) AS n FROM kept k),
told AS (SELECT s.repo, s.filename, s.n, s.n || ') ' || kind || ' `' || s.name || '` is ' || CASE s.change WHEN 'signature' THEN 'declared differently' WHEN 'body' THEN 'works differently' ELSE 'gone' END || ': ' || s.filename
  || CASE WHEN start_line > 0 THEN ' lines ' || start_line || ' to ' || end_line ELSE '' END || {NL} || 'uses: ' || total_callers || ', untouched: ' || unmodified_callers || ', listed: ' || coalesce(listed, 0)
  || CASE WHEN other_definitions > 0 OR likely_unrelated > 0 THEN {NL} || 'namesakes: ' || other_definitions || ' defined, ' || likely_unrelated || ' of their uses left out' ELSE '' END
  || coalesce({NL} || texts, '') || {NL} || 'tested in: ' || coalesce(tests, 'no file found') AS text
  FROM section s LEFT JOIN callers_of c USING (repo, filename, name, change) LEFT JOIN tested t USING (repo, filename, name, change)),
run AS (SELECT *, sum(length(text)) OVER (PARTITION BY repo, filename ORDER BY n) > 7000 AND n > 1 AS over FROM told),
within AS (SELECT *, bool_or(over) OVER (PARTITION BY repo, filename ORDER BY n) AS stopped FROM run)
SELECT repo, 'c0' AS sha, filename, string_agg(text, {NL} || {NL} ORDER BY n) AS evidence FROM within WHERE NOT stopped GROUP BY repo, filename"""


@query("C22_render_evidence", with_views(f"WITH {EVIDENCE}", *TIER_VIEWS))
def render_evidence(spark, d):
    return run_impact(spark, d).evidence


@query("J2_impact", with_views(f"WITH {EVIDENCE}", *TIER_VIEWS))
def impact_job(spark, d):
    return impact(fx.symbol_changes(spark, d), fx.source_files(spark, d)).evidence


# ----------------------------------------------------------------------------- reports ---
def _safe(column: str) -> str:
    return f"regexp_replace({_MENTION.format(c=column)}, '{_TAGS}', '&lt;\\1', 'g')"


REPORT = f"""{VERIFIED},
posted AS (SELECT DISTINCT repo, sha, filename, line FROM (SELECT *, row_number() OVER (PARTITION BY repo, sha ORDER BY filename, seq) AS n FROM verified WHERE line IS NOT NULL AND sha <> 'c2') WHERE n <= 50),
open AS (SELECT v.* FROM verified v LEFT JOIN posted p ON p.repo = v.repo AND p.sha = v.sha AND p.filename = v.filename AND p.line = v.line WHERE p.line IS NULL),
texts AS (SELECT repo, sha, row_number() OVER (PARTITION BY repo, sha ORDER BY {SEVERITY_RANK}, filename, coalesce(line, 0), seq) AS n,
  '- **[' || severity || '/' || category || ']** ' || {_safe('title')} || ' — `' || filename || coalesce(':' || line, '') || '`' || {NL} || '  ' || {_safe('detail')} || CASE WHEN coalesce(suggestion, '') <> '' THEN {NL} || '  Suggestion: ' || {_safe('suggestion')} ELSE '' END AS text FROM open),
parts AS (SELECT repo, sha, string_agg(text, {NL} ORDER BY n) AS parts FROM texts WHERE n <= 2308 GROUP BY repo, sha),
sv AS (SELECT repo, sha, count(*) AS n, min({SEVERITY_RANK}) AS worst, count(*) FILTER (severity = 'critical') AS c, count(*) FILTER (severity = 'major') AS ma, count(*) FILTER (severity = 'minor') AS mi, count(*) FILTER (severity = 'nit') AS ni FROM verified GROUP BY repo, sha),
left_out AS (SELECT repo, sha, filename, reason FROM triaged WHERE reason IS NOT NULL UNION ALL SELECT repo, sha, filename, CASE WHEN "full" THEN 'over_file_cap' ELSE 'over_char_budget' END FROM walk WHERE NOT selected),
skipping AS (SELECT repo, sha, 'skipped ' || total || ' file(s): ' || string_agg(filename || ': ' || reason, '; ' ORDER BY filename || ': ' || reason) || CASE WHEN total > 5 THEN ' …' ELSE '' END AS note
  FROM (SELECT *, row_number() OVER (PARTITION BY repo, sha ORDER BY filename) AS n, count(*) OVER (PARTITION BY repo, sha) AS total FROM left_out) WHERE n <= 5 GROUP BY repo, sha, total)
SELECT t.repo, t.sha, substring('{publish.MARKER}' || {NL} || {NL} || '## Change review (`' || substring(t.sha, 1, 7) || '`)' || {NL} || {NL} || '**Verdict:** ' || CASE WHEN worst <= 1 THEN 'Changes requested' WHEN sv.n > 0 THEN 'Comments for the author' ELSE 'No problems found' END
  || {NL} || {NL} || '### Impact' || {NL} || '- `f` changed its signature' || CASE WHEN sv.n > 0 THEN {NL} || {NL} || '**Findings:** ' || concat_ws(' · ', CASE WHEN c > 0 THEN 'critical ' || c END, CASE WHEN ma > 0 THEN 'major ' || ma END, CASE WHEN mi > 0 THEN 'minor ' || mi END, CASE WHEN ni > 0 THEN 'nit ' || ni END) ELSE '' END
  || {NL} || {NL} || coalesce(parts, 'No findings to report here.') || {NL} || {NL} || '---' || {NL} || {NL} || '<sub>' || coalesce({_safe('note')}, '') || '</sub>', 1, 60000) AS report
FROM (SELECT DISTINCT repo, sha FROM v_changed_files) t LEFT JOIN sv USING (repo, sha) LEFT JOIN parts USING (repo, sha) LEFT JOIN skipping USING (repo, sha)"""


@query("C33_render_report", with_views(f"{_TRIAGED}{REPORT}", "v_changed_files", "f_patch_rows", "v_response_items", recursive=True))
def render_report(spark, d):
    return _publication(spark, d).reports
