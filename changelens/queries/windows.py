"""Top-k, caps, budgets and set operations."""

from pyspark.sql import functions as F

from changelens import fixtures as fx
from changelens.fixtures import HEX_SQL, SEVERITY_RANK, with_views
from changelens.functions import text as tx
from changelens.operators import diff, impact, memory, publish, state, symbols
from changelens.operators import findings as fd
from changelens.operators import triage as tr
from changelens.operators.grouping import first_per_group
from changelens.options import Options
from changelens.plans import impact as plan
from changelens.queries.aggregates import KEPT, TOP_VERIFY
from changelens.queries.filters import TRIAGE
from changelens.queries.joins import NAMES, TIER_VIEWS, TIERS, run_impact
from changelens.queries.registry import query
from changelens.queries.texts import RISK, secret_patches
from changelens.sources import events


@query("F1_last_commits", with_views("SELECT event_id, sha, seq FROM f_targets WHERE pr_number IS NULL", "f_targets"))
def last_commits(spark, d):
    parsed = events.read_events(fx.events(spark, d))
    return events.event_filter(parsed, ("push",)).select("event_id", "sha", "seq")


SELECTION = f"""c AS (SELECT repo, sha, filename, CAST({RISK} AS DOUBLE) AS score, least(length(patch), 24000) AS cost FROM triaged WHERE reason IS NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY repo, sha ORDER BY score DESC, filename) AS i FROM c),
walk AS (SELECT repo, sha, filename, i, score, 1 AS taken, cost AS used, true AS selected, false AS full FROM o WHERE i = 1
  UNION ALL SELECT o.repo, o.sha, o.filename, o.i, o.score, w.taken + CASE WHEN w.taken < 30 AND w.used + o.cost <= 160000 THEN 1 ELSE 0 END,
    w.used + CASE WHEN w.taken < 30 AND w.used + o.cost <= 160000 THEN o.cost ELSE 0 END, w.taken < 30 AND w.used + o.cost <= 160000, w.taken >= 30
  FROM walk w JOIN o ON o.repo = w.repo AND o.sha = w.sha AND o.i = w.i + 1)"""


@query("F2_select_files", with_views(f"""WITH {TRIAGE}, {SELECTION}
SELECT repo, sha, filename, score, selected, CASE WHEN NOT selected THEN CASE WHEN "full" THEN 'over_file_cap' ELSE 'over_char_budget' END END AS reason FROM walk""".replace("AS full", 'AS "full"'), "v_changed_files", recursive=True))
def select_files(spark, d):
    candidates = tr.triage(fx.changed_files(spark, d)).filter("reason IS NULL").drop("reason")
    return tr.select_files(candidates, 30, 160_000, 24_000).select("repo", "sha", "filename", "score", "selected", "reason")


@query("F3_dedupe_findings", with_views("""WITH p AS (SELECT *, lower(trim(title, ' ' || chr(9))) AS t FROM v_findings),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo, sha, filename, line, t ORDER BY origin <> 'rule', seq) AS n FROM p) WHERE n = 1),
c AS (SELECT *, row_number() OVER (PARTITION BY repo, sha, filename ORDER BY origin <> 'rule', seq) AS rank FROM k)
SELECT repo, sha, filename, seq, CAST(rank AS INTEGER) AS rank FROM c WHERE rank <= 12""", "v_findings"))
def dedupe_findings(spark, d):
    return fd.dedupe(fd.valid_findings(fx.raw_findings(spark, d))).select("repo", "sha", "filename", "seq", "rank")


@query("F4_cap_items", with_views("""SELECT repo, sha, filename, count(*) AS n FROM v_response_items WHERE NOT broken AND i < 3 AND severity <> 'severe' AND (raw_line IS NULL OR raw_line >= 1)
  AND length(title) BETWEEN 1 AND 200 GROUP BY repo, sha, filename""", "v_response_items"))
def cap_items(spark, d):
    return fd.parse_responses(fx.responses(spark, d), max_items=3).groupBy("repo", "sha", "filename").agg(F.count(F.lit(1)).alias("n"))


@query("F5_cap_secrets", with_views("""SELECT repo, sha, filename, line, kind FROM (SELECT *, row_number() OVER (PARTITION BY repo, sha, doc_id ORDER BY line, seq) AS n FROM f_secrets) WHERE n <= 5""", "f_secret_lines", "f_secrets"))
def cap_secrets(spark, d):
    lines = fx.secret_lines(spark, d).groupBy("repo", "sha", "filename", "doc_id").agg(F.array_sort(F.collect_list(F.struct("line", "text"))).alias("rows"))
    patch = F.concat(F.lit("@@ -0,0 +1,1 @@\n+"), F.array_join(F.transform("rows", lambda r: r["text"]), "\n+"))
    return tr.secret_hits(lines.select("repo", "sha", "filename", patch.alias("patch")), per_file=5).select("repo", "sha", "filename", "line", "kind")


@query("F6_top_symbols", with_views("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY repo, path ORDER BY CASE change WHEN 'signature' THEN 0 WHEN 'removed' THEN 1 ELSE 2 END, start_line) AS rank FROM f_symbols)
SELECT repo, path AS filename, name, change, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 1""", "f_symbols"))
def top_symbols(spark, d):
    found = plan.changed_symbols(fx.symbol_changes(spark, d), fx.source_files(spark, d), Options(max_symbols_per_file=1))
    return found.select("repo", "filename", "name", "change", "rank")


def _renames(spark, d):
    """Files whose patch removes eight functions, some with short names, some added again in another file."""
    rows = "concat('@@ -1,8 +1,1 @@\\n', array_join(transform(sequence(0, 7), i -> concat('-def ', elt(i % 4 + 1, 'alpha', 'be', 'gone', 'zeta'), CASE WHEN i >= 4 THEN '_x' ELSE '' END, '(a):')), '\\n'), CASE WHEN j % 5 = 0 THEN '\\n+def alpha(b):' ELSE '' END)"
    return fx.modules(spark, d).selectExpr(
        "concat('r', n) AS repo", "concat('c', j div 2) AS sha", "concat('m', j, '.py') AS filename", "'modified' AS status", "1 AS additions", "8 AS deletions", f"{rows} AS patch"
    )


@query("F7_cap_removed", with_views("""SELECT repo, 'c' || (j // 2) AS sha, 'm' || j || '.py' AS filename, name FROM (SELECT *, row_number() OVER (PARTITION BY repo, j ORDER BY name) AS n FROM (
  SELECT repo, j, unnest(['alpha', 'alpha_x', 'be', 'be_x', 'gone', 'gone_x', 'zeta', 'zeta_x']) AS name FROM f_modules) m
  WHERE NOT (name = 'alpha' AND EXISTS (SELECT 1 FROM f_modules o WHERE o.repo = m.repo AND o.j // 2 = m.j // 2 AND o.j % 5 = 0)) AND length(name) >= 3) WHERE n <= 4""", "f_modules"))
def cap_removed(spark, d):
    files = _renames(spark, d)
    sources = files.select("repo", "sha", F.col("filename").alias("path"), F.lit("x = 1\n").alias("content"))
    return symbols.removed_symbols(symbols.file_symbols(files, sources), per_file_cap=4).select("repo", "sha", "filename", "name")


@query("F8_cap_names", with_views(f"WITH {NAMES} SELECT repo, 'c0' AS sha, name FROM names", "f_symbols"))
def cap_names(spark, d):
    return symbols.searched_names(plan.changed_symbols(fx.symbol_changes(spark, d), fx.source_files(spark, d)))


SHOWN = f"""shown AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo, filename, name, change ORDER BY CASE link WHEN 'imports' THEN 0 ELSE 1 END, in_changed_file,
    CASE use_kind WHEN 'call' THEN 3 WHEN 'import' THEN 1 ELSE 0 END DESC, regexp_extract(path, '^(.*)/', 1) <> regexp_extract(filename, '^(.*)/', 1), path, line) AS rank
  FROM tiers WHERE NOT is_test AND link NOT IN ('shadowed', 'elsewhere')) WHERE rank <= CASE change WHEN 'body' THEN 2 ELSE 4 END)"""


@query("F9_top_callers", with_views(f"WITH {TIERS}, {SHOWN} SELECT repo, filename, name, change, path, line, CAST(rank AS INTEGER) AS caller_rank FROM shown", *TIER_VIEWS))
def top_callers(spark, d):
    return run_impact(spark, d).shown.select("repo", "filename", "name", "change", "path", "line", "caller_rank")


@query("F10_top_verify", with_views(f"WITH {TOP_VERIFY} SELECT repo, sha, filename, seq, CAST(n AS INTEGER) AS rank FROM top", "v_findings"))
def top_verify(spark, d):
    return fd.top_verify(fd.valid_findings(fx.raw_findings(spark, d))).select("repo", "sha", "filename", "seq", "rank")


def _sections(spark, d):
    """Evidence texts of uneven size: the lines of a document are the sections of a file."""
    lines = fx.raw_findings(spark, d)
    return lines.select("repo", "sha", "filename", "seq", "title")


@query("F11_evidence_budget", with_views("""WITH w AS (SELECT *, sum(length(title)) OVER w AS used, row_number() OVER w AS n FROM v_raw_findings WINDOW w AS (PARTITION BY repo, sha, filename ORDER BY seq ROWS UNBOUNDED PRECEDING)),
s AS (SELECT *, min(seq) FILTER (used > 700 AND n > 1) OVER (PARTITION BY repo, sha, filename) AS stop FROM w)
SELECT repo, sha, filename, seq FROM s WHERE stop IS NULL OR seq < stop""", "v_raw_findings"))
def evidence_budget(spark, d):
    from changelens.operators.grouping import prefix_within

    rows = _sections(spark, d)
    kept = prefix_within(rows, ["repo", "sha", "filename"], [F.col("seq")], F.length("title"), 700, first_always=True)
    return kept.select("repo", "sha", "filename", "seq")


@query("F11_evidence_sections", with_views(f"WITH {KEPT} SELECT repo, filename, name, change, CAST(row_number() OVER (PARTITION BY repo, filename ORDER BY CASE change WHEN 'signature' THEN 0 WHEN 'removed' THEN 1 ELSE 2 END) AS INTEGER) AS section FROM kept", *TIER_VIEWS))
def evidence_sections(spark, d):
    return run_impact(spark, d).sections.select("repo", "filename", "name", "change", "section")


@query("F12_recall_budget", f"""WITH l AS (SELECT doc_id, lang AS type, unnest(string_split(text, chr(10))) AS raw, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents),
m AS (SELECT doc_id, type, pos, regexp_replace(raw, {HEX_SQL}, '[REDACTED:assigned_hex]', 'g') AS x FROM l),
c AS (SELECT doc_id, pos, '- [' || type || '] ' || substring(translate(trim(regexp_replace(x, '[\\s\\p{{Z}}]+', ' ', 'g')), '<>', '‹›'), 1, 400) AS line FROM m WHERE pos < 12 AND trim(regexp_replace(x, '[\\s\\p{{Z}}]+', ' ', 'g')) <> ''),
w AS (SELECT *, sum(length(line)) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS used FROM c),
s AS (SELECT *, min(pos) FILTER (used > 1500) OVER (PARTITION BY doc_id) AS stop FROM w)
SELECT doc_id, CAST(pos AS INTEGER) AS pos, line FROM s WHERE stop IS NULL OR pos < stop""")
def recall_budget(spark, d):
    items = fx.table(spark, d, "documents").select("doc_id", F.col("lang").alias("type"), F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    return memory.recall_budget(items, ["doc_id"], max_tokens=500)


@query("F13_cap_headlines", with_views(f"""WITH {KEPT}, h AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY filename, CASE change WHEN 'signature' THEN 0 ELSE 1 END) AS n FROM kept WHERE change <> 'body' AND unmodified_callers > 0)
SELECT repo, filename, CAST(n AS INTEGER) AS rank, filename || ': `' || name || CASE change WHEN 'removed' THEN '` is gone; ' ELSE '` is declared differently; ' END || unmodified_callers || ' of ' || total_callers || ' uses are in untouched files' AS headline FROM h WHERE n <= 8""", *TIER_VIEWS))
def cap_headlines(spark, d):
    return run_impact(spark, d).headlines.select("repo", "filename", "rank", "headline")


@query("C23_impact_headline", with_views(f"""WITH {KEPT} SELECT repo, filename, name, change, CASE WHEN change <> 'body' AND unmodified_callers > 0 THEN filename || ': `' || name || CASE change WHEN 'removed' THEN '` is gone; ' ELSE '` is declared differently; ' END || unmodified_callers || ' of ' || total_callers || ' uses are in untouched files' END AS headline FROM kept""", *TIER_VIEWS))
def impact_headline(spark, d):
    return run_impact(spark, d).sections.select("repo", "filename", "name", "change", "headline")


@query("F13_summary_payload", with_views(f"""SELECT repo, sha, CAST(n AS INTEGER) AS rank, '- [' || severity || '/' || category || '] ' || filename || ':' || coalesce(CAST(line AS VARCHAR), '-') || ' ' || title AS text FROM (
  SELECT *, row_number() OVER (PARTITION BY repo, sha ORDER BY {SEVERITY_RANK}, filename, coalesce(line, 0), seq) AS n FROM v_findings) WHERE n <= 40""", "v_findings"))
def summary_payload(spark, d):
    return fd.summary_payload(fd.valid_findings(fx.raw_findings(spark, d)))


@query("F13_skip_notes", with_views(f"""WITH {TRIAGE}, s AS (SELECT *, row_number() OVER (PARTITION BY repo, sha ORDER BY filename) AS n, count(*) OVER (PARTITION BY repo, sha) AS total FROM triaged WHERE reason IS NOT NULL)
SELECT repo, sha, total AS n_skipped, 'skipped ' || total || ' file(s): ' || string_agg(filename || ': ' || reason, '; ' ORDER BY filename || ': ' || reason) || CASE WHEN total > 5 THEN ' …' ELSE '' END AS note FROM s WHERE n <= 5 GROUP BY repo, sha, total""", "v_changed_files"))
def skip_notes(spark, d):
    skipped = tr.triage(fx.changed_files(spark, d)).filter("reason IS NOT NULL")
    return publish.skip_notes(skipped)


@query("F14_keep_newest", """WITH s AS (SELECT event_type AS namespace, 'u' || user_id AS key, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS seq FROM events GROUP BY event_type, user_id)
SELECT namespace, key, seq FROM (SELECT *, row_number() OVER (PARTITION BY namespace ORDER BY ts DESC, seq DESC, key) AS n FROM s) WHERE n <= 100""")
def keep_newest(spark, d):
    rows = fx.table(spark, d, "events").selectExpr("event_type AS namespace", "concat('u', user_id) AS key", "props AS value", "cast(ts AS timestamp) AS ts", "event_id AS seq")
    return state.keep_newest(state.latest(rows), 100).select("namespace", "key", "seq")


@query("F14_keep_many", "SELECT event_type AS namespace, event_id AS seq FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 1500")
def keep_many(spark, d):
    rows = fx.table(spark, d, "events").selectExpr("event_type AS namespace", "concat('e', event_id) AS key", "cast(ts AS timestamp) AS ts", "event_id AS seq")
    return state.keep_newest(rows, 1_500).select("namespace", "seq")


@query("F15_parse_cap", with_views("""WITH m AS (SELECT DISTINCT repo, path FROM (SELECT repo, path, name FROM f_references UNION ALL SELECT repo, path, name FROM f_definitions) WHERE starts_with(name, 'sym_')),
r AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY path) AS n, count(*) OVER (PARTITION BY repo) AS total FROM m)
SELECT repo, path, n = 60 AND total > 60 AS incomplete FROM r WHERE n <= 60""", "f_references", "f_definitions"))
def parse_cap(spark, d):
    names = fx.modules(spark, d).select(F.concat(F.lit("r"), "n").alias("repo"), F.lit("c0").alias("sha"), F.concat(F.lit("sym_"), "j").alias("name"))
    return symbols.scan(fx.source_files(spark, d), names, max_parse=60).select("repo", "path", "incomplete")


@query("F15_scan_cap", with_views("""SELECT repo, path, false AS incomplete FROM (SELECT repo, path, row_number() OVER (PARTITION BY repo ORDER BY path) AS n FROM f_modules) WHERE n <= 70""", "f_modules"))
def scan_cap(spark, d):
    names = fx.modules(spark, d).select(F.concat(F.lit("r"), "n").alias("repo"), F.lit("c0").alias("sha"), F.concat(F.lit("sym_"), "j").alias("name"))
    return symbols.scan(fx.source_files(spark, d), names, max_scan=70).select("repo", "path", "incomplete")


@query("F16_collect_sorted", with_views("SELECT repo, sha, filename, seq, severity, line FROM v_findings", "v_findings"))
def collect_sorted(spark, d):
    return fd.collect_sorted(fd.valid_findings(fx.raw_findings(spark, d))).select("repo", "sha", "filename", "seq", "severity", "line")


# ----------------------------------------------------------------------------- set operations ---
@query("G1_all_comments", with_views("SELECT repo, kind, id, body FROM v_comments", "v_comments"))
def all_comments(spark, d):
    listed = fx.comments(spark, d)
    commit, review = listed.filter("kind = 'commit'").drop("kind"), listed.filter("kind = 'review'").drop("kind")
    return memory.all_comments(commit, review).select("repo", "kind", "id", "body")


@query("G2_trusted_logins", with_views("""SELECT DISTINCT repo, login FROM (SELECT repo, 'u' || right(repo, 1) AS login FROM v_comments UNION ALL SELECT repo, 'bot-me' FROM v_comments UNION ALL SELECT repo, 'u5' FROM v_comments)""", "v_comments"))
def trusted_logins(spark, d):
    from changelens.queries.joins import _owners

    return memory.trusted_logins(_owners(spark, d), "Bot-Me", ("U5",))


@query("G3_touched_lines", with_views("""SELECT DISTINCT repo, sha, filename, line FROM (SELECT repo, sha, filename, new_line AS line FROM f_patch_rows WHERE op = '+'
UNION ALL SELECT repo, sha, filename, greatest(gap_hi - 1, 0) FROM f_patch_rows WHERE op = '-' UNION ALL SELECT repo, sha, filename, gap_hi FROM f_patch_rows WHERE op = '-')""", "f_patch_rows"))
def touched_lines(spark, d):
    return diff.touched_lines(fx.changed_files(spark, d))


@query("G4_subtract_names", with_views("SELECT repo, path AS filename, 'old_' || j AS name FROM f_modules WHERE j % 9 = 2", "f_modules"))
def subtract_names(spark, d):
    per_file = symbols.file_symbols(fx.symbol_changes(spark, d), fx.source_files(spark, d))
    return per_file.select("repo", "filename", F.explode("removed").alias("name"))


@query("G5_defines_searched", with_views(f"WITH {NAMES} SELECT repo, path, name, start_line FROM f_definitions JOIN names USING (repo, name)", "f_symbols", "f_definitions"))
def defines_searched(spark, d):
    return symbols.definers(run_impact(spark, d).scanned).select("repo", "path", "name", "start_line")


@query("G6_pair_files", """SELECT CAST(doc_id AS VARCHAR) AS "case", source AS path FROM documents WHERE doc_id % 10 <> 3 AND NOT (doc_id % 10 <> 1 AND doc_id % 10 <> 2 AND
  len(list_filter(range(len(string_split(text, chr(10)))), lambda i: (doc_id + i) % 5 = 0 OR (doc_id + i) % 7 = 0)) = 0)""")
def pair_files(spark, d):
    from changelens.queries.texts import _trees

    return diff.line_diff(*_trees(spark, d))[0].select("case", "path")
