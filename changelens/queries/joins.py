"""Joins: import links, ranges, decisions, publishing, scoring, memory, claims."""

from functools import lru_cache

from pyspark.sql import functions as F

from changelens import fixtures as fx
from changelens.fixtures import HEX_SQL, with_views
from changelens.functions import paths
from changelens.operators import diff, evaluate, impact, links, memory, publish, state, symbols
from changelens.operators import findings as fd
from changelens.operators.grouping import materialize, shuffled, unnest
from changelens.plans import impact as plan
from changelens.queries.registry import query
from changelens.queries.sources import request_contexts
from changelens.sources import events, requests

REVIEW = ["repo", "sha"]


def _links(spark, d, files):
    facts = symbols.with_source_facts(files).select("repo", "sha", "path", "language", "imports")
    targets = files.select("repo", "sha", F.col("path").alias("target"))
    return links.link_files(facts, targets).select("repo", "path", "target")


@query("D1_link_python_absolute", with_views("SELECT repo, path, target FROM f_links", "f_links"))
def link_python(spark, d):
    return _links(spark, d, fx.source_files(spark, d))


@query("D2_link_python_relative", with_views("""SELECT repo, 'app/sub' || (j % 4) || '/m' || j || '.py' AS path, CASE j % 3
  WHEN 0 THEN 'app/sub' || (j % 4) || '/near' || (j % 4) || '.py' WHEN 1 THEN 'app/base.py' ELSE 'app/pkg/__init__.py' END AS target FROM f_modules""", "f_modules"))
def link_python_relative(spark, d):
    m = fx.modules(spark, d)
    importers = m.selectExpr(
        "concat('r', n) AS repo", "'c0' AS sha", "concat('app/sub', j % 4, '/m', j, '.py') AS path",
        "CASE j % 3 WHEN 0 THEN concat('from .near', j % 4, ' import x\\n') WHEN 1 THEN 'from .. import base\\n' ELSE 'from ..pkg import (\\n    y,\\n)\\n' END AS content",
    )
    repos = m.selectExpr("concat('r', n) AS repo", "'c0' AS sha").distinct()
    targets = repos.select("repo", "sha", F.explode(F.array(*[F.lit(t) for t in ("app/base.py", "app/pkg/__init__.py", "base.py", "pkg/y.py", *[f"app/sub{i}/near{i}.py" for i in range(4)])])).alias("target"))
    facts = symbols.with_source_facts(importers).select("repo", "sha", "path", "language", "imports")
    return links.link_files(facts, targets).select("repo", "path", "target")


@query("D3_link_js", with_views("""SELECT DISTINCT a.repo, a.ts AS path, b.ts AS target FROM f_polyglot a JOIN f_polyglot b ON a.repo = b.repo AND (b.j = a.t OR b.j = a.u)""", "f_polyglot"))
def link_js(spark, d):
    return _links(spark, d, fx.polyglot_files(spark, d).filter("path LIKE '%.ts'"))


@query("D4_link_java", with_views("""SELECT DISTINCT a.repo, a.java AS path, b.java AS target FROM f_polyglot a JOIN f_polyglot b ON a.repo = b.repo AND (b.j = a.t OR b.j = a.u)""", "f_polyglot"))
def link_java(spark, d):
    return _links(spark, d, fx.polyglot_files(spark, d).filter("path LIKE '%.java'"))


@query("D4_same_package", with_views("SELECT repo, ts AS path, false AS same FROM f_polyglot UNION ALL SELECT repo, java, j % 7 = 3 FROM f_polyglot", "f_polyglot"))
def same_package(spark, d):
    files = fx.polyglot_files(spark, d).withColumn("other", F.lit("src/com/p3/Other.java"))
    return files.select("repo", "path", links.same_package("path", "other").alias("same"))


@lru_cache(maxsize=4)
def scan_all(spark, d):
    """Every symbol of the change searched in the sources, as the impact job does. Written once, read by several queries."""
    found = materialize(plan.changed_symbols(fx.symbol_changes(spark, d), fx.source_files(spark, d)))
    return found, materialize(symbols.scan(fx.source_files(spark, d), symbols.searched_names(found)))


NAMES = "names AS (SELECT DISTINCT repo, name FROM f_symbols)"


@query("D5_filter_references", with_views(f"WITH {NAMES} SELECT repo, path, name, line, kind FROM f_references JOIN names USING (repo, name)", "f_symbols", "f_references"))
def filter_references(spark, d):
    return symbols.hits(scan_all(spark, d)[1]).select("repo", "path", "name", "line", "kind")


@query("D6_touch", with_views("""WITH t AS (SELECT repo, path, CASE WHEN j % 9 = 1 THEN 13 ELSE 11 END AS line FROM f_modules WHERE j % 9 <= 2
  UNION ALL SELECT repo, path, CASE WHEN j % 9 = 1 THEN 12 ELSE 10 END FROM f_modules WHERE j % 9 <= 2)
SELECT DISTINCT d.repo, d.path, d.name, t.line, t.line <= d.signature_end_line AS in_header FROM f_definitions d JOIN t ON t.repo = d.repo AND t.path = d.path AND t.line BETWEEN d.start_line AND d.end_line""", "f_definitions"))
def touch(spark, d):
    touched = diff.touched_lines(fx.symbol_changes(spark, d)).withColumnRenamed("filename", "path")
    files = fx.source_files(spark, d).join(shuffled(touched.select("repo", "sha", "path").distinct()), ["repo", "sha", "path"], "left_semi")
    defs = unnest(symbols.with_source_facts(files), ["repo", "sha", "path"], "definitions")
    pairs = defs.join(shuffled(touched), ["repo", "sha", "path"]).filter(F.col("line").between(F.col("start_line"), F.col("end_line")))
    return pairs.select("repo", "path", "name", "line", (F.col("line") <= F.col("signature_end_line")).alias("in_header"))


@query("D7_enclosing_definition", with_views("""SELECT repo, path, name, line, enclosing, enclosing_start FROM f_references""", "f_references"))
def enclosing(spark, d):
    names = fx.modules(spark, d).select(
        F.concat(F.lit("r"), "n").alias("repo"), F.lit("c0").alias("sha"), F.explode(F.array(F.concat(F.lit("sym_"), "j"), F.concat(F.lit("old_"), "j"))).alias("name")
    )
    return symbols.hits(symbols.scan(fx.source_files(spark, d), names)).select("repo", "path", "name", "line", "enclosing", "enclosing_start")


USES = f"""{NAMES}, top AS (SELECT s.* FROM f_symbols s),
uses AS (SELECT s.repo, s.path AS filename, s.name, s.start_line, s.change, r.path, r.line, r.kind AS use_kind, r.enclosing, r.enclosing_start FROM top s JOIN names USING (repo, name)
  JOIN f_references r ON r.repo = s.repo AND r.name = s.name WHERE NOT (r.path = s.path AND r.line BETWEEN s.start_line AND s.end_line))"""


@query("D8_drop_own_body", with_views(f"WITH {USES} SELECT repo, filename, name, change, path, line, use_kind FROM uses", "f_symbols", "f_references"))
def drop_own_body(spark, d):
    found, scanned = scan_all(spark, d)
    return impact.uses(found, symbols.hits(scanned)).select("repo", "filename", "name", "change", "path", "line", "use_kind")


@query("D9_removed_symbols", with_views("SELECT repo, path AS filename, name FROM f_symbols WHERE change = 'removed' AND name IN (SELECT name FROM (SELECT name, repo, path FROM f_symbols))", "f_symbols"))
def removed_symbols(spark, d):
    per_file = symbols.file_symbols(fx.symbol_changes(spark, d), fx.source_files(spark, d))
    return symbols.removed_symbols(per_file).select("repo", "filename", "name")


GROUPED = f"""{USES},
g AS (SELECT repo, filename, name, start_line, change, path, coalesce(enclosing_start, line) AS at_line, count(*) AS sites,
    arg_max(line, (CASE use_kind WHEN 'call' THEN 3 WHEN 'import' THEN 1 ELSE 0 END, -line)) AS line,
    arg_max(use_kind, (CASE use_kind WHEN 'call' THEN 3 WHEN 'import' THEN 1 ELSE 0 END, -line)) AS use_kind, min(enclosing) AS enclosing FROM uses GROUP BY ALL),
callers AS (SELECT * FROM g WHERE use_kind <> 'import' OR NOT EXISTS (SELECT 1 FROM g x WHERE x.repo = g.repo AND x.filename = g.filename AND x.name = g.name AND x.path = g.path AND x.use_kind <> 'import'))"""


@query("D10_drop_redundant_imports", with_views(f"WITH {GROUPED} SELECT repo, filename, name, path, line, use_kind, sites FROM callers", "f_symbols", "f_references"))
def drop_redundant_imports(spark, d):
    found, scanned = scan_all(spark, d)
    grouped = impact.drop_redundant_imports(impact.group_callers(impact.uses(found, symbols.hits(scanned))))
    return grouped.select("repo", "filename", "name", "path", "line", "use_kind", "sites")


# definers among the scanned names, and the tier of every caller
TIERS = f"""{GROUPED}, defs AS (SELECT d.repo, d.name, d.path, d.start_line FROM f_definitions d JOIN names USING (repo, name)),
tiers AS (SELECT c.*, CASE WHEN c.path = c.filename THEN 'unknown' WHEN l.target IS NOT NULL THEN 'imports'
    WHEN EXISTS (SELECT 1 FROM defs x WHERE x.repo = c.repo AND x.name = c.name AND x.path = c.path) THEN 'shadowed'
    WHEN EXISTS (SELECT 1 FROM defs x JOIN f_links y ON y.repo = x.repo AND y.target = x.path WHERE x.repo = c.repo AND x.name = c.name AND x.path <> c.filename AND y.path = c.path) THEN 'elsewhere'
    ELSE 'unknown' END AS link, regexp_matches(c.path, '(^|/)tests?/') AS is_test,
    EXISTS (SELECT 1 FROM f_symbols s WHERE s.repo = c.repo AND s.path = c.path) AS in_changed_file
  FROM callers c LEFT JOIN f_links l ON l.repo = c.repo AND l.path = c.path AND l.target = c.filename)"""
TIER_VIEWS = ("f_symbols", "f_references", "f_definitions", "f_links")


@lru_cache(maxsize=4)
def run_impact(spark, d):
    """The impact job; its checkpointed tables serve all queries that look at one part of it."""
    return plan.impact(fx.symbol_changes(spark, d), fx.source_files(spark, d))


@query("D11_link_tier", with_views(f"WITH {TIERS} SELECT repo, filename, name, path, line, link FROM tiers", *TIER_VIEWS))
def link_tier(spark, d):
    return run_impact(spark, d).callers.select("repo", "filename", "name", "path", "line", "link")


@query("D12_in_changed_file", with_views(f"WITH {TIERS} SELECT repo, filename, name, path, line, in_changed_file, is_test FROM tiers", *TIER_VIEWS))
def in_changed_file(spark, d):
    return run_impact(spark, d).callers.select("repo", "filename", "name", "path", "line", "in_changed_file", "is_test")


@query("D13_cache_lookup", with_views("""SELECT repo, sha, filename, doc_id % 3 = 0 AS cached FROM v_changed_files WHERE patch IS NOT NULL""", "v_changed_files"))
def cache_lookup(spark, d):
    asked = fx.changed_files(spark, d).filter("patch IS NOT NULL").selectExpr("repo", "sha", "filename", "doc_id", "sha2(patch, 256) || doc_id AS cache_key")
    cache = asked.filter("doc_id % 3 = 0").selectExpr("cache_key", "'[]' AS findings")
    hit, miss = requests.cache_lookup(asked, cache)
    return hit.select("repo", "sha", "filename", F.lit(True).alias("cached")).union(miss.select("repo", "sha", "filename", F.lit(False)))


DECIDED = """decided AS (SELECT f.*, d.verdict FROM v_findings f LEFT JOIN v_decisions d USING (repo, sha, filename, seq)),
final AS (SELECT repo, sha, filename, seq, category, line, title, detail, suggestion, origin, CASE WHEN origin = 'model' AND verdict = 'uncertain' AND severity IN ('critical', 'major')
    THEN CASE severity WHEN 'critical' THEN 'major' ELSE 'minor' END ELSE severity END AS severity
  FROM decided WHERE NOT (origin = 'model' AND severity IN ('critical', 'major') AND coalesce(verdict, '') = 'refuted'))"""


def decided(spark, d):
    raw = fx.raw_findings(spark, d)
    return fd.apply_decisions(fd.valid_findings(raw), fx.decisions(raw))


@query("D14_apply_decisions", with_views(f"WITH {DECIDED} SELECT repo, sha, filename, seq, severity FROM final", "v_findings", "v_decisions"))
def apply_decisions(spark, d):
    return decided(spark, d).select("repo", "sha", "filename", "seq", "severity")


FRESH = """f AS (SELECT *, substring(sha1(filename || '|' || category || '|' || regexp_replace(lower(title), '[^\\p{L}\\p{Nd}\\p{M}]+', '', 'g')), 1, 12) AS fp FROM v_findings WHERE line IS NOT NULL),
fresh AS (SELECT * FROM f WHERE (repo, fp) NOT IN (SELECT repo, fp FROM f WHERE seq % 4 = 1) AND (repo, filename, line) NOT IN (SELECT repo, filename, line FROM f WHERE seq % 5 = 2))"""


def _fresh(spark, d):
    """Earlier own comments are the inline bodies of part of the findings; others only share the anchor."""
    found = fd.valid_findings(fx.raw_findings(spark, d)).filter("line IS NOT NULL")
    printed = found.filter("seq % 4 = 1").select("repo", F.lit(None).cast("string").alias("path"), F.lit(None).cast("int").alias("line"), publish.inline_body().alias("body"), F.lit("me").alias("author"))
    anchored = found.filter("seq % 5 = 2").select("repo", F.col("filename").alias("path"), "line", F.lit("<!-- changelens-inline -->").alias("body"), F.lit("ME").alias("author"))
    foreign = found.select("repo", F.col("filename").alias("path"), "line", F.lit("plain").alias("body"), F.lit("other").alias("author"))
    prints, anchors = publish.existing_inline(printed.union(anchored).union(foreign), "me")
    return publish.fresh_inline(found, prints, anchors)


@query("D15_fresh_inline", with_views(f"WITH {FRESH} SELECT repo, sha, filename, seq, line FROM fresh", "v_findings"))
def fresh_inline(spark, d):
    return _fresh(spark, d).select("repo", "sha", "filename", "seq", "line")


@query("A9_post_inline", with_views(f"""WITH {FRESH} SELECT repo, sha, filename, seq, CAST(n AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY repo, sha ORDER BY filename, seq) AS n FROM fresh WHERE sha <> 'c1') WHERE n <= 50""", "v_findings"))
def post_inline(spark, d):
    fresh = _fresh(spark, d)
    rejected = fresh.select("repo", "sha").filter("sha = 'c1'")
    return publish.post_inline(fresh, rejected).select("repo", "sha", "filename", "seq", "rank")


@query("D16_hide_inline", with_views("""SELECT repo, sha, filename, seq FROM v_findings WHERE line IS NULL OR (repo, sha, filename, line) NOT IN (SELECT repo, sha, filename, line FROM v_findings WHERE line IS NOT NULL AND seq % 3 = 0)""", "v_findings"))
def hide_inline(spark, d):
    found = fd.valid_findings(fx.raw_findings(spark, d))
    return publish.hide_inline(found, found.filter("line IS NOT NULL AND seq % 3 = 0")).select("repo", "sha", "filename", "seq")


def eval_tables(spark, d):
    """Cases are labelled documents, runs are configurations, expectations look for the first word of the text."""
    labels = fx.table(spark, d, "labels")
    docs = fx.table(spark, d, "documents").select("doc_id", "text").withColumn("word", F.regexp_extract(F.lower("text"), "([a-z]+)", 1))
    cases = labels.join(docs, "doc_id").selectExpr(
        "doc_id AS case", "CASE WHEN toxic = 1 THEN 'cross_file' WHEN quality = 1 THEN 'clean' ELSE 'local' END AS category", "word",
        "explode(array('A', 'B', 'C')) AS run",
    )
    expectations = cases.filter("category <> 'clean' AND run = 'A'").selectExpr(
        "case", "1 AS expectation", "'f' || case AS file", "word AS pattern", "CASE WHEN case % 2 = 0 THEN 'major' ELSE 'minor' END AS min_severity"
    )
    raw = fx.raw_findings(spark, d).withColumn("filename", F.expr("'f' || doc_id"))
    findings = fd.valid_findings(raw).withColumnRenamed("doc_id", "case").join(
        labels.select(F.col("doc_id").alias("case")), "case", "left_semi"
    ).withColumn("run", F.explode(F.array(F.lit("A"), F.lit("B"), F.lit("C")))).filter("(ascii(run) + seq) % 3 <> 0")
    return cases.select("case", "run", "category"), expectations, findings


EVAL = """cases AS (SELECT d.doc_id AS "case", CASE WHEN toxic = 1 THEN 'cross_file' WHEN quality = 1 THEN 'clean' ELSE 'local' END AS category, regexp_extract(lower(text), '([a-z]+)', 1) AS word FROM labels l JOIN documents d ON d.doc_id = l.doc_id),
runs AS (SELECT unnest(['A', 'B', 'C']) AS run), cr AS (SELECT * FROM cases, runs),
vf AS (SELECT r.doc_id AS "case", run, r.seq, lower(trim(severity)) AS severity, title || chr(10) || title || ' in f' AS text0, title, detail, coalesce(suggestion, '') AS suggestion FROM v_raw_findings r JOIN labels l ON l.doc_id = r.doc_id, runs
  WHERE (ascii(run) + r.seq) % 3 <> 0 AND severity <> 'blocker' AND length(title) BETWEEN 1 AND 200 AND length(detail) <= 2000),
vr AS (SELECT *, CASE severity WHEN 'critical' THEN 0 WHEN 'major' THEN 1 WHEN 'minor' THEN 2 ELSE 3 END AS rank FROM vf),
hits AS (SELECT v.* FROM vr v JOIN cases c ON c."case" = v."case" WHERE c.category <> 'clean' AND rank <= CASE WHEN v."case" % 2 = 0 THEN 1 ELSE 2 END AND contains(lower(title || chr(10) || detail || chr(10) || suggestion), word)),
met AS (SELECT "case", run, 1 AS matched FROM hits GROUP BY "case", run),
wrong AS (SELECT "case", run, count(*) AS fp FROM vr v WHERE rank <= 1 AND NOT EXISTS (SELECT 1 FROM hits h WHERE h."case" = v."case" AND h.run = v.run AND h.seq = v.seq) GROUP BY "case", run),
scores AS (SELECT cr."case", cr.run, category, CAST(CASE WHEN category <> 'clean' THEN 1 ELSE 0 END AS BIGINT) AS expected, CAST(coalesce(matched, 0) AS BIGINT) AS matched, CAST(coalesce(fp, 0) AS BIGINT) AS false_positives
  FROM cr LEFT JOIN met ON met."case" = cr."case" AND met.run = cr.run LEFT JOIN wrong ON wrong."case" = cr."case" AND wrong.run = cr.run)"""


@query("D17_match_expectations", with_views(f'WITH {EVAL} SELECT "case", run, CAST(seq AS INTEGER) AS seq FROM hits', "v_raw_findings"))
def match_expectations(spark, d):
    _, expectations, findings = eval_tables(spark, d)
    return evaluate.matches(expectations, findings).select("case", "run", "seq")


def _owners(spark, d):
    return fx.comments(spark, d).select("repo").distinct().withColumn("owner", F.concat(F.lit("U"), F.substring("repo", -1, 1)))


def repo_reactions(spark, d):
    keyed = fx.comments(spark, d).selectExpr("repo", "kind", "id AS comment_id")
    return fx.reactions(spark, d).join(keyed, "comment_id")


@query("D18_trusted_reactions", with_views("""SELECT event_id, c.repo, content, login FROM v_reactions r JOIN v_comments c ON c.id = r.comment_id
WHERE lower(login) IN ('u' || right(c.repo, 1), 'bot-me', 'u5')""", "v_reactions", "v_comments"))
def trusted_reactions(spark, d):
    logins = memory.trusted_logins(_owners(spark, d), "Bot-Me", ("U5",))
    return memory.trusted_reactions(repo_reactions(spark, d), logins).select("event_id", "repo", "content", "login")


@query("D19_changed_conventions", f"""SELECT lang AS repo, 'd' || doc_id AS path, sha256(regexp_replace(text, {HEX_SQL}, '[REDACTED:assigned_hex]', 'g')) AS digest FROM documents WHERE doc_id % 3 <> 0""")
def changed_conventions(spark, d):
    docs = fx.table(spark, d, "documents").selectExpr("lang AS repo", "'d' || doc_id AS path", "text AS content", "doc_id")
    stored = docs.withColumn("digest", memory.digest("content")).selectExpr(
        "'conventions' AS namespace", "concat_ws(':', repo, path) AS key", "CASE doc_id % 3 WHEN 0 THEN digest WHEN 1 THEN 'old' END AS value", "doc_id"
    ).filter("doc_id % 3 < 2")
    return memory.changed_conventions(docs, stored).select("repo", "path", "digest")


RATED = """rated AS (SELECT c.repo, c.kind, c.id AS comment_id, count(*) AS n_reactions,
    bool_or(lower(login) IN ('u' || right(c.repo, 1), 'bot-me', 'u5') AND content IN ('+1', 'heart', 'hooray', 'rocket')) AS pos,
    bool_or(lower(login) IN ('u' || right(c.repo, 1), 'bot-me', 'u5') AND content IN ('-1', 'confused')) AS neg
  FROM v_reactions r JOIN v_comments c ON c.id = r.comment_id GROUP BY ALL),
ratings AS (SELECT repo, kind, comment_id, n_reactions, CASE WHEN pos AND NOT neg THEN 'helpful' WHEN neg AND NOT pos THEN 'not-helpful' END AS rating FROM rated)"""


def ratings(spark, d):
    return memory.ratings(repo_reactions(spark, d), memory.trusted_logins(_owners(spark, d), "Bot-Me", ("U5",)))


def feedback_state(rated):
    return rated.filter("comment_id % 2 = 0").selectExpr(
        "'feedback' AS namespace", "concat_ws(':', repo, kind, comment_id) AS key", "CASE WHEN comment_id % 4 = 0 THEN concat_ws(':', rating, n_reactions) ELSE 'x' END AS value"
    )


@query("D20_changed_feedback", with_views(f"WITH {RATED} SELECT repo, kind, comment_id, rating || ':' || n_reactions AS signature FROM ratings WHERE rating IS NOT NULL AND comment_id % 4 <> 0", "v_reactions", "v_comments"))
def changed_feedback(spark, d):
    rated = ratings(spark, d)
    return memory.changed_feedback(rated, feedback_state(rated)).select("repo", "kind", "comment_id", "signature")


@query("D21_attach_evidence", with_views("""SELECT repo, sha, filename, 'Change ' || sha AS message, CASE WHEN filename LIKE '%.py' THEN 'seen' ELSE '' END AS evidence,
  CASE WHEN repo = 'en' THEN '- [memory] known' ELSE '' END AS memory FROM v_changed_files WHERE patch IS NOT NULL""", "v_changed_files"))
def attach_evidence(spark, d):
    return request_contexts(spark, d).select("repo", "sha", "filename", "message", "evidence", "memory")


CLAIMS = """keyed AS (SELECT *, lower(repo) || '@' || lower(sha) || '#' || coalesce(pr_number, 0) AS key FROM f_targets),
claims AS (SELECT key, arg_min(event_id, (received_ts, event_id, seq)) AS event_id FROM keyed GROUP BY key)"""


def targets(spark, d):
    return events.with_key(events.event_filter(events.read_events(fx.events(spark, d)), ("push", "pull_request")))


@query("D22_claim", with_views(f"WITH {CLAIMS} SELECT key, event_id FROM claims WHERE key NOT LIKE 'org/r3@%'", "f_targets"))
def claim(spark, d):
    found = targets(spark, d)
    known = found.filter("key LIKE 'org/r3@%'").select("key").distinct()
    return state.claim(found, known).select("key", "event_id")
