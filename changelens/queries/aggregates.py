"""Aggregations."""

from pyspark.sql import functions as F

from changelens import fixtures as fx
from changelens.fixtures import SEVERITY_RANK, with_views
from changelens.operators import evaluate, impact, symbols
from changelens.operators import findings as fd
from changelens.queries.joins import DECIDED, EVAL, GROUPED, RATED, TIER_VIEWS, TIERS, decided, eval_tables, ratings, run_impact, scan_all
from changelens.queries.registry import query


def _targets(spark, d):
    return fx.changed_files(spark, d).select("repo", "sha").distinct()


@query("E1_verdict", with_views(f"""WITH {DECIDED}, t AS (SELECT DISTINCT lang AS repo, 'c' || (doc_id // 200) AS sha FROM documents UNION ALL SELECT DISTINCT source, 'c0' FROM documents),
k AS (SELECT repo, sha, CASE WHEN repo = 'de' THEN 'nit' ELSE severity END AS severity FROM final)
SELECT t.repo, t.sha, CASE WHEN min({SEVERITY_RANK}) FILTER (k.severity IS NOT NULL) <= 1 THEN 'request_changes' WHEN count(k.severity) > 0 THEN 'comment' ELSE 'approve' END AS verdict,
  count(k.severity) AS n_findings FROM t LEFT JOIN k ON k.repo = t.repo AND k.sha = t.sha GROUP BY t.repo, t.sha""", "v_findings", "v_decisions"))
def verdict(spark, d):
    """German reviews only have nits, and sources stand for reviews without any finding."""
    found = decided(spark, d).withColumn("severity", F.expr("CASE WHEN repo = 'de' THEN 'nit' ELSE severity END"))
    quiet = fx.table(spark, d, "documents").select(F.col("source").alias("repo"), F.lit("c0").alias("sha")).distinct()
    return fd.verdict(_targets(spark, d).union(quiet), found)


@query("E2_severity_counts", with_views("""SELECT repo, sha, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'major') AS major,
  count(*) FILTER (severity = 'minor') AS minor, count(*) FILTER (severity = 'nit') AS nit FROM v_findings GROUP BY repo, sha""", "v_findings"))
def severity_counts(spark, d):
    return fd.severity_counts(fd.valid_findings(fx.raw_findings(spark, d)))


@query("E3_group_callers", with_views(f"WITH {GROUPED} SELECT repo, filename, name, change, path, line, use_kind, sites, enclosing FROM g", "f_symbols", "f_references"))
def group_callers(spark, d):
    found, scanned = scan_all(spark, d)
    grouped = impact.group_callers(impact.uses(found, symbols.hits(scanned)))
    return grouped.select("repo", "filename", "name", "change", "path", "line", "use_kind", "sites", "enclosing")


COUNTS = f"""{TIERS},
counts AS (SELECT s.repo, s.path AS filename, s.name, s.start_line, s.change, s.kind, s.end_line,
    count(*) FILTER (NOT t.is_test AND t.link NOT IN ('shadowed', 'elsewhere')) AS total_callers,
    count(*) FILTER (NOT t.is_test AND t.link NOT IN ('shadowed', 'elsewhere') AND NOT t.in_changed_file) AS unmodified_callers,
    count(*) FILTER (NOT t.is_test AND t.link IN ('shadowed', 'elsewhere')) AS likely_unrelated,
    (SELECT count(*) FROM defs x WHERE x.repo = s.repo AND x.name = s.name AND NOT (x.path = s.path AND x.start_line = s.start_line)) AS other_definitions
  FROM f_symbols s LEFT JOIN tiers t ON t.repo = s.repo AND t.filename = s.path AND t.name = s.name AND t.change = s.change GROUP BY s.repo, s.path, s.name, s.start_line, s.change, s.kind, s.end_line)"""


@query("E4_symbol_counts", with_views(f"WITH {COUNTS} SELECT repo, filename, name, change, total_callers, unmodified_callers, likely_unrelated FROM counts", *TIER_VIEWS))
def symbol_counts(spark, d):
    return run_impact(spark, d).symbol_impact.select("repo", "filename", "name", "change", "total_callers", "unmodified_callers", "likely_unrelated")


@query("E5_test_files", with_views(f"""WITH {TIERS}, p AS (SELECT DISTINCT repo, filename, name, change, path FROM tiers WHERE is_test),
r AS (SELECT *, row_number() OVER (PARTITION BY repo, filename, name, change ORDER BY path) AS n FROM p)
SELECT repo, filename, name, change, string_agg(path, ',' ORDER BY path) AS test_files FROM r WHERE n <= 3 GROUP BY repo, filename, name, change""", *TIER_VIEWS))
def test_files(spark, d):
    found = run_impact(spark, d).symbol_impact.filter(F.size("test_files") > 0)
    return found.select("repo", "filename", "name", "change", F.array_join("test_files", ",").alias("test_files"))


@query("E6_other_definitions", with_views(f"WITH {COUNTS} SELECT repo, filename, name, change, other_definitions FROM counts", *TIER_VIEWS))
def other_definitions(spark, d):
    return run_impact(spark, d).symbol_impact.select("repo", "filename", "name", "change", "other_definitions")


KEPT = f"{COUNTS}, kept AS (SELECT * FROM counts WHERE total_callers > 0 AND (change <> 'body' OR unmodified_callers > 0))"


@query("E7_keep_symbols", with_views(f"WITH {KEPT} SELECT repo, filename, name, change FROM kept", *TIER_VIEWS))
def keep_symbols(spark, d):
    return impact.keep_symbols(run_impact(spark, d).symbol_impact).select("repo", "filename", "name", "change")


@query("E8_rating", with_views(f"WITH {RATED} SELECT repo, kind, comment_id, rating, n_reactions FROM ratings", "v_reactions", "v_comments"))
def rating(spark, d):
    return ratings(spark, d)


TOP_VERIFY = f"""top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo, sha ORDER BY {SEVERITY_RANK}, filename, coalesce(line, 0), seq) AS n
  FROM v_findings WHERE origin = 'model' AND severity IN ('critical', 'major')) WHERE n <= 10)"""


@query("E9_verify_stats", with_views(f"""WITH {TOP_VERIFY}, l AS (SELECT top.repo, top.sha, CASE WHEN verdict IN ('confirmed', 'refuted', 'uncertain') THEN verdict ELSE 'unverified' END AS v
  FROM top LEFT JOIN v_decisions USING (repo, sha, filename, seq))
SELECT repo, sha, count(*) FILTER (v = 'refuted') AS dropped, count(*) FILTER (v = 'uncertain') AS downgraded, count(*) FILTER (v = 'unverified') AS failed FROM l GROUP BY repo, sha""", "v_findings", "v_decisions"))
def verify_stats(spark, d):
    raw = fx.raw_findings(spark, d)
    return fd.verify_stats(fd.verify_log(fd.top_verify(fd.valid_findings(raw)), fx.decisions(raw)))


@query("E10_score_cases", with_views(f'WITH {EVAL} SELECT "case", run, category, expected, matched, false_positives FROM scores', "v_raw_findings"))
def score_cases(spark, d):
    return evaluate.score_cases(*eval_tables(spark, d))


_RATIOS = """CAST(CASE WHEN expected > 0 THEN matched / expected ELSE 1 END AS DOUBLE) AS recall,
  CAST(CASE WHEN matched + false_positives > 0 THEN matched / (matched + false_positives) ELSE 1 END AS DOUBLE) AS precision"""
_SUMS = "CAST(sum(expected) AS BIGINT) AS expected, CAST(sum(matched) AS BIGINT) AS matched, CAST(sum(false_positives) AS BIGINT) AS false_positives"


@query("E11_eval_summary", with_views(f"WITH {EVAL}, s AS (SELECT run, {_SUMS} FROM scores GROUP BY run) SELECT *, {_RATIOS} FROM s", "v_raw_findings"))
def eval_summary(spark, d):
    return evaluate.summary(evaluate.score_cases(*eval_tables(spark, d)), "run")


@query("E12_eval_by_category", with_views(f"WITH {EVAL} SELECT coalesce(category, 'TOTAL') AS category, {_SUMS} FROM scores GROUP BY ROLLUP (category)", "v_raw_findings"))
def eval_by_category(spark, d):
    return evaluate.by_category(evaluate.score_cases(*eval_tables(spark, d)))


@query("E13_compare_configs", with_views(f"""WITH {EVAL} SELECT "case", CAST(sum(matched) FILTER (run = 'A') AS BIGINT) AS "A", CAST(sum(matched) FILTER (run = 'B') AS BIGINT) AS "B",
  CAST(sum(matched) FILTER (run = 'C') AS BIGINT) AS "C" FROM scores GROUP BY "case" """, "v_raw_findings"))
def compare_configs(spark, d):
    scores = evaluate.score_cases(*eval_tables(spark, d)).withColumnRenamed("run", "config")
    return evaluate.compare_configs(scores, ["A", "B", "C"])


@query("E14_merge_reviews", with_views("""SELECT repo, sha, filename, seq, origin FROM v_findings UNION ALL
SELECT repo, sha, filename, i, 'model' FROM v_response_items WHERE NOT broken AND i < 8 AND severity <> 'severe' AND (raw_line IS NULL OR raw_line >= 1) AND length(title) BETWEEN 1 AND 200""", "v_findings", "v_response_items"))
def merge_reviews(spark, d):
    fields = ["repo", "sha", "filename", "seq", "origin"]
    local = fd.valid_findings(fx.raw_findings(spark, d)).select(fields)
    return local.unionByName(fd.parse_responses(fx.responses(spark, d)).select(fields))


@query("E15_review_complete", with_views("""SELECT lang AS repo, 'c' || (doc_id // 200) AS sha, filename, CAST(1 AS BIGINT) AS chunks,
  CAST(CASE WHEN doc_id % 8 = 3 OR doc_id % 21 = 5 THEN 1 ELSE 0 END AS BIGINT) AS errors, NOT (doc_id % 8 = 3 OR doc_id % 21 = 5) OR doc_id % 4 = 0 AS reviewed
FROM documents JOIN (SELECT doc_id, filename FROM v_changed_files) USING (doc_id)""", "v_changed_files"))
def review_complete(spark, d):
    ruled = fx.changed_files(spark, d).filter("doc_id % 4 = 0")
    return fd.review_complete(fx.responses(spark, d), ruled)


@query("E15_publishable", with_views("""SELECT repo, sha, CAST(sum(CASE WHEN ok THEN 1 ELSE 0 END) AS BIGINT) AS reviewed, CAST(sum(CASE WHEN bad THEN 1 ELSE 0 END) AS BIGINT) AS errors,
  bool_or(ok) OR NOT bool_or(bad) AS publish FROM (SELECT repo, sha, doc_id % 8 = 3 OR doc_id % 21 = 5 AS bad, NOT (doc_id % 8 = 3 OR doc_id % 21 = 5) OR doc_id % 4 = 0 AS ok FROM v_changed_files) GROUP BY repo, sha""", "v_changed_files"))
def publishable(spark, d):
    ruled = fx.changed_files(spark, d).filter("doc_id % 4 = 0")
    return fd.publishable(fd.review_complete(fx.responses(spark, d), ruled))


@query("E16_impact_stats", with_views(f"""WITH names AS (SELECT DISTINCT repo, name FROM f_symbols),
f AS (SELECT repo, count(DISTINCT path) AS files_parsed FROM (SELECT repo, path, name FROM f_references UNION ALL SELECT repo, path, name FROM f_definitions) JOIN names USING (repo, name) GROUP BY repo)
SELECT s.repo, 'c0' AS sha, count(*) AS symbols, (SELECT count(*) FROM names n WHERE n.repo = s.repo) AS names, any_value(f.files_parsed) AS files_parsed, false AS incomplete
FROM f_symbols s JOIN f USING (repo) GROUP BY s.repo""", *TIER_VIEWS))
def impact_stats(spark, d):
    return run_impact(spark, d).stats
