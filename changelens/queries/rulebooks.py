"""Languages and credential rules that callers add as rows."""

from pyspark.sql import functions as F

from changelens import fixtures as fx
from changelens.fixtures import with_views
from changelens.functions import leaks
from changelens.operators import rulebook, symbols
from changelens.operators import triage as tr
from changelens.operators.grouping import unnest
from changelens.options import Options
from changelens.plans import review
from changelens.queries.registry import query


def grammar(spark):
    """The built-in tables with the rows of one more language."""
    languages = rulebook.builtin_languages(spark).unionByName(spark.createDataFrame(fx.GO_LANGUAGES, rulebook.LANGUAGES))
    patterns = rulebook.builtin_patterns(spark).unionByName(spark.createDataFrame(fx.GO_PATTERNS, rulebook.PATTERNS))
    return rulebook.grammar_of(languages, patterns)


def _files(spark, d):
    return fx.go_files(spark, d).unionByName(fx.source_files(spark, d))


@query("I4_language_by_rows", with_views("""SELECT repo, path, name, kind, start_line, end_line, signature_end_line FROM f_definitions
UNION ALL SELECT repo, 'pkg/p' || j || '/m' || j || '.go', 'Cart_' || j, 'class', 6, 8, 6 FROM f_modules UNION ALL SELECT repo, 'pkg/p' || j || '/m' || j || '.go', 'Fill_' || j, 'method', 10, 13, 10 FROM f_modules
UNION ALL SELECT repo, 'pkg/p' || j || '/m' || j || '.go', 'Price_' || j, 'function', 15, 18, 16 FROM f_modules""", "f_definitions"))
def language_by_rows(spark, d):
    facts = symbols.with_source_facts(_files(spark, d), grammar=grammar(spark))
    return unnest(facts, ["repo", "path"], "definitions").select("repo", "path", "name", "kind", "start_line", "end_line", "signature_end_line")


@query("I4_scan_by_rows", with_views("""SELECT repo, 'pkg/p' || j || '/m' || j || '.go' AS path, 'Price_' || t AS name, 12 AS line, 'call' AS kind, 'Fill_' || j AS enclosing FROM f_modules""", "f_modules"))
def scan_by_rows(spark, d):
    """Uses in code only: the name also stands in a comment and in a raw string."""
    names = fx.modules(spark, d).select(F.concat(F.lit("r"), "n").alias("repo"), F.lit("c0").alias("sha"), F.concat(F.lit("Price_"), "j").alias("name"))
    scanned = symbols.scan(_files(spark, d), names, grammar=grammar(spark))
    return symbols.hits(scanned).select("repo", "path", "name", "line", "kind", "enclosing")


@query("I4_imports_by_rows", with_views("SELECT repo, 'pkg/p' || j || '/m' || j || '.go' AS path, 'repo/p' || t AS spec, 3 AS line FROM f_modules", "f_modules"))
def imports_by_rows(spark, d):
    facts = symbols.with_source_facts(fx.go_files(spark, d), grammar=grammar(spark))
    return unnest(facts, ["repo", "path"], "imports").select("repo", "path", "spec", "line")


def secret_rules(spark):
    """The built-in rules behind an own one, which takes tokens before any other looks."""
    own = spark.createDataFrame([(-1, "deploy_key", r"\bdk-[0-9a-f]{12}\b")], rulebook.SECRETS)
    return rulebook.secret_rules_of(rulebook.builtin_secrets(spark).unionByName(own))


def _lines(spark, d):
    text = "concat(text, CASE WHEN (doc_id + line) % 5 = 0 THEN concat(' dk-', substring(md5(cast(doc_id * 1000 + line AS string)), 1, 12)) ELSE '' END)"
    return fx.secret_lines(spark, d).withColumn("text", F.expr(text))


@query("I5_secret_rule_by_rows", with_views("""SELECT repo, sha, filename, line, kind FROM f_secrets
UNION ALL SELECT repo, sha, filename, line, 'deploy_key' FROM f_secret_lines WHERE (doc_id + line) % 5 = 0""", "f_secret_lines", "f_secrets"))
def secret_rule_by_rows(spark, d):
    found = unnest(_lines(spark, d), ["repo", "sha", "filename", "line"], leaks.secret_kinds("text", secret_rules(spark)))
    return found.withColumnRenamed("item", "kind")


@query("A14_options", with_views("""WITH f AS (SELECT repo, sha, filename, doc_id FROM v_changed_files WHERE patch IS NOT NULL AND doc_id % 2 = 0)
SELECT repo, sha, filename, 1::BIGINT AS keys, true AS redacted, 'deploy_key' AS kind, 2 AS line FROM f""", "v_changed_files"))
def options(spark, d):
    """One set of options through two jobs: an own rule finds and redacts, an own model makes other cache keys, and budgets bound the text."""
    given = Options(secret_rules=secret_rules(spark), model="other", max_file_chars=10**9, max_chunk_chars=2_000)
    files = fx.changed_files(spark, d).filter("patch IS NOT NULL AND doc_id % 2 = 0")
    marked = files.withColumn("patch", F.concat(F.lit("@@ -1,1 +1,2 @@\n line\n+key dk-"), F.substring(F.md5(F.col("doc_id").cast("string")), 1, 12)))
    hits = tr.secret_hits(marked, given.max_secrets_per_file, given.secret_rules).select("repo", "sha", "filename", "kind", "line")
    reviews = marked.select("repo", "sha").distinct()
    none = reviews.limit(0)
    tasks = lambda o: review.review_tasks(marked, none.withColumn("message", F.lit("")), marked.limit(0).withColumn("evidence", F.lit("")), none.withColumn("memory", F.lit("")), spark.createDataFrame([], "cache_key string, findings string"), o)
    asked = tasks(given).requests.select("repo", "sha", "filename", F.contains("prompt", F.lit("[REDACTED:deploy_key]")).alias("redacted"), "cache_key")
    plain = tasks(Options()).requests.select("cache_key").withColumn("same", F.lit(1))
    counted = asked.join(plain, "cache_key", "left").groupBy("repo", "sha", "filename").agg(F.count_if(F.col("same").isNull()).alias("keys"), F.bool_and("redacted").alias("redacted"))
    return counted.join(hits, ["repo", "sha", "filename"])
