"""Lines, diffs, credentials, symbols and text functions."""

from pyspark.sql import functions as F

from changelens import fixtures as fx
from changelens import rules
from changelens.fixtures import with_views
from changelens.functions import code, diffs, leaks, paths
from changelens.functions import text as tx
from changelens.operators import diff, findings, impact, memory, publish, symbols
from changelens.operators import triage as tr
from changelens.operators.grouping import unnest
from changelens.queries.filters import _BASE, _paths
from changelens.queries.registry import query
from changelens.queries.sources import ANNOTATED


@query("C1_explode_patch", with_views("SELECT repo, sha, filename, hunk_id, pos, op, new_line, gap_hi, text FROM f_patch_rows", "f_patch_rows"))
def explode_patch(spark, d):
    return diff.explode_patch(fx.changed_files(spark, d))


@query("C1_annotate_patch", with_views(f"""WITH {ANNOTATED} SELECT repo, sha, filename, string_agg(row, chr(10) ORDER BY hunk_id, pos) AS annotated
FROM a_rows GROUP BY ALL""", "f_patch_rows"))
def annotate_patch(spark, d):
    files = fx.changed_files(spark, d).filter("patch IS NOT NULL")
    return files.select("repo", "sha", "filename", diffs.annotate_patch("patch").alias("annotated"))


@query("C2_added_lines", with_views("SELECT DISTINCT repo, sha, filename, new_line FROM f_patch_rows WHERE op = '+'", "f_patch_rows"))
def added_lines(spark, d):
    return diff.changed_lines(fx.changed_files(spark, d))


@query("C2_deletion_gaps", with_views("SELECT DISTINCT repo, sha, filename, greatest(0, gap_hi - 1) AS gap_lo, gap_hi FROM f_patch_rows WHERE op = '-'", "f_patch_rows"))
def deletion_gaps(spark, d):
    return diff.deletion_gaps(fx.changed_files(spark, d))


@query("C3_trim_patch", with_views("""WITH h AS (SELECT doc_id, repo, sha, filename, hunk_id,
    '@@ -' || (hunk_id * 8 - 7) || ',8 +' || (hunk_id * 8 - 7 + 100 * (hunk_id - 1)) || ',8 @@' || chr(10) || string_agg(op || text, chr(10) ORDER BY pos) AS t FROM f_patch_rows GROUP BY doc_id, repo, sha, filename, hunk_id),
n AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n, sum(length(t) + 1) OVER (PARTITION BY doc_id) - 1 AS total FROM h),
s AS (SELECT *, CASE WHEN hunk_id <= (n + 1) // 2 THEN 2 * (hunk_id - 1) ELSE 2 * (n - hunk_id) + 1 END AS step FROM n),
r AS (SELECT *, sum(length(t) + 1) OVER (PARTITION BY doc_id ORDER BY step ROWS UNBOUNDED PRECEDING) <= 1500 AS fits FROM s)
SELECT repo, sha, filename, CASE WHEN total <= 1500 THEN string_agg(t, chr(10) ORDER BY hunk_id)
    WHEN count(*) FILTER (fits) = 0 THEN regexp_replace(substring(arg_min(t, hunk_id), 1, 1500), '\\n[^\\n]*$', '')
    ELSE string_agg(t, chr(10) ORDER BY hunk_id) FILTER (fits) END AS patch,
  CAST(CASE WHEN total <= 1500 THEN 0 ELSE n - greatest(count(*) FILTER (fits), 1) END AS INTEGER) AS omitted
FROM r GROUP BY repo, sha, filename, total, n""", "f_patch_rows"))
def trim_patch(spark, d):
    return diff.trim_patches(fx.changed_files(spark, d).filter("patch IS NOT NULL"), 1_500)


@query("C4_chunk_text", """WITH RECURSIVE l AS (SELECT doc_id, i, substring(x, 1, 1000) AS x FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE length(text) > 1000)),
f AS (SELECT doc_id, i, x, 0 AS chunk, length(x) + 1 AS size FROM l WHERE i = 1
  UNION ALL SELECT l.doc_id, l.i, l.x, CASE WHEN f.size + length(l.x) + 1 > 1000 THEN f.chunk + 1 ELSE f.chunk END,
    CASE WHEN f.size + length(l.x) + 1 > 1000 THEN length(l.x) + 1 ELSE f.size + length(l.x) + 1 END FROM f JOIN l ON l.doc_id = f.doc_id AND l.i = f.i + 1)
SELECT doc_id, CAST(chunk AS INTEGER) AS chunk, string_agg(x, chr(10) ORDER BY i) AS text FROM f GROUP BY doc_id, chunk
UNION ALL SELECT doc_id, 0, text FROM documents WHERE length(text) BETWEEN 1 AND 1000""")
def chunk_text(spark, d):
    return diff.chunks(fx.table(spark, d, "documents"), "text", 1_000, "doc_id")


@query("C5_excerpt", with_views(f"""WITH {ANNOTATED},
r AS (SELECT a.*, doc_id % 40 + 100 AS line, p.new_line, row_number() OVER (PARTITION BY a.doc_id ORDER BY a.hunk_id, a.pos) AS i
  FROM a_rows a LEFT JOIN (SELECT doc_id AS did, hunk_id AS h, pos AS q, new_line FROM f_patch_rows) p ON did = a.doc_id AND h = a.hunk_id AND q = a.pos),
b AS (SELECT doc_id, min(i) FILTER (abs(new_line - line) <= 15) AS lo, max(i) FILTER (abs(new_line - line) <= 15) AS hi FROM r GROUP BY doc_id)
SELECT repo, sha, filename, string_agg(row, chr(10) ORDER BY i) AS excerpt FROM r JOIN b USING (doc_id)
WHERE CASE WHEN lo IS NOT NULL THEN i BETWEEN lo AND hi ELSE i <= 60 END GROUP BY ALL""", "f_patch_rows"))
def excerpt(spark, d):
    files = fx.changed_files(spark, d).filter("patch IS NOT NULL").withColumn("annotated", diffs.annotate_patch("patch"))
    return files.select("repo", "sha", "filename", diffs.excerpt("annotated", F.expr("cast(doc_id % 40 + 100 AS int)")).alias("excerpt"))


def _trees(spark, d):
    docs = fx.table(spark, d, "documents").selectExpr("cast(doc_id AS string) AS case", "source AS path", "doc_id", "text")
    base = docs.filter("doc_id % 10 <> 1").select("case", "path", F.col("text").alias("content"))
    head = docs.filter("doc_id % 10 <> 2").selectExpr(
        "case", "path",
        "CASE WHEN doc_id % 10 = 3 THEN text ELSE array_join(transform(split(text, '\\n'), (x, i) -> CASE WHEN (doc_id + i) % 5 = 0 THEN concat('new ', x) WHEN (doc_id + i) % 7 = 0 THEN 'same' ELSE x END), '\\n') END AS content",
    )
    return base, head


_DIFF = """b AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM documents WHERE doc_id % 10 <> 1),
h0 AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents WHERE doc_id % 10 <> 2),
h AS (SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN x WHEN (doc_id + i) % 5 = 0 THEN 'new ' || x WHEN (doc_id + i) % 7 = 0 THEN 'same' ELSE x END AS text, i + 1 AS line FROM h0),
bo AS (SELECT *, row_number() OVER (PARTITION BY doc_id, text ORDER BY line) AS o FROM b), ho AS (SELECT *, row_number() OVER (PARTITION BY doc_id, text ORDER BY line) AS o FROM h),
c AS (SELECT ho.doc_id, '+' AS op, ho.line, ho.text FROM ho ANTI JOIN bo USING (doc_id, text, o) UNION ALL SELECT bo.doc_id, '-', bo.line, bo.text FROM bo ANTI JOIN ho USING (doc_id, text, o))"""


@query("C6_line_diff", f"""WITH {_DIFF} SELECT CAST(c.doc_id AS VARCHAR) AS "case", source AS path, op, CAST(line AS INTEGER) AS line, c.text FROM c JOIN documents d ON d.doc_id = c.doc_id""")
def line_diff(spark, d):
    return diff.line_diff(*_trees(spark, d))[1]


@query("C6_moved_lines", """WITH l AS (SELECT doc_id, x, i, n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(len(string_split(text, chr(10))))) AS i, len(string_split(text, chr(10))) AS n FROM documents)),
b AS (SELECT doc_id, n, i, i || ': ' || x AS x FROM l WHERE n >= 3)
SELECT CAST(doc_id AS VARCHAR) AS "case", '-' AS op, 1 AS line, x AS text, CAST(n AS INTEGER) AS moved_line FROM b WHERE i = 0
UNION ALL SELECT CAST(doc_id AS VARCHAR), '+', CAST(n AS INTEGER), x, 1 FROM b WHERE i = 0
UNION ALL SELECT CAST(doc_id AS VARCHAR), '-', 2, x, NULL FROM b WHERE i = 1 UNION ALL SELECT CAST(doc_id AS VARCHAR), '+', 1, 'new ' || x, NULL FROM b WHERE i = 1""")
def moved_lines(spark, d):
    """Numbered lines: the first one goes to the end, the second one is changed, all others stay."""
    docs = fx.table(spark, d, "documents").selectExpr("cast(doc_id AS string) AS case", "'f' AS path", "transform(split(text, '\\n'), (x, i) -> concat(i, ': ', x)) AS l").filter("size(l) >= 3")
    base = docs.selectExpr("case", "path", "array_join(l, '\\n') AS content")
    head = docs.selectExpr("case", "path", "array_join(concat(array(concat('new ', l[1])), slice(l, 3, size(l) - 2), array(l[0])), '\\n') AS content")
    return diff.aligned_diff(base, head).drop("path")


@query("C6_changed_trees", f"""WITH {_DIFF}, s AS (SELECT doc_id, count(*) FILTER (op = '+') AS additions, count(*) FILTER (op = '-') AS deletions FROM c GROUP BY doc_id)
SELECT CAST(d.doc_id AS VARCHAR) AS "case", source AS path, CASE d.doc_id % 10 WHEN 1 THEN 'added' WHEN 2 THEN 'removed' ELSE 'modified' END AS status, additions, deletions
FROM s JOIN documents d USING (doc_id)""")
def changed_trees(spark, d):
    return diff.line_diff(*_trees(spark, d))[0]


@query("C7_scan_secrets", with_views("SELECT repo, sha, filename, doc_id, line, kind FROM f_secrets", "f_secret_lines", "f_secrets"))
def scan_secrets(spark, d):
    lines = fx.secret_lines(spark, d)
    return unnest(lines, ["repo", "sha", "filename", "doc_id", "line"], leaks.secret_kinds("text")).withColumnRenamed("item", "kind")


@query("C7_scan_documents", f"SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, {fx.HEX_SQL})) AS hit FROM documents) GROUP BY doc_id")
def scan_documents(spark, d):
    """The credentials that the documents hold themselves."""
    found = fx.table(spark, d, "documents").select("doc_id", leaks.redaction_count(leaks.redact("text"), "text").cast("long").alias("n"))
    return found.filter("n > 0")


@query("C8_redact", with_views("""SELECT doc_id, line, hexes + CASE WHEN kind IS NULL THEN 0 ELSE 1 END AS n, CASE WHEN kind IS NULL THEN plain ELSE CASE kind WHEN 'aws_access_key' THEN plain || ' [REDACTED:aws_access_key] '
  WHEN 'assigned_secret' THEN plain || ' [REDACTED:assigned_secret]' ELSE plain || ' [REDACTED:' || kind || ']' END END AS redacted FROM f_secret_lines WHERE kind IS NOT NULL OR hexes > 0""", "f_secret_lines"))
def redact(spark, d):
    lines = fx.secret_lines(spark, d).withColumn("redacted", leaks.redact("text"))
    counted = lines.withColumn("n", leaks.redaction_count("redacted", "text"))
    return counted.filter("n > 0").select("doc_id", "line", "n", "redacted")


@query("C8_redact_pages", "SELECT page_id, html AS redacted, 0 AS n FROM pages")
def redact_pages(spark, d):
    found = fx.table(spark, d, "pages").withColumn("redacted", leaks.redact("html"))
    return found.select("page_id", "redacted", leaks.redaction_count("redacted", "html").alias("n"))


def secret_patches(spark, d):
    """Every line of every document as an added row of one patch, credentials included."""
    return fx.secret_lines(spark, d).select(
        "repo", "sha", F.concat("filename", F.lit("#"), F.col("line").cast("string")).alias("filename"),
        F.concat(F.lit("@@ -0,0 +1,1 @@\n+"), "text").alias("patch"),
    )


@query("C9_rule_findings", with_views(f"""WITH b AS (SELECT *, lower(regexp_extract(filename, '[^/]*$')) AS name FROM v_changed_files)
SELECT repo, sha, filename || '#' || line AS filename, seq, 1 AS line, 'Possible credential committed: ' || kind AS title FROM f_secrets
UNION ALL SELECT repo, sha, filename, 0, NULL, 'Sensitive file committed: ' || regexp_extract(filename, '[^/]*$') FROM b WHERE status <> 'removed' AND regexp_matches(name, '(^\\.env$|\\.pem$)')""", "f_secret_lines", "f_secrets", "v_changed_files"))
def rule_findings(spark, d):
    secrets = tr.secret_findings(tr.secret_hits(secret_patches(spark, d)))
    files = tr.sensitive_file_findings(tr.triage(fx.changed_files(spark, d)))
    return secrets.unionByName(files).select("repo", "sha", "filename", "seq", "line", "title")


# camel-case borders without look-around: three rewrites put a space between the words
WORDS = """list_distinct(list_filter(string_split(lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(path, '[^A-Za-z0-9]+', ' ', 'g'),
    '([A-Z])([0-9])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), ' '), lambda w: w <> ''))"""


@query("C10_path_tokens", with_views(f"WITH {_BASE} SELECT path, array_to_string(list_sort({WORDS}), ' ') AS words FROM p", "v_changed_files"))
def path_tokens(spark, d):
    return _paths(spark, d).select("path", F.array_join(F.array_sort(paths.path_tokens("path")), " ").alias("words"))


RISK = f"""round(CASE WHEN regexp_extract(name, '[^.].*?(\\.[^.]+)$', 1) IN ({", ".join(f"'{s}'" for s in rules.CODE_SUFFIXES)}) THEN 3.0 ELSE 0 END
  + CASE WHEN name IN ({", ".join(f"'{s}'" for s in rules.CONFIG_NAMES)}) OR starts_with(lower(path), '.github/workflows/') THEN 3.5 ELSE 0 END
  - CASE WHEN regexp_extract(name, '[^.].*?(\\.[^.]+)$', 1) IN ({", ".join(f"'{s}'" for s in rules.DOC_SUFFIXES)}) THEN 2.5 ELSE 0 END
  - CASE WHEN list_has_any(string_split(lower(path), '/'), ['test', 'tests', '__tests__', 'spec', 'e2e']) OR regexp_matches(lower(regexp_extract(path, '[^/]*$')), '^test_.') OR regexp_matches(lower(path), '(_|[.])test[.][a-z0-9]+$|[.]spec[.][a-z0-9]+$') THEN 1.5 ELSE 0 END
  + least(4, len(list_filter({list(rules.RISK_TERMS)}, lambda t: list_contains({WORDS}, t) OR (length(t) >= 4 AND len(list_filter({WORDS}, lambda w: starts_with(w, t))) > 0))))
  + least(3.0, (additions + 0.5 * deletions) / 60.0), 6)"""


@query("C11_risk_score", with_views(f"""SELECT repo, sha, filename, CAST({RISK} AS DOUBLE) AS score FROM (SELECT *, filename AS path, lower(regexp_extract(filename, '[^/]*$')) AS name FROM v_changed_files)""", "v_changed_files"))
def risk_score(spark, d):
    return fx.changed_files(spark, d).select("repo", "sha", "filename", paths.risk_score("filename", "additions", "deletions").alias("score"))


def _facts(spark, d):
    return symbols.with_source_facts(fx.source_files(spark, d))


@query("C12_definitions", with_views("SELECT repo, path, name, kind, start_line, end_line, signature_end_line, container FROM f_definitions", "f_definitions"))
def definitions(spark, d):
    return unnest(_facts(spark, d), ["repo", "path"], "definitions")


@query("C12_definitions_ts_java", with_views("""SELECT repo, ts AS path, 'fmt_' || j AS name, 'function' AS kind, 4 AS start_line, 6 AS end_line, 4 AS signature_end_line, '' AS container FROM f_polyglot
UNION ALL SELECT repo, ts, 'Shop_' || j, 'class', 7, 11, 7, '' FROM f_polyglot UNION ALL SELECT repo, ts, 'total_' || j, 'method', 8, 10, 8, 'Shop_' || j FROM f_polyglot
UNION ALL SELECT repo, ts, 'pick_' || j, 'function', 12, 12, 12, '' FROM f_polyglot
UNION ALL SELECT repo, java, 'C' || j, 'class', 5, 11, 5, '' FROM f_polyglot UNION ALL SELECT repo, java, 'C' || j, 'method', 6, 6, 6, 'C' || j FROM f_polyglot
UNION ALL SELECT repo, java, 'calc_' || j, 'method', 7, 10, 8, 'C' || j FROM f_polyglot""", "f_polyglot"))
def definitions_ts_java(spark, d):
    return unnest(symbols.with_source_facts(fx.polyglot_files(spark, d)), ["repo", "path"], "definitions")


def _wanted(spark, d, files, prefixes):
    names = fx.modules(spark, d).select(
        F.concat(F.lit("r"), "n").alias("repo"), F.explode(F.array(*[F.concat(F.lit(p), F.col("j")) for p in prefixes])).alias("name")
    ).withColumn("sha", F.lit("c0")).select("repo", "sha", "name")
    return symbols.scan(files, names)


@query("C13_references", with_views("SELECT repo, path, name, line, kind, enclosing FROM f_references", "f_references"))
def references(spark, d):
    scanned = _wanted(spark, d, fx.source_files(spark, d), ["sym_", "old_"])
    return symbols.hits(scanned).select("repo", "path", "name", "line", "kind", "enclosing")


@query("C13_references_ts_java", with_views("""SELECT repo, ts AS path, 'fmt_' || t AS name, 1 AS line, 'import' AS kind, NULL AS enclosing FROM f_polyglot
UNION ALL SELECT repo, ts, 'fmt_' || t, 5, 'call', 'fmt_' || j FROM f_polyglot UNION ALL SELECT repo, ts, 'fmt_' || t, 9, 'call', 'total_' || j FROM f_polyglot
UNION ALL SELECT repo, ts, 'fmt_' || t, 12, 'call', 'pick_' || j FROM f_polyglot
UNION ALL SELECT repo, java, 'calc_' || u, 3, 'import', NULL FROM f_polyglot
UNION ALL SELECT repo, java, 'calc_' || t, 9, 'call', 'calc_' || j FROM f_polyglot""", "f_polyglot"))
def references_ts_java(spark, d):
    scanned = _wanted(spark, d, fx.polyglot_files(spark, d), ["fmt_", "calc_"])
    return symbols.hits(scanned).select("repo", "path", "name", "line", "kind", "enclosing")


@query("C14_imports", with_views(f"""SELECT repo, path, {fx._module_name('t')} AS spec, 'sym_' || t AS names, 0 AS level, 1 AS line FROM f_modules
UNION ALL SELECT repo, path, CASE WHEN shadows OR u = j THEN 'os' WHEN j % 10 = 4 AND j >= 10 THEN 'pkg0.mod20' ELSE {fx._module_name('u')} END,
  CASE WHEN shadows OR u = j THEN '' ELSE 'sym_' || u END, 0, 2 FROM f_modules""", "f_modules"))
def imports(spark, d):
    found = unnest(_facts(spark, d), ["repo", "path"], "imports")
    return found.select("repo", "path", "spec", F.array_join("names", ",").alias("names"), "level", "line")


@query("C14_imports_ts_java", with_views("""SELECT repo, ts AS path, '../ts' || t || '/mod' || t AS spec, false AS wildcard, false AS static, 1 AS line FROM f_polyglot
UNION ALL SELECT repo, ts, '@/ts' || u || '/mod' || u, false, false, 2 FROM f_polyglot UNION ALL SELECT repo, ts, './local' || j, false, false, 3 FROM f_polyglot
UNION ALL SELECT repo, java, 'com.p' || (t % 7) || '.C' || t, false, false, 2 FROM f_polyglot UNION ALL SELECT repo, java, 'com.p' || (u % 7) || '.C' || u || '.calc_' || u, false, true, 3 FROM f_polyglot
UNION ALL SELECT repo, java, 'java.util', true, false, 4 FROM f_polyglot""", "f_polyglot"))
def imports_ts_java(spark, d):
    found = unnest(symbols.with_source_facts(fx.polyglot_files(spark, d)), ["repo", "path"], "imports")
    return found.select("repo", "path", "spec", "wildcard", "static", "line")


@query("C15_mentions", with_views("""SELECT DISTINCT repo, path, name FROM (SELECT repo, path, name FROM f_references UNION ALL SELECT repo, path, name FROM f_definitions)
WHERE name IN ('sym_1', 'sym_10', 'Box_7', 'old_2')""", "f_references", "f_definitions"))
def mentions(spark, d):
    wanted = F.array(*[F.lit(n) for n in ("sym_1", "sym_10", "Box_7", "old_2", "sym_")])
    files = fx.source_files(spark, d).withColumn("wanted", wanted)
    return files.select("repo", "path", F.explode(code.mentioned_names("content", "wanted")).alias("name"))


@query("C16_removed_names", with_views("""SELECT repo, path AS filename, '-' AS op, CASE WHEN j % 9 = 0 THEN 'sym_' || j ELSE 'old_' || j END AS name FROM f_modules WHERE j % 9 IN (0, 2)
UNION ALL SELECT repo, path, '+', 'sym_' || j FROM f_modules WHERE j % 9 IN (0, 2)""", "f_modules"))
def removed_names(spark, d):
    files = fx.symbol_changes(spark, d).withColumn("family", paths.family(paths.language_of("filename")))
    gone = files.withColumn("texts", diffs.removed_texts("patch")).select("repo", "filename", F.lit("-").alias("op"), F.explode(diffs.defined_names("texts", "family")).alias("name"))
    new = files.withColumn("texts", diffs.added_texts("patch")).select("repo", "filename", F.lit("+").alias("op"), F.explode(diffs.defined_names("texts", "family")).alias("name"))
    return gone.union(new)


@query("C17_changed_symbols", with_views("SELECT repo, path AS filename, name, kind, start_line, end_line, change, name AS search_name FROM f_symbols WHERE change <> 'removed'", "f_symbols"))
def changed_symbols(spark, d):
    per_file = symbols.file_symbols(fx.symbol_changes(spark, d), fx.source_files(spark, d))
    return symbols.touched_symbols(per_file).select("repo", "filename", "name", "kind", "start_line", "end_line", "change", "search_name")


@query("C18_search_names", with_views("""SELECT repo, java AS path, 'C' || j AS name, 'method' AS kind, 'C' || j AS search_name FROM f_polyglot
UNION ALL SELECT repo, java, 'calc_' || j, 'method', 'calc_' || j FROM f_polyglot UNION ALL SELECT repo, ts, 'total_' || j, 'method', 'total_' || j FROM f_polyglot""", "f_polyglot"))
def search_names(spark, d):
    defs = symbols.with_source_facts(fx.polyglot_files(spark, d)).select("repo", "path", "language", F.explode("definitions").alias("d"))
    return defs.filter("d.kind = 'method'").select("repo", "path", "d.name", "d.kind", symbols.search_name(F.col("d"), F.col("language")).alias("search_name"))


@query("C19_python_modules", with_views("""WITH p AS (SELECT DISTINCT filename AS path, string_split(regexp_replace(filename, '([^/.])\\.[^./]+$', '\\1'), '/') AS parts FROM v_changed_files)
SELECT path, array_to_string(parts[i:], '.') AS module FROM p, (SELECT unnest(range(1, 9)) AS i) WHERE i <= len(parts)""", "v_changed_files"))
def python_modules(spark, d):
    files = fx.changed_files(spark, d).select(F.col("filename").alias("path")).distinct()
    return files.select("path", F.explode(paths.python_modules("path")).alias("module"))


@query("C20_js_resolve", with_views("""SELECT doc_id, regexp_replace(filename, '(\\.d\\.ts|\\.tsx|\\.ts|\\.jsx|\\.js|\\.mjs|\\.cjs|\\.mts|\\.cts)$', '') AS stem,
  CASE doc_id % 4 WHEN 0 THEN 'a/b/x' || doc_id WHEN 1 THEN 'a/y' WHEN 2 THEN 'utils/z' || doc_id END AS resolved FROM v_changed_files""", "v_changed_files"))
def js_resolve(spark, d):
    files = fx.changed_files(spark, d).withColumn("importer", F.lit("a/b/c.ts")).withColumn(
        "spec", F.expr("CASE doc_id % 4 WHEN 0 THEN './x' || doc_id || '.js' WHEN 1 THEN '../y/index' WHEN 2 THEN '@/utils/z' || doc_id ELSE 'react' END")
    )
    return files.select("doc_id", paths.js_stem("filename").alias("stem"), paths.js_resolve("importer", "spec").alias("resolved"))


@query("C21_snippet", with_views("""SELECT repo, path, '   11 | def sym_' || j || '(a, b):' || chr(10) || '   12 |     \"\"\"Combine both parts.\"\"\"' || chr(10) || '   13 |     left = sym_' || t || '(a)' || chr(10)
  || '   14>|     right = sym_' || u || '(b)' || chr(10) || '   15 |     return left + right' AS snippet FROM f_modules""", "f_modules"))
def snippet(spark, d):
    files = fx.source_files(spark, d).withColumn("lines", tx.split_lines("content"))
    return files.select("repo", "path", code.snippet("lines", F.lit(14), F.lit(11), F.lit(15)).alias("snippet"))


_MENTION = "replace(regexp_replace({c}, '@([A-Za-z0-9_-])', '@' || chr(8203) || '\\1', 'g'), '![', '!\\[')"
_TAGS = f"(?i)<(/?(?:{rules.RISKY_TAGS})\\b|!--)"


@query("C24_sanitize", f"""SELECT 'p' || page_id AS id, regexp_replace({_MENTION.format(c='html')}, '{_TAGS}', '&lt;\\1', 'g') AS safe FROM pages
UNION ALL SELECT 'd' || doc_id, regexp_replace({_MENTION.format(c='text')}, '{_TAGS}', '&lt;\\1', 'g') FROM documents""")
def sanitize(spark, d):
    pages = fx.table(spark, d, "pages").selectExpr("'p' || page_id AS id", "html AS t")
    return pages.union(fx.table(spark, d, "documents").selectExpr("'d' || doc_id", "text")).select("id", tx.sanitize("t").alias("safe"))


@query("C25_clean_memory_text", """SELECT page_id, substring(translate(trim(regexp_replace(regexp_replace(html, '[\\x00-\\x08\\x0b-\\x1f\\x7f]', ' ', 'g'), '[\\s\\x0b\\x{85}\\p{Z}]+', ' ', 'g')), '<>', '‹›'), 1, 400) AS text FROM pages""")
def clean_memory_text(spark, d):
    return fx.table(spark, d, "pages").select("page_id", tx.clean_memory_text("html").alias("text"))


_LISTED = """l AS (SELECT id, kind, repo, unnest(string_split(source_text, chr(10))) AS x, unnest(range(len(string_split(source_text, chr(10))))) AS i, conv_id FROM v_comments),
m AS (SELECT id, kind, repo, i, row_number() OVER (PARTITION BY id ORDER BY i) AS rank, list_extract(['critical', 'major', 'minor', 'nit'], i % 4 + 1) AS severity, list_extract(['bug', 'style', 'testing'], i % 3 + 1) AS category,
  substring(translate(trim(regexp_replace(x, '[\\s\\p{Z}]+', ' ', 'g')), '<>', '‹›'), 1, 160) AS title, CASE WHEN i % 2 = 0 THEN 'src/f' || conv_id || '.py:' || (i + 1) ELSE '' END AS location FROM l WHERE i % 3 <> 2)"""


@query("C26_report_findings", with_views(f"""WITH {_LISTED} SELECT id, CAST(rank - 1 AS INTEGER) AS pos, severity, category, title, location FROM m""", "v_comments"))
def report_findings(spark, d):
    found = unnest(fx.comments(spark, d), ["id"], tx.parse_report_findings("body"), "pos")
    return found.select("id", "pos", "severity", "category", "title", "location")


@query("C27_fingerprint", with_views("""SELECT repo, sha, filename, seq, substring(sha1(filename || '|' || category || '|' || regexp_replace(lower(title), '[^\\p{L}\\p{Nd}\\p{M}]+', '', 'g')), 1, 12) AS fp FROM v_findings""", "v_findings"))
def fingerprint(spark, d):
    found = findings.valid_findings(fx.raw_findings(spark, d))
    return found.select("repo", "sha", "filename", "seq", tx.fingerprint("filename", "category", "title").alias("fp"))


@query("C28_fingerprint_of", with_views("SELECT id, CASE WHEN marked AND seq % 2 = 1 THEN substring(sha1(source_text), 1, 12) END AS fp FROM v_comments", "v_comments"))
def fingerprint_of(spark, d):
    return fx.comments(spark, d).select("id", tx.fingerprint_of("body").alias("fp"))


@query("C29_cache_key", "SELECT item_id, sha256('m' || chr(31) || text || chr(31) || '' || chr(31)) AS k FROM benchmark UNION ALL SELECT doc_id, sha256('m' || chr(31) || text || chr(31) || lang || chr(31)) FROM documents")
def cache_key(spark, d):
    items = fx.table(spark, d, "benchmark").selectExpr("item_id", "text", "cast(null AS string) AS lang")
    return items.union(fx.table(spark, d, "documents").select("doc_id", "text", "lang")).select("item_id", tx.cache_key(F.lit("m"), "text", "lang").alias("k"))


@query("C30_extract_json", with_views("SELECT doc_id, NOT doc_id % 8 = 3 AS is_object FROM documents", "v_response_items"))
def extract_json(spark, d):
    return fx.responses(spark, d).select("doc_id", tx.json_object_text("content").isNotNull().alias("is_object"))


PARSED = """parsed AS (SELECT repo, sha, filename, doc_id, i AS seq, lower(trim(severity)) AS severity, category, CAST(raw_line AS INTEGER) AS line, title, detail FROM v_response_items
  WHERE NOT broken AND i < 8 AND severity <> 'severe' AND (raw_line IS NULL OR raw_line >= 1) AND length(title) BETWEEN 1 AND 200)"""


@query("C31_parse_findings", with_views(f"WITH {PARSED} SELECT repo, sha, filename, seq, severity, category, line, title, detail, 'model' AS origin FROM parsed", "v_response_items"))
def parse_findings(spark, d):
    parsed = findings.parse_responses(fx.responses(spark, d))
    return parsed.select("repo", "sha", "filename", "seq", "severity", "category", "line", "title", "detail", "origin")


@query("C33_render_finding", with_views("""SELECT repo, sha, filename, seq, '- **[' || severity || '/' || category || ']** ' || s(title) || ' — `' || filename || coalesce(':' || line, '') || '`' || chr(10) || '  ' || s(detail)
  || coalesce(chr(10) || '  Suggestion: ' || s(suggestion), '') AS text FROM v_findings""".replace("s(title)", _MENTION.format(c="title")).replace("s(detail)", _MENTION.format(c="detail")).replace("s(suggestion)", "suggestion"), "v_findings"))
def render_finding(spark, d):
    found = findings.valid_findings(fx.raw_findings(spark, d))
    return found.select("repo", "sha", "filename", "seq", publish.finding_text().alias("text"))


@query("C34_keys", with_views("""SELECT event_id, seq, 'changelens-' || replace(lower(repo), '/', '--') AS bank, lower(repo) || '@' || lower(sha) || '#' || coalesce(pr_number, 0) AS key FROM f_targets""", "f_targets"))
def keys(spark, d):
    from changelens.sources import events

    targets = events.event_filter(events.read_events(fx.events(spark, d)), ("push", "pull_request"))
    return events.with_key(targets).select("event_id", "seq", tx.bank_id("repo").alias("bank"), "key")


@query("C34_headline", "SELECT doc_id, substring(string_split(trim(text, ' ' || chr(10) || chr(9)), chr(10))[1], 1, 120) AS headline FROM documents")
def headline(spark, d):
    return fx.table(spark, d, "documents").select("doc_id", tx.headline("text").alias("headline"))


@query("C35_recall_query", with_views("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY repo, sha ORDER BY filename) AS n FROM v_changed_files)
SELECT repo, sha, 'Conventions and feedback for changes in: ' || string_agg(filename, ', ' ORDER BY filename) || '. Change ' || sha AS query FROM r WHERE n <= 8 GROUP BY repo, sha""", "v_changed_files"))
def recall_query(spark, d):
    files = fx.changed_files(spark, d)
    messages = files.select("repo", "sha").distinct().withColumn("message", F.concat(F.lit("Change "), "sha", F.lit("\nmore")))
    return memory.recall_queries(files, messages)


@query("C36_feedback_text", with_views(f"""WITH {_LISTED} SELECT id, 'A maintainer rated a review comment as ' || CASE WHEN id % 2 = 0 THEN 'helpful and correct' ELSE 'NOT helpful' END || '. Findings: '
  || string_agg('[' || severity || '/' || category || '] ' || title || CASE WHEN location <> '' THEN ' (' || location || ')' ELSE '' END, '; ' ORDER BY i) AS text FROM m GROUP BY id""", "v_comments"))
def feedback_text(spark, d):
    rated = fx.comments(spark, d).withColumn("rating", F.expr("CASE WHEN id % 2 = 0 THEN 'helpful' ELSE 'not-helpful' END"))
    # a filter on the text itself would build it twice
    return unnest(rated, ["id"], F.array_compact(F.array(memory.feedback_text("rating", "body")))).withColumnRenamed("item", "text")


@query("C37_digest", f"SELECT doc_id, sha256(regexp_replace(text, {fx.HEX_SQL}, '[REDACTED:assigned_hex]', 'g')) AS digest FROM documents")
def digest(spark, d):
    return fx.table(spark, d, "documents").select("doc_id", memory.digest("text").alias("digest"))
