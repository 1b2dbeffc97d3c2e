"""Views that give every operator an input, derived row by row from the given tables.

Each view exists twice: as a Spark function and as a DuckDB common table expression in ``VIEWS``. Both are pure
functions of one row, so the views need no shuffle and grow with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_DIRS = (
    "src/auth", "src/util", "docs", "tests", "db/migrations", "web/dist", ".github/workflows", "src/payment",
    "node_modules/x", "src/feedback", "config", "api/handlers",
)
_EXTS = (".py", ".ts", ".java", ".md", ".png", ".lock", ".sql", ".yml", ".go", ".js", ".env", ".pem")
_SEVERITIES = ("critical", " Major", "minor", "nit", "blocker")
_CATEGORIES = ("bug", "security", "Performance", "maintainability", "testing", "style")


def _array(values: tuple[str, ...], brackets: str) -> str:
    return brackets[:-1] + ", ".join(f"'{v}'" for v in values) + brackets[-1]


_KEYS = {"documents": "doc_id", "pages": "page_id", "events": "event_id", "part": "p_partkey", "conversations": "conv_id"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. One that arrives in fewer splits than there are cores is spread by its key first."""
    path = f"{sf_dir}/{name}.parquet"
    df, cores = spark.read.parquet(path), spark.sparkContext.defaultParallelism
    if name in _KEYS and _splits(spark, path) < cores:
        return df.repartition(cores, _KEYS[name])
    return df


def _splits(spark: SparkSession, path: str) -> int:
    """In how many splits a scan reads the files, by their number and size."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    told = folder.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(folder)
    most = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    return max(told.getFileCount(), told.getLength() // most)


# ----------------------------------------------------------------------------- changed files ---
def _filename(brackets: str, div: str) -> str:
    dirs, exts = _array(_DIRS, brackets), _array(_EXTS, brackets)
    pick = (lambda a, i: f"element_at({a}, cast({i} + 1 as int))") if brackets[0] == "a" else (lambda a, i: f"list_extract({a}, {i} + 1)")
    return f"{pick(dirs, 'doc_id % 12')} || '/m' || doc_id || {pick(exts, f'(doc_id * 5 + doc_id {div} 12) % 12')}"


_STATUS = "CASE WHEN doc_id % 17 = 0 THEN 'removed' WHEN doc_id % 13 = 0 THEN 'added' ELSE 'modified' END"


def changed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo, sha, doc_id, filename, status, additions, deletions, patch); 200 documents make one commit."""
    patch = """array_join(transform(split(text, '\\n'), (x, i) -> concat(
        CASE WHEN i % 8 = 0 THEN concat('@@ -', i + 1, ',8 +', i + 1 + 100 * (i div 8), ',8 @@\\n') ELSE '' END,
        elt(i % 4 + 1, ' ', '+', '-', '+'), x)), '\\n')"""
    lines = "size(split(text, '\\n'))"
    return table(spark, sf_dir, "documents").selectExpr(
        "lang AS repo",
        "'c' || (doc_id div 200) AS sha",
        "doc_id",
        _filename("array()", "div") + " AS filename",
        f"{_STATUS} AS status",
        f"cast(({lines} + 2) div 4 + {lines} div 4 AS int) AS additions",
        f"cast(({lines} + 1) div 4 AS int) AS deletions",
        f"CASE WHEN doc_id % 19 <> 0 THEN {patch} END AS patch",
    )


VIEWS: dict[str, str] = {}
VIEWS["v_changed_files"] = f"""v_changed_files AS (
  SELECT lang AS repo, 'c' || (doc_id // 200) AS sha, doc_id, {_filename("[]", "//")} AS filename, {_STATUS} AS status,
    CAST((len(string_split(text, chr(10))) + 2) // 4 + len(string_split(text, chr(10))) // 4 AS INTEGER) AS additions,
    CAST((len(string_split(text, chr(10))) + 1) // 4 AS INTEGER) AS deletions,
    CASE WHEN doc_id % 19 <> 0 THEN array_to_string(list_transform(string_split(text, chr(10)), lambda x, i:
      CASE WHEN (i - 1) % 8 = 0 THEN '@@ -' || i || ',8 +' || (i + 100 * ((i - 1) // 8)) || ',8 @@' || chr(10) ELSE '' END
      || CASE (i - 1) % 4 WHEN 0 THEN ' ' WHEN 2 THEN '-' ELSE '+' END || x), chr(10)) END AS patch
  FROM documents)"""

# rows of every patch, numbered by the formula that made them: the independent side of the diff oracles
VIEWS["f_patch_rows"] = """f_patch_rows AS (
  SELECT repo, sha, doc_id, filename, status, CAST(i // 8 + 1 AS INTEGER) AS hunk_id, CAST(i % 8 AS INTEGER) AS pos,
    CASE i % 4 WHEN 0 THEN ' ' WHEN 2 THEN '-' ELSE '+' END AS op,
    CAST(CASE WHEN i % 4 <> 2 THEN i + 1 + 100 * (i // 8) - CASE WHEN i % 8 > 6 THEN 2 WHEN i % 8 > 2 THEN 1 ELSE 0 END END AS INTEGER) AS new_line,
    CAST(CASE WHEN i % 4 = 2 THEN i + 1 + 100 * (i // 8) - CASE WHEN i % 8 > 2 THEN 1 ELSE 0 END END AS INTEGER) AS gap_hi,
    x AS text
  FROM (SELECT v.repo, v.sha, v.doc_id, v.filename, v.status, unnest(string_split(d.text, chr(10))) AS x,
          unnest(range(len(string_split(d.text, chr(10))))) AS i
        FROM v_changed_files v JOIN documents d ON d.doc_id = v.doc_id WHERE v.patch IS NOT NULL))"""


# ----------------------------------------------------------------------------- findings ---
def raw_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One raw finding per line of every document: (repo, sha, filename, seq, severity, category, line, title, ...)."""
    sev, cat = _array(_SEVERITIES, "array()"), _array(_CATEGORIES, "array()")
    lines = table(spark, sf_dir, "documents").selectExpr(
        "lang AS repo", "'c' || (doc_id div 200) AS sha", "doc_id", _filename("array()", "div") + " AS filename",
        "posexplode(split(text, '\\n')) AS (seq, title)",
    )
    return lines.selectExpr(
        "repo", "sha", "doc_id", "filename", "seq",
        f"element_at({sev}, cast((doc_id + seq) % 5 + 1 AS int)) AS severity",
        f"element_at({cat}, cast((doc_id + 2 * seq) % 6 + 1 AS int)) AS category",
        "cast(nullif((doc_id + 3 * seq) % 40, 0) AS int) AS line",
        "title",
        "concat(title, ' in ', filename) AS detail",
        "CASE WHEN (doc_id + seq) % 3 = 0 THEN concat('Check ', filename) END AS suggestion",
        "CASE WHEN (doc_id + seq) % 11 = 0 THEN 'rule' ELSE 'model' END AS origin",
    )


VIEWS["v_raw_findings"] = f"""v_raw_findings AS (
  SELECT repo, sha, doc_id, filename, CAST(seq AS INTEGER) AS seq,
    list_extract({_array(_SEVERITIES, "[]")}, (doc_id + seq) % 5 + 1) AS severity,
    list_extract({_array(_CATEGORIES, "[]")}, (doc_id + 2 * seq) % 6 + 1) AS category,
    CAST(nullif((doc_id + 3 * seq) % 40, 0) AS INTEGER) AS line, title, title || ' in ' || filename AS detail,
    CASE WHEN (doc_id + seq) % 3 = 0 THEN 'Check ' || filename END AS suggestion,
    CASE WHEN (doc_id + seq) % 11 = 0 THEN 'rule' ELSE 'model' END AS origin
  FROM (SELECT lang AS repo, 'c' || (doc_id // 200) AS sha, doc_id, {_filename("[]", "//")} AS filename,
          unnest(string_split(text, chr(10))) AS title, unnest(range(len(string_split(text, chr(10))))) AS seq FROM documents))"""
VIEWS["v_findings"] = """v_findings AS (
  SELECT repo, sha, filename, seq, lower(trim(severity)) AS severity, lower(trim(category)) AS category, line, title, detail, suggestion, origin
  FROM v_raw_findings
  WHERE lower(trim(severity)) IN ('critical', 'major', 'minor', 'nit') AND length(title) BETWEEN 1 AND 200
    AND length(detail) BETWEEN 1 AND 2000 AND coalesce(length(suggestion), 0) <= 2000)"""
SEVERITY_RANK = "CASE severity WHEN 'critical' THEN 0 WHEN 'major' THEN 1 WHEN 'minor' THEN 2 ELSE 3 END"


def decisions(raw: DataFrame) -> DataFrame:
    """A verification decision for most findings: (repo, sha, filename, seq, verdict, reason)."""
    return raw.filter("(doc_id + seq) % 7 <> 0").selectExpr(
        "repo", "sha", "filename", "seq",
        "CASE (doc_id + 2 * seq) % 5 WHEN 0 THEN 'refuted' WHEN 1 THEN 'uncertain' WHEN 2 THEN 'maybe' ELSE 'confirmed' END AS verdict",
        "concat('reason ', seq) AS reason",
    )


VIEWS["v_decisions"] = """v_decisions AS (
  SELECT repo, sha, filename, seq,
    CASE (doc_id + 2 * seq) % 5 WHEN 0 THEN 'refuted' WHEN 1 THEN 'uncertain' WHEN 2 THEN 'maybe' ELSE 'confirmed' END AS verdict,
    'reason ' || seq AS reason
  FROM v_raw_findings WHERE (doc_id + seq) % 7 <> 0)"""


# ----------------------------------------------------------------------------- model responses ---
_PLAIN = r"regexp_replace(x, '[\\x00-\\x1f\"\\\\]', ' '{flag})"


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model-style text per file: stray words around JSON; one finding per text line; some broken, some wrong-typed."""
    item = """concat('{"severity":"', elt(cast((doc_id + i) % 5 + 1 as int), 'critical', 'MAJOR ', 'minor', 'nit', 'severe'),
      '","category":"', elt(cast((doc_id + i) % 6 + 1 as int), 'bug', 'security', 'performance', 'maintainability', 'testing', 'style'),
      '","line":', CASE WHEN (doc_id + i) % 9 = 0 THEN '"x"' WHEN (doc_id + i) % 4 = 0 THEN 'null' ELSE cast((doc_id + i) % 30 AS string) END,
      ',"title":"', regexp_replace(x, '[\\\\x00-\\\\x1f"\\\\\\\\]', ' '), '","detail":"line ', i, '"}')"""
    items = f"array_join(transform(split(text, '\\n'), (x, i) -> {item}), ',')"
    return table(spark, sf_dir, "documents").selectExpr(
        "lang AS repo", "'c' || (doc_id div 200) AS sha", _filename("array()", "div") + " AS filename", "doc_id",
        f"""concat('Here is the review: {{"findings":[', {items}, CASE WHEN doc_id % 8 = 3 THEN '' ELSE ']}}' END, ' done') AS content""",
        "CASE WHEN doc_id % 21 = 5 THEN 'Timeout' END AS error_type",
    )


VIEWS["v_response_items"] = f"""v_response_items AS (
  SELECT repo, sha, filename, doc_id, CAST(i AS INTEGER) AS i,
    list_extract(['critical', 'MAJOR ', 'minor', 'nit', 'severe'], (doc_id + i) % 5 + 1) AS severity,
    list_extract(['bug', 'security', 'performance', 'maintainability', 'testing', 'style'], (doc_id + i) % 6 + 1) AS category,
    CASE WHEN (doc_id + i) % 9 = 0 THEN -1 WHEN (doc_id + i) % 4 = 0 THEN NULL ELSE (doc_id + i) % 30 END AS raw_line,
    regexp_replace(x, '[\\x00-\\x1f"\\\\]', ' ', 'g') AS title, 'line ' || i AS detail,
    doc_id % 8 = 3 AS broken, doc_id % 21 = 5 AS failed
  FROM (SELECT lang AS repo, 'c' || (doc_id // 200) AS sha, doc_id, {_filename("[]", "//")} AS filename,
          unnest(string_split(text, chr(10))) AS x, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents))"""


# ----------------------------------------------------------------------------- repository events ---
def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One webhook delivery per event: (event, body, signature, received_ts)."""
    commits = """array_join(transform(sequence(0, cast(event_id % 8 AS int)), i -> concat('{"id":"',
        lpad(cast(event_id * 10 + i AS string), 40, '0'), '","message":"',
        CASE WHEN (event_id + i) % 5 = 0 THEN 'Merge branch' ELSE 'Change' END, ' ', i, '"',
        CASE WHEN (event_id + i) % 7 = 0 THEN ',"distinct":false' WHEN (event_id + i) % 7 = 1 THEN ',"distinct":true' ELSE '' END, '}')), ',')"""
    push = f"""concat('{{"ref":"', CASE WHEN event_id % 19 = 0 THEN 'refs/tags/v1' ELSE 'refs/heads/main' END, '","after":"',
        CASE WHEN event_id % 23 = 0 THEN repeat('0', 40) ELSE lpad(cast(event_id AS string), 40, 'a') END, '","deleted":',
        CASE WHEN event_id % 29 = 0 THEN 'true' ELSE 'false' END, ',"repository":{{"full_name":"Org/r', user_id % 12,
        '"}},"sender":{{"type":"', CASE WHEN user_id % 10 = 0 THEN 'Bot' ELSE 'User' END, '"}},"commits":[', {commits}, ']}}')"""
    pull = """concat('{"action":"', elt(cast(event_id % 5 + 1 AS int), 'opened', 'synchronize', 'closed', 'reopened', 'ready_for_review'),
        '","pull_request":{"number":', event_id % 900, ',"draft":', CASE WHEN event_id % 6 = 0 THEN 'true' ELSE 'false' END,
        ',"head":{"sha":"', lpad(cast(event_id AS string), 40, 'b'), '"}},"repository":{"full_name":"Org/r', user_id % 12,
        '"},"sender":{"type":"User"}}')"""
    bodies = table(spark, sf_dir, "events").selectExpr(
        "event_id", "user_id", "event_type", "cast(ts AS timestamp) AS received_ts",
        "CASE WHEN event_type = 'signup' THEN 'pull_request' WHEN event_type = 'view' AND event_id % 4 = 0 THEN 'ping' ELSE 'push' END AS event",
        f"CASE WHEN event_id % 31 = 0 THEN '{{broken' WHEN event_type = 'signup' THEN {pull} ELSE {push} END AS text",
    )
    return bodies.selectExpr("event_id", "user_id", "event_type", "event", "encode(text, 'UTF-8') AS body", "received_ts")


VIEWS["v_events"] = """v_events AS (
  SELECT event_id, user_id, event_type, ts AS received_ts, event_id % 31 = 0 AS broken,
    CASE WHEN event_type = 'signup' THEN 'pull_request' WHEN event_type = 'view' AND event_id % 4 = 0 THEN 'ping' ELSE 'push' END AS event,
    'Org/r' || (user_id % 12) AS repo, event_type <> 'signup' AND user_id % 10 = 0 AS bot,
    event_id % 19 = 0 AS tag, event_id % 23 = 0 AS zero, event_id % 29 = 0 AS deleted,
    list_extract(['opened', 'synchronize', 'closed', 'reopened', 'ready_for_review'], event_id % 5 + 1) AS action, event_id % 6 = 0 AS draft,
    lpad(CAST(event_id AS VARCHAR), 40, 'b') AS head, CAST(event_id % 900 AS INTEGER) AS number
  FROM events)"""
VIEWS["f_commits"] = """f_commits AS (
  SELECT event_id, CAST(i AS INTEGER) AS i, lpad(CAST(event_id * 10 + i AS VARCHAR), 40, '0') AS id,
    (event_id + i) % 5 = 0 AS merge, (event_id + i) % 7 <> 0 AS is_distinct
  FROM (SELECT event_id, unnest(range(event_id % 8 + 1)) AS i FROM events))"""
VIEWS["f_targets"] = """f_targets AS (
  SELECT event_id, received_ts, repo, sha, pr_number, seq FROM (
    SELECT e.event_id, e.received_ts, e.repo, c.id AS sha, CAST(NULL AS INTEGER) AS pr_number, c.i,
      row_number() OVER (PARTITION BY e.event_id ORDER BY c.i DESC) AS back, count(*) OVER (PARTITION BY e.event_id) AS n,
      CAST(row_number() OVER (PARTITION BY e.event_id ORDER BY c.i) - greatest(count(*) OVER (PARTITION BY e.event_id) - 5, 0) AS INTEGER) AS seq
    FROM v_events e JOIN f_commits c USING (event_id)
    WHERE e.event = 'push' AND NOT broken AND NOT bot AND NOT tag AND NOT zero AND NOT deleted AND NOT c.merge AND c.is_distinct) WHERE back <= 5
  UNION ALL
  SELECT event_id, received_ts, repo, head, number, 1 FROM v_events
  WHERE event = 'pull_request' AND NOT broken AND action <> 'closed' AND NOT draft)"""


# ----------------------------------------------------------------------------- comments and reactions ---
MARKER = "<!-- changelens -->"
INLINE_TAG = "changelens-inline"


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One comment per conversation turn: (repo, kind, id, seq, path, line, body, author, reaction_total)."""
    body = f"""concat(CASE WHEN conv_id % 5 = 0 THEN '' WHEN turn % 2 = 0 THEN '{MARKER}\\n'
          ELSE concat('<!-- {INLINE_TAG} fp=', substring(sha1(text), 1, 12), ' -->\\n') END,
        array_join(transform(split(text, '\\n'), (x, i) -> CASE WHEN i % 3 = 2 THEN x ELSE concat(
          '- **[', elt(i % 4 + 1, 'critical', 'major', 'minor', 'nit'), '/', elt(i % 3 + 1, 'bug', 'style', 'testing'), ']** ', x,
          CASE WHEN i % 2 = 0 THEN concat(' — `src/f', conv_id, '.py:', i + 1, '`') ELSE '' END) END), '\\n'))"""
    return table(spark, sf_dir, "conversations").selectExpr(
        "'org/r' || (conv_id % 6) AS repo", "CASE WHEN turn % 2 = 0 THEN 'commit' ELSE 'review' END AS kind",
        "conv_id * 100 + turn AS id", "conv_id", "cast(turn AS int) AS seq", "concat('src/f', conv_id, '.py') AS path",
        "cast(nullif(turn * 7 % 20, 0) AS int) AS line", f"{body} AS body",
        "CASE WHEN role = 'user' THEN 'Bot-Me' ELSE role END AS author", "cast(conv_id % 4 AS int) AS reaction_total",
    )


VIEWS["v_comments"] = f"""v_comments AS (
  SELECT 'org/r' || (conv_id % 6) AS repo, CASE WHEN turn % 2 = 0 THEN 'commit' ELSE 'review' END AS kind, conv_id * 100 + turn AS id, conv_id,
    CAST(turn AS INTEGER) AS seq, 'src/f' || conv_id || '.py' AS path, CAST(nullif(turn * 7 % 20, 0) AS INTEGER) AS line,
    CASE WHEN conv_id % 5 = 0 THEN '' WHEN turn % 2 = 0 THEN '{MARKER}' || chr(10)
      ELSE '<!-- {INLINE_TAG} fp=' || substring(sha1(text), 1, 12) || ' -->' || chr(10) END
    || array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: CASE WHEN (i - 1) % 3 = 2 THEN x ELSE
      '- **[' || list_extract(['critical', 'major', 'minor', 'nit'], (i - 1) % 4 + 1) || '/' || list_extract(['bug', 'style', 'testing'], (i - 1) % 3 + 1) || ']** ' || x
      || CASE WHEN (i - 1) % 2 = 0 THEN ' — `src/f' || conv_id || '.py:' || i || '`' ELSE '' END END), chr(10)) AS body,
    CASE WHEN role = 'user' THEN 'Bot-Me' ELSE role END AS author, CAST(conv_id % 4 AS INTEGER) AS reaction_total,
    conv_id % 5 <> 0 AS marked, text AS source_text
  FROM conversations)"""


def reactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "event_id % 150 * 100 + event_id % 3 AS comment_id", "event_id",
        "CASE event_type WHEN 'purchase' THEN '+1' WHEN 'click' THEN 'heart' WHEN 'error' THEN '-1' WHEN 'view' THEN 'laugh' ELSE 'rocket' END AS content",
        "concat('U', user_id % 6) AS login",
    )


VIEWS["v_reactions"] = """v_reactions AS (
  SELECT event_id % 150 * 100 + event_id % 3 AS comment_id, event_id,
    CASE event_type WHEN 'purchase' THEN '+1' WHEN 'click' THEN 'heart' WHEN 'error' THEN '-1' WHEN 'view' THEN 'laugh' ELSE 'rocket' END AS content,
    'U' || (user_id % 6) AS login
  FROM events)"""


# ----------------------------------------------------------------------------- credentials in text ---
# kind of the credential on line i of a document, by number; made at run time, so that no file holds one
_SECRET_NO = "CASE WHEN (doc_id + i) % 23 = 0 THEN cast((doc_id + i) div 23 % 8 AS int) WHEN (doc_id + i) % 29 = 0 THEN cast(8 + (doc_id + i) div 29 % 3 AS int) END"


def secret_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo, sha, filename, doc_id, line, text): every line of every document, some with a made-up credential."""
    lines = table(spark, sf_dir, "documents").selectExpr(
        "lang AS repo", "'c' || (doc_id div 200) AS sha", _filename("array()", "div") + " AS filename", "doc_id",
        "posexplode(split(text, '\\n')) AS (i, x)",
    )
    made = """concat(x, CASE no
        WHEN 0 THEN concat(' ghp', '_', h, 'A1') WHEN 1 THEN concat(' github', '_pat_', h) WHEN 2 THEN concat(' AK', 'IA', upper(substring(h, 1, 16)), ' ')
        WHEN 3 THEN concat(' xo', 'xb-', h) WHEN 4 THEN concat(' AI', 'za', h, 'Abc') WHEN 5 THEN concat(' s', 'k-', h)
        WHEN 6 THEN concat(' Bea', 'rer ', h) WHEN 7 THEN concat(' -----BEGIN RSA ', 'PRIVATE KEY-----')
        WHEN 8 THEN concat(' pass', 'word = "Zq!', h, '"') WHEN 9 THEN concat(' pass', 'word = "change-me-', h, '"')
        WHEN 10 THEN concat(' pass', 'word = os.environ["', h, '"]') ELSE '' END)"""
    return lines.selectExpr("*", f"{_SECRET_NO} AS no", "md5(cast(doc_id * 1000 + i AS string)) AS h").selectExpr(
        "repo", "sha", "filename", "doc_id", "cast(i + 1 AS int) AS line", f"{made} AS text"
    )


#: An assigned value of 32 hex digits or more, as the documents hold some, for DuckDB.
HEX_SQL = """'(?i:(?:password|passwd|secret|api_?key|token)\\w*["'']?\\s*[:=]\\s*)["'']?[0-9a-fA-F]{32,}\\b["'']?'"""
VIEWS["f_secret_lines"] = f"""f_secret_lines AS (
  SELECT repo, sha, filename, doc_id, CAST(i + 1 AS INTEGER) AS line, regexp_replace(x, {HEX_SQL}, '[REDACTED:assigned_hex]', 'g') AS plain, len(regexp_extract_all(x, {HEX_SQL})) AS hexes,
    list_extract(['github_token', 'github_token', 'aws_access_key', 'slack_token', 'google_api_key', 'api_key', 'bearer_token', 'private_key', 'assigned_secret'], no + 1) AS kind
  FROM (SELECT *, {_SECRET_NO.replace(' div ', ' // ').replace(' AS int)', ' AS INTEGER)')} AS no FROM (
    SELECT lang AS repo, 'c' || (doc_id // 200) AS sha, doc_id, {_filename("[]", "//")} AS filename,
      unnest(string_split(text, chr(10))) AS x, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents)))"""
VIEWS["f_secrets"] = """f_secrets AS (
  SELECT repo, sha, filename, doc_id, line, kind, 0 AS seq FROM f_secret_lines WHERE kind IS NOT NULL
  UNION ALL SELECT repo, sha, filename, doc_id, line, 'assigned_hex', CASE WHEN kind IS NULL THEN 0 ELSE 1 END FROM f_secret_lines WHERE hexes > 0)"""


# ----------------------------------------------------------------------------- source repositories ---
_MODULES = """SELECT n, j, (j * 7 + 1) % 100 AS t, CASE WHEN j % 10 = 4 AND j >= 10 THEN 0 ELSE j % 10 END AS u,
    j % 10 = 0 AND j >= 10 AS shadows, j % 9 = 5 AS late
  FROM (SELECT p_partkey {div} 100 AS n, p_partkey % 100 AS j FROM {part})"""


def _module_path(j: str) -> str:
    return f"CASE WHEN {j} % 13 = 0 THEN concat('tests/test_mod', {j}, '.py') ELSE concat('pkg', {j} % 5, '/mod', {j}, '.py') END"


def _module_name(j: str) -> str:
    return f"CASE WHEN {j} % 13 = 0 THEN concat('tests.test_mod', {j}) ELSE concat('pkg', {j} % 5, '.mod', {j}) END"


def modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return spark.sql(_MODULES.format(div="div", part="{part}"), part=part)


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Python modules that import and call each other: (repo, sha, path, content); 100 modules make one repository."""
    content = f"""concat(
      'from ', {_module_name('t')}, ' import sym_', t, '\\n',
      CASE WHEN shadows OR u = j THEN 'import os' WHEN j % 10 = 4 AND j >= 10 THEN 'from pkg0.mod20 import sym_0'
        ELSE concat('from ', {_module_name('u')}, ' import sym_', u) END, '\\n\\n\\n',
      'class Box_', j, ':\\n    def fill_', j, '(self, rate,\\n                 currency):\\n        return rate\\n\\n\\n',
      'def sym_', j, '(a, b):\\n    \"\"\"Combine both parts.\"\"\"\\n    left = sym_', t, '(a)\\n    right = sym_', u, '(b)\\n    return left + right\\n',
      CASE WHEN shadows THEN concat('\\n\\ndef sym_', u, '(b):\\n    return b\\n') ELSE '' END,
      CASE WHEN late THEN concat('\\n\\ndef late_', j, '():\\n    return old_', j - 3, '(1)\\n') ELSE '' END)"""
    return modules(spark, sf_dir).selectExpr(
        "concat('r', n) AS repo", "'c0' AS sha", f"{_module_path('j')} AS path", f"{content} AS content"
    )


def symbol_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed files over ``source_files``: header patches, body patches and renames."""
    patch = """CASE j % 9
      WHEN 0 THEN concat('@@ -11,2 +11,2 @@\\n-def sym_', j, '(a):\\n+def sym_', j, '(a, b):\\n     \"\"\"Combine both parts.\"\"\"')
      WHEN 1 THEN concat('@@ -13,1 +13,1 @@\\n-    left = sym_', t, '(b)\\n+    left = sym_', t, '(a)')
      ELSE concat('@@ -11,2 +11,2 @@\\n-def old_', j, '(a, b):\\n+def sym_', j, '(a, b):\\n     \"\"\"Combine both parts.\"\"\"') END"""
    return modules(spark, sf_dir).filter("j % 9 <= 2").selectExpr(
        "concat('r', n) AS repo", "'c0' AS sha", f"{_module_path('j')} AS filename", "'modified' AS status",
        "1 AS additions", "1 AS deletions", f"{patch} AS patch",
    )


_PATH = _module_path("j")
VIEWS["f_modules"] = f"f_modules AS (SELECT *, 'r' || n AS repo, {_PATH} AS path FROM ({_MODULES.format(div='//', part='part')}))"
# definitions by formula
VIEWS["f_definitions"] = """f_definitions AS (
  SELECT repo, path, j, 'Box_' || j AS name, 'class' AS kind, 5 AS start_line, 8 AS end_line, 5 AS signature_end_line, '' AS container FROM f_modules
  UNION ALL SELECT repo, path, j, 'fill_' || j, 'method', 6, 8, 7, 'Box_' || j FROM f_modules
  UNION ALL SELECT repo, path, j, 'sym_' || j, 'function', 11, 15, 11, '' FROM f_modules
  UNION ALL SELECT repo, path, j, 'sym_' || u, 'function', 18, 19, 18, '' FROM f_modules WHERE shadows
  UNION ALL SELECT repo, path, j, 'late_' || j, 'function', CASE WHEN shadows THEN 22 ELSE 18 END, CASE WHEN shadows THEN 23 ELSE 19 END,
    CASE WHEN shadows THEN 22 ELSE 18 END, '' FROM f_modules WHERE late)"""
# uses by formula, with the definition around them
VIEWS["f_references"] = """f_references AS (
  SELECT repo, path, 'sym_' || t AS name, 1 AS line, 'import' AS kind, CAST(NULL AS VARCHAR) AS enclosing, CAST(NULL AS INTEGER) AS enclosing_start FROM f_modules
  UNION ALL SELECT repo, path, 'sym_' || u, 2, 'import', NULL, NULL FROM f_modules WHERE NOT shadows AND u <> j
  UNION ALL SELECT repo, path, 'sym_' || t, 13, 'call', 'sym_' || j, 11 FROM f_modules
  UNION ALL SELECT repo, path, 'sym_' || u, 14, 'call', 'sym_' || j, 11 FROM f_modules
  UNION ALL SELECT repo, path, 'old_' || (j - 3), CASE WHEN shadows THEN 23 ELSE 19 END, 'call', 'late_' || j, CASE WHEN shadows THEN 22 ELSE 18 END FROM f_modules WHERE late)"""
# which module file imports which module file, by formula
VIEWS["f_links"] = f"""f_links AS (
  SELECT DISTINCT repo, path, target FROM (
    SELECT repo, path, {_module_path('t')} AS target FROM f_modules
    UNION ALL SELECT repo, path, CASE WHEN j % 10 = 4 AND j >= 10 THEN 'pkg0/mod20.py' ELSE {_module_path('u')} END FROM f_modules WHERE NOT shadows AND u <> j))"""
# symbols of the change, before any cap
VIEWS["f_symbols"] = """f_symbols AS (
  SELECT repo, path, 'sym_' || j AS name, 'function' AS kind, 11 AS start_line, 15 AS end_line,
    CASE WHEN j % 9 = 1 THEN 'body' ELSE 'signature' END AS change, '' AS container FROM f_modules WHERE j % 9 <= 2
  UNION ALL SELECT repo, path, 'old_' || j, 'function', 0, 0, 'removed', '' FROM f_modules WHERE j % 9 = 2)"""


# ----------------------------------------------------------------------------- TypeScript and Java files ---
def _ts_path(j: str) -> str:
    return f"concat('web/ts', {j}, '/mod', {j}, '.ts')"


def _java_path(j: str) -> str:
    return f"concat('src/com/p', {j} % 7, '/C', {j}, '.java')"


def polyglot_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One TypeScript and one Java file per module: (repo, sha, path, content)."""
    ts = """concat('import { fmt_', t, ' } from \\'../ts', t, '/mod', t, '\\';\nimport def from "@/ts', u, '/mod', u, '";\n',
      'const old = require(\\'./local', j, '\\');\n', 'export function fmt_', j, '(amount: number, locale: string): string {\n  return fmt_', t, '(amount);\n}\n',
      'class Shop_', j, ' {\n  total_', j, '(a: number) {\n    return fmt_', t, '(a);\n  }\n}\n', 'export const pick_', j, ' = (a: number) => fmt_', t, '(a);\n')"""
    java = """concat('package com.p', j % 7, ';\nimport com.p', t % 7, '.C', t, ';\nimport static com.p', u % 7, '.C', u, '.calc_', u, ';\nimport java.util.*;\n',
      'public class C', j, ' {\n    public C', j, '(int a) {}\n    public int calc_', j, '(int a,\n                    int b) {\n        return C', t, '.calc_', t, '(a, b);\n    }\n}\n')"""
    m = modules(spark, sf_dir)
    part = lambda path, content: m.selectExpr("concat('r', n) AS repo", "'c0' AS sha", f"{path} AS path", f"{content} AS content")
    return part(_ts_path("j"), ts).unionByName(part(_java_path("j"), java))


def go_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One Go file per module, a language that is known by rows only: (repo, sha, path, content)."""
    content = """concat('package p', j, '\\n\\nimport "repo/p', t, '"\\n\\n// Price_', t, '(x) is told "here\\ntype Cart_', j, ' struct {\\n\\ttext string\\n}\\n\\nfunc (c Cart_', j,
      ') Fill_', j, '(a int) int {\\n\\tnote := `raw { Price_', t, '(a)`\\n\\treturn Price_', t, '(a, note)\\n}\\n\\nfunc Price_', j, '(a int,\\n\\tb string) int {\\n\\treturn a\\n}\\n')"""
    return modules(spark, sf_dir).selectExpr("concat('r', n) AS repo", "'c0' AS sha", "concat('pkg/p', j, '/m', j, '.go') AS path", f"{content} AS content")


#: What a caller adds to know Go: rows, no code.
GO_LANGUAGES = ((".go", "go", "go", "braces"),)
GO_PATTERNS = (
    ("go", "comment", 0, None, r"//[^\n]*+", False), ("go", "comment", 1, None, r"/\*[\s\S]*?(?:\*/|\z)", False),
    ("go", "quoted", 0, None, r'"[^"\\\n]*+(?:\\[\s\S][^"\\\n]*+)*+"', False), ("go", "quoted", 1, None, r"`[^`]*+`", False),
    ("go", "header", 0, "class", r"(\btype\s+(\w+)\s+(?:struct|interface)\s*)\z", False),
    ("go", "header", 1, "method", r"(\bfunc\s*\([^()]*\)\s*(\w+)\s*\([^{}]*)\z", False), ("go", "header", 2, "function", r"(\bfunc\s+(\w+)\s*\([^{}]*)\z", False),
    ("go", "import", 0, None, r'(?m)^[ \t]*import[ \t]+"([^"\n]+)"', False),
)


VIEWS["f_polyglot"] = f"""f_polyglot AS (SELECT repo, j, t, u, {_ts_path('j')} AS ts, {_java_path('j')} AS java FROM f_modules)"""


def with_views(sql: str, *names: str, recursive: bool = False) -> str:
    """Oracle text: the named views (with what they need) in front of ``sql``, which may bring its own ``WITH`` list."""
    needs = {
        "f_patch_rows": ("v_changed_files",), "v_findings": ("v_raw_findings",), "v_decisions": ("v_raw_findings",),
        "f_targets": ("v_events", "f_commits"), "f_definitions": ("f_modules",), "f_references": ("f_modules",),
        "f_links": ("f_modules",), "f_symbols": ("f_modules",), "f_polyglot": ("f_modules",),
    }
    ordered: list[str] = []
    for name in names:
        for item in (*needs.get(name, ()), name):
            if item not in ordered:
                ordered.append(item)
    head = "WITH RECURSIVE " if recursive else "WITH "
    body = sql.strip()
    joined = ",\n".join(VIEWS[name] for name in ordered)
    if body.upper().startswith("WITH "):
        return f"{head}{joined},\n{body[5:]}"
    return f"{head}{joined}\n{body}"
