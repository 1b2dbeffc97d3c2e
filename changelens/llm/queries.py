"""The registered queries of the operators, over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changelens.llm import (
    chat, decontamination, fingerprints, html_text, katz, languages, packing, prefix_trie, quality, repair, similar, token_files, url_filters,
)
from changelens.llm.common import materialize, read, shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

URL_RULES = (
    url_filters.Rule("allow", "com", "/"), url_filters.Rule("block", "example.com", "/en/"), url_filters.Rule("allow", "www.example.com", "/en/"),
    url_filters.Rule("block", "net", "/es/"), url_filters.Rule("block", "net", "/fr/"),
)

#: Arguments of the tools that the conversations may call.
TOOL_SCHEMAS = {
    "search": {"type": "object", "properties": {"query": {"type": "string"}, "limit": {"type": "integer", "minimum": 1}}, "required": ["query"], "additionalProperties": False},
    "get_document": {"type": "object", "properties": {"doc_id": {"type": "integer", "minimum": 0}}, "required": ["doc_id"], "additionalProperties": False},
}


def query(key: str, sql: str | None = None):
    def add(function):
        QUERIES[key] = function
        if sql is not None:
            ORACLES[key] = sql
        return function

    return add


@query("op7_url_filters", r"""
WITH cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), split AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), fits AS (
  SELECT *, (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') AS com,
    (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') AS example,
    (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') AS www,
    (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') AS es, (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') AS fr
  FROM split
)
SELECT page_id, host, path,
  CASE WHEN www THEN 'www.example.com/en/' WHEN example THEN 'example.com/en/' WHEN com THEN 'com/' WHEN es THEN 'net/es/' WHEN fr THEN 'net/fr/' END AS rule,
  CASE WHEN www THEN 'allow' WHEN example OR es OR fr THEN 'block' ELSE 'allow' END AS verdict
FROM fits
""")
def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(read(spark, sf_dir, "pages"), URL_RULES)


@query("op8_quality_classifier")
def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality.classify(docs, quality.fit(docs, read(spark, sf_dir, "labels")))


@query("op6_language_id")
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return languages.identify(docs, languages.fit(docs))


@query("op2_best_fit_packing")
def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query("op5_document_fingerprints")
def op5_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprints.fingerprint_documents(read(spark, sf_dir, "documents"))
    found = found.withColumn("edited", fingerprints.edited(F.col("text"), F.col("n_chars"), F.col("next.text")))
    found = found.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", fingerprints.fingerprint(F.col("edited")).alias("edited_fingerprint"),
        F.col("next.fingerprint").alias("next_fingerprint"),
    )
    return found.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        fingerprints.likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        fingerprints.likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )


@query("op3_html_extraction")
def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


@query("op10_chat_formatting", """
SELECT conv_id, turn, turn AS order_turn, 0 AS order_rank, 'text' AS kind, 'plain' AS status, 0::BIGINT AS n_calls, 0::BIGINT AS n_invalid,
  json_object('content', text, 'role', role)::VARCHAR AS message
FROM conversations
""")
def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chat(read(spark, sf_dir, "conversations"), TOOL_SCHEMAS)


@query("op4_benchmark_decontamination", """
WITH d AS (
  SELECT doc_id, list_filter(string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' '), lambda w: w <> '') AS w FROM documents
), i AS (
  SELECT item_id, list_filter(string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' '), lambda w: w <> '') AS w FROM benchmark
), ish AS (
  SELECT item_id, len(w) AS n, array_to_string(w[k:k+4], ' ') AS h FROM (SELECT *, unnest(range(1, len(w) - 3)) AS k FROM i)
), icount AS (SELECT item_id, n, h, count(*) AS c FROM ish GROUP BY ALL),
dsh AS (SELECT doc_id, len(w) AS l, k - 1 AS pos, array_to_string(w[k:k+4], ' ') AS h FROM (SELECT *, unnest(range(1, len(w) - 3)) AS k FROM d)),
hit AS (SELECT DISTINCT doc_id, l, item_id, n, pos FROM dsh JOIN icount USING (h)),
win AS (
  SELECT DISTINCT doc_id, item_id, n, least(n, l) AS width, unnest(range(greatest(0, least(pos - n + 5, l - n)), least(pos, greatest(l - n, 0)) + 1)) AS start FROM hit
), wcount AS (
  SELECT doc_id, item_id, n, width, start, h, count(*) AS c FROM win JOIN dsh USING (doc_id) WHERE pos BETWEEN start AND start + width - 5 GROUP BY ALL
), scored AS (
  SELECT doc_id, item_id, n, start, width, sum(least(w.c, coalesce(x.c, 0))) AS common
  FROM wcount w LEFT JOIN icount x USING (item_id, n, h) GROUP BY ALL
), kept AS (SELECT *, common / (n - 4 + width - 4 - common) AS similarity FROM scored WHERE common / (n - 4 + width - 4 - common) >= 0.8)
SELECT doc_id, item_id, start::INTEGER AS start, n::INTEGER AS n_words, similarity
FROM kept QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) = 1
""")
def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query("op1_ngram_jaccard_join", """
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' '), lambda w: w <> '') AS w FROM documents
), sh AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[k:k+4], ' ') END AS h
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 3, 2))) AS k FROM d WHERE len(w) > 0)
), size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM common JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 10 * c >= 8 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b)
SELECT d.doc_id, r.class_id, coalesce(l.n_links, 0) AS n_links
FROM d JOIN (SELECT a, min(b) AS class_id FROM reach GROUP BY a) r ON r.a = d.doc_id LEFT JOIN (SELECT a, count(*) AS n_links FROM link GROUP BY a) l ON l.a = d.doc_id
""")
def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar.classes(read(spark, sf_dir, "documents"))


@query("op9_lm_scoring")
def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(read(spark, sf_dir, "documents"))


#: crc32 of short ASCII strings for DuckDB: the table from its rule, then a fold over the characters.
CRC = """crc_table AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM (SELECT unnest(range(256)) AS i))"""


def crc_sql(text: str) -> str:
    codes = f"list_prepend(4294967295, list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT))"
    return f"xor(list_reduce({codes}, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295)"


_PUT = {0: ("'u'", 2), 1: ("'u'", 2), 2: ("'a'", 3), 3: ("'u'", 2)}
_NONE = "{'c': 1000000000, 'a': '', 't': ''}"
_LINE = "CASE WHEN x.t = '' THEN '' ELSE x.t || chr(10) END ||"


def _labels_sql() -> str:
    """One step of the recursion: the least (cost, audit, repaired text) per state after the row, and the inserts that may follow."""
    moves: dict[int, list[str]] = {state: [] for state in range(4)}
    for state in range(4):
        of = lambda cost, letter, text: f"list_transform([s{state}], lambda x: {{'c': x.c + {cost}, 'a': x.a || '{letter}', 't': {text}}})[1]"
        moves[state].append(of("2", "D", "x.t"))
        _, to = _PUT[state]
        role = "assistant" if to == 3 else "user"
        moves[to].append(f"CASE WHEN bad THEN {_NONE} ELSE {of('1 + more', 'R', f'{_LINE} {chr(39)}{role}:{chr(39)} || body')} END")
        for initial, kept in (("s", 1), ("u", 2), ("a", 3)):
            if (state, initial) in repair.NEXT:
                moves[kept].append(f"CASE WHEN bad OR initial <> '{initial}' THEN {_NONE} ELSE {of('more', 'K', f'{_LINE} role || {chr(39)}:{chr(39)} || body')} END")
    return ", ".join(f"list_min([{', '.join(options)}]) AS s{state}" for state, options in moves.items())


def _inserts_sql(source: str) -> str:
    put = lambda s, role: f"list_transform([s{s}], lambda x: {{'c': x.c + 5, 'a': x.a || 'I', 't': {_LINE} '{role}:'}})[1]"
    twice = f"(SELECT * REPLACE (list_min([s2, {put(0, 'user')}, {put(1, 'user')}, {put(3, 'user')}]) AS s2) FROM {source})"
    thrice = f"(SELECT * REPLACE (list_min([s3, {put(2, 'assistant')}]) AS s3) FROM {twice})"
    return f"(SELECT * REPLACE (list_min([s2, {put(3, 'user')}]) AS s2) FROM {thrice})"


OP11_SQL = f"""WITH RECURSIVE {CRC}, hit AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS hit FROM conversations, crc_table
), rows AS (
  SELECT conv_id, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role, CASE hit WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS body,
    unnest(range(CASE hit WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM hit WHERE hit <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, body, copy) AS n, rtrim(body, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS core,
    row_number() OVER (PARTITION BY conv_id, role, body ORDER BY turn NULLS FIRST, copy) AS seen FROM rows
), told AS (
  SELECT *, left(role, 1) AS initial, CASE WHEN core = '' THEN 'b' WHEN seen > 1 THEN 'd' WHEN right(core, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY n) AS before FROM placed
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
    count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal, max(n) AS n FROM told GROUP BY conv_id
), step AS (SELECT conv_id, n, role, body, initial, fault IN ('b', 'd') AS bad, CASE fault WHEN 't' THEN 5 ELSE 0 END AS more FROM told),
walk AS (
  SELECT conv_id, 0::BIGINT AS n, s0, s1, s2, s3 FROM {_inserts_sql(f"(SELECT DISTINCT conv_id, {{'c': 0, 'a': '', 't': ''}} AS s0, {_NONE} AS s1, {_NONE} AS s2, {_NONE} AS s3 FROM conversations)")}
  UNION ALL
  SELECT conv_id, n, s0, s1, s2, s3 FROM {_inserts_sql(f"(SELECT w.conv_id, p.n, {_labels_sql()} FROM walk w JOIN step p ON p.conv_id IS NOT DISTINCT FROM w.conv_id AND p.n = w.n + 1)")}
), best AS (SELECT conv_id, n, list_min([s0, s3]) AS b FROM walk)
SELECT b.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  b.b.c::BIGINT AS cost, b.b.a AS audit, sha256(b.b.t) AS repaired_sha256
FROM best b LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM b.conv_id WHERE b.n = coalesce(c.n, 0)"""


@query("op11_conversation_repair", OP11_SQL)
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(read(spark, sf_dir, "conversations"), damaged=True)


@query("op12_token_files")
def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/token-files-{uuid.uuid4().hex}"
    token_files.write(read(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"))
    found = materialize(token_files.read(spark, folder))
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return found


OP13_SQL = f"""WITH {CRC}, own AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base, {crc_sql("conv_id::VARCHAR")} % 9 AS head FROM (SELECT DISTINCT conv_id FROM own), crc_table
), lead AS (SELECT c.conv_id, count(o.place) AS n FROM convs c LEFT JOIN own o ON o.conv_id = c.base AND o.place <= c.head GROUP BY c.conv_id),
turns AS (
  SELECT c.conv_id, o.place AS depth, role, text FROM convs c JOIN own o ON o.conv_id = c.base AND o.place <= c.head
  UNION ALL SELECT o.conv_id, o.place - c.head + l.n, role, text FROM own o JOIN convs c USING (conv_id) JOIN lead l USING (conv_id) WHERE o.place > c.head
), prefixes AS (
  SELECT conv_id, depth, strlen(text) AS bytes, sha256(string_agg(length(role) || ':' || role || length(text) || ':' || text, '' ORDER BY depth) OVER (PARTITION BY conv_id ORDER BY depth)) AS name FROM turns
  UNION ALL SELECT conv_id, 0, 0, '' FROM convs
), lasts AS (SELECT conv_id, max(depth) AS depth FROM prefixes GROUP BY conv_id),
nodes AS (SELECT depth, name, min(conv_id) AS conv_id, count(*) AS n_convs, max(bytes) AS bytes FROM prefixes GROUP BY depth, name),
up AS (
  SELECT n.depth, n.name, q.name AS parent FROM nodes n LEFT JOIN prefixes q ON q.conv_id = n.conv_id AND q.depth = n.depth - 1
), kids AS (SELECT depth - 1 AS depth, parent AS name, count(*) AS n_children FROM up WHERE parent IS NOT NULL GROUP BY ALL),
told AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN kids USING (depth, name)),
sums AS (
  SELECT q.depth, q.name, sum(CASE WHEN t.n_children = 0 THEN 1 ELSE 0 END)::BIGINT AS n_leaves, sum((t.n_convs - 1) * t.bytes)::BIGINT AS saved_tokens
  FROM told t JOIN prefixes q ON q.conv_id = t.conv_id AND q.depth <= t.depth GROUP BY q.depth, q.name
), ends AS (SELECT depth, name, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends_sha256 FROM prefixes JOIN lasts USING (conv_id, depth) GROUP BY depth, name)
SELECT t.conv_id, t.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, t.n_convs, t.n_children, n_leaves, saved_tokens, coalesce(ends_sha256, sha256('')) AS ends_sha256
FROM told t JOIN sums USING (depth, name) JOIN up u USING (depth, name) LEFT JOIN ends USING (depth, name) LEFT JOIN nodes p ON p.depth = t.depth - 1 AND p.name = u.parent"""


@query("op13_prefix_trie", OP13_SQL)
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = read(spark, sf_dir, "conversations")
    return prefix_trie.trie(prefix_trie.rebuilt_sequences(conversations), prefix_trie.levels_of(conversations)).drop("a", "b")
