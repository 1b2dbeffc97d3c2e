"""Column functions on short literal inputs."""

import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from changelens.functions import diffs, leaks, paths
from changelens.functions import text as tx

TOKEN = "gh" + "p_" + "a1B2c3D4e5F6g7H8i9J0k1L2m3N4o5P6q7R8"
PATCH = "@@ -1,4 +1,6 @@\n a\n+b\n+c\n-d\n e\n\\ No newline at end of file\n@@ -20,2 +22,3 @@\n x\n+y\n z\n"


def one(spark, column, **values):
    """The value of a column over one row of named strings."""
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or [F.lit(1).alias("_")])
    return row.select(column.alias("v")).first()["v"]


def many(spark, values, column):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["r"] for r in rows.select("i", column.alias("r")).orderBy("i").collect()]


def test_added_lines_and_gaps(spark):
    rows = one(spark, diffs.patch_rows("p"), p=PATCH)
    assert [r["new_line"] for r in rows if r["op"] == "+"] == [2, 3, 23]
    assert [r["gap_hi"] for r in rows if r["op"] == "-"] == [4]
    assert all("No newline" not in r["text"] for r in rows)


def test_annotated_rows(spark):
    text = one(spark, diffs.annotate_patch("p"), p=PATCH)
    assert "    2 + b" in text and "      - d" in text and "    4   e" in text and text.splitlines()[0].startswith("@@")


@pytest.mark.parametrize("limit", [40, 60, 90, 200, 900])
def test_trim_matches_direct_definition(spark, limit):
    hunks = [f"@@ -{i},1 +{i},1 @@\n+" + "x" * (7 * i % 40) for i in range(1, 8)]
    patch = "\n".join(hunks)
    kept, used, low, high, front = set(), 0, 0, len(hunks) - 1, True
    while low <= high:
        index = low if front else high
        if used + len(hunks[index]) + 1 > limit:
            break
        kept.add(index)
        used += len(hunks[index]) + 1
        low, high, front = (low + 1, high, False) if front else (low, high - 1, True)
    if len(patch) <= limit:
        expected = (patch, 0)
    elif kept:
        expected = ("\n".join(hunks[i] for i in sorted(kept)), len(hunks) - len(kept))
    else:
        expected = (hunks[0][:limit].rsplit("\n", 1)[0], len(hunks) - 1)
    assert tuple(one(spark, diffs.trim_patch("p", limit), p=patch)) == expected


def test_chunks_keep_every_line_below_the_limit(spark):
    text = "\n".join(f"line {i} " + "y" * (i % 37) for i in range(200))
    chunks = one(spark, tx.chunk_text("t", 300), t=text)
    assert "\n".join(chunks) == text and all(len(c) <= 300 for c in chunks)
    assert one(spark, tx.chunk_text("t", 300), t="") == []


def test_line_breaks_of_every_kind(spark):
    assert one(spark, tx.split_lines("t"), t="a\r\nb\rc d\x0be\n") == ["a", "b", "c", "d", "e"]


def test_reviewable_and_sensitive_paths(spark):
    cases = {
        "src/app.py": (True, False), "package-lock.json": (False, False), "web/dist/bundle.js": (False, False), "static/app.min.js": (False, False),
        "logo.PNG": (False, False), "node_modules/x/index.js": (False, False), "build/agentHost/generate.ts": (True, False), "docs/readme.md": (True, False),
        ".env": (True, True), "config/.env.production": (True, True), ".env.example": (True, False), "deploy/server.pem": (True, True),
        "keys/id_rsa": (True, True), "docs/keys.md": (True, False), "terraform.tfstate": (True, True), "credentials.json.sample": (True, False),
    }
    assert many(spark, cases, paths.should_review("v")) == [c[0] for c in cases.values()]
    assert many(spark, cases, paths.is_sensitive_path("v")) == [c[1] for c in cases.values()]


def test_risk_words_are_whole_words(spark):
    hits = many(spark, ["feedback/design.py", "DbSession.py", "authentication.py", "src/HTTPHandler.java"], paths.risk_hits("v"))
    assert hits == [0, 2, 1, 1]


def test_redaction_counts(spark):
    text = f"x = 1\nA = '{TOKEN}'\nkey = '" + "AK" + "IAABCDEFGHIJKLMNOP" + "'\n-----BEGIN RSA PRIVATE" + " KEY-----\nprint('ok')"
    lines = [
        text, "password = 'changeme-please'", "api_key = os.environ['API_KEY_VALUE_X']", "token = '${TOKEN}'", "secret = 'your_secret_here_1234'",
        "password = 'short'", "password = '" + "Zq8!xK2#mPv9Lw'",
    ]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(lines)], "i int, v string").withColumn("r", leaks.redact("v"))
    found = rows.select("i", "r", leaks.redaction_count("r", "v").alias("n")).orderBy("i").collect()
    assert [r["n"] for r in found] == [3, 0, 0, 0, 0, 0, 1]
    assert TOKEN not in found[0]["r"] and "print('ok')" in found[0]["r"]


def test_secret_kinds_never_hold_a_value(spark):
    assert many(spark, [f"token = '{TOKEN}'", "nothing"], leaks.secret_kinds("v")) == [["github_token"], []]


def test_fingerprint_ignores_case_and_punctuation(spark):
    a = one(spark, tx.fingerprint("p", "c", "t"), p="a.py", c="bug", t="Null  check: missing!")
    b = one(spark, tx.fingerprint("p", "c", "t"), p="a.py", c="bug", t="null check missing")
    assert a == b == hashlib.sha1(b"a.py|bug|nullcheckmissing").hexdigest()[:12]
    wide = [one(spark, tx.fingerprint("p", "c", "t"), p="a.py", c="bug", t=t) for t in ("空指针", "越界")]
    assert wide[0] != wide[1]


def test_sanitize(spark):
    safe = one(spark, tx.sanitize("t"), t="hi @bob ![x](y) <img src> <!-- --> <b>")
    assert safe == "hi @​bob !\\[x](y) &lt;img src> &lt;!-- --> <b>"


def test_signature(spark):
    secret, body = "0123456789abcdef", b'{"a": 1}'
    good = "sha256=" + hmac.new(secret.encode(), body, hashlib.sha256).hexdigest()
    rows = spark.createDataFrame([(0, bytearray(body), good), (1, bytearray(body), "sha1=x"), (2, bytearray(b"other"), good), (3, bytearray(body), None)], "i int, body binary, h string")
    assert [r[1] for r in rows.select("i", tx.verify_signature("body", "h", secret)).orderBy("i").collect()] == [True, False, False, False]
    assert rows.select(tx.verify_signature("body", "h", "")).first()[0] is False


def test_report_findings_are_read_back(spark):
    body = "- **[major/bug]** A <title> — `src/a.py:3`\nx\n**[minor/style]** foo"
    assert [tuple(f) for f in one(spark, tx.parse_report_findings("b"), b=body)] == [("major", "bug", "A ‹title›", "src/a.py:3"), ("minor", "style", "foo", "")]


def test_module_names(spark):
    assert many(spark, ["src/billing/pricing.py", "billing/__init__.py"], paths.python_modules("v")) == [["src.billing.pricing", "billing.pricing", "pricing"], ["billing"]]
    assert many(spark, ["src/format.d.ts", "src/lib/index.ts", "a.js"], paths.js_stem("v")) == ["src/format", "src/lib", "a"]
