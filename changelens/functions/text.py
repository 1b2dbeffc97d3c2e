"""Line, text and hash functions."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

from changelens import rules

ColumnLike = Column | str

_LINE_BREAKS = "\r\n|[\r\u000b\u000c\u001c-\u001e\u0085\u2028\u2029]"
_SPACES = " \t\n\r\u000b\u000c\u001c\u001d\u001e\u001f\u0085\u00a0\u2028\u2029"


def as_column(value: ColumnLike) -> Column:
    return F.col(value) if isinstance(value, str) else value


def built_once(function: Callable[..., Column]) -> Callable[..., Column]:
    """Keep the column a function builds from column names: a column is immutable, a long one takes a second to build."""
    built: dict[tuple, Column] = {}

    @functools.wraps(function)
    def wrapper(*args, **kwargs) -> Column:
        names = (*args, *kwargs.items())
        if any(isinstance(value, Column) for value in (*args, *kwargs.values())):
            return function(*args, **kwargs)
        key = (id(SparkContext._gateway), *names)
        if key not in built:
            built[key] = function(*args, **kwargs)
        return built[key]

    return wrapper


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it in ``body`` as often as needed."""
    return F.transform(F.array(value), body)[0]


@built_once
def normalize_breaks(text: ColumnLike) -> Column:
    """Every line break becomes a newline; one final break is dropped."""
    return F.regexp_replace(F.regexp_replace(as_column(text), _LINE_BREAKS, "\n"), "\n\\z", "")


@built_once
def split_lines(text: ColumnLike) -> Column:
    text = as_column(text)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(normalize_breaks(text), "\n", -1))


def strip(text: ColumnLike) -> Column:
    return F.btrim(as_column(text), F.lit(_SPACES))


def pr_message(title: ColumnLike, body: ColumnLike) -> Column:
    return strip(F.concat_ws("\n\n", F.coalesce(as_column(title), F.lit("")), F.coalesce(as_column(body), F.lit(""))))


def headline(message: ColumnLike, limit: int = 120) -> Column:
    """First line of the message, cut to ``limit``; empty for a blank message."""
    return F.substring(F.regexp_extract(normalize_breaks(strip(message)), "^([^\n]*)", 1), 1, limit)


@built_once
def chunk_text(text: ColumnLike, max_chars: int = 12_000) -> Column:
    """Pack lines into chunks that stay below ``max_chars``; a longer line is cut.

    The fold only records where a chunk starts, so the work is linear in the number of lines.
    """
    text = as_column(text)

    def pack(lines: Column) -> Column:
        start = F.struct(
            F.lit(0).alias("size"), F.lit(0).alias("line"), F.array().cast("array<int>").alias("starts")
        )

        def step(acc: Column, line: Column) -> Column:
            cost = F.length(line) + 1
            opens = (acc["line"] == 0) | ((acc["size"] + cost > max_chars) & (acc["size"] > 0))
            return F.struct(
                F.when(opens, cost).otherwise(acc["size"] + cost).alias("size"),
                (acc["line"] + 1).alias("line"),
                F.when(opens, F.concat(acc["starts"], F.array(acc["line"] + 1))).otherwise(acc["starts"]).alias("starts"),
            )

        starts = F.aggregate(lines, start, step, lambda acc: acc["starts"])
        return let(
            F.concat(starts, F.array(F.size(lines) + 1)),
            lambda bounds: F.transform(
                F.slice(bounds, F.lit(1), F.size(bounds) - 1),
                lambda first, i: F.array_join(F.slice(lines, first, F.get(bounds, i + 1) - first), "\n"),
            ),
        )

    cut = F.transform(split_lines(text), lambda line: F.substring(line, 1, max_chars))
    return (
        F.when(text == "", F.array().cast("array<string>"))
        .when(F.length(text) <= max_chars, F.array(text))
        .otherwise(let(cut, pack))
    )


@built_once
def sanitize(text: ColumnLike) -> Column:
    """Neutralise mentions, images and risky tags."""
    text = F.regexp_replace(as_column(text), rules.MENTION, "@\u200b")
    text = F.regexp_replace(text, rules.IMAGE, r"!\\[")
    return F.regexp_replace(text, rf"(?i)<(?=/?(?:{rules.RISKY_TAGS})\b|!--)", "&lt;")


@built_once
def clean_memory_text(text: ColumnLike, limit: int = 400) -> Column:
    text = F.regexp_replace(as_column(text), rules.CONTROL_CHARACTERS, " ")
    text = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    return F.substring(F.translate(text, "<>", "‹›"), 1, limit)


@built_once
def fingerprint(path: ColumnLike, category: ColumnLike, title: ColumnLike) -> Column:
    """Line-independent id of a finding."""
    words = F.regexp_replace(F.lower(as_column(title)), r"(?U)[\W_]+", "")
    return F.substring(F.sha1(F.concat_ws("|", as_column(path), as_column(category), words)), 1, 12)


def fingerprint_of(body: ColumnLike, tag: str = "changelens-inline") -> Column:
    """Read a fingerprint back out of a comment body; null when there is none."""
    found = F.regexp_extract(as_column(body), rf"<!-- {tag} fp=([0-9a-f]{{12}}) -->", 1)
    return F.when(found != "", found)


def cache_key(*parts: ColumnLike) -> Column:
    ended = [piece for part in parts for piece in (F.coalesce(as_column(part), F.lit("")), F.lit("\u001f"))]
    return F.sha2(F.concat(*ended), 256)


def _candidate(line: Column) -> Column:
    """The text of a line without its list mark; null for lines that cannot start a finding."""
    said = F.trim(F.translate(line, "\t\r", "  "))
    plain = let(said, lambda t: F.when(F.startswith(t, F.lit("- ")), F.ltrim(F.substring(t, 3, 2147483647))).otherwise(t))
    return let(plain, lambda t: F.when(F.startswith(t, F.lit("**[")) & F.contains(t, F.lit("]** ")), t))


def _finding(said: Column) -> Column:
    """The parts of a candidate; null when it names no severity or category. Every part is evaluated once: what lambdas share is not found by the optimizer."""

    def placed(rest: Column) -> Column:
        place = F.when(F.endswith(rest, F.lit("`")) & F.contains(rest, F.lit(" — `")), F.substring_index(F.rtrim(F.regexp_replace(rest, "`$", "")), " — `", -1))
        return let(place, lambda p: F.when((p != "") & ~F.contains(p, F.lit("`")), p).otherwise(""))

    def parts(tag: Column) -> Column:
        severity, category = F.substring_index(tag, "/", 1), F.substring(tag, F.instr(tag, "/") + 1, F.length(tag))
        rest = F.substring(said, F.length(tag) + 8, F.length(said))

        def told(rest: Column, place: Column) -> Column:
            title = F.when(place != "", F.substring(rest, F.lit(1), F.length(rest) - F.length(place) - 5)).otherwise(rest)
            return F.struct(
                severity.alias("severity"), category.alias("category"), clean_memory_text(title, 160).alias("title"), clean_memory_text(place, 120).alias("location"),
            )

        valid = severity.isin(*rules.SEVERITIES) & category.rlike("^[a-z]+$")
        return F.when(valid, let(rest, lambda r: let(placed(r), lambda p: told(r, p))))

    return let(F.substring(F.substring_index(said, "]** ", 1), 4, 2147483647), parts)


@built_once
def parse_report_findings(body: ColumnLike, limit: int | None = None) -> Column:
    """Finding lines of an earlier report as an array of structs: all, or the first ``limit``."""
    candidates = F.array_compact(F.transform(split_lines(body), _candidate))
    found = F.array_compact(F.transform(candidates, _finding))
    return found if limit is None else F.slice(found, 1, limit)


def message_text(parts: ColumnLike) -> Column:
    """Model content given as a list of parts is one text."""
    return F.array_join(as_column(parts), "")


@built_once
def json_object_text(text: ColumnLike) -> Column:
    """From the first ``{`` to the last ``}``; null when that is not a JSON object."""
    found = F.regexp_extract(as_column(text), r"(?s)\{.*\}", 0)
    return let(found, lambda body: F.when((body != "") & F.try_parse_json(body).isNotNull(), body))


def bank_id(repo: ColumnLike, prefix: str = "changelens-") -> Column:
    name = F.regexp_replace(F.lower(as_column(repo)), "/", "--")
    return F.concat(F.lit(prefix), F.regexp_replace(name, "[^a-z0-9_.-]", "-"))


def review_key(repo: ColumnLike, sha: ColumnLike, pr_number: ColumnLike) -> Column:
    number = F.coalesce(as_column(pr_number), F.lit(0)).cast("string")
    return F.concat(F.lower(as_column(repo)), F.lit("@"), F.lower(as_column(sha)), F.lit("#"), number)


def hmac_sha256(body: ColumnLike, secret: str) -> Column:
    """HMAC of a binary body as lower-case hex, built from the hash function and the two padded keys."""
    import hashlib

    key = secret.encode("utf-8")
    key = hashlib.sha256(key).digest() if len(key) > 64 else key
    key = key.ljust(64, b"\0")
    inner = F.lit(bytearray(byte ^ 0x36 for byte in key))
    outer = F.lit(bytearray(byte ^ 0x5C for byte in key))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, as_column(body)), 256))), 256)


def verify_signature(body: ColumnLike, header: ColumnLike, secret: str) -> Column:
    """True when the header is ``sha256=<hmac>``; an empty secret never verifies."""
    if not secret:
        return F.lit(False)
    return F.coalesce(as_column(header) == F.concat(F.lit("sha256="), hmac_sha256(body, secret)), F.lit(False))
