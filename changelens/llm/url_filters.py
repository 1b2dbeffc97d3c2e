"""Exact URL lists as Bloom filter cascades over the key universe of a corpus.

A rule is a host and the beginning of a path. A url is looked up by keys: each of its host's suffixes at a dot, with each beginning of its path
that is as long as some rule's path. All keys that the corpus can ask for make the universe; the listed ones among them are encoded at level 1, the
other keys that level 1 takes for listed at level 2, the listed keys that level 2 takes for unlisted at level 3, and so on until a level makes no
mistake. For every key of the universe the cascade then answers exactly, from a few bits, and the rows need no join.

Only DataFrame functions are used. What reaches the driver is the bit words of the levels, whose number follows the number of listed keys, is known
before a filter is built, and is checked against ``max_bits``; beyond it the lookup is a join on the same keys (:func:`judge`, ``max_bits=0``).
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changelens.llm.common import filled, materialize


@dataclass(frozen=True)
class Rule:
    action: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Level:
    """One Bloom filter: its bits as 64-bit words and the number of hash functions; keys are hashed with the level's number."""

    number: int
    words: tuple[int, ...]
    hashes: int


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Level, ...]

    def contains(self, key: Column) -> Column:
        """Exact for every key of the universe that the cascade was built over."""
        if not self.levels:
            return F.lit(False)
        answer = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(self.levels):  # the first level without the key decides: even levels then say listed
            answer = F.when(~_in_level(key, level), F.lit(level.number % 2 == 0)).otherwise(answer)
        return answer


def _positions(key: Column, number: int, bits: int, hashes: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(number * 1_000 + k)), F.lit(bits)) for k in range(hashes)]


def _in_level(key: Column, level: Level) -> Column:
    words, bits = F.lit(list(level.words)).cast("array<bigint>"), 64 * len(level.words)
    found = F.lit(True)
    for at in _positions(key, level.number, bits, level.hashes):
        word = F.element_at(words, (F.floor(at / 64) + 1).cast("int"))
        found = found & (F.getbit(word, (at % 64).cast("int")) == 1)
    return found


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://``; A-Z lower-cased) and path (up to ``?`` or ``#``); both empty if null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return filled(host), filled(path)


def candidate_keys(host: Column, path: Column, lengths: Sequence[int]) -> Column:
    """Keys of a url, the longest first: host suffixes at a dot, each with the beginnings of the path of the given lengths."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))))
    starts = F.filter(F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in sorted(lengths, reverse=True)]), lambda p: p.isNotNull())
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(starts, lambda p: F.struct(F.length(s) + F.length(p), F.length(s), F.concat(s, F.lit("\n"), p)))))
    return F.transform(F.sort_array(keys, asc=False), lambda k: k["col3"])


def build_cascade(universe: DataFrame, listed: DataFrame, max_bits: int, first_rate: float = 0.25, rate: float = 0.5) -> Cascade | None:
    """Levels for the listed keys of ``universe`` (column ``key``, distinct); None where a level would need more than ``max_bits``.

    ``listed`` (column ``key``) may hold keys outside the universe: nobody asks for them. The work per level is one pass over the keys that
    the level before got wrong, after one pass over the universe. An empty list gives a cascade that holds nothing.
    """
    inside = materialize(universe.join(listed.select("key").distinct(), "key", "left_semi"))
    outside = universe.join(listed.select("key").distinct(), "key", "left_anti")
    levels: list[Level] = []
    wanted, other = inside, outside
    while count := wanted.count():
        chance = rate if levels else first_rate
        hashes = max(1, round(-math.log2(chance)))
        bits = 64 * math.ceil(max(64.0, -count * math.log(chance) / math.log(2) ** 2 * 1.1) / 64)
        if bits > max_bits:
            return None
        level = _filled_level(wanted, len(levels) + 1, bits, hashes)
        levels.append(level)
        wanted, other = materialize(other.filter(_in_level(F.col("key"), level))), wanted
    return Cascade(tuple(levels))


def _filled_level(keys: DataFrame, number: int, bits: int, hashes: int) -> Level:
    at = keys.select(F.explode(F.array(*_positions(F.col("key"), number, bits, hashes))).alias("at"))
    words = at.groupBy(F.floor(F.col("at") / 64).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("at") % 64).cast("int"))).alias("set"))
    found = {row["word"]: row["set"] for row in words.collect()}  # at most bits / 64 rows
    return Level(number, tuple(found.get(i, 0) for i in range(bits // 64)), hashes)


def judge(pages: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", url_col: str = "url", default: str = "allow", max_bits: int = 1 << 24) -> DataFrame:
    """Per row: id, ``host``, ``path``, ``rule`` (text of the longest rule that fits; null: none) and ``verdict``.

    A rule fits its host and all subdomains if the url's path starts with the rule's. One cascade per action holds the rules of that action over
    all keys of ``pages``; the longest key that a cascade contains is the rule. Without one the verdict is ``default``. Of two rules with one
    host and path the first counts. A null url, or one without ``://``, has the empty host and path and fits no rule unless a rule has both empty.
    Repeated rows are judged each; an empty table gives an empty result; other columns of ``pages`` are not read. No rules: all ``default``.
    A list above ``max_bits`` bits a level is looked up by a join of keys instead.
    """
    host, path = split_url(F.col(url_col))
    split = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    first: dict[tuple[str, str], Rule] = {}
    for rule in rules:
        first.setdefault((rule.host, rule.path), rule)
    if not first:
        return split.select(id_col, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    lengths = {len(p) for _, p in first}
    keyed = split.withColumn("keys", candidate_keys(F.col("host"), F.col("path"), lengths))
    universe = materialize(keyed.select(F.explode("keys").alias("key")).distinct())
    spark, cascades = pages.sparkSession, {}
    for action in sorted({rule.action for rule in first.values()}):
        listed = spark.createDataFrame([(f"{h}\n{p}",) for (h, p), rule in first.items() if rule.action == action], "key string")
        cascades[action] = build_cascade(universe, listed, max_bits)
    if any(cascade is None for cascade in cascades.values()):
        return _judge_by_join(keyed, list(first.values()), id_col, default)

    def action_of(key: Column) -> Column:
        return F.coalesce(*[F.when(cascade.contains(key), F.lit(action)) for action, cascade in cascades.items()])

    marked = F.transform(F.col("keys"), lambda k: F.struct(F.replace(k, F.lit("\n"), F.lit("")).alias("rule"), action_of(k).alias("verdict")))
    hit = F.get(F.filter(marked, lambda m: m["verdict"].isNotNull()), F.lit(0))
    return keyed.select(id_col, "host", "path", hit.alias("hit")).select(
        id_col, "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", F.lit(default)).alias("verdict")
    )


def _judge_by_join(keyed: DataFrame, rules: list[Rule], id_col: str, default: str) -> DataFrame:
    """The same verdicts for lists whose filters are over the bound: urls are looked up once each, by a join on the keys."""
    table = keyed.sparkSession.createDataFrame([(f"{r.host}\n{r.path}", r.text, r.action) for r in rules], "key string, rule string, action string")
    asked = keyed.select("host", "path", F.posexplode("keys").alias("rank", "key")).distinct()
    best = asked.join(table, "key").groupBy("host", "path").agg(F.min_by(F.struct("rule", "action"), "rank").alias("hit"))
    return keyed.join(best, ["host", "path"], "left").select(
        id_col, "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.action", F.lit(default)).alias("verdict")
    )
