"""Repair of conversation structure at the least cost.

A conversation is legal when its role initials read ``(s?(ua)+)?``. Its rows, in the order of their turns, are kept (0), given another role (1) or
deleted (2), and empty user or assistant rows are inserted anywhere (5). Blank and repeated rows have to go; a truncated row that stays costs 5 more.
Of the cheapest repairs the one whose audit, the initials of its edits in order, is first in ASCII is returned.

The search is a depth-first branch-and-bound: an explicit stack of prefixes, a lower bound of what the rest of the rows must cost after each row in each
state of the grammar, the best whole repair so far (cost, audit) as the incumbent, and a table per node (rows used, state) of the best prefix that reached it.
It ends when every prefix on the stack is cut by one of the three, which proves the incumbent. Two prefixes that used the same rows at the same cost
are never one the beginning of the other (only inserts use no row, and they cost), so the smaller of two stays the smaller after any common rest.

Rows are dealt by conversation in one shuffle and pass through a task in order, never more than :data:`SEGMENT` of them held at once: a longer
conversation is searched segment by segment for each state it can begin and end in, at most four prefixes stay open between two segments, and each
carries the running hash of its repaired rows. So a conversation of any length needs the memory of a segment and of its audit.

Null role or text counts as one space; rows of a null ``conv_id`` are one conversation of that id; rows of equal turn are ordered by role and text, null
turns first; an empty role has no legal initial; repeated rows are duplicates; further columns are ignored; an empty table gives an empty result; texts may be
of any length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: State of the grammar after an initial: 0 nothing yet, 1 system, 2 user, 3 assistant.
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: The initial that may be filled in, and its state.
FILL = {0: ("u", 2), 1: ("u", 2), 2: ("a", 3), 3: ("u", 2)}
ROLE = {"u": "user", "a": "assistant"}
STATES, ACCEPTED = (0, 1, 2, 3), (0, 3)
LEGAL = {"su", "ua", "au"}
SEGMENT = 512
NEVER = 1 << 60
SPACE = " \t\n\x0b\x0c\r"


def edits(code: str, state: int) -> Iterator[tuple[str, int, int, int]]:
    """(initial of the edit, its cost, rows it uses, state after it) of what may happen before or to a row; ``code`` is empty after the last.

    Codes: ``x`` has to go; u, a, s, o is the row's initial (o: any other); the same in capitals: truncated.
    """
    filled = FILL[state][1]
    if code:
        yield "D", DELETE, 1, state
    yield "I", INSERT, 0, filled
    if code and code != "x":
        more = TRUNCATED if code.isupper() else 0
        kept = NEXT.get((state, code.lower()))
        if kept is not None:
            yield "K", KEEP + more, 1, kept
        yield "R", REROLE + more, 1, filled


def suffix_bounds(codes: str, exits: tuple[int, ...], final: bool) -> list[list[int]]:
    """``[i][state]``: a lower bound of the cost of the rows from ``i`` on; no end in reach: :data:`NEVER`."""
    bounds = [[0 if s in exits else NEVER for s in STATES]]
    if final:
        bounds[0] = _with_inserts(bounds[0])
    for code in reversed(codes):
        after = bounds[-1]
        bounds.append(_with_inserts([min((cost + after[to] for _, cost, used, to in edits(code, s) if used), default=NEVER) for s in STATES]))
    return bounds[::-1]


def _with_inserts(bound: list[int]) -> list[int]:
    for _ in range(2):
        bound = [min(b, INSERT + bound[FILL[s][1]]) for s, b in enumerate(bound)]
    return bound


@lru_cache(maxsize=50_000)
def search(codes: str, entry: int, exits: tuple[int, ...], final: bool = True) -> tuple[int, str] | None:
    """The least (cost, audit) from state ``entry`` to one of ``exits`` over all rows; None when there is none.

    Only a ``final`` segment ends with inserts, so that every insert has one place.
    """
    bounds, n = suffix_bounds(codes, exits, final), len(codes)
    best: tuple[int, str] | None = None
    reached: dict[tuple[int, int], tuple[int, str]] = {}
    stack = [(0, entry, 0, "")]
    while stack:
        row, state, cost, audit = stack.pop()
        least = cost + bounds[row][state]
        if least >= NEVER or (best and (least, audit) > (best[0], best[1][: len(audit)])):
            continue
        before = reached.get((row, state))
        if before and before <= (cost, audit):
            continue
        reached[row, state] = cost, audit
        if row == n and state in exits and (best is None or (cost, audit) < best):
            best = cost, audit
        if row == n and not final:
            continue
        code = codes[row] if row < n else ""
        onward = [(row + used, to, cost + price, audit + letter) for letter, price, used, to in edits(code, state)]
        stack += sorted(onward, key=lambda node: (node[2] + bounds[node[0]][node[1]], node[3]), reverse=True)
    return best


class Prefix:
    """The best repair of the rows so far that ends in one state."""

    def __init__(self, cost: int = 0, rank: int = 0, audit: tuple | None = None, sha=None, rows: int = 0, turns: tuple | None = None) -> None:
        self.cost, self.rank, self.audit, self.sha, self.rows, self.turns = cost, rank, audit, sha or hashlib.sha256(), rows, turns

    def onward(self, rows: list[tuple[str, str]], state: int, cost: int, audit: str, keep: bool) -> Prefix:
        sha, n, left, added = self.sha.copy(), self.rows, iter(rows), []
        for letter in audit:
            role, text = ("", "") if letter == "I" else next(left)
            if letter == "D":
                continue
            initial, filled = FILL[state]
            if letter == "K":
                state = NEXT[state, role[:1]]
            else:
                role, state = ROLE[initial], filled
            sha.update(f"{chr(10) if n else ''}{role}:{text}".encode())
            n += 1
            if keep:
                added.append({"role": role, "text": text})
        return Prefix(self.cost + cost, 0, (self.audit, audit), sha, n, (self.turns, added))


def _chain(link: tuple | None) -> list:
    parts = []
    while link:
        link, part = link
        parts.append(part)
    return parts[::-1]


class Conversation:
    """Takes the rows of one conversation in order."""

    def __init__(self, conv_id: int | None, keep: bool) -> None:
        self.conv_id, self.keep = conv_id, keep
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first_turn = self.last_turn = self.initial = None
        self.rows: list[tuple[str, str]] = []
        self.codes: list[str] = []
        self.open = {0: Prefix()}

    def add(self, turn: int | None, role: str, text: str, fault: str) -> None:
        if len(self.rows) == SEGMENT:
            self._close([(s,) for s in STATES], False)
        if turn is not None and turn != self.last_turn:
            self.first_turn, self.last_turn, self.turns = turn if self.first_turn is None else self.first_turn, turn, self.turns + 1
        initial = role[:1]
        self.illegal += self.initial is not None and self.initial + initial not in LEGAL
        self.initial = initial
        self.blank, self.duplicate, self.truncated = self.blank + (fault == "b"), self.duplicate + (fault == "d"), self.truncated + (fault == "t")
        code = initial if initial and initial in "uas" else "o"
        self.codes.append("x" if fault in ("b", "d") else code.upper() if fault == "t" else code)
        self.rows.append((role, text))

    def _close(self, exits: list[tuple[int, ...]], final: bool) -> None:
        codes, made = "".join(self.codes), []
        for ends in exits:
            found = [(p.cost + s[0], p.rank, s[1], s[0], entry) for entry, p in self.open.items() if (s := search(codes, entry, ends, final))]
            if found:
                made.append((min(found), ends))
        ranks = {key: number for number, key in enumerate(sorted({(m[1], m[2]) for m, _ in made}))}
        after = {}
        for (_, rank, audit, cost, entry), ends in made:
            prefix = self.open[entry].onward(self.rows, entry, cost, audit, self.keep)
            prefix.rank = ranks[rank, audit]
            after[ends[0]] = prefix
        self.open, self.rows, self.codes = after, [], []

    def result(self) -> dict:
        self._close([ACCEPTED], True)
        best = self.open[ACCEPTED[0]]
        out = {
            "conv_id": self.conv_id, "gaps": self.last_turn - self.first_turn + 1 - self.turns if self.turns else 0, "blank": self.blank,
            "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal, "cost": best.cost, "audit": "".join(_chain(best.audit)),
            "repaired_sha256": best.sha.hexdigest(),
        }
        return out | ({"turns": [t for part in _chain(best.turns) for t in part]} if self.keep else {})


def _damage(rows: DataFrame) -> DataFrame:
    key = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" "))))
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    hit = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (key % 20).alias("hit"))
    copies = F.sequence(F.lit(0), F.when(F.col("hit") == 3, 1).otherwise(0))
    changed = F.when(F.col("hit") <= 1, "").when(F.col("hit") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return hit.select(
        "conv_id", "turn", F.when(F.col("hit") == 4, "user").otherwise(F.col("role")).alias("role"), changed.alias("text"), (F.col("hit") == 0).alias("gone"),
        F.explode(copies).alias("copy"),
    )


def faults(first: Column) -> Column:
    """First fault of a row: ``b`` blank, ``d`` seen earlier, ``t`` truncated, else empty."""
    core = F.rtrim(F.col("text"), F.lit(SPACE))
    return F.when(core == "", "b").when(~first, "d").when(~F.right(core, F.lit(1)).isin(".", "!", "?"), "t").otherwise("")


def repair(conversations: DataFrame, damaged: bool = False, turns: bool = False) -> DataFrame:
    """One row per conversation: ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost``, ``audit``, ``repaired_sha256`` (of the repaired
    ``role:text`` joined by line breaks) and, with ``turns``, the repaired ``turns`` themselves.

    With ``damaged`` the rows are damaged first, by ``crc32(conv_id:turn) % 20`` (0 drops, 1 empties, 2 removes sentence ends, 3 repeats, 4 makes it
    the user's); a conversation that loses all rows keeps its place with zeros and an empty audit.
    """
    rows = conversations.select("conv_id", "turn", "role", "text")
    if damaged:
        rows = _damage(rows)
    else:
        filled = [F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")]
        rows = rows.select("conv_id", "turn", *filled, F.lit(False).alias("gone"), F.lit(0).alias("copy"))
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("copy")]
    # both windows and the sort below keep to the partitions of one shuffle by conversation
    same = Window.partitionBy("conv_id", "gone", "role", "text").orderBy(F.col("turn").asc_nulls_first(), "copy")
    dealt = rows.repartition("conv_id").withColumn("fault", faults(F.row_number().over(same) == 1))
    dealt = dealt.select("conv_id", "turn", "role", "text", "gone", "fault", "copy").sortWithinPartitions("conv_id", *order).drop("copy")
    fields = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
    fields += ", turns array<struct<role: string, text: string>>" if turns else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, now = [], None
        for batch in batches:
            columns = (batch.column(name).to_pylist() for name in ("conv_id", "turn", "role", "text", "gone", "fault"))
            for conv_id, turn, role, text, gone, fault in zip(*columns, strict=True):
                if now is None or conv_id != now.conv_id:
                    if now:
                        done.append(now.result())
                    now = Conversation(conv_id, turns)
                if not gone:
                    now.add(turn, role, text, fault)
            if done:
                yield _batch(done, turns)
                done = []
        if now:
            yield _batch([now.result()], turns)

    return dealt.mapInArrow(run, fields)


def _batch(rows: list[dict], turns: bool) -> pa.RecordBatch:
    longs = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    fields = [(c, pa.int64()) for c in longs] + [("audit", pa.string()), ("repaired_sha256", pa.string())]
    if turns:
        fields.append(("turns", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))))
    return pa.RecordBatch.from_pylist(rows, schema=pa.schema(fields))
