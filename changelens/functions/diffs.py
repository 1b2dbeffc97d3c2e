"""Unified-diff functions. A patch is one cell, so everything is computed inside its row: no shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from changelens import rules
from changelens.functions import code
from changelens.functions.text import as_column, built_once, ColumnLike, let, normalize_breaks, split_lines

_HEADER_AHEAD = r"\n(?=" + rules.HUNK_HEADER[1:] + ")"


def split_hunks(patch: ColumnLike) -> Column:
    """Hunk texts; rows before the first header form a piece of their own."""
    return F.split(normalize_breaks(patch), _HEADER_AHEAD, -1)


def _hunk_start(hunk: Column) -> Column:
    return F.regexp_extract(hunk, rules.HUNK_HEADER, 1).cast("int")


def _body_rows(hunk: Column) -> Column:
    rows = let(F.split(hunk, "\n", -1), lambda lines: F.slice(lines, F.lit(2), F.size(lines)))
    return F.filter(rows, lambda r: ~r.startswith("\\"))


def _hunk_rows(hunk: Column, hunk_id: Column) -> Column:
    """Numbered rows of one hunk.

    The number needs no running count: among the rows that exist in the new file, a row's number is the hunk start
    plus its index; for a removed row, the rows before it that exist in the new file are its position minus its index
    among the removed rows.
    """
    rows = _body_rows(hunk)
    placed = F.transform(rows, lambda row, i: F.struct(i.alias("pos"), row.alias("row")))

    def record(row: Column, number: Column, gap: Column) -> Column:
        text = row["row"]
        op = F.when(F.left(text, F.lit(1)).isin("+", "-"), F.left(text, F.lit(1))).otherwise(" ")
        return F.struct(
            hunk_id.alias("hunk_id"),
            row["pos"].alias("pos"),
            op.alias("op"),
            number.alias("new_line"),
            gap.alias("gap_hi"),
            F.substring(text, 2, 2147483647).alias("text"),
        )

    def numbered(start: Column, rows: Column) -> Column:
        removed = F.filter(rows, lambda r: r["row"].startswith("-"))
        kept = F.filter(rows, lambda r: ~r["row"].startswith("-"))
        null = F.lit(None).cast("int")
        return F.array_sort(
            F.concat(
                F.transform(kept, lambda r, i: record(r, start + i, null)),
                F.transform(removed, lambda r, k: record(r, null, start + r["pos"] - k)),
            )
        )

    return let(_hunk_start(hunk), lambda start: let(placed, lambda rows: numbered(start, rows)))


@built_once
def patch_rows(patch: ColumnLike) -> Column:
    """array<struct<hunk_id, pos, op, new_line, gap_hi, text>> in patch order.

    ``new_line`` is set on added and context rows; ``gap_hi`` is the new-file line that follows a removed row.
    """
    hunks = F.filter(split_hunks(patch), lambda h: h.rlike(rules.HUNK_HEADER))
    return F.flatten(F.transform(hunks, lambda hunk, i: _hunk_rows(hunk, i + 1)))


def added_lines(rows: ColumnLike) -> Column:
    """New-file numbers of added rows (ascending within a hunk), from ``patch_rows``."""
    return F.transform(F.filter(as_column(rows), lambda r: r["op"] == "+"), lambda r: r["new_line"])


@built_once
def added_numbers(patch: ColumnLike) -> Column:
    """What ``added_lines`` gives from ``patch_rows``, from the patch itself: texts and removed rows are not put in order for it."""

    def numbers(hunk: Column) -> Column:
        def told(start: Column) -> Column:
            kept = F.filter(_body_rows(hunk), lambda r: ~r.startswith("-"))
            placed = F.transform(kept, lambda r, i: F.when(r.startswith("+"), start + i))
            return F.filter(placed, lambda n: n.isNotNull())

        return let(_hunk_start(hunk), told)

    return F.flatten(F.transform(F.filter(split_hunks(patch), lambda h: h.rlike(rules.HUNK_HEADER)), numbers))


def deletion_gaps(rows: ColumnLike) -> Column:
    """Distinct (gap_lo, gap_hi) neighbours of removed rows, from ``patch_rows``."""
    removed = F.filter(as_column(rows), lambda r: r["op"] == "-")
    return F.array_distinct(
        F.transform(
            removed,
            lambda r: F.struct(
                F.greatest(F.lit(0), r["gap_hi"] - 1).alias("gap_lo"), r["gap_hi"].alias("gap_hi")
            ),
        )
    )


def touched_lines(added: ColumnLike, gaps: ColumnLike) -> Column:
    """Added lines and both ends of every gap."""
    gaps = as_column(gaps)
    return F.array_distinct(
        F.concat(
            as_column(added),
            F.transform(gaps, lambda g: g["gap_lo"]),
            F.transform(gaps, lambda g: g["gap_hi"]),
        )
    )


def render_row(row: Column) -> Column:
    number = F.lpad(row["new_line"].cast("string"), 5, " ")
    wide = F.when(F.length(row["new_line"].cast("string")) > 5, row["new_line"].cast("string")).otherwise(number)
    return (
        F.when(row["op"] == "-", F.concat(F.lit("      - "), row["text"]))
        .when(row["op"] == "+", F.concat(wide, F.lit(" + "), row["text"]))
        .otherwise(F.concat(wide, F.lit("   "), row["text"]))
    )


@built_once
def annotate_patch(patch: ColumnLike) -> Column:
    """Patch text with every added and context row prefixed by its new-file number."""
    hunks = F.filter(split_hunks(patch), lambda h: h.rlike(rules.HUNK_HEADER))
    per_hunk = F.transform(
        hunks,
        lambda hunk, i: F.concat(
            F.array(F.substring_index(hunk, "\n", 1)), F.transform(_hunk_rows(hunk, i), render_row)
        ),
    )
    return F.array_join(F.flatten(per_hunk), "\n")


@built_once
def trim_patch(patch: ColumnLike, max_chars: int = 24_000) -> Column:
    """struct<text, omitted>: whole hunks taken alternately from both ends until the first that does not fit."""
    patch = as_column(patch)

    def choose(hunks: Column) -> Column:
        n = F.size(hunks)
        at_step = lambda s: F.when(s % 2 == 0, (s / 2).cast("int")).otherwise(n - 1 - ((s - 1) / 2).cast("int"))
        order = F.transform(F.sequence(F.lit(0), n - 1), at_step)
        start = F.struct(F.lit(0).alias("used"), F.lit(0).alias("taken"), F.lit(False).alias("full"))

        def step(acc: Column, index: Column) -> Column:
            cost = F.length(F.get(hunks, index)) + 1
            fits = ~acc["full"] & (acc["used"] + cost <= max_chars)
            return F.struct(
                F.when(fits, acc["used"] + cost).otherwise(acc["used"]).alias("used"),
                (acc["taken"] + fits.cast("int")).alias("taken"),
                (~fits).alias("full"),
            )

        taken = F.aggregate(order, start, step, lambda acc: acc["taken"])
        cut = F.regexp_replace(F.substring(F.get(hunks, F.lit(0)), 1, max_chars), r"\n[^\n]*\z", "")

        def result(taken: Column) -> Column:
            front = F.ceil(taken / 2).cast("int")
            back = taken - front
            kept = F.concat(F.slice(hunks, F.lit(1), front), F.slice(hunks, n - back + 1, back))
            return F.struct(
                F.when(taken == 0, cut).otherwise(F.array_join(kept, "\n")).alias("text"),
                (n - F.greatest(taken, F.lit(1))).alias("omitted"),
            )

        return let(taken, result)

    whole = F.struct(patch.alias("text"), F.lit(0).alias("omitted"))
    return F.when(F.length(patch) <= max_chars, whole).otherwise(let(split_hunks(patch), choose))


@built_once
def removed_texts(patch: ColumnLike) -> Column:
    """Texts of ``-`` rows; rows that look like file headers are ignored."""
    rows = F.filter(split_lines(patch), lambda r: r.startswith("-") & ~r.startswith("---"))
    return F.transform(rows, lambda r: F.substring(r, 2, 2147483647))


@built_once
def added_texts(patch: ColumnLike) -> Column:
    rows = F.filter(split_lines(patch), lambda r: r.startswith("+") & ~r.startswith("+++"))
    return F.transform(rows, lambda r: F.substring(r, 2, 2147483647))


def defined_names(texts: ColumnLike, family: ColumnLike) -> Column:
    """Distinct names of the definitions whose header starts in one of the rows, by the header grammar of the rows' family."""
    return F.array_distinct(code.header_names(texts, family))


def excerpt(annotated: ColumnLike, line: ColumnLike, context: int = 15, fallback: int = 60) -> Column:
    """Rows of an annotated patch around a line, as one contiguous slice; the first rows when nothing is near."""
    line = as_column(line)

    def cut(rows: Column) -> Column:
        number = lambda row: F.regexp_extract(row, r"^\s*(\d+)[ +]", 1)
        placed = F.transform(
            rows,
            lambda row, i: F.struct(
                i.alias("i"), F.when(number(row) != "", F.abs(number(row).try_cast("int") - line) <= context).alias("near")
            ),
        )

        def window(near: Column) -> Column:
            first, last = F.array_min(near)["i"], F.array_max(near)["i"]
            return F.when(F.size(near) > 0, F.slice(rows, first + 1, last - first + 1)).otherwise(F.slice(rows, 1, fallback))

        return let(F.filter(placed, lambda p: p["near"]), window)

    return F.array_join(let(split_lines(annotated), cut), "\n")
