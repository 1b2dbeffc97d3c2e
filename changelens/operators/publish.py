"""Publish actions: what to post, update or hide. The result is a table of actions, never a call."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changelens.functions import text as tx
from changelens.operators.findings import report_order, severity_rank
from changelens.operators.grouping import REVIEW, first_per_group

FILE = (*REVIEW, "filename")
MARKER = "<!-- changelens -->"
INLINE_TAG = "changelens-inline"


def own_marked(me: str, *markers: str) -> Column:
    marked = F.lit(False)
    for marker in markers or (MARKER,):
        marked = marked | F.contains("body", F.lit(marker))
    return marked & (F.lower("author") == me.lower())


def upsert_comments(new: DataFrame, existing: DataFrame, me: str, keys: list[str], max_chars: int = 60_000) -> DataFrame:
    """Update the first own marked comment in listing order, else create one; the body is cut to the limit."""
    own = existing.filter(own_marked(me)).groupBy(*keys).agg(F.min_by("id", F.struct("seq", "id")).alias("comment_id"))
    return new.join(own, keys, "left").select(
        *[c for c in new.columns if c != "body"], "comment_id", F.when(F.col("comment_id").isNull(), "created").otherwise("updated").alias("action"),
        F.substring("body", 1, max_chars).alias("body"),
    )


def existing_inline(comments: DataFrame, me: str) -> tuple[DataFrame, DataFrame]:
    """(fingerprints, anchors) of own inline comments."""
    own = comments.filter(own_marked(me, "<!-- " + INLINE_TAG))
    prints = own.select("repo", tx.fingerprint_of("body", INLINE_TAG).alias("fp")).filter(F.col("fp").isNotNull()).distinct()
    anchors = own.filter(F.col("path").isNotNull() & F.col("line").isNotNull()).select(
        "repo", F.col("path").alias("filename"), "line"
    ).distinct()
    return prints, anchors


def fresh_inline(findings: DataFrame, fingerprints: DataFrame, anchors: DataFrame) -> DataFrame:
    """Anchored findings that are not on the pull request yet: two equality anti joins, not one join on OR."""
    anchored = findings.filter(F.col("line").isNotNull()).withColumn("fp", tx.fingerprint("filename", "category", "title"))
    return anchored.join(fingerprints, ["repo", "fp"], "left_anti").join(anchors, ["repo", "filename", "line"], "left_anti")


def post_inline(fresh: DataFrame, rejected: DataFrame, cap: int = 50) -> DataFrame:
    """The first ``cap`` fresh findings of a review in file order, none where the anchors were rejected."""
    kept = fresh.join(rejected.select(*REVIEW).distinct(), list(REVIEW), "left_anti")
    return first_per_group(kept, REVIEW, [F.col("filename"), F.col("seq")], cap, "rank")


def hide_inline(findings: DataFrame, posted: DataFrame) -> DataFrame:
    """Findings that stay in the report: those not shown inline."""
    return findings.join(posted.select(*FILE, "line").distinct(), [*FILE, "line"], "left_anti")


@tx.built_once
def finding_text() -> Column:
    where = F.concat(F.lit("`"), F.col("filename"), F.coalesce(F.concat(F.lit(":"), F.col("line").cast("string")), F.lit("")), F.lit("`"))
    return F.concat_ws(
        "\n",
        F.concat(F.lit("- **["), F.col("severity"), F.lit("/"), F.col("category"), F.lit("]** "), tx.sanitize("title"), F.lit(" — "), where),
        F.concat(F.lit("  "), tx.sanitize("detail")),
        F.concat(F.lit("  Suggestion: "), tx.sanitize(F.when(F.col("suggestion") != "", F.col("suggestion")))),
    )


@tx.built_once
def inline_body() -> Column:
    return F.concat_ws(
        "\n\n",
        F.concat(
            F.lit(f"<!-- {INLINE_TAG} fp="), tx.fingerprint("filename", "category", "title"), F.lit(" -->\n**["), F.col("severity"),
            F.lit("/"), F.col("category"), F.lit("]** "), tx.sanitize("title"),
        ),
        tx.sanitize("detail"),
        F.concat(F.lit("Suggestion: "), tx.sanitize(F.when(F.col("suggestion") != "", F.col("suggestion")))),
    )


VERDICT_TEXT = {
    "request_changes": "Changes requested", "comment": "Comments for the author", "approve": "No problems found",
}


def report_parts(findings: DataFrame, max_chars: int = 60_000) -> DataFrame:
    """Finding texts that can still be visible in a report of ``max_chars``, with the number of all findings.

    A report is cut to ``max_chars`` when it is posted, and every finding text is at least ``_SHORTEST`` long, so only
    the first ``max_chars / _SHORTEST`` of a review can be visible; a hot review is cut to that before the shuffle.
    """
    visible = max_chars // _SHORTEST + 1
    return first_per_group(findings, REVIEW, report_order(), visible, "rank").select(*REVIEW, "rank", finding_text().alias("text"))


# "- **[nit/bug]** t — `f`" and two spaces of detail: no rendered finding is shorter than this many characters
_SHORTEST = 26


def render_reports(
    reviews: DataFrame, findings: DataFrame, counts: DataFrame, headlines: DataFrame, notes: DataFrame, max_chars: int = 60_000,
    summaries: DataFrame | None = None,
) -> DataFrame:
    """(repo, sha, report): Markdown per review, cut to ``max_chars``; ``summaries`` are the model's (repo, sha, summary), if asked."""
    found = report_parts(findings, max_chars).groupBy(*REVIEW).agg(
        F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("parts")
    )
    told = headlines.groupBy(*REVIEW).agg(F.array_sort(F.collect_list(F.struct("rank", "headline"))).alias("heads"))
    label = F.lit(None).cast("string")
    for code, shown in VERDICT_TEXT.items():
        label = F.when(F.col("verdict") == code, shown).otherwise(label)
    joined = reviews.join(found, list(REVIEW), "left").join(told, list(REVIEW), "left").join(counts, list(REVIEW), "left").join(
        notes, list(REVIEW), "left"
    )
    if summaries is not None:
        joined = joined.join(summaries.select(*REVIEW, "summary"), list(REVIEW), "left")
    summary = F.when(F.col("summary") != "", tx.sanitize("summary")) if summaries is not None else F.lit(None).cast("string")
    heads = F.array_join(F.transform("heads", lambda h: F.concat(F.lit("- "), tx.sanitize(h["headline"]))), "\n")
    body = F.concat_ws(
        "\n\n",
        F.lit(MARKER),
        F.format_string("## Change review (`%s`)", F.substring("sha", 1, 7)),
        F.concat(F.lit("**Verdict:** "), label),
        summary,
        F.concat(F.lit("### Impact\n"), heads),
        F.concat(F.lit("**Findings:** "), F.when(F.col("counts") != "", F.col("counts"))),
        F.when(F.size("parts") > 0, F.array_join(F.transform("parts", lambda p: p["text"]), "\n")).otherwise("No findings to report here."),
        F.lit("---"),
        F.concat(F.lit("<sub>"), tx.sanitize(F.coalesce("note", F.lit(""))), F.lit("</sub>")),
    )
    return joined.select(*REVIEW, F.substring(body, 1, max_chars).alias("report"))


def skip_notes(skipped: DataFrame, k: int = 5) -> DataFrame:
    """(repo, sha, n_skipped, note): how many files were left out and the first ``k`` of them with the reason."""
    total = skipped.groupBy(*REVIEW).agg(F.count(F.lit(1)).alias("n_skipped"))
    first = first_per_group(skipped, REVIEW, [F.col("filename")], k).groupBy(*REVIEW).agg(
        F.sort_array(F.collect_list(F.concat_ws(": ", "filename", "reason"))).alias("shown")
    )
    more = F.when(F.col("n_skipped") > k, " …").otherwise("")
    return total.join(first, list(REVIEW)).select(
        *REVIEW, "n_skipped", F.format_string("skipped %d file(s): %s%s", "n_skipped", F.array_join("shown", "; "), more).alias("note")
    )


__all__ = [
    "MARKER", "INLINE_TAG", "own_marked", "upsert_comments", "existing_inline", "fresh_inline", "post_inline", "hide_inline",
    "finding_text", "inline_body", "report_parts", "render_reports", "skip_notes", "severity_rank",
]
