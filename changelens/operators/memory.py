"""Project memory: what maintainers' conventions and ratings teach, and what is recalled for a review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changelens import rules
from changelens.functions import leaks
from changelens.functions import text as tx
from changelens.operators.grouping import REVIEW, first_per_group, prefix_within, unnest
from changelens.operators.publish import INLINE_TAG, MARKER, own_marked


def all_comments(commit_comments: DataFrame, review_comments: DataFrame) -> DataFrame:
    return commit_comments.withColumn("kind", F.lit("commit")).unionByName(review_comments.withColumn("kind", F.lit("review")))


def trusted_logins(owners: DataFrame, me: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """(repo, login): the owner of the repository, the own login and listed users, lower case."""
    rows = F.array(F.lower("owner"), *[F.lit(name.lower()) for name in (me, *extra)])
    return owners.select("repo", F.explode(rows).alias("login")).distinct()


def trusted_reactions(reactions: DataFrame, logins: DataFrame) -> DataFrame:
    return reactions.withColumn("_login", F.lower("login")).join(
        logins.select("repo", F.col("login").alias("_login")), ["repo", "_login"], "left_semi"
    ).drop("_login")


def rating(content_positive: Column, content_negative: Column) -> Column:
    """helpful or not-helpful; null when both or none occur."""
    return F.when(content_positive & ~content_negative, "helpful").when(content_negative & ~content_positive, "not-helpful")


def ratings(reactions: DataFrame, logins: DataFrame) -> DataFrame:
    """Per comment: the rating by trusted logins and the number of all reactions. One map-side combined aggregate."""
    flags = reactions.withColumn("_login", F.lower("login")).join(
        logins.select("repo", F.col("login").alias("_login"), F.lit(True).alias("_trusted")), ["repo", "_login"], "left"
    )
    trusted = F.coalesce("_trusted", F.lit(False))
    said = lambda names: F.coalesce(F.bool_or(trusted & F.col("content").isin(*names)), F.lit(False))
    counted = flags.groupBy("repo", "kind", "comment_id").agg(
        said(rules.POSITIVE_REACTIONS).alias("positive"), said(rules.NEGATIVE_REACTIONS).alias("negative"), F.count(F.lit(1)).alias("n_reactions")
    )
    return counted.select(
        "repo", "kind", "comment_id", rating(F.col("positive"), F.col("negative")).alias("rating"), "n_reactions"
    )


def rated_comments(comments: DataFrame, me: str) -> DataFrame:
    """Own marked comments that have reactions."""
    return comments.filter(own_marked(me, MARKER, "<!-- " + INLINE_TAG) & (F.col("reaction_total") > 0))


def changed_feedback(rated: DataFrame, state: DataFrame) -> DataFrame:
    """Ratings whose signature (rating and number of reactions) is not the stored one."""
    signed = rated.filter(F.col("rating").isNotNull()).withColumn(
        "signature", F.concat_ws(":", "rating", F.col("n_reactions").cast("string"))
    ).withColumn("key", F.concat_ws(":", "repo", "kind", F.col("comment_id").cast("string")))
    old = state.filter(F.col("namespace") == "feedback").select("key", F.col("value").alias("_old"))
    return signed.join(old, "key", "left").filter(~F.col("signature").eqNullSafe(F.col("_old"))).drop("_old")


def feedback_text(rating_column: str, body: str) -> Column:
    """One sentence about the rating with the findings of the comment; null when it lists none."""
    findings = tx.parse_report_findings(body)

    def shown(f: Column) -> Column:
        place = F.when(f["location"] != "", F.concat(F.lit(" ("), f["location"], F.lit(")"))).otherwise("")
        return F.concat(F.lit("["), f["severity"], F.lit("/"), f["category"], F.lit("] "), f["title"], place)

    label = F.when(F.col(rating_column) == "helpful", "helpful and correct").otherwise("NOT helpful")
    return tx.let(
        findings,
        lambda found: F.when(
            F.size(found) > 0,
            F.concat(F.lit("A maintainer rated a review comment as "), label, F.lit(". Findings: "), F.array_join(F.transform(found, shown), "; ")),
        ),
    )


def learn_feedback(comments: DataFrame, reactions: DataFrame, logins: DataFrame, state: DataFrame, me: str) -> DataFrame:
    """Memory items to retain from ratings: (repo, document_id, text, key, value)."""
    own = rated_comments(comments, me).withColumn("comment_id", F.col("id"))
    fresh = changed_feedback(ratings(reactions, logins), state)
    joined = own.select("repo", "kind", "comment_id", "body").join(fresh, ["repo", "kind", "comment_id"])
    # a filter on the text itself would build it twice
    told = unnest(joined, ["repo", "kind", "comment_id", "key", "signature"], F.array_compact(F.array(feedback_text("rating", "body"))))
    return told.select(
        "repo", F.concat_ws(":", F.lit("feedback"), "kind", F.col("comment_id").cast("string")).alias("document_id"), F.col("item").alias("text"),
        "key", F.col("signature").alias("value"),
    )


def digest(content: str, secret_rules: leaks.Rules = rules.SECRET_RULES) -> Column:
    """Hash of a whole convention document without its credentials."""
    return F.sha2(leaks.redact(content, secret_rules), 256)


def changed_conventions(documents: DataFrame, state: DataFrame, secret_rules: leaks.Rules = rules.SECRET_RULES) -> DataFrame:
    """Convention documents that are not blank and whose digest is not the stored one."""
    hashed = documents.filter(tx.strip("content") != "").withColumn("digest", digest("content", secret_rules)).withColumn(
        "key", F.concat_ws(":", "repo", "path")
    )
    old = state.filter(F.col("namespace") == "conventions").select("key", F.col("value").alias("_old"))
    return hashed.join(old, "key", "left").filter(~F.col("digest").eqNullSafe(F.col("_old"))).drop("_old")


def recall_query(paths: Column, message: str) -> Column:
    return tx.strip(
        F.concat(
            F.lit("Conventions and feedback for changes in: "), F.array_join(F.slice(paths, 1, 8), ", "), F.lit(". "), tx.headline(message)
        )
    )


def recall_queries(files: DataFrame, messages: DataFrame) -> DataFrame:
    """(repo, sha, query) from the first eight paths of a review and its headline."""
    first = first_per_group(files.select(*REVIEW, "filename"), REVIEW, [F.col("filename")], 8).groupBy(*REVIEW).agg(
        F.sort_array(F.collect_list("filename")).alias("paths")
    )
    return first.join(messages, list(REVIEW), "left").select(
        *REVIEW, recall_query(F.col("paths"), "message").alias("query")
    )


def recall_budget(
    items: DataFrame, keys: list[str], max_items: int = 12, max_tokens: int = 1_500, secret_rules: leaks.Rules = rules.SECRET_RULES
) -> DataFrame:
    """The recalled lines that fit: the first items, blank ones skipped, up to the first that exceeds the budget.

    Items are redacted before they are cleaned.
    """
    first = first_per_group(items, keys, [F.col("pos")], max_items)
    kind = F.when(F.coalesce("type", F.lit("")) == "", "memory").otherwise(F.col("type"))
    lines = first.withColumn("text", tx.clean_memory_text(leaks.redact("text", secret_rules))).filter(F.col("text") != "").withColumn(
        "line", F.concat(F.lit("- ["), tx.clean_memory_text(kind, 20), F.lit("] "), F.col("text"))
    )
    return prefix_within(lines, keys, [F.col("pos")], F.length("line"), max_tokens * 3).select(*keys, "pos", "line")


def memory_text(lines: DataFrame, keys: list[str]) -> DataFrame:
    joined = lines.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("rows"))
    return joined.select(*keys, F.array_join(F.transform("rows", lambda r: r["line"]), "\n").alias("memory"), F.size("rows").alias("n_items"))
