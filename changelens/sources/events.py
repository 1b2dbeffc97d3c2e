"""Webhook deliveries: size, signature and JSON checks, then review targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changelens import rules
from changelens.functions import paths
from changelens.functions import text as tx
from changelens.operators.grouping import unnest

PAYLOAD = (
    "ref string, after string, deleted boolean, repository struct<full_name:string>, sender struct<type:string>, "
    "commits array<struct<id:string,message:string,distinct:boolean>>, action string, "
    "pull_request struct<number:int,draft:boolean,head:struct<sha:string>>"
)


def read_events(deliveries: DataFrame, max_bytes: int = 5 * 1024 * 1024) -> DataFrame:
    """Adds ``payload`` and ``status``: too_large, pong, malformed or ok. Works on a batch and on a stream."""
    body = F.decode("body", "UTF-8")
    parsed = deliveries.withColumn(
        "payload", F.when((F.octet_length("body") <= max_bytes) & F.is_valid_utf8(body), F.from_json(body, PAYLOAD))
    )
    valid = F.try_parse_json(body).isNotNull()
    status = (
        F.when(F.octet_length("body") > max_bytes, "too_large").when(F.col("event") == "ping", "pong")
        .when(~valid, "malformed").otherwise("ok")
    )
    return parsed.withColumn("status", status)


def event_allowed(events: tuple[str, ...], allowed_repos: tuple[str, ...]) -> Column:
    repo = F.col("payload.repository.full_name")
    return (
        F.col("event").isin(*events) & (F.coalesce(repo, F.lit("")) != "") & paths.repo_allowed(repo, allowed_repos)
        & ~F.coalesce(F.col("payload.sender.type") == "Bot", F.lit(False))
    )


def push_targets(max_commits: int) -> Column:
    """The last commits of a push that are distinct and not merges, in their order."""
    kept = F.filter(
        F.coalesce("payload.commits", F.array().cast("array<struct<id:string,message:string,distinct:boolean>>")),
        lambda c: F.coalesce(c["distinct"], F.lit(True)) & ~F.coalesce(c["message"], F.lit("")).startswith("Merge "),
    )
    last = tx.let(kept, lambda c: F.slice(c, F.greatest(F.size(c) - max_commits + 1, F.lit(1)), F.lit(max_commits)))
    return F.transform(last, lambda c: F.struct(c["id"].alias("sha"), F.lit(None).cast("int").alias("pr_number")))


def event_filter(
    parsed: DataFrame, events: tuple[str, ...] = ("push",), allowed_repos: tuple[str, ...] = (), max_commits: int = 5
) -> DataFrame:
    """One row per review target: the delivery columns, repo, sha, pr_number and the position ``seq``."""
    payload = lambda path: F.col(f"payload.{path}")
    is_push = (
        (F.col("event") == "push") & ~F.coalesce(payload("deleted"), F.lit(False))
        & F.coalesce(payload("ref").startswith("refs/heads/"), F.lit(False)) & ~F.coalesce(payload("after").eqNullSafe("0" * 40), F.lit(False))
    )
    is_pull = (
        (F.col("event") == "pull_request") & F.coalesce(payload("action").isin(*rules.PULL_ACTIONS), F.lit(False))
        & ~F.coalesce(payload("pull_request.draft"), F.lit(False))
    )
    pull = F.array(F.struct(payload("pull_request.head.sha").alias("sha"), payload("pull_request.number").alias("pr_number")))
    # one expression decides and builds the targets; filters on the payload would parse the body once per filter
    usable = (F.col("status") == "ok") & event_allowed(events, allowed_repos)
    targets = F.when(usable & is_push, push_targets(max_commits)).when(usable & is_pull, pull)
    keep = [c for c in parsed.columns if c not in ("payload", "body", "status")]
    rows = unnest(parsed, [*keep, payload("repository.full_name").alias("repo")], targets, "_pos")
    return rows.select(*keep, "repo", "sha", "pr_number", (F.col("_pos") + 1).alias("seq"))


def with_key(targets: DataFrame) -> DataFrame:
    return targets.withColumn("key", tx.review_key("repo", "sha", "pr_number"))
