"""The review jobs around the model: triage, tasks, collection, verification, publishing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changelens.functions import diffs
from changelens.operators import findings as fd
from changelens.operators import publish as pub
from changelens.operators import triage as tr
from changelens.operators.grouping import REVIEW, materialize
from changelens.options import DEFAULTS, Options
from changelens.sources import requests as rq

FILE = (*REVIEW, "filename")
FINDING = (*FILE, "seq", *fd.FINDING_FIELDS)
#: Where findings of a chunk are not counted off, places of the next chunk begin this far on.
_PER_CHUNK = 1_000_000


@dataclass(frozen=True)
class Triage:
    selected: DataFrame
    skipped: DataFrame
    rule_findings: DataFrame


def triage(changed_files: DataFrame, options: Options = DEFAULTS) -> Triage:
    """Which files are reviewed, why the others are not, and what is found without a model."""
    sorted_out = tr.triage(changed_files)
    ranked = tr.select_files(
        sorted_out.filter(F.col("reason").isNull()).drop("reason"), options.max_files, options.max_total_chars, options.max_file_chars
    )
    selected = ranked.filter("selected").drop("selected", "reason", "cost")
    skipped = sorted_out.filter(F.col("reason").isNotNull()).select(*FILE, "reason").unionByName(
        ranked.filter("NOT selected").select(*FILE, "reason")
    )
    candidates = sorted_out.filter(F.col("reason").isNull())  # whole patches of all of them, whatever the budget selects
    rules = tr.secret_findings(tr.secret_hits(candidates, options.max_secrets_per_file, options.secret_rules)).unionByName(tr.sensitive_file_findings(sorted_out))
    return Triage(selected, skipped, rules)


@dataclass(frozen=True)
class Tasks:
    contexts: DataFrame
    cached: DataFrame
    requests: DataFrame


def review_tasks(
    selected: DataFrame, messages: DataFrame, evidence: DataFrame, memory: DataFrame, cache: DataFrame, options: Options = DEFAULTS
) -> Tasks:
    contexts = rq.with_context(rq.review_texts(selected, options), messages, evidence, memory, options)
    cached, misses = rq.cache_lookup(contexts, cache)
    return Tasks(contexts, cached, rq.emit_review_requests(misses, options.max_chunk_chars))


@dataclass(frozen=True)
class Reviews:
    findings: DataFrame
    errors: DataFrame
    files: DataFrame


def collect_reviews(
    responses: DataFrame, rule_findings: DataFrame, selected: DataFrame, options: Options = DEFAULTS, cached: DataFrame | None = None
) -> Reviews:
    """Responses (repo, sha, filename, content, error_type[, chunk]) and cache hits -> anchored, deduplicated findings."""
    responses = responses if "chunk" in responses.columns else responses.withColumn("chunk", F.lit(0))
    if cached is not None:
        responses = responses.select(*FILE, "chunk", "content", "error_type").unionByName(rq.cached_responses(cached))
    usable = responses.filter(F.col("error_type").isNull())
    parsed = fd.parse_responses(usable, options.max_findings_per_chunk)
    ordered = parsed.withColumn("seq", F.col("chunk") * (options.max_findings_per_chunk or _PER_CHUNK) + F.col("seq"))
    found = rule_findings.select(*FINDING).unionByName(ordered.select(*FINDING))
    kept = selected.select(*FILE, diffs.trim_patch("patch", options.max_file_chars)["text"].alias("patch"))
    anchored = fd.anchor_in(found, kept.select(*FILE, diffs.added_numbers("patch").alias("added")))
    # every later step reads the findings, so answers are parsed once
    unique = materialize(fd.dedupe(anchored, options.max_findings_per_file).drop("seq").withColumnRenamed("rank", "seq"))
    files = fd.review_complete(responses, rule_findings)
    return Reviews(unique, fd.parse_errors(responses), files)


@dataclass(frozen=True)
class Verified:
    findings: DataFrame
    log: DataFrame
    stats: DataFrame


def verify(findings: DataFrame, decisions: DataFrame, options: Options = DEFAULTS) -> Verified:
    """Only the most severe findings of a review are checked, so only decisions about those count."""
    candidates = fd.top_verify(findings, options.verify_max_findings)
    checked = decisions.join(candidates.select(*FILE, "seq"), [*FILE, "seq"], "left_semi")
    log = fd.verify_log(candidates, checked)
    return Verified(fd.apply_decisions(findings, checked), log, fd.verify_stats(log))


def synthesize(targets: DataFrame, findings: DataFrame) -> DataFrame:
    """Verdict and severity counts per review."""
    counts = fd.counts_line(fd.severity_counts(findings))
    return fd.verdict(targets, findings).join(counts, list(REVIEW), "left").withColumn("counts", F.coalesce("counts", F.lit("")))


@dataclass(frozen=True)
class Publication:
    inline: DataFrame
    reports: DataFrame
    actions: DataFrame


def publish(
    targets: DataFrame, findings: DataFrame, files: DataFrame, comments: DataFrame, headlines: DataFrame, skipped: DataFrame,
    rejected: DataFrame, me: str, options: Options = DEFAULTS, summaries: DataFrame | None = None,
) -> Publication:
    """Inline comments, reports and what to do with each report. Reviews in which everything failed are not published."""
    fingerprints, anchors = pub.existing_inline(comments, me)
    inline = pub.post_inline(pub.fresh_inline(findings, fingerprints, anchors), rejected, options.max_inline)
    known = findings.join(anchors, ["repo", "filename", "line"], "left_semi").select(*FILE, "line")
    remaining = pub.hide_inline(findings, inline.select(*FILE, "line").unionByName(known))
    allowed = targets.join(fd.publishable(files).filter("publish"), list(REVIEW), "left_semi")
    reviews = synthesize(allowed, findings)
    reports = pub.render_reports(
        reviews.drop("counts"), remaining, reviews.select(*REVIEW, "counts"), headlines, pub.skip_notes(skipped), options.max_comment_chars, summaries
    )
    actions = pub.upsert_comments(reports.withColumnRenamed("report", "body"), comments, me, list(REVIEW), options.max_comment_chars)
    return Publication(inline.withColumn("body", pub.inline_body()), reports, actions)
