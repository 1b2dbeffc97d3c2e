"""Request and response tables that stand in for live model calls, and report sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from changelens import rules
from changelens.functions import diffs, leaks
from changelens.functions import text as tx
from changelens.operators import findings as fd
from changelens.operators.grouping import REVIEW, unnest
from changelens.options import DEFAULTS, Options

FILE = (*REVIEW, "filename")


def review_texts(selected: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    """Trimmed, numbered and redacted text per selected file, with the truncation facts."""
    return (
        selected.withColumn("trimmed", diffs.trim_patch("patch", options.max_file_chars))
        .withColumn("kept", F.col("trimmed.text"))
        .withColumn("annotated", diffs.annotate_patch("kept"))
        .withColumn("safe_text", leaks.redact("annotated", options.secret_rules))
        .select(
            *FILE, "safe_text", F.col("trimmed.omitted").alias("omitted"),
            ((F.col("trimmed.omitted") > 0) | (F.length("kept") < F.length("patch"))).alias("truncated"),
        )
    )


def with_context(texts: DataFrame, messages: DataFrame, evidence: DataFrame, memory: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    """Adds commit message, impact evidence and recalled memory (empty when there is none) and the cache key."""
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    safe = messages.select(*REVIEW, F.substring(leaks.redact("message", options.secret_rules), 1, options.max_message_chars).alias("message"))
    joined = (
        texts.join(evidence.select(*FILE, "evidence"), list(FILE), "left")
        .join(safe, list(REVIEW), "left").join(memory.select(*REVIEW, "memory"), list(REVIEW), "left")
        .select(*FILE, "safe_text", "omitted", "truncated", blank("message"), blank("evidence"), blank("memory"))
    )
    key = tx.cache_key(
        F.lit(options.model), F.lit(options.prompt_version), F.lit(options.language), "filename", "safe_text", "message", "memory", "evidence"
    )
    return joined.withColumn("cache_key", key)


def cache_lookup(contexts: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits, misses): cached findings by key, a row per chunk (an empty list is a hit; no chunk column: one chunk), and what still has to be asked."""
    known = cache.select("cache_key", F.col("chunk") if "chunk" in cache.columns else F.lit(0).alias("chunk"), F.col("findings").alias("cached"))
    return contexts.select(*FILE, "cache_key").join(known, "cache_key"), contexts.join(known, "cache_key", "left_anti")


def cached_responses(cached: DataFrame) -> DataFrame:
    """Cache hits in the form of answers, so that they are parsed, anchored and counted as reviewed like them."""
    content = F.concat(F.lit('{"findings":'), F.col("cached"), F.lit("}"))
    return cached.select(*FILE, "chunk", content.alias("content"), F.lit(None).cast("string").alias("error_type"))


def cache_rows(answered: DataFrame) -> DataFrame:
    """(cache_key, chunk, findings) of the files of which no chunk failed: the findings of every chunk as a JSON list of its own.

    So bounds per chunk hold for cached answers as for fresh ones. Files of one key have one text; of their answers to a chunk the smallest is kept.
    """
    items = F.get_json_object(tx.json_object_text("content"), "$.findings")
    usable = F.col("error_type").isNull() & F.startswith(F.ltrim(items), F.lit("["))
    chunks = answered.groupBy("cache_key", "chunk").agg(F.bool_and(F.coalesce(usable, F.lit(False))).alias("whole"), F.min(items).alias("findings"))
    files = chunks.groupBy("cache_key").agg(F.bool_and("whole").alias("whole"), F.collect_list(F.struct("chunk", "findings")).alias("chunks"))
    return files.filter("whole").select("cache_key", F.inline("chunks"))


def prompt_text() -> Column:
    note = F.when(F.col("omitted") > 0, F.format_string(" (truncated, %d hunk(s) left out)", "omitted")).when(
        F.col("truncated"), " (truncated)"
    ).otherwise("")
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Review this change and answer in JSON.\nFile: "), F.col("filename"), F.format_string(" part %d of %d", F.col("chunk") + 1, "chunks"), note),
        _block("message", "message"), _block("memory", "memory"), _block("impact", "evidence"),
        F.concat(F.lit("<diff>\n"), F.col("text"), F.lit("\n</diff>")),
    )


def emit_review_requests(misses: DataFrame, max_chunk_chars: int = 12_000) -> DataFrame:
    """One row per (file, chunk): request_id, prompt and cache key."""
    parts = misses.withColumn("parts", tx.chunk_text("safe_text", max_chunk_chars))
    keys = [c for c in misses.columns if c != "safe_text"]
    rows = unnest(parts, [*keys, F.size("parts").alias("chunks")], "parts", "chunk").withColumnRenamed("item", "text")
    request = F.sha2(F.concat_ws("\u001f", "cache_key", F.col("chunk").cast("string")), 256)
    return rows.select(*FILE, "cache_key", "chunk", "chunks", request.alias("request_id"), prompt_text().alias("prompt"))


def _block(tag: str, column: str) -> Column:
    return F.when(F.col(column) != "", F.concat(F.lit(f"<{tag}>\n"), F.col(column), F.lit(f"\n</{tag}>")))


def emit_verify_requests(findings: DataFrame, selected: DataFrame, evidence: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    """One request per finding that is worth a second look: the finding, the code around its line and the impact evidence of its file.

    Only the most severe findings of a review are asked about, so few files are read again; their patches are trimmed, numbered and redacted as for the review.
    """
    candidates = fd.top_verify(findings, options.verify_max_findings)
    shown = review_texts(selected, options).select(*FILE, "safe_text")
    asked = candidates.join(shown, list(FILE), "left").join(evidence.select(*FILE, "evidence"), list(FILE), "left")
    near = F.substring(diffs.excerpt(F.coalesce("safe_text", F.lit("")), "line"), 1, options.max_excerpt_chars)
    told = asked.withColumn("code", near).withColumn("impact", F.substring(F.coalesce("evidence", F.lit("")), 1, options.max_impact_chars))
    prompt = F.concat_ws(
        "\n",
        F.lit("Is this finding right? Answer confirmed, refuted or uncertain, with a reason, in JSON."),
        F.concat(F.lit("File: "), F.col("filename"), F.lit("\nFinding: ["), F.col("severity"), F.lit("/"), F.col("category"), F.lit("] "), F.col("title")),
        F.concat(F.lit("Line: "), F.coalesce(F.col("line").cast("string"), F.lit("unknown"))),
        _block("detail", "detail"), _block("impact", "impact"), F.coalesce(_block("code", "code"), F.lit("<code/>")),
    )
    request = F.sha2(F.concat_ws("\u001f", F.lit("verify"), F.lit(options.model), F.lit(options.prompt_version), "repo", "sha", F.col("seq").cast("string"), "prompt"), 256)
    return told.withColumn("prompt", prompt).select(*FILE, "seq", "rank", request.alias("request_id"), "prompt")


def read_decisions(requests: DataFrame, responses: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    """(repo, sha, filename, seq, verdict, reason) from the answers; what is no decision, failed or is missing has no row."""
    said = tx.json_object_text("content")
    verdict = F.lower(tx.strip(F.get_json_object(said, "$.verdict")))
    answered = requests.select(*FILE, "seq", "request_id").join(responses.filter(F.col("error_type").isNull()).select("request_id", "content"), "request_id")
    found = answered.select(*FILE, "seq", verdict.alias("verdict"), F.substring(F.coalesce(F.get_json_object(said, "$.reason"), F.lit("")), 1, options.max_reason_chars).alias("reason"))
    return found.filter(F.col("verdict").isin(*rules.DECISIONS))


def emit_summary_requests(findings: DataFrame, messages: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    """One request per review that has findings: its message and its first findings in report order."""
    listed = fd.summary_payload(findings, options.summary_findings).groupBy(*REVIEW).agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("rows"))
    safe = messages.select(*REVIEW, F.substring(leaks.redact("message", options.secret_rules), 1, options.max_message_chars).alias("message"))
    told = listed.join(safe, list(REVIEW), "left").select(
        *REVIEW, F.coalesce("message", F.lit("")).alias("message"), F.array_join(F.transform("rows", lambda r: r["text"]), "\n").alias("findings")
    )
    prompt = F.concat_ws("\n", F.lit("Sum up this review in a few sentences and answer in JSON."), _block("message", "message"), _block("findings", "findings"))
    request = F.sha2(F.concat_ws("\u001f", F.lit("summary"), F.lit(options.model), F.lit(options.prompt_version), "repo", "sha", "prompt"), 256)
    return told.withColumn("prompt", prompt).select(*REVIEW, request.alias("request_id"), "prompt")


def read_summaries(requests: DataFrame, responses: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    """(repo, sha, summary): empty where the answer failed, is missing or is no JSON object."""
    said = requests.select(*REVIEW, "request_id").join(responses.filter(F.col("error_type").isNull()).select("request_id", "content"), "request_id", "left")
    text = F.get_json_object(tx.json_object_text("content"), "$.summary")
    return said.select(*REVIEW, F.substring(F.coalesce(text, F.lit("")), 1, options.max_summary_chars).alias("summary"))


def read_review_responses(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Responses joined back to their requests; a request without a response counts as failed."""
    joined = requests.drop("prompt").join(responses.select("request_id", "content", "error_type"), "request_id", "left")
    missing = F.col("content").isNull() & F.col("error_type").isNull()
    return joined.withColumn("error_type", F.when(missing, "NoResponse").otherwise(F.col("error_type")))


def answer_with(requests: DataFrame, model: Callable[[str], str], attempts: int = 1) -> DataFrame:
    """Let a user function answer the prompts, one Arrow batch at a time; what it still raises at the last attempt becomes its type name."""

    def ask(prompt: str) -> tuple[str | None, str | None]:
        for attempt in range(attempts):
            try:
                return model(prompt), None
            except Exception as error:  # the payload must not leak into the table
                if attempt == attempts - 1:
                    return None, type(error).__name__
        return None, "NotAsked"

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for first in range(0, len(batch), _ANSWERS):
                part = batch.iloc[first : first + _ANSWERS]
                rows = [(request_id, *ask(prompt)) for request_id, prompt in zip(part["request_id"], part["prompt"])]
                yield pd.DataFrame(rows, columns=["request_id", "content", "error_type"])

    return requests.select("request_id", "prompt").mapInPandas(answer, ANSWER)


#: So many answers are held in a task before they are handed on.
_ANSWERS = 100
ANSWER = "request_id string, content string, error_type string"


def answer_requests(requests: DataFrame, model: Callable[[str], str], folder: str, run: str, attempts: int = 2, tasks: int | None = None) -> DataFrame:
    """Ask what has no answer yet, append the answers to ``folder`` and return one row per request that was asked so far.

    Answers lie under the name of the ``run``; one that is repeated under its name replaces what it wrote, and asks what no other run answered. A lost task is
    asked again and leaves no half of its answers, because Spark commits what a task wrote as a whole. Failed requests are rows with the type of the error; a later run
    asks them again. Equal requests are asked once. ``tasks`` is how many prompts are out at the same time.
    """
    spark = requests.sparkSession
    spark.createDataFrame([], ANSWER).write.mode("append").parquet(f"{folder}/run=none")
    known = answers_of(spark, folder).filter(F.col("run") != run)
    open_ = requests.select("request_id", "prompt").dropDuplicates(["request_id"]).join(known.filter("error_type IS NULL").select("request_id"), "request_id", "left_anti")
    open_ = open_ if tasks is None else open_.repartition(tasks, "request_id")
    answer_with(open_, model, attempts).write.mode("overwrite").parquet(f"{folder}/run={run}")
    return answers_of(spark, folder).groupBy("request_id").agg(
        F.min_by(F.struct("content", "error_type", "run"), F.struct(F.col("error_type").isNotNull(), "run")).alias("a")
    ).select("request_id", "a.*")


def answers_of(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(f"{ANSWER}, run string").parquet(folder)


def write_eval_report(report: DataFrame, path: str) -> None:
    """Evaluation rows as JSON lines; large results stay partitioned."""
    report.write.mode("overwrite").json(path)
