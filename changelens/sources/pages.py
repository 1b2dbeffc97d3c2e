"""Archived API pages: one row per page, (keys..., page, items)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from changelens.functions import text as tx

_BROKEN = "_broken"

FILE_ITEM = "array<struct<filename:string,status:string,additions:int,deletions:int,patch:string>>"
COMMIT_PAGE = f"repo string, sha string, page int, message string, files {FILE_ITEM}"
PULL_PAGE = f"repo string, sha string, number int, page int, files {FILE_ITEM}"
COMMENT_ITEM = "array<struct<id:bigint,path:string,line:int,body:string,author:string,reaction_total:int>>"
REACTION_ITEM = "array<struct<content:string,login:string>>"


@dataclass(frozen=True)
class Scan:
    pages: DataFrame
    broken: DataFrame


def read_pages(spark: SparkSession, path: str, schema: str, repos: list[str] | None = None) -> Scan:
    """Archived pages: JSON lines below ``path``, in folders ``repo=...`` if the archive has them, with an explicit schema (no inference pass).

    With ``repos`` only their folders are listed and read. A line that is no JSON, or whose fields have other types, is no page: it comes back in ``broken`` as (file,
    text), so nothing is lost without a trace.
    """
    of = lambda lines: lines if repos is None else lines.filter(F.col("repo").isin(repos))
    pages = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    parsed = F.from_json("value", f"{schema}, {_BROKEN} string", {"columnNameOfCorruptRecord": _BROKEN})
    lines = spark.read.text(path).filter((F.trim("value") != "") & parsed[_BROKEN].isNotNull())
    return Scan(of(pages), of(lines).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"), *[c for c in lines.columns if c != "value"]))


def write_pages(pages: DataFrame, path: str) -> None:
    """Archive pages as JSON lines in a folder per repository."""
    pages.write.mode("append").partitionBy("repo").json(path)


def within_pages(pages: DataFrame, keys: list[str], items: str, max_pages: int | None, page_size: int) -> DataFrame:
    """Pages up to the first short one, all or at most ``max_pages``: a list ends at the first page that is not full."""
    seen = pages.filter(F.col("page") >= 1 if max_pages is None else F.col("page").between(1, max(1, max_pages)))
    short = F.coalesce(F.size(items), F.lit(0)) < page_size
    last = F.min(F.when(short, F.col("page"))).over(Window.partitionBy(*keys))
    return seen.withColumn("_last", last).filter(F.col("_last").isNull() | (F.col("page") <= F.col("_last"))).drop("_last")


def _file(item: Column) -> list[Column]:
    return [
        F.coalesce(item["filename"], F.lit("")).alias("filename"), F.coalesce(item["status"], F.lit("modified")).alias("status"),
        F.coalesce(item["additions"], F.lit(0)).alias("additions"), F.coalesce(item["deletions"], F.lit(0)).alias("deletions"),
        item["patch"].alias("patch"),
    ]


def read_commit_pages(pages: DataFrame, max_pages: int | None = None, page_size: int = 100) -> tuple[DataFrame, DataFrame]:
    """(messages, changed_files) of commits; the message comes from the first page only."""
    kept = within_pages(pages, ["repo", "sha"], "files", max_pages, page_size)
    messages = pages.filter(F.col("page") == 1).select("repo", "sha", F.coalesce("message", F.lit("")).alias("message"))
    files = kept.select("repo", "sha", F.explode("files").alias("f")).select("repo", "sha", *_file(F.col("f")))
    return messages, files


def read_pull_pages(pages: DataFrame, max_pages: int | None = None, page_size: int = 100) -> DataFrame:
    kept = within_pages(pages, ["repo", "number"], "files", max_pages, page_size)
    return kept.select("repo", "sha", "number", F.explode("files").alias("f")).select("repo", "sha", "number", *_file(F.col("f")))


def read_listing(pages: DataFrame, keys: list[str], max_pages: int | None = None, page_size: int = 100) -> DataFrame:
    """Comments or reactions: ``items`` of the pages that count, with their listing order."""
    kept = within_pages(pages, keys, "items", max_pages, page_size)
    at = (F.col("page") - 1) * page_size + F.col("pos")
    return kept.select(*keys, "page", F.posexplode("items").alias("pos", "item")).select(*keys, at.alias("seq"), "item.*")


def decode_contents(contents: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Text of base64 contents: plain files, all or up to a size limit; broken UTF-8 is replaced, not fatal."""
    kept = contents.filter((F.col("type") == "file") & (F.col("encoding") == "base64"))
    kept = kept if max_bytes is None else kept.filter(F.coalesce("size", F.lit(0)) <= max_bytes)
    return kept.select("repo", "path", F.decode(F.unbase64("content"), "UTF-8").alias("content"))


def pull_messages(pulls: DataFrame) -> DataFrame:
    return pulls.select("repo", "number", tx.pr_message("title", "body").alias("message"))
