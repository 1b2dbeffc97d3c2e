"""Repository snapshots: archive members or files on disk -> source_files(repo, sha, path, content)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from changelens import rules
from changelens.functions import paths
from changelens.functions.text import let
from changelens.operators.grouping import REVIEW


def read_members(spark: SparkSession, folder: str, repo: str = "*", sha: str = "*") -> DataFrame:
    """Files of unpacked snapshots below ``folder/<repo>/<sha>/``, one row per file with its bytes; names of either narrow what is listed."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{folder}/{repo}/{sha}")
    depth = len([part for part in folder.split("://")[-1].removeprefix("file:").split("/") if part])
    at = F.filter(F.split(F.regexp_replace("path", r"^[a-z][a-z0-9+.-]*:/*", ""), "/"), lambda part: part != "")
    tail = F.slice(at, F.lit(depth + 1), F.size(at))
    return files.select(
        F.get(tail, F.lit(0)).alias("repo"), F.get(tail, F.lit(1)).alias("sha"),
        F.array_join(F.slice(tail, F.lit(2), F.size(tail)), "/").alias("name"), F.lit("file").alias("type"),
        F.col("length").alias("size"), F.decode("content", "UTF-8").alias("content"),
    )


@dataclass(frozen=True)
class Contents:
    places: DataFrame
    texts: DataFrame


def by_content(source_files: DataFrame) -> Contents:
    """``places`` (repo, sha, path, content_id) and ``texts`` (content_id, language, content): a file that is equal in many snapshots is one text.

    The id is a hash of language and text. Copies meet in a map-side combined aggregate, so of a text that is in every commit each task sends one.
    """
    language = paths.language_of("path")
    told = source_files.withColumn("language", language).withColumn("content_id", F.sha2(F.concat_ws("\n", "language", "content"), 256))
    texts = told.groupBy("content_id").agg(F.any_value("language").alias("language"), F.any_value("content").alias("content"))
    return Contents(told.select(*REVIEW, "path", "content_id"), texts)


def source_members(members: DataFrame, max_file_bytes: int | None = None) -> DataFrame:
    """Regular source files with a safe path; the first path part is the archive prefix and dropped."""
    inner = let(F.split("name", "/"), lambda p: F.slice(p, F.lit(2), F.size(p)))
    unsafe = F.exists("parts", lambda p: p.isin("", ".", "..") | F.contains(p, F.lit(":")) | F.contains(p, F.lit("\\")))
    folders = F.slice("parts", F.lit(1), F.greatest(F.size("parts") - 1, F.lit(0)))
    skipped = F.arrays_overlap(folders, F.array(*[F.lit(d) for d in rules.SNAPSHOT_SKIP_DIRS]))
    return (
        members.filter((F.col("type") == "file") & (F.lit(True) if max_file_bytes is None else F.col("size") <= max_file_bytes))
        .withColumn("parts", inner)
        .filter((F.size("parts") > 0) & ~unsafe & ~skipped)
        .withColumn("path", F.array_join("parts", "/"))
        .filter(paths.language_of("path").isNotNull())
        .drop("parts")
    )


def load_snapshot(
    members: DataFrame, max_files: int | None = None, max_file_bytes: int | None = None, max_total_bytes: int | None = None
) -> DataFrame:
    """Source files of every snapshot in archive order: all, or up to the first that breaks a count or size cap.

    The running totals are built over (key, size) rows only and joined back to the texts as one cut position per
    snapshot. Snapshots far from both caps, which is nearly all of them, never enter the window.
    """
    kept = source_members(members, max_file_bytes)
    if max_files is None and max_total_bytes is None:
        return kept
    max_files, max_total_bytes = max_files or 2**31, max_total_bytes or 2**62
    totals = kept.groupBy(*REVIEW).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    large = totals.filter((F.col("n") > max_files) | (F.col("bytes") > max_total_bytes)).select(*REVIEW)
    # a block of 4096 members is one row of the running sum, so a huge archive is not sorted in one task
    sized = kept.join(large, list(REVIEW), "left_semi").select(*REVIEW, "ordinal", "size", F.floor(F.col("ordinal") / 4096).alias("block"))
    blocks = sized.groupBy(*REVIEW, "block").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    before = Window.partitionBy(*REVIEW).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = blocks.select(
        *REVIEW, "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"),
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
    )
    inside = Window.partitionBy(*REVIEW, "block").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    running = sized.join(base, [*REVIEW, "block"]).select(
        *REVIEW, "ordinal",
        (F.col("n_before") + F.count(F.lit(1)).over(inside)).alias("n"), (F.col("bytes_before") + F.sum("size").over(inside)).alias("bytes"),
    )
    stop = running.filter((F.col("n") > max_files) | (F.col("bytes") > max_total_bytes)).groupBy(*REVIEW).agg(
        F.min("ordinal").alias("stop")
    )
    return kept.join(stop, list(REVIEW), "left").filter(F.col("stop").isNull() | (F.col("ordinal") < F.col("stop"))).drop("stop")
