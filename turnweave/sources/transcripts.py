"""Transcript files as a table of lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.runtime import stage

MAIN_PATTERN = r"([^/]+)/([^/]+)\.jsonl$"
BROADCAST_SPLITS = 100_000  # about 20 MB
AGENT_PATTERN = r"([^/]+)/([^/]+)/subagents/agent-([^/]+)\.jsonl$"


def local_path(c: Column) -> Column:
    """File path without the file: scheme."""
    return F.regexp_replace(c, r"^file:(//)?(?=/)", "")


def _files(spark: SparkSession, roots: Sequence[str] | str, glob: str):
    roots = [roots] if isinstance(roots, str) else list(roots)
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
    return reader, roots


def with_file_identity(df: DataFrame) -> DataFrame:
    """Role, project, session and agent of a transcript file from its path; other files go."""
    path = F.col("path")
    is_agent = path.rlike(AGENT_PATTERN)
    name = F.element_at(F.split(path, "/"), -1)
    is_main = ~is_agent & ~path.contains("/subagents/") & ~name.startswith("agent_") & ~name.startswith("agent-")

    def pick(group: int) -> Column:
        return F.when(is_agent, F.regexp_extract(path, AGENT_PATTERN, group)).otherwise(
            F.regexp_extract(path, MAIN_PATTERN, group)
        )

    return df.filter(is_agent | is_main).select(
        "*",
        F.when(is_agent, "subagent").otherwise("main").alias("file_role"),
        pick(1).alias("project_key"),
        pick(2).alias("session_id"),
        F.when(is_agent, F.regexp_extract(path, AGENT_PATTERN, 3)).otherwise("").alias("agent_id"),
    )


def number_lines(df: DataFrame) -> DataFrame:
    """Dense 0-based line numbers per file.

    Rows of a split have ids in a row, so a number is the row's id, less the first id of its split, plus the lines of the splits
    before it. Only one row a split is looked at in order; the lines themselves are neither sorted nor put in a window, and move
    only where there are more splits than a broadcast should hold.
    """
    placed = df.withColumn("__id", F.monotonically_increasing_id())
    splits = stage(placed.groupBy("path", "block_start").agg(F.min("__id").alias("__first"), F.count(F.lit(1)).alias("__n")))
    earlier = Window.partitionBy("path").orderBy("block_start").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("__n").over(earlier), F.lit(0)) - F.col("__first")
    shifts = splits.select("path", "block_start", shift.alias("__shift"))
    shifts = F.broadcast(shifts) if splits.count() <= BROADCAST_SPLITS else shifts.hint("shuffle_hash")
    line_no = (F.col("__id") + F.col("__shift")).cast("bigint").alias("line_no")
    return placed.join(shifts, ["path", "block_start"]).select(*[c for c in df.columns if c != "block_start"], line_no)


def scan_transcripts(spark: SparkSession, roots: Sequence[str] | str) -> DataFrame:
    """All lines of main and sub-agent transcripts below the roots, with file identity and line_no."""
    reader, roots = _files(spark, roots, "*.jsonl")
    lines = reader.option("lineSep", "\n").text(roots).select(
        "value",
        local_path(F.col("_metadata.file_path")).alias("path"),
        F.col("_metadata.file_modification_time").alias("mtime"),
        F.col("_metadata.file_size").alias("file_size"),
        F.col("_metadata.file_block_start").alias("block_start"),
    )
    return number_lines(with_file_identity(lines))


def list_files(spark: SparkSession, roots: Sequence[str] | str, glob: str = "*.jsonl") -> DataFrame:
    """path, mtime and size of every transcript file, without reading the bodies."""
    reader, roots = _files(spark, roots, glob)
    listed = reader.format("binaryFile").load(roots)
    return with_file_identity(
        listed.select(
            local_path(F.col("path")).alias("path"),
            F.col("modificationTime").alias("mtime"),
            F.col("length").alias("file_size"),
        )
    )


def discover_project_dirs(files: DataFrame) -> DataFrame:
    """Distinct project directories of a file listing."""
    main = files.filter(F.col("file_role") == "main")
    return main.select(
        F.regexp_replace("path", r"/[^/]+$", "").alias("project_dir"), "project_key"
    ).distinct()


def main_lines(lines: DataFrame) -> DataFrame:
    return lines.filter(F.col("file_role") == "main")


def subagent_lines(lines: DataFrame) -> DataFrame:
    return lines.filter(F.col("file_role") == "subagent")


def session_by_id(sessions: DataFrame, session_id: str, dirs: Sequence[str] | None = None) -> DataFrame:
    """The row of one session id; the first project directory of ``dirs`` wins, then the path."""
    rank = F.lit(0)
    if dirs:
        rank = F.array_position(F.array(*[F.lit(d) for d in dirs]), F.regexp_replace("path", r"/[^/]+$", ""))
        rank = F.when(rank == 0, len(dirs) + 1).otherwise(rank)
    hit = sessions.filter(F.col("session_id") == session_id)
    return hit.withColumn("__dir", rank).orderBy("__dir", "path").limit(1).drop("__dir")
