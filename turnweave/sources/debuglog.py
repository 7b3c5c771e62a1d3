"""Debug log files as a table of numbered lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .transcripts import local_path, number_lines


def scan_debug_logs(spark: SparkSession, roots: Sequence[str] | str) -> DataFrame:
    """(session_id, line_no, value) of <session>.txt files."""
    roots = [roots] if isinstance(roots, str) else list(roots)
    lines = spark.read.option("pathGlobFilter", "*.txt").option("lineSep", "\n").text(roots).select(
        "value",
        local_path(F.col("_metadata.file_path")).alias("path"),
        F.col("_metadata.file_block_start").alias("block_start"),
    )
    numbered = number_lines(lines)
    return numbered.select(F.regexp_extract("path", r"([^/]+)\.txt$", 1).alias("session_id"), "line_no", "value")
