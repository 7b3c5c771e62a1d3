"""Sidecar files of sub-agents, the session registry and saved outputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import jsonx, text
from .transcripts import local_path

SIDECAR = r"([^/]+)/([^/]+)/subagents/agent-([^/]+?)\.(meta|forked-skill)\.json$"


def _json_files(spark: SparkSession, roots: Sequence[str] | str, glob: str) -> DataFrame:
    """One row per small JSON file: path and its content as VARIANT (NULL when broken)."""
    roots = [roots] if isinstance(roots, str) else list(roots)
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
    files = reader.text(roots, wholetext=True)
    return files.select(local_path(F.col("_metadata.file_path")).alias("path"), F.try_parse_json("value").alias("v"))


def scan_sidecars(spark: SparkSession, roots: Sequence[str] | str) -> DataFrame:
    """(project_key, session_id, agent_id, agent_type, skill_name) of sub-agents with sidecars."""
    files = _json_files(spark, roots, "agent-*.json").filter(F.col("path").rlike(SIDECAR))
    v = F.col("v")
    part = F.regexp_extract("path", SIDECAR, 4)
    skill = F.coalesce(
        F.nullif(jsonx.get_str(v, "$.skillName"), F.lit("")), F.nullif(jsonx.get_str(v, "$.attributionName"), F.lit(""))
    )
    return files.groupBy(
        F.regexp_extract("path", SIDECAR, 1).alias("project_key"),
        F.regexp_extract("path", SIDECAR, 2).alias("session_id"),
        F.regexp_extract("path", SIDECAR, 3).alias("agent_id"),
    ).agg(
        F.max(F.when(part == "meta", jsonx.get_str(v, "$.agentType"))).alias("agent_type"),
        F.max(F.when(part == "forked-skill", skill)).alias("skill_name"),
    )


def scan_registry(spark: SparkSession, root: str) -> DataFrame:
    """Registry of running sessions, one row per readable file with a session id."""
    files = _json_files(spark, root, "*.json")
    v = F.col("v")
    whole = lambda key: F.when(
        F.schema_of_variant(jsonx.field(v, key)) == "BIGINT", F.try_variant_get(v, key, "bigint")
    )
    is_str = lambda key: F.schema_of_variant(jsonx.field(v, key)) == "STRING"
    return files.filter(F.coalesce(is_str("$.sessionId"), F.lit(False))).select(
        jsonx.get_str(v, "$.sessionId").alias("session_id"),
        F.nullif(text.utrim(jsonx.get_str(v, "$.name")), F.lit("")).alias("name"),
        F.when(is_str("$.status"), jsonx.get_str(v, "$.status")).alias("status"),
        whole("$.statusUpdatedAt").alias("status_updated_at"),
        whole("$.pid").alias("pid"),
        F.when(is_str("$.bridgeSessionId"), jsonx.get_str(v, "$.bridgeSessionId")).alias("bridge_session_id"),
        F.col("path").alias("registry_path"),
    )


def read_outputs(spark: SparkSession, roots: Sequence[str] | str, glob: str = "*.txt") -> DataFrame:
    """(output_path, output) of saved tool and hook outputs."""
    roots = [roots] if isinstance(roots, str) else list(roots)
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(roots, wholetext=True)
    return files.select(local_path(F.col("_metadata.file_path")).alias("output_path"), F.col("value").alias("output"))


def _with_output(df: DataFrame, outputs: DataFrame, path: Column) -> DataFrame:
    """Join saved outputs; rows that name no file do not take part in the shuffle key's group."""
    keyed = df.withColumn("__path", path)
    named = keyed.filter(F.col("__path").isNotNull()).join(outputs.withColumnRenamed("output_path", "__path"), "__path", "left")
    return named.unionByName(keyed.filter(F.col("__path").isNull()).withColumn("output", F.lit(None).cast("string")))


def resolve_persisted(blocks: DataFrame, outputs: DataFrame, column: str = "result_text") -> DataFrame:
    """Replace texts that point to a saved output by the file, where it exists."""
    out = _with_output(blocks, outputs, text.persisted_path(F.col(column)))
    return out.withColumn(column, F.coalesce("output", column)).select(*blocks.columns)


def resolve_hook_output(msgs: DataFrame, outputs: DataFrame) -> DataFrame:
    """Replace hook output previews by the saved file, where it exists."""
    out = _with_output(msgs, outputs, F.col("hook_output_path"))
    full = F.when(F.col("rule") == "hook_attachment", text.utrim(F.col("output"))).otherwise(F.col("output"))
    return out.withColumn("hook_command", F.coalesce(full, F.col("hook_command"))).select(*msgs.columns)
