"""Transcript lines to typed entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import jsonx, tokens

# JSON shape of one transcript line. Free parts stay VARIANT; unknown fields are ignored.
LINE_SCHEMA = (
    "type string, uuid string, parentUuid string, logicalParentUuid string, leafUuid string, "
    "timestamp string, requestId string, isSidechain boolean, isMeta boolean, isCompactSummary boolean, "
    "cwd string, gitBranch string, permissionMode string, subtype string, content variant, summary string, "
    "teamName string, agentName string, sourceToolUseID string, parentToolUseID string, "
    "toolUseResult variant, forkedFrom variant, forkedSessionId string, hookEvent string, hookName string, "
    "hookCount bigint, hookInfos variant, hookSpecificOutput variant, attachment variant, data variant, "
    "reason string, toolName string, directory string, sourceAgentName string, requestingAgentUuid string, "
    "message struct<role string, content variant, model string, stop_reason string, "
    "usage variant>, __bad string"
)
USAGE_SCHEMA = (
    "struct<input_tokens bigint, output_tokens bigint, cache_read_input_tokens bigint, "
    "cache_creation_input_tokens bigint, cache_creation struct<input_tokens bigint>, "
    "iterations array<struct<type string, model string>>>"
)

IDENTITY = ["session_id", "agent_id"]
KEY = [*IDENTITY, "line_no"]


def by_file(df: DataFrame) -> DataFrame:
    """Make ``session_id`` the key of a session file: its project directory and its id.

    Two project directories may hold the same session id. All operators tell sessions apart by ``session_id``, so whole plans
    run on this key and give the plain columns back with ``plain_ids``.
    """
    return df.withColumn("session_id", F.concat("project_key", F.lit("/"), "session_id"))


def plain_ids(df: DataFrame) -> DataFrame:
    """Take the key of ``by_file`` apart again. Directory and file names hold no slash."""
    cut = F.instr("session_id", "/")
    parts = {"project_key": F.expr("left(session_id, instr(session_id, '/') - 1)"), "session_id": F.substring(F.col("session_id"), cut + 1, F.length("session_id"))}
    first = [] if "project_key" in df.columns else [parts["project_key"].alias("project_key")]
    return df.select(*first, *[parts[n].alias(n) if n in parts else F.col(n) for n in df.columns])


def repair_surrogates(c: Column) -> Column:
    """Lone UTF-16 surrogate escapes become the replacement character; valid pairs stay."""
    high, low = r"\\u[dD][89abAB][0-9a-fA-F]{2}", r"\\u[dD][c-fC-F][0-9a-fA-F]{2}"
    fixed = F.regexp_replace(c, rf"{high}(?!{low})", r"\\uFFFD")
    fixed = F.regexp_replace(fixed, rf"(?<!{high}){low}", r"\\uFFFD")
    return F.when(c.rlike(r"\\u[dD][89a-fA-F]"), fixed).otherwise(c)


def parse_ts(c: Column) -> Column:
    """RFC 3339 or naive UTC time; NULL for anything else."""
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}"), c.try_cast("timestamp"))


def parse_entries(lines: DataFrame) -> DataFrame:
    """Typed entries of all valid JSON lines.

    ``is_entry`` marks lines that count as transcript entries: a type, a uuid or leafUuid, and no
    known field of a wrong type. The catalogue also reads the others.
    """
    spare = [c for c in lines.columns if c != "value"]
    parsed = lines.select(
        *spare,
        F.from_json(
            repair_surrogates(F.col("value")), LINE_SCHEMA, {"columnNameOfCorruptRecord": "__bad"}
        ).alias("e"),
    )
    text = lambda name: F.coalesce(F.col(f"e.{name}"), F.lit(""))
    flag = lambda name: F.coalesce(F.col(f"e.{name}"), F.lit(False))
    number = lambda name: F.coalesce(F.col(f"__usage.{name}"), F.lit(0))
    usable = F.col("e.__bad").isNull() | F.col("e.type").isNotNull() | F.col("e.uuid").isNotNull()
    parsed = parsed.filter(usable).withColumn("__usage", F.try_variant_get("e.message.usage", "$", USAGE_SCHEMA))
    typed = parsed.select(
        *spare,
        text("type").alias("type"),
        text("uuid").alias("uuid"),
        text("parentUuid").alias("parent_uuid"),
        text("logicalParentUuid").alias("logical_parent_uuid"),
        text("leafUuid").alias("leaf_uuid"),
        F.col("e.timestamp").isNotNull().alias("has_ts"),
        parse_ts(F.col("e.timestamp")).alias("ts"),
        text("requestId").alias("request_id"),
        flag("isSidechain").alias("is_sidechain"),
        flag("isMeta").alias("is_meta"),
        flag("isCompactSummary").alias("is_compact_summary"),
        text("cwd").alias("cwd"),
        text("gitBranch").alias("git_branch"),
        text("permissionMode").alias("permission_mode"),
        text("subtype").alias("subtype"),
        F.col("e.content").alias("top_content"),
        text("summary").alias("summary"),
        text("teamName").alias("team_name"),
        text("agentName").alias("agent_name"),
        text("sourceToolUseID").alias("source_tool_use_id"),
        text("parentToolUseID").alias("parent_tool_use_id"),
        F.col("e.toolUseResult").alias("tool_use_result"),
        F.col("e.forkedFrom").isNotNull().alias("is_inherited"),
        text("forkedSessionId").alias("forked_session_id"),
        text("hookEvent").alias("hook_event"),
        text("hookName").alias("hook_name"),
        F.coalesce(F.col("e.hookCount"), F.lit(0)).alias("hook_count"),
        F.col("e.hookInfos").alias("hook_infos"),
        F.col("e.hookSpecificOutput").alias("hook_specific_output"),
        F.col("e.attachment").alias("attachment"),
        F.col("e.data").alias("data"),
        text("reason").alias("reason"),
        text("toolName").alias("denied_tool"),
        text("directory").alias("directory"),
        text("sourceAgentName").alias("source_agent_name"),
        text("requestingAgentUuid").alias("requesting_agent_uuid"),
        F.coalesce(F.col("e.message.role"), F.lit("")).alias("role"),
        F.coalesce(F.col("e.message.model"), F.lit("")).alias("model"),
        F.coalesce(F.col("e.message.stop_reason"), F.lit("")).alias("stop_reason"),
        F.col("e.message.content").alias("content"),
        # an explicit null also counts as present: cut streams write it
        F.col("e.message.usage").isNotNull().alias("has_usage"),
        number("input_tokens").alias("input_tokens"),
        number("output_tokens").alias("output_tokens"),
        number("cache_read_input_tokens").alias("cache_read_tokens"),
        tokens.effective_cache_creation(
            F.col("__usage.cache_creation_input_tokens"), F.col("__usage.cache_creation.input_tokens")
        ).alias("cache_creation_tokens"),
        F.coalesce(tokens.advisor_model(F.col("__usage.iterations")), F.lit("")).alias("advisor_model"),
        F.col("e.__bad").isNull().alias("__clean"),
    )
    return typed.withColumns(
        {
            "is_entry": F.col("__clean")
            & (F.col("type") != "")
            & ((F.col("uuid") != "") | (F.col("leaf_uuid") != "")),
            "content_kind": jsonx.kind_of(F.col("content")),
            "blocks": jsonx.block_array(F.col("content")),
            "text": jsonx.extract_text(
                jsonx.content_string(F.col("content")), jsonx.block_array(F.col("content"))
            ),
        }
    ).drop("__clean")


def dedup_lines(entries: DataFrame) -> DataFrame:
    """First occurrence of each uuid: for landings that replay lines."""
    first = entries.filter(F.col("uuid") != "").groupBy(*IDENTITY, "uuid").agg(F.min("line_no").alias("line_no"))
    kept = entries.filter(F.col("uuid") != "").join(first, [*KEY, "uuid"], "left_semi")
    return kept.unionByName(entries.filter(F.col("uuid") == ""))
