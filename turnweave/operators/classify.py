"""Entries to classified messages and content blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import jsonx, text
from .entries import IDENTITY, KEY

# Entry types without displayable content.
NOISE_TYPES = [
    "system", "file-history-snapshot", "queue-operation", "progress", "fork-context-ref",
    "workflow-start", "workflow-progress", "workflow-complete", "workflow-cancelled", "workflow-error",
    "rewind-pointer", "last-prompt",
]
# Names of a denial as an entry of its own and inside a progress entry.
DENIAL_TYPES = [
    "auto-mode-denial", "auto_mode_denial", "automode-denial", "permission-denial", "permission_denial",
]
DENIAL_DATA_TYPES = [
    "auto_mode_denial", "auto-mode-denial", "automode_denial", "automode-denial",
    "permission_denial", "permission-denial",
]
SYNTHETIC = "<synthetic>"
BLOCK_STRIDE = 1 << 20

# What each rule yields; rules not listed drop the line.
RULE_KIND = {
    "denial_progress": "system", "hook_progress": "hook", "recap": "compact", "stop_summary": "hook",
    "hook_system": "hook", "hook_attachment": "hook", "summary": "compact", "stop_feedback": "hook",
    "teammate": "teammate", "command_output": "system", "bash_output": "system",
    "task_notification": "system", "tool_loaded": "system", "compact_summary": "compact", "user": "user",
    "assistant": "ai", "denial": "system", "meta": "ai",
}
USAGE = ["input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens"]


def has_user_content(content_kind: Column, txt: Column, blocks: Column) -> Column:
    shown = F.exists(
        blocks, lambda b: F.coalesce((b["type"] == "text") | jsonx.is_attachment_type(b["type"]), F.lit(False))
    )
    return F.coalesce(
        F.when(content_kind == "string", text.utrim(txt) != "").when(content_kind == "array", shown), F.lit(False)
    )


def is_user_noise(trimmed: Column, blocks: Column) -> Column:
    only = F.get(blocks, 0)
    lone_interrupt = (
        (F.size(blocks) == 1) & (only["type"] == "text") & F.coalesce(only["text"], F.lit("")).startswith(text.INTERRUPTED)
    )
    return (
        text.is_pure_tag(trimmed, text.CAVEAT_TAG)
        | text.is_pure_tag(trimmed, text.REMINDER_TAG)
        | trimmed.isin(
            text.STDOUT_TAG + text.STDOUT_TAG.replace("<", "</"), text.STDERR_TAG + text.STDERR_TAG.replace("<", "</")
        )
        | trimmed.startswith(text.INTERRUPTED)
        | F.coalesce(lone_interrupt, F.lit(False))
    )


def with_rule(entries: DataFrame) -> DataFrame:
    """The classification rule of each entry; the first match in this order counts."""
    c = F.col
    data_type, data_hook = jsonx.get_str(c("data"), "$.type"), jsonx.field(c("data"), "$.hookEvent")
    is_user, is_assistant = c("type") == "user", c("type") == "assistant"
    t = c("__trim")
    inner = text.teammate_content(t)
    excluded = text.starts(
        t, text.STDERR_TAG, text.STDOUT_TAG, text.CAVEAT_TAG, text.BASH_STDOUT_TAG, text.BASH_STDERR_TAG, text.TASK_TAG
    )
    matches = F.try_variant_get(c("tool_use_result"), "$.matches", "array<variant>")
    any_match = F.exists(matches, lambda m: F.schema_of_variant(m) == "STRING")
    yes = lambda cond: F.coalesce(cond, F.lit(False))
    rule = (
        F.when(c("is_sidechain"), "sidechain")
        .when((c("type") == "progress") & data_type.isin(DENIAL_DATA_TYPES), "denial_progress")
        .when((c("type") == "progress") & ((data_type == "hook_progress") | yes(data_hook.isNotNull())), "hook_progress")
        .when((c("type") == "system") & (c("subtype") == "away_summary"), "recap")
        .when((c("type") == "system") & (c("subtype") == "stop_hook_summary") & (c("hook_count") > 0), "stop_summary")
        .when((c("type") == "system") & ((c("subtype") == "hook_progress") | (c("hook_event") != "")), "hook_system")
        .when((c("type") == "attachment") & (jsonx.get_str(c("attachment"), "$.hookEvent") != ""), "hook_attachment")
        .when(c("type").isin(NOISE_TYPES), "noise_type")
        .when(c("type") == "summary", "summary")
        .when(is_assistant & (c("model") == SYNTHETIC), "synthetic")
        .when(is_user & is_user_noise(t, c("blocks")), "user_noise")
        .when(is_user & c("is_meta") & t.startswith(text.STOP_FEEDBACK), "stop_feedback")
        .when(is_user & c("is_meta"), "user_meta")
        .when(is_user & text.is_teammate(t) & text.is_protocol(inner), "teammate_protocol")
        .when(is_user & text.is_teammate(t), "teammate")
        .when(is_user & text.starts(t, text.STDOUT_TAG, text.STDERR_TAG), "command_output")
        .when(is_user & text.starts(t, text.BASH_STDOUT_TAG, text.BASH_STDERR_TAG), "bash_output")
        .when(is_user & text.starts(t, text.TASK_TAG), "task_notification")
        .when(is_user & (t == "Tool loaded.") & yes(any_match), "tool_loaded")
        .when(is_user & c("is_compact_summary"), "compact_summary")
        .when(is_user & ~excluded & has_user_content(c("content_kind"), c("text"), c("blocks")), "user")
        .when(
            is_assistant & (c("content_kind").isNull() | yes((c("content_kind") == "array") & (F.size("blocks") == 0))),
            "empty_assistant",
        )
        .when(is_assistant, "assistant")
        .when(c("type").isin(DENIAL_TYPES), "denial")
        .when(c("role") == "", "no_role")
        .otherwise("meta")
    )
    return entries.withColumn("__trim", text.utrim(F.col("text"))).withColumn("rule", rule)


def dedup_summaries(entries: DataFrame) -> DataFrame:
    """Keep the first summary of each (agent name, team name, text) in a file.

    Only the line numbers of repeats are joined back, so bodies are not sorted or grouped.
    """
    same = [*IDENTITY, "agent_name", "team_name", "summary"]
    summaries = entries.filter(F.col("type") == "summary").select(*same, "line_no")
    first = summaries.groupBy(*same).agg(F.min("line_no").alias("__first"))
    repeats = summaries.join(first, same).filter(F.col("line_no") > F.col("__first")).select(*KEY)
    return entries.join(repeats, KEY, "left_anti")


def hook_output(v: Column, path: str) -> tuple[Column, Column]:
    """(inline text, file path) of a hook output that is a string or a {path, preview} object."""
    inner = jsonx.field(v, path)
    plain = F.when(F.schema_of_variant(inner) == "STRING", F.try_variant_get(v, path, "string"))
    is_obj = jsonx.is_object(inner)
    inline = F.coalesce(plain, F.when(is_obj, jsonx.get_str(inner, "$.preview")), F.lit(""))
    return inline, F.when(is_obj, F.nullif(jsonx.get_str(inner, "$.path"), F.lit("")))


def classify(entries: DataFrame, *, subagents: bool = False) -> DataFrame:
    """Classified messages of the entries.

    One wide table with ``kind`` in user, ai, system, teammate, compact, hook. ``subagents`` clears the
    side-chain flag first, as for sub-agent files.
    """
    source = entries.filter(F.col("is_entry"))
    if subagents:
        source = source.withColumn(
            "is_sidechain", F.when(F.col("agent_id") != "", F.lit(False)).otherwise(F.col("is_sidechain"))
        )
    ruled = with_rule(source)
    c, t, raw = F.col, F.col("__trim"), F.col("text")
    r = c("rule")
    kind = F.lit(None).cast("string")
    for k in ("user", "ai", "system", "teammate", "compact", "hook"):
        kind = F.when(r.isin([n for n, v in RULE_KIND.items() if v == k]), k).otherwise(kind)
    matches = F.filter(
        F.try_variant_get(c("tool_use_result"), "$.matches", "array<variant>"),
        lambda m: F.schema_of_variant(m) == "STRING",
    )
    loaded = F.array_join(F.transform(matches, lambda m: F.try_variant_get(m, "$", "string")), ", ")
    msg_text = (
        F.when(r == "denial_progress", text.format_denial(jsonx.get_str(c("data"), "$.reason"), jsonx.get_str(c("data"), "$.toolName")))
        .when(r == "denial", text.format_denial(c("reason"), c("denied_tool")))
        .when(r == "recap", F.coalesce(jsonx.content_string(c("top_content")), F.lit("")))
        .when(r == "summary", c("summary"))
        .when(r == "command_output", text.extract_command_output(raw))
        .when(r == "bash_output", text.extract_bash_output(raw))
        .when(r == "task_notification", text.extract_task_notification(raw))
        .when(r == "tool_loaded", F.concat(F.lit("Loaded: "), loaded))
        .when(r == "teammate", text.sanitize_content(text.teammate_content(t)))
        .when(r.isin("compact_summary", "user", "assistant"), text.sanitize_content(raw))
        .when(r == "meta", raw)
        .otherwise("")
    )
    fb_name, fb_command = text.hook_feedback(t)
    pr_text, pr_path = hook_output(c("data"), "$.command")
    bl_text, bl_path = hook_output(c("attachment"), "$.blockingError.blockingError")
    er_text, er_path = hook_output(c("attachment"), "$.stderr")
    blocking = (text.utrim(bl_text) != "") | bl_path.isNotNull()
    at = r == "hook_attachment"
    pr = r == "hook_progress"
    hook_event = (
        F.when(pr, jsonx.get_str(c("data"), "$.hookEvent"))
        .when(r.isin("stop_summary", "stop_feedback"), "Stop")
        .when(r == "hook_system", c("hook_event"))
        .when(at, jsonx.get_str(c("attachment"), "$.hookEvent"))
        .otherwise("")
    )
    hook_name = (
        F.when(pr, jsonx.get_str(c("data"), "$.hookName"))
        .when(r == "stop_summary", jsonx.get_str(c("hook_infos"), "$[0].command"))
        .when(r == "stop_feedback", fb_name)
        .when(r == "hook_system", c("hook_name"))
        .when(at, jsonx.get_str(c("attachment"), "$.hookName"))
        .otherwise("")
    )
    hook_command = (
        F.when(pr, pr_text)
        .when(r == "stop_feedback", fb_command)
        .when(at, text.utrim(F.when(blocking, bl_text).otherwise(er_text)))
        .otherwise("")
    )
    hook_path = F.when(pr, pr_path).when(at, F.when(blocking, bl_path).otherwise(er_path))
    metadata = (
        F.when(pr, jsonx.field(c("data"), "$.hookSpecificOutput"))
        .when(r.isin("stop_summary", "hook_system"), c("hook_specific_output"))
        .when(at, c("attachment"))
    )
    attributed = r.isin("hook_progress", "hook_system")
    is_ai = r == "assistant"
    usage = [F.when(is_ai, c(u)).otherwise(0).alias(u) for u in USAGE]
    n_blocks = lambda cond: F.coalesce(F.size(F.filter("blocks", cond)), F.lit(0))
    named_call = lambda b: (
        b["type"].isin("tool_use", "server_tool_use")
        & (F.coalesce(b["id"], F.lit("")) != "")
        & (F.coalesce(b["name"], F.lit("")) != "")
    )
    file_columns = [n for n in ("project_key", "path", "mtime") if n in entries.columns]
    return ruled.filter(r.isin(list(RULE_KIND))).select(
        *KEY,
        *file_columns,
        kind.alias("kind"),
        r.alias("rule"),
        "ts",
        "is_inherited",
        msg_text.alias("text"),
        (
            F.when(r == "bash_output", text.bash_failed(raw))
            .when(r == "task_notification", text.task_failed(raw))
            .otherwise(F.lit(False))
        ).alias("is_error"),
        (r == "recap").alias("is_recap"),
        F.when(r == "user", c("permission_mode")).otherwise("").alias("permission_mode"),
        F.when(r == "teammate", text.teammate_id(t)).otherwise("").alias("teammate_id"),
        F.when(r == "teammate", text.teammate_color(t)).otherwise("").alias("teammate_color"),
        hook_event.alias("hook_event"),
        hook_name.alias("hook_name"),
        hook_command.alias("hook_command"),
        hook_path.alias("hook_output_path"),
        F.to_json(metadata).alias("hook_metadata"),
        F.when(attributed, c("source_agent_name"))
        .when(at, jsonx.get_str(c("attachment"), "$.sourceAgentName"))
        .otherwise("")
        .alias("source_agent_name"),
        F.when(attributed, c("requesting_agent_uuid"))
        .when(at, jsonx.get_str(c("attachment"), "$.requestingAgentUuid"))
        .otherwise("")
        .alias("requesting_agent_uuid"),
        F.when(is_ai, c("model")).otherwise("").alias("model"),
        F.when(is_ai, c("stop_reason")).otherwise("").alias("stop_reason"),
        F.when(is_ai, c("advisor_model")).otherwise("").alias("advisor_model"),
        (~is_ai).alias("is_meta"),
        F.when(is_ai, n_blocks(lambda b: b["type"] == "thinking")).otherwise(0).alias("thinking_count"),
        F.when(is_ai, n_blocks(named_call)).otherwise(0).alias("tool_call_count"),
        *usage,
        F.when(r.isin("assistant", "meta"), c("blocks")).alias("blocks"),
    )


def noise_audit(entries: DataFrame) -> DataFrame:
    """Number of entries per classification rule, and whether the rule drops them."""
    ruled = with_rule(entries.filter(F.col("is_entry")))
    return (
        ruled.groupBy("rule")
        .agg(F.count(F.lit(1)).alias("lines"))
        .withColumn("dropped", ~F.col("rule").isin(list(RULE_KIND)))
    )


def explode_blocks(msgs: DataFrame) -> DataFrame:
    """One row per content block, in order (``ord`` orders blocks over a whole session).

    Assistant messages give all their blocks; meta messages give their tool results, or one text
    block; teammate and hook messages give one block of their own kind.
    """
    c = F.col
    carried = [n for n in msgs.columns if n not in ("blocks", "text", "tool_id")]
    has_result = F.coalesce(F.exists("blocks", lambda b: b["type"] == "tool_result"), F.lit(False))
    listed = (c("rule") == "assistant") | ((c("rule") == "meta") & has_result)
    many = msgs.filter(listed).select(*carried, F.posexplode("blocks").alias("block_no", "b"))
    is_result = F.coalesce(c("b.type"), F.lit("")) == "tool_result"
    kept = many.filter((c("rule") == "assistant") | is_result)
    bt = F.coalesce(c("b.type"), F.lit(""))
    meta = c("rule") == "meta"
    is_call = bt.isin("tool_use", "server_tool_use")
    advisor = bt == "advisor_tool_result"
    result_text = jsonx.stringify_content(c("b.content"))
    body = F.when(meta, result_text).when(
        advisor, F.coalesce(jsonx.get_str(c("b.content"), "$.text"), F.lit(""))
    )
    exploded = kept.select(
        *carried,
        c("block_no").cast("bigint").alias("block_no"),
        F.when(is_call, "tool_use")
        .when(advisor, "tool_result")
        # a plain result inside an assistant message carries no id there
        .otherwise(bt)
        .alias("block_type"),
        F.coalesce(F.when(bt == "thinking", c("b.thinking")).otherwise(c("b.text")), F.lit("")).alias("text"),
        F.coalesce(
            F.when(is_call, c("b.id")).when(advisor | (meta & is_result), c("b.tool_use_id")), F.lit("")
        ).alias("tool_id"),
        F.when(is_call, F.coalesce(c("b.name"), F.lit(""))).otherwise("").alias("tool_name"),
        F.when(is_call, jsonx.normalize_tool_input(c("b.input"))).alias("tool_input"),
        F.coalesce(body, F.lit("")).alias("result_text"),
        F.when(meta & jsonx.kind_of(c("b.content")).isin("array", "object"), F.to_json(c("b.content"))).alias("result_json"),
        (meta & F.coalesce(c("b.is_error"), F.lit(False))).alias("result_error"),
        F.when(advisor | (c("b.name") == "advisor"), c("advisor_model")).otherwise("").alias("block_advisor_model"),
    )
    single = msgs.filter(c("kind").isin("teammate", "hook") | ((c("rule") == "meta") & ~has_result)).select(
        *carried,
        F.lit(0).cast("bigint").alias("block_no"),
        F.when(c("kind") == "teammate", "teammate").when(c("kind") == "hook", "hook_event").otherwise("text").alias("block_type"),
        F.when(c("kind") == "hook", c("hook_command")).otherwise(c("text")).alias("text"),
        F.lit("").alias("tool_id"),
        F.lit("").alias("tool_name"),
        F.lit(None).cast("variant").alias("tool_input"),
        F.lit("").alias("result_text"),
        F.lit(None).cast("string").alias("result_json"),
        F.lit(False).alias("result_error"),
        F.lit("").alias("block_advisor_model"),
    )
    return exploded.unionByName(single).withColumn("ord", c("line_no") * BLOCK_STRIDE + c("block_no"))
