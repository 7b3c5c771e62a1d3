"""Classified messages to chunks and display items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import jsonx, text, tools
from ..plans.ordered import SEGMENT, first_k, ordered_scan, text_parts
from ..plans.runtime import stage
from .classify import BLOCK_STRIDE, USAGE, explode_blocks
from .entries import IDENTITY

# Fixed value: an item longer than this beside a running sub-agent shows the agent's time, not its own.
CONCURRENT_MS = 60_000
CHUNK = [*IDENTITY, "chunk_no"]


def millis_between(end: Column, start: Column) -> Column:
    """Whole milliseconds from start to end, cut towards zero."""
    us = F.unix_micros(end) - F.unix_micros(start)
    return (F.signum(us) * F.floor(F.abs(us) / 1000)).cast("bigint")


def assign_chunks(msgs: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Give each message its chunk: a run of ai, teammate and hook messages, or one other message.

    ``next_kind`` is the kind of the first message after the chunk.
    """
    is_run = F.col("kind").isin("ai", "teammate", "hook")
    shape = F.when(F.col("is_recap"), "recap").otherwise(F.col("kind"))
    flagged = ordered_scan(
        msgs.withColumn("chunk_type", F.when(is_run, "ai").otherwise(shape)),
        IDENTITY, "line_no", segment=segment, before={"__prev_run": is_run.cast("int")},
    )
    starts = ~(is_run & (F.coalesce(F.col("__prev_run"), F.lit(0)) == 1))
    numbered = ordered_scan(
        flagged.withColumn("__starts", starts), IDENTITY, "line_no", segment=segment,
        totals={"__chunks": F.col("__starts").cast("bigint")},
        after={"next_kind": F.when(F.col("__starts"), F.col("chunk_type"))},
    )
    return numbered.withColumn("chunk_no", F.col("__chunks") - 1).drop("__prev_run", "__starts", "__chunks")


def _team_task(v: Column) -> Column:
    return jsonx.is_object(v) & jsonx.has_key(v, "$.name")


def _events(blocks: DataFrame) -> tuple[Column, Column]:
    bt = F.col("block_type")
    return (bt == "tool_use") & ~F.col("is_meta"), (bt == "tool_result") & F.col("rule").isin("assistant", "meta")


def tool_pairs(blocks: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(chunk, ord, ts, event, is_agent, before, after): calls (event 1) and results (0) with their neighbours of the same tool id.

    ``before`` is the event before in the chunk, ``after`` the event, place and time of the one behind. No body takes part.
    """
    is_call, is_result = _events(blocks)
    agent = F.col("tool_name").isin("Task", "Agent") if "tool_name" in blocks.columns else F.lit(False)
    rows = blocks.select(
        *CHUNK, "ord", "ts", F.when(is_call, 1).when(is_result, 0).alias("event"), (is_call & agent).alias("is_agent"), F.col("tool_id").alias("__id")
    ).filter("event IS NOT NULL")
    return ordered_scan(
        rows, [*CHUNK, "__id"], "ord", segment=segment * BLOCK_STRIDE,
        before={"before": F.col("event")}, after={"after": F.struct("event", "ord", "ts")},
    ).drop("__id")


def pair_results(blocks: DataFrame, segment: int = SEGMENT, pairs: DataFrame | None = None) -> DataFrame:
    """Add ``answer`` to calls (the result that resolves them) and ``is_matched`` to results.

    Inside a chunk a result resolves the event just before it with the same tool id if that is a call. Events are paired by place
    alone; what a result says is fetched by one join.
    """
    c = F.col
    pairs = tool_pairs(blocks, segment) if pairs is None else pairs
    is_call, is_result = _events(blocks)
    met = pairs.select(*CHUNK, "ord", "before", c("after.event").alias("__next"))
    found = pairs.filter("event = 1 AND after.event = 0").select(*CHUNK, c("after.ord").alias("ord"), c("ord").alias("__call"))
    said = F.struct(
        F.lit(0).alias("event"), c("result_text").alias("text"), c("result_json").alias("json"), c("result_error").alias("error"),
        c("block_advisor_model").alias("advisor"), c("ts").alias("ts"),
    )
    replies = blocks.filter(is_result).join(found, [*CHUNK, "ord"]).select(*CHUNK, c("__call").alias("ord"), said.alias("answer"))
    paired = blocks.join(met, [*CHUNK, "ord"], "left").join(replies, [*CHUNK, "ord"], "left")
    return paired.select(
        *[c(n) for n in blocks.columns],
        is_call.alias("is_call"),
        is_result.alias("is_result"),
        "answer",
        (is_result & (F.coalesce("before", F.lit(0)) == 1)).alias("is_matched"),
        (is_call & c("__next").isNull()).alias("is_pending"),
    )


def build_items(blocks: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Display items of the blocks of chunked messages (blocks carry ``chunk_no``)."""
    c = F.col
    pairs = stage(tool_pairs(blocks, segment))
    p = pair_results(blocks, segment, pairs).withColumn("__args", F.when(c("is_call"), tools.tool_args(c("tool_input"))))
    bt = c("block_type")
    agent_call = c("is_call") & c("tool_name").isin("Task", "Agent")
    item_type = (
        F.when(c("is_meta") & (bt == "teammate"), "TeammateMessage")
        .when(c("is_meta") & (bt == "hook_event"), "HookEvent")
        .when(c("is_result") & ~c("is_matched"), "Output")
        .when(~c("is_meta") & (bt == "thinking") & (c("text") != ""), "Thinking")
        .when(~c("is_meta") & (bt == "text"), "Output")
        .when(agent_call, "Subagent")
        .when(c("is_call"), "ToolCall")
    )
    v, is_agent, hook = c("tool_input"), c("item_type") == "Subagent", c("item_type") == "HookEvent"
    call, mate = c("is_call"), c("item_type") == "TeammateMessage"
    described = F.when(jsonx.get_str(v, "$.description") != "", jsonx.get_str(v, "$.description")).otherwise(
        text.truncate(jsonx.get_str(v, "$.prompt"), 80)
    )
    answer = c("answer")
    duration = F.coalesce(F.when(answer.isNotNull(), millis_between(answer["ts"], c("ts"))), F.lit(0))
    answered_by = F.nullif(answer["advisor"], F.lit(""))
    pending_orphan = c("is_pending") & (c("next_kind") == "user")
    items = p.withColumn("item_type", item_type).filter(c("item_type").isNotNull()).select(
        *CHUNK,
        "ord",
        "line_no",
        "ts",
        "item_type",
        F.when(c("is_result"), c("result_text")).when(call | hook, "").otherwise(c("text")).alias("text"),
        # agent calls keep their name, other calls show the MCP server
        F.when(is_agent, c("tool_name")).when(call, tools.mcp_display(c("tool_name"))).otherwise("").alias("tool_name"),
        F.when(call, c("tool_name")).otherwise("").alias("raw_tool_name"),
        F.when(call, c("tool_id")).otherwise("").alias("tool_id"),
        v.alias("tool_input"),
        F.when(call, tools.tool_summary(c("tool_name"), v, c("__args"))).otherwise("").alias("tool_summary"),
        F.when(call, tools.tool_category(c("tool_name"))).otherwise("Other").alias("tool_category"),
        F.coalesce(answer["text"], F.lit("")).alias("tool_result"),
        answer["json"].alias("tool_result_json"),
        F.coalesce(answer["error"], F.lit(False)).alias("tool_error"),
        duration.alias("duration_ms"),
        F.when(is_agent, jsonx.get_str(v, "$.subagent_type")).otherwise("").alias("subagent_type"),
        F.when(is_agent, described).otherwise("").alias("subagent_desc"),
        F.when(is_agent, jsonx.get_str(v, "$.name")).otherwise("").alias("team_member_name"),
        (call & _team_task(v)).alias("is_team_task"),
        F.when(mate, c("teammate_id")).otherwise("").alias("teammate_id"),
        F.when(mate, c("teammate_color")).otherwise("").alias("teammate_color"),
        F.when(hook, c("hook_event")).otherwise("").alias("hook_event"),
        F.when(hook, c("hook_name")).otherwise("").alias("hook_name"),
        F.when(hook, c("hook_command")).otherwise("").alias("hook_command"),
        F.when(hook, c("hook_metadata")).alias("hook_metadata"),
        F.when(hook, c("source_agent_name")).otherwise("").alias("hook_source_agent_name"),
        F.when(hook, c("requesting_agent_uuid")).otherwise("").alias("hook_requesting_agent_uuid"),
        F.when(call & ~is_agent, F.coalesce(answered_by, c("block_advisor_model")))
        .when(is_agent, F.coalesce(answered_by, F.lit("")))
        .otherwise("")
        .alias("advisor_model"),
        F.coalesce(pending_orphan, F.lit(False)).alias("is_orphan"),
        (c("is_pending") & ~F.coalesce(pending_orphan, F.lit(False))).alias("is_deferred"),
    )
    return suppress_inflated(items, agent_times(pairs))


def agent_times(pairs: DataFrame) -> DataFrame:
    """Chunks in which a sub-agent call took time, from the pairs of ``tool_pairs``."""
    c = F.col
    # a call without an answer counts as zero
    ms = F.when(c("after.event") == 0, F.coalesce(millis_between(c("after.ts"), c("ts")), F.lit(0))).otherwise(0)
    took = pairs.filter("is_agent").groupBy(*CHUNK).agg(F.max(ms).alias("__longest"))
    return took.filter(c("__longest") != 0).select(*CHUNK, F.lit(True).alias("__timed"))


def suppress_inflated(items: DataFrame, timed: DataFrame) -> DataFrame:
    """Zero the long durations of other items in chunks where a sub-agent ran."""
    shown = F.col("__timed") & ~F.col("item_type").isin("Subagent", "TeammateMessage") & (F.col("duration_ms") > CONCURRENT_MS)
    return (
        items.join(timed, CHUNK, "left")
        .withColumn("duration_ms", F.when(shown, F.lit(0).cast("bigint")).otherwise(F.col("duration_ms")))
        .drop("__timed")
    )


def number_items(items: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Add ``item_no``, the 0-based position of an item in its chunk."""
    counted = ordered_scan(
        items, CHUNK, "ord", segment=segment * BLOCK_STRIDE, totals={"__n": F.lit(1).cast("bigint")}
    )
    return counted.withColumn("item_no", F.col("__n") - 1).drop("__n")


def merge_chunks(chunked: DataFrame) -> DataFrame:
    """One row per chunk: times, model, stop reason, counts and the usage snapshot.

    The text of a chunk is in ``chunk_texts``.
    """
    c = F.col
    own = (c("kind") == "ai") & ~c("is_meta")
    total = c("input_tokens") + c("output_tokens") + c("cache_read_tokens") + c("cache_creation_tokens")
    last_usage = F.max_by(F.struct(*USAGE), F.when(own & (total > 0), c("line_no")))
    grouped = chunked.groupBy(*CHUNK).agg(
        F.first("chunk_type").alias("chunk_type"),
        F.min("line_no").alias("first_line"),
        F.max("line_no").alias("last_line"),
        F.min_by("ts", "line_no").alias("ts"),
        F.max_by("ts", "line_no").alias("__end"),
        F.coalesce(F.min_by("model", F.when(own & (c("model") != ""), c("line_no"))), F.lit("")).alias("model"),
        F.coalesce(F.max_by("stop_reason", F.when(own & (c("stop_reason") != ""), c("line_no"))), F.lit("")).alias("stop_reason"),
        F.sum("thinking_count").alias("thinking_count"),
        F.sum("tool_call_count").alias("tool_call_count"),
        F.count(F.lit(1)).alias("message_count"),
        F.max("is_error").alias("is_error"),
        last_usage.alias("__usage"),
    )
    return grouped.select(
        *CHUNK,
        "chunk_type",
        "first_line",
        "last_line",
        "ts",
        F.when(c("chunk_type") == "ai", F.coalesce(millis_between(c("__end"), c("ts")), F.lit(0))).otherwise(0).alias("duration_ms"),
        "model",
        "stop_reason",
        "thinking_count",
        "tool_call_count",
        "message_count",
        "is_error",
        *[F.coalesce(c("__usage")[u], F.lit(0)).alias(u) for u in USAGE],
    )


def chunk_texts(chunked: DataFrame, part_bytes: int | None = None, segment: int = SEGMENT) -> DataFrame:
    """Text of each chunk: (…, chunk_no, part_no, text), one part unless it is very large."""
    spoken = chunked.filter((F.col("text") != "") & ~F.col("kind").isin("teammate", "hook"))
    extra = {} if part_bytes is None else {"part_bytes": part_bytes}
    return text_parts(spoken, CHUNK, "line_no", "text", segment=segment, **extra)


def build_chunks(msgs: DataFrame, segment: int = SEGMENT) -> tuple[DataFrame, DataFrame]:
    """(chunks, items) of classified messages."""
    chunked = assign_chunks(msgs, segment)
    return merge_chunks(chunked), build_items(explode_blocks(chunked), segment)


def last_output(items: DataFrame) -> DataFrame:
    """Last output of each chunk: text, else tool result, else its first five calls."""
    c = F.col
    call = c("item_type").isin("ToolCall", "Subagent")
    out = F.max_by("text", F.when((c("item_type") == "Output") & (c("text") != ""), c("ord")))
    res = F.max_by(
        F.struct("tool_name", "tool_result", "tool_error"), F.when(call & (c("tool_result") != ""), c("ord"))
    )
    ends = items.groupBy(*CHUNK).agg(out.alias("t"), res.alias("r"))
    calls = (
        first_k(items.filter(call).select(*CHUNK, "ord", "tool_name", "tool_summary"), CHUNK, "ord", 5)
        .groupBy(*CHUNK)
        .agg(F.array_sort(F.collect_list(F.struct("ord", F.col("tool_name").alias("name"), F.col("tool_summary").alias("summary")))).alias("calls"))
    )
    listed = F.transform("calls", lambda x: F.struct(x["name"].alias("name"), x["summary"].alias("summary")))
    kind = F.when(c("t").isNotNull(), "Text").when(c("r").isNotNull(), "ToolResult").when(c("calls").isNotNull(), "ToolCalls")
    result = F.when(kind == "ToolResult", c("r"))
    return (
        ends.join(calls, CHUNK, "left")
        .filter(kind.isNotNull())
        .select(
            *CHUNK,
            kind.alias("output_type"),
            F.coalesce("t", F.lit("")).alias("text"),
            F.coalesce(result["tool_name"], F.lit("")).alias("tool_name"),
            F.coalesce(result["tool_result"], F.lit("")).alias("tool_result"),
            F.coalesce(result["tool_error"], F.lit(False)).alias("is_error"),
            F.when(kind == "ToolCalls", listed).alias("tool_calls"),
        )
    )


def last_permission_mode(msgs: DataFrame) -> DataFrame:
    """Last non-empty permission mode of the user messages of a session."""
    mode = F.max_by("permission_mode", F.when((F.col("kind") == "user") & (F.col("permission_mode") != ""), F.col("line_no")))
    return msgs.groupBy(*IDENTITY).agg(F.coalesce(mode, F.lit("")).alias("permission_mode"))
