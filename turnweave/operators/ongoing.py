"""Ongoing state from chunks and items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text, tools
from ..plans.runtime import durable
from .catalogue import is_fresh
from .entries import IDENTITY

SID = "session_id"


def activity_log(items: DataFrame) -> DataFrame:
    """(session_id, agent_id, ord, step, is_ending): one or two events per item that is no orphan."""
    c = F.col
    live = items.filter(~c("is_orphan"))
    # a plan exit or an approval is told by the name shown, as for any other call
    approves = (c("item_type") == "ToolCall") & tools.is_shutdown_approval(c("tool_name"), c("tool_input"))
    first = (
        F.when(c("item_type") == "Thinking", False)
        .when((c("item_type") == "Output") & (text.utrim(c("text")) != ""), True)
        .when(c("item_type") == "ToolCall", (c("tool_name") == "ExitPlanMode") | approves)
        .when(c("item_type") == "Subagent", False)
    )
    has_result = c("item_type").isin("ToolCall", "Subagent") & (c("tool_result") != "")
    base = live.select(*IDENTITY, "ord", "item_type", "tool_id", first.alias("first"), has_result.alias("answered"), approves.alias("approves"))
    acts = base.filter("first is not null").select(*IDENTITY, "ord", F.lit(0).alias("step"), c("first").alias("is_ending"))
    approved = base.filter("approves").groupBy(*IDENTITY, "tool_id").agg(F.min("ord").alias("__approved"))
    results = base.filter("answered").join(approved, [*IDENTITY, "tool_id"], "left").select(
        *IDENTITY, "ord", F.lit(1).alias("step"),
        F.coalesce((c("item_type") == "ToolCall") & (c("__approved") <= c("ord")), F.lit(False)).alias("is_ending"),
    )
    return acts.unionByName(results)


def pending_agents(items: DataFrame) -> DataFrame:
    """Whether any agent call still lacks a result."""
    c = F.col
    waits = (
        ~c("is_orphan")
        & (c("tool_result") == "")
        & ((c("item_type") == "Subagent") | ((c("item_type") == "ToolCall") & c("tool_name").isin("Task", "Agent")))
    )
    return items.groupBy(*IDENTITY).agg(F.max(waits).alias("pending_agents"))


def pending_background(chunked: DataFrame, items: DataFrame) -> DataFrame:
    """Whether more background commands were started than reported finished.

    ``chunked``: messages with their text (system chunks are single messages).
    """
    c = F.col
    started = items.filter((c("item_type") == "ToolCall") & c("tool_result").contains("running in background"))
    ended = chunked.filter(
        (c("kind") == "system")
        & c("text").contains("Background command")
        & (c("text").contains("completed") | c("text").contains("failed") | c("text").contains("was stopped"))
    )
    counts = started.select(*IDENTITY, F.lit(1).alias("n")).unionByName(ended.select(*IDENTITY, F.lit(-1).alias("n")))
    return counts.groupBy(*IDENTITY).agg((F.sum("n") > 0).alias("pending_background"))


def chunks_ongoing(chunks: DataFrame, items: DataFrame) -> DataFrame:
    """Verdict of the chunks of each session or agent."""
    c = F.col
    tail = chunks.groupBy(*IDENTITY).agg(
        F.max_by("chunk_type", "chunk_no").alias("last_type"),
        F.max_by("stop_reason", F.when(c("chunk_type") == "ai", c("chunk_no"))).alias("last_stop"),
        F.max((c("chunk_type") == "ai").cast("int")).alias("has_ai"),
    )
    pos = c("ord") * 2 + c("step")
    log = activity_log(items).groupBy(*IDENTITY).agg(
        F.max(F.when(c("is_ending"), pos)).alias("e"), F.max(F.when(~c("is_ending"), pos)).alias("a")
    )
    has_items = items.groupBy(*IDENTITY).agg(F.lit(True).alias("has_items"))
    joined = tail.join(log, IDENTITY, "left").join(has_items, IDENTITY, "left").join(pending_agents(items), IDENTITY, "left")
    active = c("a").isNotNull() & (c("e").isNull() | (c("a") > c("e")))
    verdict = (
        F.when(c("last_type") == "user", True)
        .when(c("has_items"), active | F.coalesce(c("pending_agents"), F.lit(False)))
        .otherwise((c("has_ai") == 1) & (c("last_stop") != "end_turn"))
    )
    return joined.select(*IDENTITY, F.coalesce(verdict, F.lit(False)).alias("chunks_ongoing"))


def subagent_ongoing(chunks: DataFrame, items: DataFrame, chunked: DataFrame, subagents: DataFrame, now: Column) -> DataFrame:
    """Verdict of each sub-agent: open work, no end marker and a fresh file."""
    c = F.col
    return (
        subagents.select(*IDENTITY, "has_end_marker", "mtime")
        .join(chunks_ongoing(chunks, items), IDENTITY, "left")
        .join(pending_background(chunked, items), IDENTITY, "left")
        .select(
            *IDENTITY,
            (
                ~c("has_end_marker")
                & (F.coalesce(c("chunks_ongoing"), F.lit(False)) | F.coalesce(c("pending_background"), F.lit(False)))
                & is_fresh(c("mtime"), now)
            ).alias("ongoing"),
        )
    )


def subagent_ongoing_deep(agents: DataFrame, edges: DataFrame) -> DataFrame:
    """An agent is ongoing when it or any descendant is.

    ``agents``: (session_id, agent_id, ongoing); ``edges``: (session_id, parent_agent, child_agent).
    The verdict moves up one level per round until nothing changes; cycles end by themselves. Only
    ongoing agents travel, and the rounds are bounded by the nesting depth.
    """
    c = F.col
    links = durable(
        edges.filter(c("parent_agent") != "").select(SID, c("child_agent").alias("agent_id"), "parent_agent").distinct()
    )
    known = durable(agents.filter("ongoing").select(*IDENTITY).distinct())
    front = known
    while not front.isEmpty():
        up = front.join(links, IDENTITY).select(SID, c("parent_agent").alias("agent_id")).distinct()
        front = durable(up.join(known, IDENTITY, "left_anti"))
        known = durable(known.unionByName(front))
    deep = known.withColumn("__deep", F.lit(True))
    return agents.join(deep, IDENTITY, "left").select(*IDENTITY, F.coalesce("__deep", F.lit(False)).alias("ongoing_deep"))


def session_ongoing(
    chunks: DataFrame, items: DataFrame, chunked: DataFrame, agents: DataFrame, files: DataFrame, now: Column
) -> DataFrame:
    """(session_id, ongoing) of main sessions.

    ``agents``: (session_id, agent_id, ongoing); ``files``: (session_id, mtime) of main files.
    """
    c = F.col
    main = lambda df: df.filter(c("agent_id") == "").drop("agent_id")
    any_agent = agents.filter(c("agent_id") != "").groupBy(SID).agg(F.max("ongoing").alias("__agents"))
    joined = (
        main(chunks_ongoing(chunks, items))
        .join(main(pending_background(chunked, items)), SID, "left")
        .join(any_agent, SID, "left")
        .join(files.select(SID, "mtime"), SID, "left")
    )
    yes = lambda n: F.coalesce(c(n), F.lit(False))
    fresh = F.coalesce(is_fresh(c("mtime"), now), F.lit(True))
    return joined.select(SID, ((yes("chunks_ongoing") & fresh) | yes("__agents") | yes("pending_background")).alias("ongoing"))
