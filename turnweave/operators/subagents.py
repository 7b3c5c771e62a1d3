"""Sub-agent and team processes: profiles, links to the calls that started them, nesting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import jsonx, text
from ..plans.ordered import ordered_scan, range_rank
from ..plans.runtime import stage
from .chunks import CHUNK, millis_between
from .classify import BLOCK_STRIDE, SYNTHETIC, USAGE
from .entries import IDENTITY

SID = "session_id"
TEAM_PREFIX = "team:"
# Synthetic items stand behind the blocks of the last line of their chunk.
ORPHAN_OFFSET = BLOCK_STRIDE // 2


def rank_processes(procs: DataFrame, keys: list[str], name: str) -> DataFrame:
    """1-based position in process order: sub-agents by start, then team processes by start."""
    keyed = procs.withColumn("start_key", F.coalesce(F.unix_micros("start_time"), F.lit(0)))
    return range_rank(keyed, keys, ["is_team", "start_key", "agent_id"], name).drop("start_key")


def warmup_agents(entries: DataFrame) -> DataFrame:
    """Sub-agents whose first user line is the warm-up prompt."""
    first = F.min_by(F.coalesce(jsonx.content_string(F.col("content")), F.lit("")), "line_no")
    users = entries.filter((F.col("agent_id") != "") & (F.col("type") == "user"))
    return users.groupBy(*IDENTITY).agg(first.alias("p")).filter("p = 'Warmup'").select(*IDENTITY)


def team_workers(entries: DataFrame, items: DataFrame) -> DataFrame:
    """(session_id, worker_session, team_name, agent_name): sessions of named team members.

    A worker is another main file of the project whose first non-empty agent name, with its team
    name, was given in a named agent call of the lead.
    """
    c = F.col
    main = entries.filter(c("agent_id") == "")
    identity = (
        main.filter(c("agent_name") != "")
        .groupBy("project_key", SID)
        .agg(F.min_by(F.struct("team_name", "agent_name"), "line_no").alias("i"))
        .select("project_key", c(SID).alias("worker_session"), "i.team_name", "i.agent_name")
    )
    projects = main.select(SID, "project_key").distinct()
    wanted = (
        items.filter((c("agent_id") == "") & (c("item_type") == "Subagent") & c("is_team_task"))
        .select(
            SID,
            jsonx.get_str(c("tool_input"), "$.team_name").alias("team_name"),
            jsonx.get_str(c("tool_input"), "$.name").alias("agent_name"),
        )
        .filter(c("agent_name") != "")
        .distinct()
        .join(projects, SID)
    )
    return (
        wanted.join(identity, ["project_key", "team_name", "agent_name"])
        .filter(c(SID) != c("worker_session"))
        .select(SID, "worker_session", "team_name", "agent_name")
    )


def process_entries(entries: DataFrame, workers: DataFrame | None = None) -> DataFrame:
    """Entries of all processes, keyed by the lead session and the process.

    Team workers come in under ``team:<worker session>``; warm-up agents go.
    """
    c = F.col
    own = entries.filter(c("agent_id") != "").join(warmup_agents(entries), IDENTITY, "left_anti")
    if workers is None:
        return own
    link = workers.select(c(SID).alias("__lead"), c("worker_session").alias(SID))
    team = (
        entries.filter(c("agent_id") == "")
        .join(link, SID)
        .withColumns({"agent_id": F.concat(F.lit(TEAM_PREFIX), c(SID)), SID: c("__lead")})
        .drop("__lead")
    )
    return own.unionByName(team.select(*own.columns))


def subagent_profile(
    entries: DataFrame, msgs: DataFrame, chunks: DataFrame,
    sidecars: DataFrame | None = None, workers: DataFrame | None = None,
) -> DataFrame:
    """One row per process that has chunks: id, times, usage, prompt, end marker, team data.

    All inputs are those of processes only. Prompt and times come from entries that were not
    inherited, else from all chunks.
    """
    c = F.col
    line = c("line_no")
    entry = c("is_entry")
    head = F.min_by(jsonx.content_string(c("content")), F.when(entry & (c("type") == "user") & (c("content_kind") == "string"), line))
    marks = entries.groupBy(*IDENTITY).agg(
        F.max(entry & (c("type") == "assistant") & (c("model") == SYNTHETIC)).alias("has_end_marker"),
        head.alias("head"),
        F.max("mtime").alias("mtime"),
        F.max("path").alias("path"),
    )
    own = ~c("is_inherited")
    is_user = (c("kind") == "user") & (c("text") != "")
    spans = msgs.groupBy(*IDENTITY).agg(
        F.min(F.when(own, c("ts"))).alias("own_start"),
        F.max(F.when(own, c("ts"))).alias("own_end"),
        F.min_by("text", F.when(own & is_user, line)).alias("own_prompt"),
        F.min_by("text", F.when(is_user, line)).alias("any_prompt"),
    )
    used = c("input_tokens") + c("output_tokens") + c("cache_read_tokens") + c("cache_creation_tokens") > 0
    whole = chunks.groupBy(*IDENTITY).agg(
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.max_by(F.struct(*USAGE), F.when((c("chunk_type") == "ai") & used, c("chunk_no"))).alias("u"),
    )
    out = whole.join(marks, IDENTITY).join(spans, IDENTITY, "left")
    if sidecars is not None:
        out = out.join(sidecars.select(*IDENTITY, "agent_type", "skill_name"), IDENTITY, "left")
    else:
        out = out.withColumns({"agent_type": F.lit(None).cast("string"), "skill_name": F.lit(None).cast("string")})
    is_team = c("agent_id").startswith(TEAM_PREFIX)
    if workers is not None:
        names = workers.select(
            SID,
            F.concat(F.lit(TEAM_PREFIX), c("worker_session")).alias("agent_id"),
            F.concat("agent_name", F.lit("@"), "team_name").alias("worker_id"),
        )
        out = out.join(names, IDENTITY, "left")
    else:
        out = out.withColumn("worker_id", F.lit(None).cast("string"))
    start, end = F.coalesce("own_start", "first_ts"), F.coalesce("own_end", "last_ts")
    blank = F.lit("")
    return out.select(
        *IDENTITY,
        is_team.alias("is_team"),
        F.coalesce("worker_id", "agent_id").alias("proc_id"),
        "path",
        "mtime",
        start.alias("start_time"),
        end.alias("end_time"),
        F.greatest(F.coalesce(millis_between(end, start), F.lit(0)), F.lit(0)).alias("duration_ms"),
        *[F.coalesce(c("u")[u], F.lit(0)).alias(u) for u in USAGE],
        F.coalesce("own_prompt", "any_prompt", blank).alias("prompt"),
        c("has_end_marker"),
        F.when(is_team, "").otherwise(F.coalesce(text.teammate_summary(c("head")), blank)).alias("team_summary"),
        F.coalesce(text.teammate_color(c("head")), blank).alias("teammate_color"),
        F.coalesce("agent_type", blank).alias("subagent_type"),
        F.coalesce("skill_name", blank).alias("description"),
    )


def agent_links(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((session_id, agent, tool_id), (session_id, tool_id, color)) told by tool results of main files."""
    c = F.col
    v = c("tool_use_result")
    agent = F.when(jsonx.has_key(v, "$.agentId"), jsonx.get_str(v, "$.agentId")).otherwise(jsonx.get_str(v, "$.agent_id"))
    answered = F.get(
        F.filter("blocks", lambda b: (b["type"] == "tool_result") & (F.coalesce(b["tool_use_id"], F.lit("")) != "")), 0
    )["tool_use_id"]
    tool = F.when(c("source_tool_use_id") != "", c("source_tool_use_id")).otherwise(F.coalesce(answered, F.lit("")))
    told = (
        entries.filter((c("agent_id") == "") & c("is_entry") & jsonx.is_object(v))
        .select(SID, "line_no", agent.alias("agent"), tool.alias("tool_id"), jsonx.get_str(v, "$.color").alias("color"))
        .filter((c("agent") != "") & (c("tool_id") != ""))
    )
    links = told.groupBy(SID, "agent").agg(F.max_by("tool_id", "line_no").alias("tool_id"))
    colors = told.filter(c("color") != "").groupBy(SID, "tool_id").agg(F.max_by("color", "line_no").alias("color"))
    return links, colors


def skill_links(process_lines: DataFrame, procs: DataFrame) -> DataFrame:
    """(session_id, agent, tool_id) told by skill progress lines of process files; the first counts."""
    c = F.col
    told = process_lines.filter(jsonx.get_str(c("data"), "$.type") == "skill_progress").select(
        *IDENTITY,
        "line_no",
        jsonx.get_str(c("data"), "$.agentId").alias("agent"),
        c("parent_tool_use_id").alias("tool_id"),
    ).filter((c("agent") != "") & (c("tool_id") != ""))
    order = procs.select(*IDENTITY, "is_team", F.coalesce("start_time", F.timestamp_seconds(F.lit(0))).alias("start_time"))
    first = F.min_by("tool_id", F.struct("is_team", "start_time", "agent_id", "line_no"))
    return told.join(order, IDENTITY).groupBy(SID, "agent").agg(first.alias("tool_id"))


def _task_items(items: DataFrame, linked_tools: DataFrame) -> DataFrame:
    """Agent calls, and other calls that some link names."""
    c = F.col
    wanted = ["agent_id", "ord", "item_type", "tool_id", "subagent_desc", "subagent_type", "tool_summary", "is_team_task"]
    v = c("tool_input")
    cols = [SID, *wanted, jsonx.get_str(v, "$.team_name").alias("team_name"), jsonx.get_str(v, "$.name").alias("agent_name")]
    agents = items.filter(c("item_type") == "Subagent").select(*cols)
    others = items.filter(c("item_type") == "ToolCall").join(linked_tools, [SID, "tool_id"], "left_semi").select(*cols)
    return agents.unionByName(others)


def _rank_items(tasks: DataFrame, keys: list[str], name: str) -> DataFrame:
    return ordered_scan(tasks, keys, "ord", segment=BLOCK_STRIDE << 16, totals={name: F.lit(1).cast("bigint")})


def link_subagents(
    procs: DataFrame, main_items: DataFrame, process_items: DataFrame, entries: DataFrame, process_lines: DataFrame
) -> DataFrame:
    """Processes with ``parent_task_id``, description, type, colour and final ``proc_id``.

    Links by result or skill progress come first, then team summaries, then position; what a process
    lacks is filled from the calls inside other processes.
    """
    c = F.col
    told, colors = agent_links(entries)
    skill = skill_links(process_lines, procs).join(told, [SID, "agent"], "left_anti")
    links = stage(told.unionByName(skill))
    linked_tools = links.select(SID, "tool_id").distinct()
    tasks = stage(_task_items(main_items.filter(c("agent_id") == ""), linked_tools))
    fields = ["tool_id", "subagent_desc", "subagent_type", "is_team_task", "team_name", "agent_name"]
    by_tool = tasks.groupBy(SID, "tool_id").agg(F.max_by(F.struct(*fields[1:]), "ord").alias("task"))

    # 1: by link
    named = procs.join(links.select(SID, c("agent").alias("proc_id"), c("tool_id").alias("link")), [SID, "proc_id"], "left")
    hit = by_tool.select(SID, c("tool_id").alias("link"), c("task").alias("linked"))
    base = stage(named.join(hit, [SID, "link"], "left"))
    used = base.filter(c("linked").isNotNull()).select(SID, c("link").alias("tool_id")).distinct()
    free_tasks = tasks.join(used, [SID, "tool_id"], "left_anti")
    free = base.filter(c("link").isNull())

    # 2: team members by summary, the i-th call of a summary gets the i-th process
    summarised = free.filter(c("team_summary") != "").select(*IDENTITY, "is_team", "start_time", "team_summary")
    ranked = rank_processes(summarised, [SID, "team_summary"], "i").select(*IDENTITY, "team_summary", "i")
    calls = _rank_items(free_tasks.filter("is_team_task").withColumn("team_summary", c("subagent_desc")), [SID, "team_summary"], "i")
    team = ranked.join(calls.drop("agent_id"), [SID, "team_summary", "i"]).select(*IDENTITY, F.struct(*fields).alias("p"))
    team = stage(team)

    # 3: the i-th process left over gets the i-th other call
    rest = free.join(team, IDENTITY, "left_anti").select(*IDENTITY, "is_team", "start_time")
    spare = rank_processes(rest, [SID], "i").select(*IDENTITY, "i")
    others = _rank_items(free_tasks.filter(~c("is_team_task")), [SID], "i")
    placed = spare.join(others.drop("agent_id"), [SID, "i"]).select(*IDENTITY, F.struct(*fields).alias("p"))

    pick = base.join(team.unionByName(placed), IDENTITY, "left")
    parent = F.coalesce("link", c("p")["tool_id"], F.lit(""))
    found = c("linked").isNotNull() | c("p").isNotNull()
    linked = stage(pick).withColumns(
        {
            "parent_task_id": parent,
            "description": F.when(found, F.coalesce(c("linked")["subagent_desc"], c("p")["subagent_desc"])).otherwise(c("description")),
            "subagent_type": F.when(found, F.coalesce(c("linked")["subagent_type"], c("p")["subagent_type"])).otherwise(c("subagent_type")),
        }
    )

    # 4: calls made inside processes
    order = procs.select(*IDENTITY, "is_team", F.coalesce("start_time", F.timestamp_seconds(F.lit(0))).alias("start_time"))
    inner = _task_items(process_items, linked_tools).join(order, IDENTITY)
    nested = inner.groupBy(SID, c("tool_id").alias("parent_task_id")).agg(
        F.max_by(F.struct("subagent_desc", "tool_summary", "subagent_type"), F.struct("is_team", "start_time", "agent_id", "ord")).alias("n")
    )
    filled = stage(linked).join(nested, [SID, "parent_task_id"], "left")
    lacks = (c("description") == "") & c("n").isNotNull()
    detail = F.when(c("n")["subagent_desc"] != "", c("n")["subagent_desc"]).otherwise(c("n")["tool_summary"])
    kind = F.when(lacks & (c("subagent_type") == ""), c("n")["subagent_type"]).otherwise(c("subagent_type"))
    filled = filled.withColumns({"subagent_type": kind, "description": F.when(lacks, detail).otherwise(c("description"))})

    # colour and team id of the parent call
    parents = by_tool.select(SID, c("tool_id").alias("parent_task_id"), c("task").alias("pt"))
    tinted = filled.join(colors.withColumnRenamed("tool_id", "parent_task_id"), [SID, "parent_task_id"], "left").join(
        parents, [SID, "parent_task_id"], "left"
    )
    renamed = c("pt")["is_team_task"] & (c("pt")["team_name"] != "") & (c("pt")["agent_name"] != "")
    return tinted.withColumns(
        {
            "teammate_color": F.when(c("teammate_color") == "", F.coalesce("color", F.lit(""))).otherwise(c("teammate_color")),
            "proc_id": F.when(
                F.coalesce(renamed, F.lit(False)), F.concat(c("pt")["agent_name"], F.lit("@"), c("pt")["team_name"])
            ).otherwise(c("proc_id")),
        }
    ).select(*procs.columns, "parent_task_id")


def inject_orphans(chunks: DataFrame, items: DataFrame, procs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chunks, items, processes) with an item for each unlinked process in the last ai chunk.

    Sessions without an ai chunk get one.
    """
    c = F.col
    lost = rank_processes(procs.filter(c("parent_task_id") == ""), [SID], "__i").withColumn(
        "parent_task_id", F.concat(F.lit("orphan-"), "proc_id")
    )
    main = chunks.filter(c("agent_id") == "")
    ends = main.groupBy(SID).agg(
        F.max_by(F.struct("chunk_no", "last_line"), F.when(c("chunk_type") == "ai", c("chunk_no"))).alias("ai"),
        F.max("chunk_no").alias("top"),
        F.max("last_line").alias("top_line"),
    )
    begun = lost.groupBy(SID).agg(F.min("start_time").alias("begin"))
    homes = begun.join(ends, SID, "left").select(
        SID,
        "begin",
        c("ai").isNull().alias("is_new"),
        F.coalesce(c("ai")["chunk_no"], c("top") + 1, F.lit(0)).alias("chunk_no"),
        F.coalesce(c("ai")["last_line"], c("top_line") + 1, F.lit(0)).alias("home_line"),
    )
    blank = lambda t: F.lit("" if t == "string" else 0 if t in ("bigint", "int") else False if t == "boolean" else None).cast(t)
    new = homes.filter("is_new")
    made = {SID: c(SID), "agent_id": F.lit(""), "chunk_no": c("chunk_no"), "chunk_type": F.lit("ai"), "ts": c("begin"),
            "first_line": c("home_line"), "last_line": c("home_line")}
    new_chunks = new.select(*[made.get(n, blank(t)).alias(n) for n, t in chunks.dtypes])
    description = F.when(c("description") == "", text.orphan_description(c("prompt"))).otherwise(c("description"))
    given = {
        SID: c(SID), "agent_id": F.lit(""), "chunk_no": c("chunk_no"),
        "ord": c("home_line") * BLOCK_STRIDE + ORPHAN_OFFSET + c("__i"), "line_no": c("home_line"), "ts": c("start_time"),
        "item_type": F.lit("Subagent"), "tool_name": F.lit("Agent"), "raw_tool_name": F.lit("Agent"),
        "tool_id": c("parent_task_id"), "tool_category": F.lit("Other"), "subagent_type": c("subagent_type"),
        "subagent_desc": description, "is_orphan": F.lit(True), "duration_ms": c("duration_ms"),
    }
    made_items = lost.join(homes, SID).select(
        *[given.get(n, F.lit(None).cast(t) if n in ("tool_input", "tool_result_json", "hook_metadata") else blank(t)).alias(n) for n, t in items.dtypes]
    )
    linked = procs.filter(c("parent_task_id") != "").unionByName(lost.select(*procs.columns))
    return chunks.unionByName(new_chunks), items.unionByName(made_items), linked


def agent_edges(items: DataFrame, procs: DataFrame) -> DataFrame:
    """(session_id, parent_agent, tool_id, child_agent): which call started which process.

    Of several processes with the same parent call the last in process order counts.
    """
    c = F.col
    order = F.struct("is_team", F.coalesce("start_time", F.timestamp_seconds(F.lit(0))), "agent_id")
    child = procs.filter(c("parent_task_id") != "").groupBy(SID, c("parent_task_id").alias("tool_id")).agg(
        F.max_by("agent_id", order).alias("child_agent")
    )
    calls = items.filter(c("tool_id") != "").select(SID, c("agent_id").alias("parent_agent"), "tool_id").distinct()
    return calls.join(child, [SID, "tool_id"])
