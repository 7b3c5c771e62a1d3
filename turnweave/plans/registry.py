"""Queries over the given tables, each with its SQL twin where one exists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import display, text, tools
from ..operators import catalogue, chain, chunks, classify, debug, messages, ongoing, picker, projects, subagents, teams, usage
from ..operators.entries import parse_entries
from . import adapters, twins
from .runtime import stage

_STAGED: dict[tuple[str, str, str], DataFrame] = {}


def _staged(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Tables several queries read, written once per application and data directory."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STAGED:
        _STAGED[key] = stage(_BUILD[name](spark, sf_dir))
    return _STAGED[key]


_BUILD = {
    "entries": lambda s, d: parse_entries(adapters.event_lines(s, d)),
    "talk": lambda s, d: parse_entries(adapters.conversation_lines(s, d)),
    "chunked": lambda s, d: chunks.assign_chunks(classify.classify(_staged(s, d, "entries"))),
    "items": lambda s, d: chunks.build_items(classify.explode_blocks(_staged(s, d, "chunked"))),
    "talk_chunked": lambda s, d: chunks.assign_chunks(classify.classify(_staged(s, d, "talk"))),
    "talk_items": lambda s, d: chunks.build_items(classify.explode_blocks(_staged(s, d, "talk_chunked"))),
    "debug": lambda s, d: debug.parse_debug(adapters.debug_lines(s, d)),
}


_BUILD |= {
    "agent_entries": lambda s, d: parse_entries(adapters.agent_lines(s, d)),
    "lead_chunked": lambda s, d: chunks.assign_chunks(classify.classify(_main(_staged(s, d, "agent_entries")))),
    "lead_items": lambda s, d: chunks.build_items(classify.explode_blocks(_staged(s, d, "lead_chunked"))),
    "proc_chunked": lambda s, d: chunks.assign_chunks(classify.classify(_procs(s, d), subagents=True)),
    "proc_items": lambda s, d: chunks.build_items(classify.explode_blocks(_staged(s, d, "proc_chunked"))),
    "profiles": lambda s, d: subagents.subagent_profile(
        _procs(s, d), _staged(s, d, "proc_chunked"), chunks.merge_chunks(_staged(s, d, "proc_chunked"))
    ),
    "linked": lambda s, d: subagents.link_subagents(
        _staged(s, d, "profiles"), _staged(s, d, "lead_items"), _staged(s, d, "proc_items"), _staged(s, d, "agent_entries"), _procs(s, d)
    ),
}


def _main(entries: DataFrame) -> DataFrame:
    return entries.filter(F.col("agent_id") == "")


def _procs(s, d):
    return subagents.process_entries(_staged(s, d, "agent_entries"))


def _with_orphans(s, d):
    lead = chunks.merge_chunks(_staged(s, d, "lead_chunked"))
    return subagents.inject_orphans(lead, _staged(s, d, "lead_items"), _staged(s, d, "linked"))


def _edges(s, d):
    _, items, procs = _with_orphans(s, d)
    return subagents.agent_edges(items.unionByName(_staged(s, d, "proc_items")), procs)


def _agent_state(s, d):
    now = F.timestamp_seconds(F.lit(1767225630))
    c = _staged(s, d, "proc_chunked")
    return ongoing.subagent_ongoing(chunks.merge_chunks(c), _staged(s, d, "proc_items"), c, _staged(s, d, "profiles"), now)


def _on(name: str, fn):
    return lambda s, d: fn(_staged(s, d, name))


def _items(s, d):
    return _staged(s, d, "items").select(
        "session_id", "chunk_no", "ord", "item_type", "text", "tool_name", "tool_id", "tool_summary", "tool_category",
        "tool_result", "tool_error", "duration_ms", "subagent_desc", "is_orphan", "is_deferred",
    )


def _chunks(s, d):
    return chunks.merge_chunks(_staged(s, d, "chunked"))


def _messages(s, d):
    return messages.to_messages(_chunks(s, d), _staged(s, d, "items"), chunks.chunk_texts(_staged(s, d, "chunked")))


def _talk_messages(s, d):
    c = _staged(s, d, "talk_chunked")
    return messages.to_messages(chunks.merge_chunks(c), _staged(s, d, "talk_items"), chunks.chunk_texts(c))


def _sessions(s, d):
    return adapters.user_sessions(s, d)


NOW_SECONDS = 1706745600  # 2024-02-01
KEEP_MSG = [
    "session_id", "msg_no", "role", "model", "content", "thinking_count", "tool_call_count", "output_count", "tokens_raw",
    "context_tokens", "duration_ms", "is_error", "item_count", "agent_count",
]


def _docs(s, d, *cols):
    return s.read.parquet(f"{d}/documents.parquet").select(*cols)


def _churn(s, d):
    """Each document against the next one of its source, as an edit."""
    docs = _docs(s, d, "doc_id", "text")
    nxt = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("new"))
    return usage.line_churn(docs.withColumnRenamed("text", "old").join(nxt, "doc_id"), ["doc_id"])


def _pages(s, d):
    raw = s.read.parquet(f"{d}/pages.parquet")
    body = F.concat(F.lit("  <system-reminder>"), F.col("url"), F.lit("</system-reminder>"), F.col("html"), F.lit("<bash-input>ls</bash-input> \n"))
    return raw.select("page_id", text.sanitize_content(body).alias("shown"))


def _labels(s, d):
    c = F.col
    docs = _docs(s, d, "doc_id", "text", "source", "n_chars")
    path = F.concat(F.lit("/a/"), c("source"), F.lit("/x."), c("doc_id").cast("string"), F.lit("_y/"), c("source"), F.lit("-feat-z"))
    return docs.select(
        "doc_id",
        text.truncate(c("text"), 40).alias("short"),
        text.truncate_word(c("text"), 60).alias("worded"),
        tools.short_path_n(path, 2).alias("tail"),
        display.short_path(path).alias("last"),
        display.encode_path(path).alias("encoded"),
        display.is_long_path(path).alias("too_long"),
        display.trim_branch_suffix(F.concat(c("source"), F.lit("-feat-z")), F.lit("refs/heads/feat/Z")).alias("repo"),
    )


def _models(s, d):
    c = F.col
    rows = catalogue.token_rows(_staged(s, d, "entries"))
    return rows.groupBy("model").agg(F.count(F.lit(1)).alias("row_count")).select(
        "row_count", display.short_model(c("model")).alias("short"), "model"
    )


def _modes(s, d):
    c = F.col
    e = _staged(s, d, "entries").filter(c("permission_mode") != "")
    return e.groupBy("permission_mode").agg(F.count(F.lit(1)).alias("n")).select(
        "n", display.short_mode(c("permission_mode")).alias("label"), display.is_default_mode(c("permission_mode")).alias("is_default")
    )


QUERIES = {
    "s11_messages_json": lambda s, d: _talk_messages(s, d).select(
        "session_id", "msg_no", F.to_json(F.struct("role", "content")).alias("value")
    ),
    "c21_rule_counts": _on("entries", classify.noise_audit),
    "c22_blocks": lambda s, d: classify.explode_blocks(_staged(s, d, "chunked")).select(
        "session_id", "line_no", "block_no", "block_type", "text", "tool_id", "tool_name", "result_text", "result_error"
    ),
    "c01_messages_of_talk": _on("talk", lambda e: classify.classify(e).select("session_id", "line_no", "kind", "text")),
    "g01_live_tip": _on("entries", chain.live_tip),
    "g02_live_chain": _on("entries", lambda e: chain.live_chain(e)),
    "g04_live_filter": _on("entries", lambda e: chain.live_filter(e).select("session_id", "line_no", "type")),
    "k01_chunk_numbers": _on("chunked", lambda m: m.select("session_id", "line_no", "kind", "chunk_type", "chunk_no", "next_kind")),
    "k03_items": _items,
    "k06_chunks": lambda s, d: _chunks(s, d).drop("agent_id", "ts", "is_error"),
    "k06_chunk_texts": lambda s, d: chunks.chunk_texts(_staged(s, d, "chunked")).drop("agent_id"),
    "k10_last_output": _on("items", lambda i: chunks.last_output(i).select(
        "session_id", "chunk_no", "output_type", "text", "tool_name", "tool_result", "is_error", F.size("tool_calls").alias("calls")
    )),
    "k11_last_mode": _on("chunked", lambda m: chunks.last_permission_mode(m).drop("agent_id")),
    "a01_session_attributes": _on("entries", catalogue.session_attributes),
    "a02_session_dirs": _on("entries", catalogue.session_dirs),
    "a05_turn_counts": _on("entries", catalogue.turn_counts),
    "a05_turns_of_talk": _on("talk", catalogue.turn_counts),
    "a06_best_snapshots": _on("entries", lambda e: catalogue.best_snapshots(catalogue.token_rows(e))),
    "a08_token_totals": _on("entries", catalogue.token_totals),
    "a08_token_totals_live": _on("entries", lambda e: catalogue.token_totals(e, "live")),
    "a10_model_usage": _on("entries", catalogue.model_usage),
    "a13_first_messages": _on("entries", catalogue.first_messages),
    "a13_first_messages_of_talk": _on("talk", catalogue.first_messages),
    "a14_scan_ongoing": _on("entries", catalogue.scan_ongoing),
    "o01_chunks_ongoing": lambda s, d: ongoing.chunks_ongoing(_chunks(s, d), _staged(s, d, "items")).drop("agent_id"),
    "o02_activity_log": _on("items", lambda i: ongoing.activity_log(i).drop("agent_id")),
    "o03_pending_agents": _on("items", lambda i: ongoing.pending_agents(i).drop("agent_id")),
    "o04_pending_background": lambda s, d: ongoing.pending_background(_staged(s, d, "chunked"), _staged(s, d, "items")).drop("agent_id"),
    "m01_messages": lambda s, d: _messages(s, d).select(*KEEP_MSG),
    "m01_messages_of_talk": lambda s, d: _talk_messages(s, d).select(*KEEP_MSG),
    "m04_time_filter": lambda s, d: messages.time_filter(_chunks(s, d), "2024-01-05", "2024-01-09").select("session_id", "chunk_no", "chunk_type"),
    "m05_page": lambda s, d: messages.page(_messages(s, d), 2, 5).select("session_id", "msg_no", "role", "content"),
    "m06_message_at": lambda s, d: messages.message_at(_messages(s, d), 3).select("session_id", "msg_no", "role", "content"),
    "m08_roles": lambda s, d: messages.roles(_talk_messages(s, d)).select("session_id", "page_no", F.array_join("roles", ",").alias("roles")),
    "m08_context": lambda s, d: messages.latest_context_tokens(_messages(s, d)).drop("agent_id"),
    "m10_message_stats": lambda s, d: messages.message_stats(_messages(s, d)).drop("agent_id"),
    "m11_short_model": _models,
    "m12_short_mode": _modes,
    "r01_search": lambda s, d: picker.search_sessions(_sessions(s, d), "NAME 1").select("session_id", "name"),
    "r03_group_by_date": lambda s, d: picker.group_by_date(_sessions(s, d), F.timestamp_seconds(F.lit(NOW_SECONDS))).select("session_id", "date_group", "group_rank"),
    "r04_totals": lambda s, d: picker.catalogue_totals(_sessions(s, d)),
    "r05_titles": lambda s, d: picker.session_title(_sessions(s, d)).select("session_id", "title", "subtitle"),
    "r06_newest": lambda s, d: picker.sort_by_mtime(_sessions(s, d), 20).select("session_id", F.unix_micros("mtime").alias("mtime_us")),
    "j02_fork_root": lambda s, d: projects.fork_root(_sessions(s, d)),
    "r02_filter_project": lambda s, d: picker.filter_project(_sessions(s, d), projects.project_roots(_sessions(s, d)), "-w-app0").select("session_id", "path"),
    "j03_project_nodes": lambda s, d: projects.project_nodes(_sessions(s, d)),
    "j05_parent_by_prefix": lambda s, d: projects.parent_by_prefix(projects.project_nodes(_sessions(s, d))),
    "j06_project_tree": lambda s, d: projects.project_tree(stage(projects.project_nodes(_sessions(s, d)))),
    "j08_flat_items": lambda s, d: projects.flat_items(_sessions(s, d)).select(
        "key", "name", "count", "ongoing", "depth", "is_group", "has_children", "is_expanded"
    ),
    "l01_agent_links": _on("agent_entries", lambda e: subagents.agent_links(e)[0]),
    "l10_profiles": _on("profiles", lambda p: p.select(
        "session_id", "agent_id", "prompt", "has_end_marker", "team_summary", "teammate_color", "duration_ms"
    )),
    "l07_linked_agents": _on("linked", lambda p: p.select(
        "session_id", "agent_id", "proc_id", "parent_task_id", "description", "teammate_color"
    )),
    "l08_orphan_items": lambda s, d: _with_orphans(s, d)[1].filter("tool_id like 'orphan-%'").select(
        "session_id", "chunk_no", "tool_id", "subagent_desc", "item_type", "is_orphan", "duration_ms"
    ),
    "l12_agent_edges": _edges,
    "m03_attached_agents": lambda s, d: messages.attach_subagents(
        _with_orphans(s, d)[1], _edges(s, d), _with_orphans(s, d)[2],
        _agent_state(s, d).withColumnRenamed("ongoing", "ongoing_deep"), subagents.agent_links(_staged(s, d, "agent_entries"))[1],
    ).filter("proc_id <> ''").select("session_id", "tool_id", "proc_id", "subagent_prompt", "subagent_ongoing"),
    "o05_subagent_ongoing": _agent_state,
    "o06_ongoing_deep": lambda s, d: ongoing.subagent_ongoing_deep(_agent_state(s, d), _edges(s, d)),
    "t01_teams": _on("lead_items", teams.teams),
    "t03_team_tasks": lambda s, d: teams.team_tasks(_staged(s, d, "lead_items"), _staged(s, d, "linked"), _staged(s, d, "proc_items")),
    "t05_team_members": _on("lead_items", teams.team_members),
    "t06_member_state": lambda s, d: teams.member_state(
        teams.teams(_staged(s, d, "lead_items")), _staged(s, d, "linked"),
        ongoing.chunks_ongoing(chunks.merge_chunks(_staged(s, d, "proc_chunked")), _staged(s, d, "proc_items")),
    ),
    "t07_active_teams": _on("lead_items", lambda i: teams.active_teams(teams.teams(i)).select("session_id", "team_no", "name")),
    "x01_tool_usage": _on("items", usage.tool_usage),
    "x06_edit_churn": _on("items", usage.edit_churn),
    "x06_line_churn": _churn,
    "p08_sanitize": _pages,
    "x04_labels": _labels,
    "d01_debug_entries": _on("debug", lambda e: e.drop("ts")),
    "d03_filtered": _on("debug", lambda e: debug.filter_text(debug.filter_level(e, "WARN"), "FAILED").select("session_id", "entry_line", "level", "category", "message")),
    "d04_collapsed": _on("debug", lambda e: debug.collapse_duplicates(debug.filter_level(e, "WARN")).select("session_id", "entry_line", "message", "entry_count")),
    "d05_debug_hooks": _on("debug", lambda e: debug.debug_hooks(e).drop("ts")),
    "d06_merged_hooks": lambda s, d: debug.merge_hooks(
        classify.classify(_staged(s, d, "entries")), debug.debug_hooks(_staged(s, d, "debug"))
    ).select("session_id", "line_no", "kind", "hook_name"),
}

ORACLES = {name: sql for name, sql in twins.SQL.items() if name in QUERIES}
