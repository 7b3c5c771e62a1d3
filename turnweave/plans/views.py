"""Whole plans: from transcript lines to the tables of a session view and of the catalogue."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import catalogue, chain, chunks, classify, debug, messages, ongoing, subagents, teams
from ..operators.entries import by_file, plain_ids
from ..sources import sidecars as saved
from .runtime import stage


@dataclass
class SessionView:
    """Lazy tables of a session view; main and process rows are told apart by ``agent_id``.

    ``session_id`` is the key of ``entries.by_file``, project directory and session id, so that further joins keep sessions of one
    id in two projects apart; ``entries.plain_ids`` takes it apart.
    """

    entries: DataFrame
    msgs: DataFrame
    chunks: DataFrame
    items: DataFrame
    texts: DataFrame
    processes: DataFrame
    edges: DataFrame
    messages: DataFrame
    ongoing: DataFrame
    teams: DataFrame
    team_tasks: DataFrame
    team_members: DataFrame
    member_state: DataFrame


def live_messages(entries: DataFrame) -> DataFrame:
    """Classified messages of main sessions on their live chain, without repeated summaries."""
    main = entries.filter(F.col("agent_id") == "")
    return classify.classify(classify.dedup_summaries(chain.live_filter(main)))


def _keyed(df: DataFrame, ids: DataFrame) -> DataFrame:
    """A table with plain session ids by the key of the files that have them, in each project where none is named."""
    if "project_key" in df.columns:
        return by_file(df).drop("project_key")
    return by_file(df.join(ids, "session_id")).drop("project_key")


def session_view(
    entries: DataFrame,
    now: Column,
    *,
    sidecars: DataFrame | None = None,
    debug_entries: DataFrame | None = None,
    debug_more: DataFrame | None = None,
    outputs: DataFrame | None = None,
    since=None,
    before=None,
) -> SessionView:
    """All tables of the view of every session in ``entries``.

    Tables that several steps read are staged, so the plan of each step stays small. ``outputs``: saved tool and hook outputs
    (``sources.sidecars.read_outputs``), which replace the previews that name them.
    """
    ids = entries.select("project_key", "session_id").distinct()
    entries = by_file(entries)
    sidecars = None if sidecars is None else _keyed(sidecars, ids)
    whole = (lambda df: df) if outputs is None else (lambda df: saved.resolve_persisted(df, outputs))
    hooked = (lambda df: df) if outputs is None else (lambda df: saved.resolve_hook_output(df, outputs))

    msgs = stage(hooked(live_messages(entries)))
    if debug_entries is not None:
        msgs = debug.merge_hooks(msgs, _keyed(debug.debug_hooks(debug_entries, debug_more), ids))
    main_msgs = stage(chunks.assign_chunks(msgs))
    main_chunks = chunks.merge_chunks(main_msgs)
    main_items = stage(chunks.build_items(stage(whole(classify.explode_blocks(main_msgs)))))

    workers = subagents.team_workers(entries, main_items)
    proc_entries = subagents.process_entries(entries, stage(workers))
    proc_msgs = stage(chunks.assign_chunks(stage(hooked(classify.classify(proc_entries, subagents=True)))))
    proc_chunks = chunks.merge_chunks(proc_msgs)
    proc_items = stage(chunks.build_items(stage(whole(classify.explode_blocks(proc_msgs)))))
    procs = stage(subagents.subagent_profile(proc_entries, proc_msgs, proc_chunks, sidecars, workers))
    linked = stage(subagents.link_subagents(procs, main_items, proc_items, entries, proc_entries))
    main_chunks, main_items, linked = (stage(t) for t in subagents.inject_orphans(main_chunks, main_items, linked))
    if since is not None or before is not None:
        main_chunks = messages.time_filter(main_chunks, since, before)
        main_items = main_items.join(main_chunks.select(*chunks.CHUNK), chunks.CHUNK, "left_semi")

    proc_chunks = stage(proc_chunks)
    all_chunks = main_chunks.unionByName(proc_chunks)
    all_items = main_items.unionByName(proc_items)
    all_msgs = main_msgs.unionByName(proc_msgs)
    texts = chunks.chunk_texts(all_msgs)
    edges = subagents.agent_edges(all_items, linked)
    agents = ongoing.subagent_ongoing(proc_chunks, proc_items, proc_msgs, linked, now)
    files = entries.filter(F.col("agent_id") == "").groupBy("session_id").agg(F.max("mtime").alias("mtime"))
    team_rows = teams.teams(main_items)
    verdicts = ongoing.chunks_ongoing(proc_chunks, proc_items)
    return SessionView(
        entries=entries,
        msgs=all_msgs,
        chunks=all_chunks,
        items=all_items,
        texts=texts,
        processes=linked,
        edges=edges,
        messages=messages.to_messages(all_chunks, all_items, texts),
        ongoing=ongoing.session_ongoing(main_chunks, main_items, main_msgs, agents, files, now),
        teams=team_rows,
        team_tasks=teams.team_tasks(main_items, linked, proc_items),
        team_members=teams.team_members(main_items),
        member_state=teams.member_state(team_rows, linked, verdicts),
    )


def session_catalogue(
    entries: DataFrame,
    files: DataFrame,
    now: Column,
    *,
    registry: DataFrame | None = None,
    live_pids: DataFrame | None = None,
    verdicts: DataFrame | None = None,
) -> DataFrame:
    """Catalogue rows of every main file; two project directories with one session id are two rows.

    ``registry`` (``sources.sidecars.scan_registry``) adds names and, with the ``live_pids`` of the machine, live status;
    ``verdicts`` (path, ongoing) replace the catalogue's own view of what is ongoing.
    """
    out = plain_ids(catalogue.build_sessions(by_file(entries), by_file(files), now))
    if verdicts is not None:
        out = catalogue.override_ongoing(out, verdicts)
    if registry is not None:
        out = catalogue.join_names(out, registry)
        if live_pids is not None:
            out = catalogue.join_liveness(out, registry, live_pids, now)
    return out
