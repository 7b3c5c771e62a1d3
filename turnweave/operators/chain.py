"""Which entries lie on the live conversation chain of a session.

A session is a forest: every entry names its parent. The live chain runs from the live tip back to
the root. Nearly all entries name the entry just before them, so consecutive entries are contracted
into runs first. Only the few runs are walked: per session in one pass for sessions of a bounded
number of runs, and by pointer doubling over joins for larger ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ordered import SEGMENT, ordered_scan
from ..plans.runtime import durable
from .entries import KEY

RUNS_PER_TASK = 200_000
RUNS_PER_ROW = 64
RUN = ["run", "end_line", "side", "to_run", "to_line", "via_logical", "target"]
SID = "session_id"


def _main(entries: DataFrame) -> DataFrame:
    return entries.filter(F.col("is_entry") & (F.col("agent_id") == "")).select(
        SID, "line_no", "type", "uuid", "parent_uuid", "logical_parent_uuid", "leaf_uuid", "is_sidechain"
    )


def live_tip(entries: DataFrame) -> DataFrame:
    """(session_id, tip): the last leaf hint if it is a known childless entry, else the last
    childless entry that is not on a side chain. Sessions without a tip have no row."""
    e = _main(entries)
    parents = e.filter(F.col("parent_uuid") != "").select(SID, F.col("parent_uuid").alias("uuid")).distinct()
    childless = e.filter(F.col("uuid") != "").select(SID, "uuid", "line_no", "is_sidechain").join(
        parents, [SID, "uuid"], "left_anti"
    )
    hint = e.filter(F.col("leaf_uuid") != "").groupBy(SID).agg(F.max_by("leaf_uuid", "line_no").alias("hint"))
    hinted = childless.join(hint.withColumnRenamed("hint", "uuid"), [SID, "uuid"], "left_semi").select(
        SID, F.col("uuid").alias("hinted")
    ).distinct()
    last = childless.filter(~F.col("is_sidechain")).groupBy(SID).agg(F.max_by("uuid", "line_no").alias("last"))
    return (
        last.join(hinted, SID, "full")
        .select(SID, F.coalesce("hinted", "last").alias("tip"))
        .filter(F.col("tip").isNotNull())
    )


def _nodes(entries: DataFrame, segment: int) -> DataFrame:
    """One row per uuid (its last occurrence) with the run it belongs to."""
    e = _main(entries).filter(F.col("uuid") != "")
    nodes = e.groupBy(SID, "uuid").agg(
        F.max("line_no").alias("line_no"),
        F.max_by("is_sidechain", "line_no").alias("side"),
        F.max_by("parent_uuid", "line_no").alias("parent_uuid"),
        F.max_by("logical_parent_uuid", "line_no").alias("logical"),
    )
    linked = ordered_scan(
        nodes, [SID], "line_no", segment=segment,
        before={"prev_uuid": F.col("uuid"), "prev_side": F.col("side")},
    )
    follows = (
        (F.col("parent_uuid") != "")
        & (F.col("parent_uuid") == F.col("prev_uuid"))
        & (F.col("side") == F.col("prev_side"))
    )
    linked = linked.withColumn("is_head", ~F.coalesce(follows, F.lit(False)))
    placed = ordered_scan(
        linked, [SID], "line_no", segment=segment, before={"run": F.when(F.col("is_head"), F.col("line_no"))}
    )
    return placed.withColumn("run", F.when(F.col("is_head"), F.col("line_no")).otherwise(F.col("run")))


def _runs(nodes: DataFrame) -> DataFrame:
    """One row per run, with the run and line its first entry points to."""
    heads = nodes.filter("is_head").select(
        SID,
        "run",
        "side",
        F.when(F.col("parent_uuid") != "", F.col("parent_uuid")).otherwise(F.nullif("logical", F.lit(""))).alias("target"),
        ((F.col("parent_uuid") == "") & (F.col("logical") != "")).alias("via_logical"),
    )
    ends = nodes.groupBy(SID, "run").agg(F.max("line_no").alias("end_line"))
    targets = nodes.select(
        SID, F.col("uuid").alias("target"), F.col("run").alias("to_run"), F.col("line_no").alias("to_line")
    )
    return heads.join(ends, [SID, "run"]).join(targets, [SID, "target"], "left")


def _walk_runs(runs: list[tuple], run: int, line: int) -> tuple[dict[int, int], str | None]:
    """Live prefix of each run of one session, and the missing parent the chain ends at, if any.

    ``runs``: (run, end_line, side, to_run, to_line, via_logical, target) by run.
    """
    at = {r[0]: i for i, r in enumerate(runs)}
    upto: dict[int, int] = {}
    while True:
        known = upto.get(run, -1)
        if line <= known:
            return upto, None
        upto[run] = line
        i = at[run]
        _, _, _, to_run, to_line, via_logical, target = runs[i]
        if known >= 0 or target is None:
            return upto, None
        if to_run is None:
            return upto, target
        if via_logical and to_line <= upto.get(to_run, -1):
            j = i - 1
            while j >= 0 and (runs[j][2] or upto.get(runs[j][0], -1) >= runs[j][1]):
                j -= 1
            if j < 0:
                return upto, None
            to_run, to_line = runs[j][0], runs[j][1]
        run, line = to_run, to_line


def _live_rows(sid: str, upto: dict[int, int], gap: str | None) -> list[tuple]:
    rows = [(sid, r, u, None) for r, u in upto.items()]
    return rows + [(sid, None, None, gap)] if gap is not None else rows


def _live_frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[SID, "run", "upto", "gap"]).astype({"run": "Int64", "upto": "Int64"})


def _walk_session(pdf: pd.DataFrame) -> pd.DataFrame:
    """One session of a bounded number of runs."""
    pdf = pdf.sort_values("run")
    whole = lambda name: [None if pd.isna(x) else int(x) for x in pdf[name]]
    runs = list(zip(*(whole(n) if n in ("to_run", "to_line") else pdf[n].tolist() for n in RUN)))
    return _live_frame(_live_rows(pdf[SID].iloc[0], *_walk_runs(runs, pdf["tip_run"].iloc[0], pdf["tip_line"].iloc[0])))


def _walk_batch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Many small sessions at a time, each with all its runs in one row."""
    for pdf in batches:
        rows: list[tuple] = []
        for sid, run, line, runs in zip(pdf[SID], pdf["tip_run"], pdf["tip_line"], pdf["runs"]):
            rows += _live_rows(sid, *_walk_runs([tuple(r[n] for n in RUN) for r in runs], run, line))
        yield _live_frame(rows)


LIVE_SCHEMA = "session_id string, run bigint, upto bigint, gap string"


def _closure(edges: DataFrame, tips: DataFrame) -> DataFrame:
    """Runs reachable from the tips, by pointer doubling: ⌈log₂ path⌉ rounds of joins.

    ``line``/``depth``: where and how far from the tip a run is first entered; ``upto``: the highest
    entry.
    """
    jump = edges.filter(F.col("to_run").isNotNull()).select(SID, "run", "to_run", "to_line")
    path = tips.select(SID, "run", "line", F.lit(0).cast("bigint").alias("depth"), F.col("line").alias("upto"))
    step, size = 1, None
    while True:
        reached = path.join(jump, [SID, "run"]).select(
            SID,
            F.col("to_run").alias("run"),
            F.col("to_line").alias("line"),
            (F.col("depth") + step).alias("depth"),
            F.col("to_line").alias("upto"),
        )
        path = durable(
            path.unionByName(reached)
            .groupBy(SID, "run")
            .agg(F.min_by("line", "depth").alias("line"), F.min("depth").alias("depth"), F.max("upto").alias("upto"))
        )
        now = path.agg(F.count(F.lit(1)), F.sum("upto")).first()
        if now == size:
            return path
        size, step = now, step * 2
        nxt = jump.select(SID, F.col("run").alias("to_run"), F.col("to_run").alias("__r"), F.col("to_line").alias("__l"))
        jump = durable(
            jump.join(nxt, [SID, "to_run"]).select(SID, "run", F.col("__r").alias("to_run"), F.col("__l").alias("to_line"))
        )


def _walk_distributed(runs: DataFrame) -> DataFrame:
    """The walk of ``_walk`` for sessions with any number of runs.

    Each pass follows the chain from the current tip. A pass that ends at a logical parent already on
    the chain starts the next one at the nearest earlier run that is not wholly live.
    """
    runs = durable(runs)
    tips = runs.select(SID, F.col("tip_run").alias("run"), F.col("tip_line").alias("line")).distinct()
    marks = None
    while True:
        path = _closure(runs, tips)
        if marks is None:
            fresh = path
            merged = path.select(SID, "run", "upto")
            reach = path.select(SID, F.col("run").alias("to_run"), F.col("line").alias("seen"))
        else:
            fresh = path.join(marks, [SID, "run"], "left_anti")
            merged = path.select(SID, "run", "upto").unionByName(marks).groupBy(SID, "run").agg(F.max("upto").alias("upto"))
            reach = (
                marks.select(SID, F.col("run").alias("to_run"), F.col("upto").alias("seen"))
                .unionByName(fresh.select(SID, F.col("run").alias("to_run"), F.col("line").alias("seen")))
            )
        merged = durable(merged)
        last = fresh.groupBy(SID).agg(F.max_by("run", "depth").alias("run"))
        closing = (
            last.join(runs.filter("via_logical"), [SID, "run"])
            .join(reach, [SID, "to_run"])
            .filter(F.col("to_line") <= F.col("seen"))
            .select(SID, F.col("run").alias("stop_run"))
        )
        open_runs = runs.filter(~F.col("side")).join(merged, [SID, "run"], "left").filter(
            F.coalesce("upto", F.lit(-1)) < F.col("end_line")
        )
        tips = durable(
            open_runs.join(closing, SID)
            .filter(F.col("run") < F.col("stop_run"))
            .groupBy(SID)
            .agg(F.max("run").alias("run"), F.max_by("end_line", "run").alias("line"))
        )
        marks = merged
        if tips.isEmpty():
            break
    gaps = marks.join(runs, [SID, "run"]).filter(F.col("target").isNotNull() & F.col("to_run").isNull())
    return marks.select(SID, "run", "upto", F.lit(None).cast("string").alias("gap")).unionByName(
        gaps.select(SID, F.lit(None).cast("bigint").alias("run"), F.lit(None).cast("bigint").alias("upto"), F.col("target").alias("gap"))
    )


def live_chain(entries: DataFrame, *, runs_per_task: int = RUNS_PER_TASK, segment: int = SEGMENT) -> DataFrame:
    """(session_id, uuid) of the live chain, for sessions that have a tip."""
    # narrow and read several times below, so written once
    nodes = durable(_nodes(entries, segment).select(SID, "uuid", "line_no", "side", "parent_uuid", "logical", "run", "is_head"))
    runs = _runs(nodes)
    tips = live_tip(entries).join(
        nodes.select(SID, F.col("uuid").alias("tip"), F.col("run").alias("tip_run"), F.col("line_no").alias("tip_line")),
        [SID, "tip"],
    ).drop("tip")
    sized = tips.join(runs.groupBy(SID).agg(F.count(F.lit(1)).alias("n_runs")), SID)
    walked = durable(runs.join(sized, SID))
    fits = F.col("n_runs") <= runs_per_task
    small = (
        walked.filter(fits & (F.col("n_runs") <= RUNS_PER_ROW))
        .groupBy(SID, "tip_run", "tip_line")
        .agg(F.array_sort(F.collect_list(F.struct(*RUN))).alias("runs"))
        .mapInPandas(_walk_batch, LIVE_SCHEMA)
    )
    medium = walked.filter(fits & (F.col("n_runs") > RUNS_PER_ROW)).groupBy(SID).applyInPandas(_walk_session, LIVE_SCHEMA)
    small = small.unionByName(medium)
    large = walked.filter(F.col("n_runs") > runs_per_task)
    live = small if large.isEmpty() else small.unionByName(_walk_distributed(large.drop("n_runs")))
    inside = nodes.join(live.filter(F.col("run").isNotNull()), [SID, "run"]).filter(F.col("line_no") <= F.col("upto"))
    gaps = live.filter(F.col("gap").isNotNull()).select(SID, F.col("gap").alias("uuid"))
    return inside.select(SID, "uuid").unionByName(gaps)


def live_filter(entries: DataFrame, *, runs_per_task: int = RUNS_PER_TASK, segment: int = SEGMENT) -> DataFrame:
    """Drop main entries that are off the live chain.

    Side-chain entries, entries without uuid and attachments of a live entry stay, as do all entries
    of sessions without a tip. Only the keys of dropped rows are joined to the wide entries.
    """
    e = _main(entries).filter((F.col("uuid") != "") & ~F.col("is_sidechain"))
    live = live_chain(entries, runs_per_task=runs_per_task, segment=segment)
    with_tip = live_tip(entries).select(SID)
    off = e.join(with_tip, SID, "left_semi").join(live, [SID, "uuid"], "left_anti")
    hanging = (F.col("type") == "attachment") & (F.col("parent_uuid") != "")
    rescued = off.filter(hanging).join(
        live.withColumnRenamed("uuid", "parent_uuid"), [SID, "parent_uuid"], "left_semi"
    ).select(SID, "line_no")
    dropped = off.select(SID, "line_no").join(rescued, [SID, "line_no"], "left_anti")
    return entries.join(dropped.withColumn("agent_id", F.lit("")), KEY, "left_anti")
