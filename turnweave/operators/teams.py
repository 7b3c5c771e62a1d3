"""Team boards from the calls of a lead session and its workers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import jsonx
from ..plans.ordered import SEGMENT, ordered_scan
from .classify import BLOCK_STRIDE
from .entries import IDENTITY

SID = "session_id"
TEAM = [SID, "team_no"]


def _arg(name: str) -> Column:
    return jsonx.get_str(F.col("tool_input"), f"$.{name}")


def _events(items: DataFrame, segment: int) -> DataFrame:
    """Team calls of lead sessions with the team they act on (0 when none is active)."""
    c = F.col
    name = F.when((c("item_type") == "Subagent") & c("is_team_task"), "spawn").when(
        (c("item_type") == "ToolCall") & c("tool_name").isin("TeamCreate", "TeamDelete", "TaskCreate", "TaskUpdate"), c("tool_name")
    )
    acts = (
        items.filter(c("agent_id") == "")
        .select(
            SID, "ord", name.alias("act"), _arg("team_name").alias("team_name"), _arg("description").alias("description"),
            _arg("name").alias("member"), _arg("subject").alias("subject"), _arg("taskId").alias("task_id"),
            _arg("status").alias("status"), _arg("owner").alias("owner"),
        )
        .filter("act is not null")
    )
    op = F.when(c("act") == "TeamCreate", 1).when(c("act") == "TeamDelete", 0)
    scanned = ordered_scan(
        acts, [SID], "ord", segment=segment * BLOCK_STRIDE,
        before={"__op": op}, totals={"__teams": (c("act") == "TeamCreate").cast("bigint")},
    )
    active = (c("act") == "TeamCreate") | (F.coalesce(c("__op"), F.lit(0)) == 1)
    return scanned.withColumn("team_no", F.when(active, c("__teams")).otherwise(0)).drop("__op", "__teams")


def teams(items: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(session_id, team_no, name, description, deleted, created_ord)."""
    c = F.col
    ev = _events(items, segment).filter(c("team_no") > 0)
    made = ev.filter(c("act") == "TeamCreate").select(*TEAM, c("team_name").alias("name"), "description", c("ord").alias("created_ord"))
    gone = ev.filter(c("act") == "TeamDelete").select(*TEAM, F.lit(True).alias("d")).distinct()
    return made.join(gone, TEAM, "left").withColumn("deleted", F.coalesce("d", F.lit(False))).drop("d")


def active_teams(team_rows: DataFrame) -> DataFrame:
    return team_rows.filter(~F.col("deleted"))


def worker_names(procs: DataFrame) -> DataFrame:
    """(session_id, agent_id, member, team_name, …) of processes named member@team."""
    c = F.col
    at = F.instr("proc_id", "@")
    return procs.filter(at > 0).select(
        *IDENTITY,
        F.substring("proc_id", F.lit(1), at - 1).alias("member"),
        F.substring("proc_id", at + 1, F.length("proc_id")).alias("team_name"),
        "teammate_color",
        "is_team",
        F.coalesce("start_time", F.timestamp_seconds(F.lit(0))).alias("start_time"),
    ).filter(c("team_name") != "")


def _first_team(team_rows: DataFrame) -> DataFrame:
    """The first team of each name."""
    first = team_rows.groupBy(SID, F.col("name").alias("team_name")).agg(F.min_by(F.struct("team_no", "created_ord"), "team_no").alias("f"))
    return first.select(SID, "team_name", "f.team_no", "f.created_ord")


def team_tasks(items: DataFrame, procs: DataFrame, worker_items: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(session_id, team_no, task_id, subject, status, owner): tasks after all updates.

    Updates of the lead count from the creation of a task on; those of workers follow, in process
    order. A worker that names no owner owns a task nobody owned.
    """
    c = F.col
    ev = _events(items, segment).filter(c("team_no") > 0)
    made = ordered_scan(
        ev.filter(c("act") == "TaskCreate"), TEAM, "ord", segment=segment * BLOCK_STRIDE, totals={"n": F.lit(1).cast("bigint")}
    ).select(*TEAM, c("n").cast("string").alias("task_id"), c("ord").alias("created"), c("subject").alias("first_subject"))
    moment = lambda phase, team, start, agent: F.struct(
        F.lit(phase).alias("phase"), team.alias("is_team"), start.alias("start"), agent.alias("agent"), c("ord").alias("ord")
    )
    zero = F.timestamp_seconds(F.lit(0))
    lead = (
        ev.filter(c("act") == "TaskUpdate")
        .join(made.select(*TEAM, "task_id", "created"), [*TEAM, "task_id"])
        .filter(c("created") < c("ord"))
        .select(*TEAM, "task_id", "status", "owner", "subject", F.lit("").alias("member"),
                moment(0, F.lit(False), zero, F.lit("")).alias("at"))
    )
    named = worker_names(procs).join(_first_team(teams(items, segment)), [SID, "team_name"])
    worker = (
        worker_items.filter((c("item_type") == "ToolCall") & (c("tool_name") == "TaskUpdate"))
        .select(*IDENTITY, "ord", _arg("taskId").alias("task_id"), _arg("status").alias("status"), _arg("owner").alias("owner"), _arg("subject").alias("subject"))
        .filter(c("task_id") != "")
        .join(named, IDENTITY)
        .select(*TEAM, "task_id", "status", "owner", "subject", "member",
                moment(1, c("is_team"), c("start_time"), c("agent_id")).alias("at"))
    )
    last = lambda n: F.max_by(n, F.when(c(n) != "", c("at"))).alias(n)
    final = lead.unionByName(worker).groupBy(*TEAM, "task_id").agg(
        last("status"), last("owner"), last("subject"), F.min_by("member", F.when(c("member") != "", c("at"))).alias("taker")
    )
    return made.join(final, [*TEAM, "task_id"], "left").select(
        *TEAM,
        "task_id",
        F.coalesce("subject", "first_subject").alias("subject"),
        F.coalesce("status", F.lit("pending")).alias("status"),
        F.coalesce("owner", "taker", F.lit("")).alias("owner"),
    )


def team_members(items: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(session_id, team_no, member, first_ord): named members by first spawn."""
    c = F.col
    ev = _events(items, segment)
    spawns = ev.filter((c("act") == "spawn") & (c("team_name") != "") & (c("member") != "")).select(SID, "ord", "team_name", "member")
    return (
        spawns.join(_first_team(teams(items, segment)), [SID, "team_name"])
        .filter(c("created_ord") < c("ord"))
        .groupBy(*TEAM, "member")
        .agg(F.min("ord").alias("first_ord"))
    )


def member_state(team_rows: DataFrame, procs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(session_id, team_no, member, color, ongoing) of the workers of every team of that name.

    ``verdicts``: (session_id, agent_id, chunks_ongoing) of the processes.
    """
    c = F.col
    order = F.struct("is_team", "start_time", "agent_id")
    state = (
        worker_names(procs)
        .join(verdicts, IDENTITY, "left")
        .groupBy(SID, "team_name", "member")
        .agg(
            F.coalesce(F.max_by("teammate_color", F.when(c("teammate_color") != "", order)), F.lit("")).alias("color"),
            F.max(F.coalesce("chunks_ongoing", F.lit(False))).alias("ongoing"),
        )
    )
    return team_rows.select(*TEAM, c("name").alias("team_name")).join(state, [SID, "team_name"]).select(*TEAM, "member", "color", "ongoing")
