"""Session catalogue: one summary row per session, by aggregation over entries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import jsonx, text, tokens, tools
from ..plans.ordered import SEGMENT, ordered_scan
from .chunks import millis_between
from .classify import BLOCK_STRIDE, SYNTHETIC, USAGE, has_user_content
from .entries import IDENTITY

SID = "session_id"
STALE_SECONDS = 60
PREVIEW_CHARS = 500
REJECTED = "User rejected tool use"


def main_entries(entries: DataFrame) -> DataFrame:
    return entries.filter(F.col("agent_id") == "")


def _own() -> Column:
    """Entries with a uuid that were not inherited from a forked session."""
    return (F.col("uuid") != "") & ~F.col("is_inherited")


def _added_dir() -> Column:
    return (F.col("hook_event") == "DirectoryAdded") | (jsonx.get_str(F.col("data"), "$.hookEvent") == "DirectoryAdded")


def attribute_marks(entries: DataFrame) -> DataFrame:
    """(session_id, …): the line and value of what ``session_attributes`` shows, last or first seen, and the number of lines."""
    c = F.col
    line = c("line_no")
    at = lambda value, cond, pick: pick(F.when(cond, F.struct(line.alias("line_no"), value.alias("v"))))
    last = lambda name, cond: at(c(name), cond & (c(name) != ""), F.max).alias(name)
    forks = (c("type") == "fork-context-ref") & (c("forked_session_id") != "")
    speaks = _own() & (c("type") == "assistant") & ~c("is_sidechain") & (c("model") != SYNTHETIC) & (c("model") != "")
    timed = c("has_ts") & ~c("is_inherited")
    return main_entries(entries).groupBy(SID).agg(
        last("cwd", ~_added_dir()),
        last("git_branch", F.lit(True)),
        last("permission_mode", F.lit(True)),
        at(c("forked_session_id"), forks, F.min).alias("forked_from_session_id"),
        at(c("model"), speaks, F.min).alias("model"),
        at(c("ts"), timed, F.min).alias("first_ts"),
        at(c("ts"), timed, F.max).alias("last_ts"),
        F.count(F.lit(1)).alias("line_count"),
    )


def shown_attributes() -> list[Column]:
    """The columns of ``session_attributes`` from its marks."""
    c = F.col
    text_of = lambda name, other="": F.coalesce(f"{name}.v", F.lit(other)).alias(name)
    span = F.coalesce(millis_between(c("last_ts.v"), c("first_ts.v")), F.lit(0)).alias("duration_ms")
    fork = c("forked_from_session_id.v").alias("forked_from_session_id")
    return [text_of("cwd"), text_of("git_branch"), text_of("permission_mode", "manual"), fork, text_of("model"), c("line_count"), span]


def session_attributes(entries: DataFrame) -> DataFrame:
    """Last cwd, branch and mode, fork parent, first model and own duration of each session."""
    return attribute_marks(entries).select(SID, *shown_attributes())


def seen_dirs(entries: DataFrame) -> DataFrame:
    """(session_id, dir, first_seen): distinct working and added directories with the place they first stand at."""
    c = F.col
    added = _added_dir()
    named = F.filter(
        F.array(
            F.struct(F.lit(0).alias("p"), c("cwd").alias("dir")),
            F.struct(F.lit(1).alias("p"), F.when(added, c("directory")).otherwise("").alias("dir")),
            F.struct(F.lit(2).alias("p"), F.when(added, jsonx.get_str(c("data"), "$.directory")).otherwise("").alias("dir")),
        ),
        lambda d: d["dir"] != "",
    )
    seen = main_entries(entries).select(SID, "line_no", F.explode(named).alias("d"))
    return seen.groupBy(SID, c("d.dir").alias("dir")).agg(F.min(c("line_no") * 4 + c("d.p")).alias("first_seen"))


def session_dirs(entries: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Distinct working and added directories of a session in first-seen order (``dir_no``)."""
    c = F.col
    first = seen_dirs(entries)
    ranked = ordered_scan(first, [SID], "first_seen", segment=segment * 4, totals={"__n": F.lit(1).cast("bigint")})
    return ranked.select(SID, (c("__n") - 1).alias("dir_no"), "dir")


def recap_marks(entries: DataFrame) -> DataFrame:
    """(session_id, mark): the last recap or user turn with its line; pushed channel events do not count."""
    c = F.col
    blocks = F.try_variant_get(c("top_content"), "$", "array<struct<text string>>")
    joined = F.array_join(F.array_compact(F.transform(blocks, lambda b: b["text"])), " ")
    recap = F.nullif(
        text.utrim(F.coalesce(jsonx.content_string(c("top_content")), F.when(jsonx.kind_of(c("top_content")) == "array", joined), F.lit(""))),
        F.lit(""),
    )
    is_recap = (c("type") == "system") & (c("subtype") == "away_summary") & recap.isNotNull()
    with_text = F.get(F.filter(F.coalesce("blocks", F.array().cast(jsonx.BLOCKS)), lambda b: b["text"].isNotNull()), 0)["text"]
    said = F.coalesce(jsonx.content_string(c("content")), with_text, F.lit(""))
    resumes = (c("type") == "user") & ~text.ltrim_ws(said).startswith("<channel")
    marks = main_entries(entries).filter(is_recap | resumes)
    return marks.groupBy(SID).agg(F.max(F.struct("line_no", F.when(is_recap, recap).alias("recap"))).alias("mark"))


def session_recap(entries: DataFrame) -> DataFrame:
    """Recap of sessions not resumed by a user turn since."""
    return recap_marks(entries).select(SID, F.col("mark.recap").alias("recap")).filter("recap is not null")


def is_user_turn() -> Column:
    """User entries that count as a turn."""
    c = F.col
    t = text.utrim(c("text"))
    tagged = text.starts(
        t, text.STDERR_TAG, text.STDOUT_TAG, text.CAVEAT_TAG, text.BASH_STDOUT_TAG, text.BASH_STDERR_TAG, text.TASK_TAG
    )
    return (
        (c("type") == "user")
        & ~c("is_meta")
        & ~c("is_sidechain")
        & ~text.is_teammate(t)
        & ~tagged
        & ~text.is_pure_tag(t, text.REMINDER_TAG)
        & has_user_content(c("content_kind"), c("text"), c("blocks"))
    )


def turn_parts(entries: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(session_id, turn_count, head, tail): user turns plus the first main assistant message after each.

    ``head`` and ``tail`` tell whether the first and the last message of the lines given is a user's (1) or an answer (0), which
    is what the count of later lines needs to know.

    Turns are counted inside segments first; only one row per segment is then looked at in order.
    """
    c = F.col
    answers = (c("type") == "assistant") & ~c("is_sidechain") & (c("model") != SYNTHETIC)
    turns = (
        main_entries(entries)
        .filter(_own())
        .select(SID, "line_no", F.when(is_user_turn(), 1).when(answers, 0).alias("u"))
        .filter("u is not null")
        .withColumn("__seg", F.expr(f"line_no div {segment}"))
    )
    prev = F.lag("u").over(Window.partitionBy(SID, "__seg").orderBy("line_no"))
    parts = turns.withColumn("prev", prev).groupBy(SID, "__seg").agg(
        F.sum((c("u") == 1).cast("bigint") + ((c("u") == 0) & (c("prev") == 1)).cast("bigint")).alias("n"),
        F.sum("u").alias("users"),
        F.min_by("u", "line_no").alias("head"),
        F.max_by("u", "line_no").alias("tail"),
    )
    counted = parts.withColumn("n", F.coalesce("n", F.lit(0)) + 0)
    before = F.lag("tail").over(Window.partitionBy(SID).orderBy("__seg"))
    joined = counted.withColumn("__before", before)
    bridge = ((c("head") == 0) & (c("__before") == 1)).cast("bigint")
    return joined.groupBy(SID).agg(
        F.sum(c("n") + F.coalesce(bridge, F.lit(0))).alias("turn_count"), F.min_by("head", "__seg").alias("head"), F.max_by("tail", "__seg").alias("tail")
    )


def turn_counts(entries: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """User turns plus the first main assistant message after each."""
    return turn_parts(entries, segment).select(SID, "turn_count")


def first_message_parts(entries: DataFrame, max_lines: int | None = None) -> DataFrame:
    """(session_id, said, command): first readable user text and first slash command, each with its line.

    ``max_lines``: look at the first so many lines only, as a reader of file heads does.
    """
    c = F.col
    raw = c("text")
    seen = main_entries(entries).filter(
        (F.lit(True) if max_lines is None else c("line_no") < max_lines)
        & _own()
        & (c("type") == "user")
        & (raw != "")
        & ~text.is_command_output(raw)
        & ~raw.startswith(text.INTERRUPTED)
    )
    is_cmd = raw.startswith("<command-name>")
    shown = F.when(~is_cmd, F.nullif(text.sanitize_content(raw), F.lit("")))
    command = F.when(is_cmd, F.coalesce(text.command_name(raw), F.lit("/command")))
    picked = seen.select(SID, "line_no", shown.alias("shown"), command.alias("command"))
    return picked.groupBy(SID).agg(
        F.min(F.when(c("shown").isNotNull(), F.struct("line_no", F.substring("shown", 1, PREVIEW_CHARS).alias("text")))).alias("said"),
        F.min(F.when(c("command").isNotNull(), F.struct("line_no", c("command").alias("text")))).alias("command"),
    )


def first_message_text() -> Column:
    """The message of ``first_message_parts`` that stands for a session."""
    return F.replace(F.coalesce("said.text", "command.text", F.lit("")), F.lit("\n"), F.lit(" "))


def first_messages(entries: DataFrame, max_lines: int | None = None) -> DataFrame:
    """First readable user text of a session, else the first slash command; ``max_lines`` as above."""
    return first_message_parts(entries, max_lines).select(SID, first_message_text().alias("first_message"))


# --- tokens and cost -------------------------------------------------------------------------------


def token_rows(entries: DataFrame, mode: str = "catalogue", extra: Sequence[str] = ()) -> DataFrame:
    """Usage rows of assistant entries.

    ``catalogue``: main entries need a uuid and are not inherited; output is estimated for unfinished
    main entries only; all-zero sub-agent rows are skipped. ``live``: no uuid needed, inherited rows
    skipped and output estimated everywhere, all-zero rows skipped. ``extra``: columns to carry along.
    """
    c = F.col
    spoken = (c("type") == "assistant") & (c("model") != SYNTHETIC) & c("has_usage")
    main = c("agent_id") == ""
    live = mode == "live"
    allowed = ~c("is_inherited") if live else (~main | _own())
    estimate = (c("stop_reason") == "") & (F.lit(True) if live else main)
    output = F.when(
        estimate, F.greatest(c("output_tokens"), tokens.estimate_output_tokens(c("blocks")))
    ).otherwise(c("output_tokens"))
    rows = entries.filter(spoken & allowed).select(
        *IDENTITY,
        *extra,
        "line_no",
        "request_id",
        "model",
        (c("stop_reason") != "").alias("has_stop"),
        "input_tokens",
        output.alias("output_tokens"),
        "cache_read_tokens",
        "cache_creation_tokens",
    )
    some = c("input_tokens") + c("output_tokens") + c("cache_read_tokens") + c("cache_creation_tokens") != 0
    return rows.filter(some if live else (main | some))


def best_snapshots(rows: DataFrame) -> DataFrame:
    """One row per request: complete before partial, then more output, then later.

    Main and sub-agent rows of a session share their request ids.
    """
    c = F.col
    snap = F.struct("model", *USAGE)
    rank = F.struct("has_stop", "output_tokens", F.col("agent_id"), "line_no")
    return (
        rows.filter(c("request_id") != "")
        .groupBy(SID, "request_id")
        .agg(F.max_by(snap, rank).alias("s"), F.count(F.lit(1)).alias("snapshots"))
        .select(SID, "request_id", "s.*", "snapshots")
    )


def token_totals(entries: DataFrame, mode: str = "catalogue") -> DataFrame:
    """Token sums and cost per session.

    Rows without a request id count as they are. Their cost is left out for main rows in catalogue
    mode, and taken at the default price otherwise.
    """
    c = F.col
    rows = token_rows(entries, mode)
    priced = tokens.cost_units(c("model"), *[c(u) for u in USAGE])
    best = best_snapshots(rows).select(SID, *USAGE, priced.alias("units"))
    paid = F.lit(True) if mode == "live" else (c("agent_id") != "")
    loose_cost = F.when(paid, tokens.cost_units(F.lit(""), *[c(u) for u in USAGE])).otherwise(0)
    loose = rows.filter(c("request_id") == "").select(SID, *USAGE, loose_cost.cast("bigint").alias("units"))
    return (
        best.unionByName(loose)
        .groupBy(SID)
        .agg(*[F.sum(u).alias(u) for u in USAGE], tokens.usd(F.sum("units")).alias("cost_usd"))
        .withColumn("total_tokens", sum((c(u) for u in USAGE[1:]), c(USAGE[0])))
    )


def model_usage(entries: DataFrame, mode: str = "catalogue") -> DataFrame:
    """Requests, tokens and cost per session and model."""
    c = F.col
    best = best_snapshots(token_rows(entries, mode))
    return best.groupBy(SID, "model").agg(
        F.count(F.lit(1)).alias("requests"),
        *[F.sum(u).alias(u) for u in USAGE],
        tokens.usd(F.sum(tokens.cost_units(c("model"), *[c(u) for u in USAGE]))).alias("cost_usd"),
    )


# --- activity --------------------------------------------------------------------------------------


def shutdown_approvals(entries: DataFrame) -> DataFrame:
    """(session_id, tool_id, approved): calls that approve a shutdown, with their order."""
    c = F.col
    own = main_entries(entries).filter(_own() & (c("type") == "assistant") & ~c("is_sidechain"))
    blocks = own.select(SID, "line_no", F.posexplode("blocks").alias("n", "b")).withColumn("ord", c("line_no") * BLOCK_STRIDE + c("n"))
    call = (F.coalesce(c("b.type"), F.lit("")) == "tool_use") & (F.coalesce(c("b.id"), F.lit("")) != "")
    approves = tools.is_shutdown_approval(F.coalesce(c("b.name"), F.lit("")), c("b.input"))
    return blocks.filter(call & approves).groupBy(SID, c("b.id").alias("tool_id")).agg(F.min("ord").alias("approved"))


def activity_events(entries: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(session_id, ord, is_ending): what main assistant and user entries did, in order; ``known``: approvals in lines before.

    Texts, plan exits, shutdown approvals and their results, rejections and interruptions end an
    activity; thinking, calls and results are activity.
    """
    c = F.col
    own = main_entries(entries).filter(_own())
    speaks = (c("type") == "assistant") & ~c("is_sidechain")
    listens = c("type") == "user"
    rejected = F.coalesce(
        F.when(F.schema_of_variant("tool_use_result") == "STRING", F.try_variant_get("tool_use_result", "$", "string")) == REJECTED,
        F.lit(False),
    )
    blocks = (
        own.filter(speaks | listens)
        .select(SID, "line_no", "type", rejected.alias("rejected"), F.posexplode("blocks").alias("n", "b"))
        .withColumn("ord", c("line_no") * BLOCK_STRIDE + c("n"))
    )
    bt = F.coalesce(c("b.type"), F.lit(""))
    blank = lambda name: text.utrim(F.coalesce(c(f"b.{name}"), F.lit(""))) == ""
    said = blocks.filter(c("type") == "assistant")
    call = (bt == "tool_use") & (F.coalesce(c("b.id"), F.lit("")) != "")
    name = F.coalesce(c("b.name"), F.lit(""))
    approves = tools.is_shutdown_approval(name, c("b.input"))
    ending = F.when(call, (name == "ExitPlanMode") | approves).when((bt == "text") & ~blank("text"), True).when(
        (bt == "thinking") & ~blank("thinking"), False
    )
    spoken = said.select(SID, "ord", ending.alias("is_ending")).filter("is_ending is not null")
    approvals = said.filter(call & approves).select(SID, c("b.id").alias("tool_id"), "ord")
    if known is not None:
        approvals = approvals.unionByName(known.select(SID, "tool_id", c("approved").alias("ord")))
    approvals = approvals.groupBy(SID, "tool_id").agg(F.min("ord").alias("__approved"))
    heard = blocks.filter(c("type") == "user")
    results = heard.filter((bt == "tool_result") & (F.coalesce(c("b.tool_use_id"), F.lit("")) != "")).select(
        SID, "ord", c("b.tool_use_id").alias("tool_id"), "rejected"
    )
    answered = results.join(approvals, [SID, "tool_id"], "left").select(
        SID, "ord", (c("rejected") | F.coalesce(c("__approved") < c("ord"), F.lit(False))).alias("is_ending")
    )
    cut = heard.filter((bt == "text") & F.coalesce(c("b.text"), F.lit("")).startswith(text.INTERRUPTED)).select(
        SID, "ord", F.lit(True).alias("is_ending")
    )
    cut_line = own.filter(listens & jsonx.content_string(c("content")).startswith(text.INTERRUPTED)).select(
        SID, (c("line_no") * BLOCK_STRIDE).alias("ord"), F.lit(True).alias("is_ending")
    )
    return spoken.unionByName(answered).unionByName(cut).unionByName(cut_line)


def scan_ongoing(entries: DataFrame) -> DataFrame:
    """Whether a session shows activity after its last ending, or any when it has none.

    A call that still waits for its result is activity itself, so open calls need no extra rule.
    """
    return activity_marks(entries).select(SID, active_since().alias("is_ongoing"))


def activity_marks(entries: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(session_id, ended, acted): the order of the last ending and of the last activity."""
    ending, order = F.col("is_ending"), F.col("ord")
    return activity_events(entries, known).groupBy(SID).agg(
        F.max(F.when(ending, order)).alias("ended"), F.max(F.when(~ending, order)).alias("acted")
    )


def active_since() -> Column:
    """Whether there was activity after the last ending."""
    return F.expr("acted IS NOT NULL AND (ended IS NULL OR acted > ended)")


def is_fresh(mtime: Column, now: Column) -> Column:
    """Last written at most a minute before ``now``."""
    return F.unix_micros(now) - F.unix_micros(mtime) <= STALE_SECONDS * 1_000_000


def build_sessions(entries: DataFrame, files: DataFrame, now: Column, mode: str = "catalogue") -> DataFrame:
    """The catalogue: one row per main file of ``files`` (path, mtime, file_role, session_id, agent_id)."""
    origin = session_dirs(entries).groupBy(SID).agg(
        F.min_by("dir", "dir_no").alias("origin_dir"), F.count(F.lit(1)).alias("dir_count")
    )
    parts = [
        session_attributes(entries), turn_counts(entries), first_messages(entries), session_recap(entries),
        token_totals(entries, mode), origin, scan_ongoing(entries),
    ]
    return assemble(files, parts, now)


def assemble(files: DataFrame, parts: Sequence[DataFrame], now: Column) -> DataFrame:
    """Catalogue rows of the main files from tables by session_id that hold the columns between them."""
    c = F.col
    main = files.filter(c("file_role") == "main").select("path", "project_key", SID, "mtime")
    active = (
        files.filter((c("file_role") == "subagent") & is_fresh(c("mtime"), now))
        .select(SID, "project_key")
        .distinct()
        .withColumn("__agents", F.lit(True))
    )
    out = main
    for part in parts:
        out = out.join(part, SID, "left")
    out = out.join(active, [SID, "project_key"], "left")
    zero = lambda n: F.coalesce(c(n), F.lit(0)).alias(n)
    blank = lambda n: F.coalesce(c(n), F.lit("")).alias(n)
    running = F.coalesce(c("is_ongoing"), F.lit(False)) & is_fresh(c("mtime"), now)
    return out.select(
        "path", "project_key", SID, "mtime", blank("first_message"), "recap", zero("turn_count"),
        (running | F.coalesce(c("__agents"), F.lit(False))).alias("is_ongoing"),
        zero("total_tokens"), *[zero(u) for u in USAGE], F.coalesce(c("cost_usd"), F.lit(0.0)).alias("cost_usd"),
        zero("duration_ms"), blank("model"), blank("cwd"), "origin_dir", zero("dir_count"), blank("git_branch"),
        F.coalesce(c("permission_mode"), F.lit("manual")).alias("permission_mode"), "forked_from_session_id",
    )


# --- registry joins --------------------------------------------------------------------------------


def join_names(sessions: DataFrame, registry: DataFrame) -> DataFrame:
    names = registry.filter(F.col("name").isNotNull()).groupBy(SID).agg(F.max_by("name", "registry_path").alias("name"))
    return sessions.drop("name").join(names, SID, "left")


def join_liveness(sessions: DataFrame, registry: DataFrame, live_pids: DataFrame, now: Column) -> DataFrame:
    """Status and idle seconds of sessions whose process is among ``live_pids``."""
    c = F.col
    latest = registry.groupBy(SID).agg(F.max_by(F.struct("status", "status_updated_at", "pid"), "registry_path").alias("r")).select(SID, "r.*")
    alive = latest.filter(c("status").isNotNull()).join(live_pids.select("pid").distinct(), "pid", "left_semi")
    now_ms = F.unix_millis(now)
    idle = F.greatest(now_ms - F.coalesce(c("status_updated_at"), now_ms), F.lit(0))
    state = alive.select(
        SID, c("status").alias("live_status"), F.floor(idle / 1000).cast("bigint").alias("idle_seconds"), c("pid").alias("live_pid")
    )
    return sessions.join(state, SID, "left")


def override_ongoing(sessions: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Replace the catalogue verdict by that of ``verdicts`` (path, ongoing) where there is one."""
    v = verdicts.select("path", F.col("ongoing").alias("__verdict"))
    return (
        sessions.join(v, "path", "left")
        .withColumn("is_ongoing", F.coalesce("__verdict", "is_ongoing"))
        .select(*sessions.columns)
    )
