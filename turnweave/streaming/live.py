"""Live transcripts: streamed tokens, session updates and the watch for changes.

Lines come from ``sources.tail.tail_transcripts``, which reads appended bytes only; a file that shrank starts a new epoch. What
must be remembered is kept in stateful operators with timers and expiry, so no batch reads what an earlier one wrote.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import tokens
from ..operators import catalogue, chunks, messages
from ..operators.classify import USAGE
from ..operators.entries import by_file, parse_entries, plain_ids
from ..plans.runtime import stage
from ..plans.views import SessionView

SID = "session_id"
FILE = ["project_key", SID]
TRIGGER = "1 second"
SHARES = 16  # a session's requests are spread over so many states
IDLE_MS = 3_600_000  # after an hour without lines a session's open requests are taken as finished
KEEP_MS = 7 * 86_400_000  # what was last told of a session is forgotten after a week of silence


def stream_entries(lines: DataFrame) -> DataFrame:
    """Typed entries of a line stream; heartbeats stay, they refresh the file time."""
    return parse_entries(lines)


def drop_replayed(entries: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Drop lines that the landing replays within the delay.

    Lines without a uuid (summaries, modes, directories, forks) are told apart by their place in the file.
    """
    c = F.col
    place = F.concat_ws("/", F.lit("#"), c("path"), c("line_no").cast("string"))
    keyed = entries.withColumn("__key", F.when(c("uuid") != "", c("uuid")).otherwise(place))
    return keyed.withWatermark("ts", delay).dropDuplicatesWithinWatermark([SID, "agent_id", "epoch", "__key"]).drop("__key")


# --- streamed totals --------------------------------------------------------------------------------

_SUMS = (*USAGE, "cost_units")
_LONGS = ", ".join(f"{n} bigint" for n in _SUMS)
TOTALS = f"project_key string, session_id string, share int, agent_id string, epoch bigint, {_LONGS}"


def usage_rows(entries: DataFrame) -> DataFrame:
    """Usage rows of a stream of entries: what is counted, its rank among the snapshots of its request and its price.

    Any line of a file that started anew also gives a row without a request, so that the old sums of the file go.
    """
    c = F.col
    rows = catalogue.token_rows(entries, "live", extra=["project_key", "epoch"])
    # a row without a request id is a request of its own
    own = F.concat_ws("/", F.lit("#"), c("agent_id"), c("line_no").cast("string"))
    priced = tokens.cost_units(F.when(c("request_id") != "", c("model")).otherwise(""), *[c(u) for u in USAGE])
    keyed = rows.withColumns({"request_id": F.when(c("request_id") != "", c("request_id")).otherwise(own), "cost_units": priced.cast("bigint")})
    kept = [*FILE, "epoch", "request_id", "has_stop", "agent_id", "line_no", *_SUMS]
    anew = entries.filter("epoch > 0").select(
        *FILE, "epoch", F.lit("").alias("request_id"), F.lit(False).alias("has_stop"), "agent_id", "line_no",
        *[F.lit(0).cast("bigint").alias(n) for n in _SUMS],
    )
    return keyed.select(*kept).unionByName(anew).withColumn("share", F.pmod(F.xxhash64("request_id"), F.lit(SHARES)).cast("int"))


def _add_up(idle_ms: int):
    """Sums of one share of a session's requests, by file of the session.

    State, one row a share: the best snapshot of each open request, dropped after ``idle_ms`` without lines, and the sums of each
    file. A snapshot that beats the one before moves the difference. A later epoch of a file starts its sums anew; lines of an
    earlier one are past.
    """
    out = USAGE.index("output_tokens")
    zero = [0] * len(_SUMS)

    def step(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        sums, best = json.loads(state.get[0]) if state.exists else ({}, {})
        if state.hasTimedOut:
            state.update((json.dumps([sums, {}]),))
            return
        met = set()
        for frame in frames:
            for r in frame.sort_values("epoch").itertuples(index=False):
                own = sums.get(r.agent_id)
                if own is None or r.epoch > own[0]:
                    own = sums[r.agent_id] = [int(r.epoch), *zero]
                met.add(r.agent_id)
                if r.epoch < own[0] or r.request_id == "":
                    continue
                new = [int(getattr(r, n)) for n in _SUMS]
                rank = [bool(r.has_stop), new[out], r.agent_id, int(r.line_no)]
                old = best.get(r.request_id)
                if old and old["epoch"] == sums[old["rank"][2]][0]:  # else its file started anew since
                    if rank <= old["rank"]:
                        continue
                    loser = sums[old["rank"][2]]
                    loser[1:] = [s - w for s, w in zip(loser[1:], old["sums"])]
                    met.add(old["rank"][2])
                best[r.request_id] = {"rank": rank, "epoch": int(r.epoch), "sums": new}
                own[1:] = [s + n for s, n in zip(own[1:], new)]
        state.update((json.dumps([sums, best]),))
        state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame([(*key, agent, *sums[agent]) for agent in sorted(met)], columns=[*FILE, "share", "agent_id", "epoch", *_SUMS])

    return step


def stream_totals(entries: DataFrame, idle_ms: int = IDLE_MS) -> DataFrame:
    """Token sums of each (project, session, share, file) that a batch touches, from a stream of entries."""
    shares = usage_rows(entries).groupBy(*FILE, "share")
    return shares.applyInPandasWithState(_add_up(idle_ms), TOTALS, "state string", "update", GroupStateTimeout.ProcessingTimeTimeout)


def start_token_totals(entries: DataFrame, out: str, checkpoint: str, trigger: dict | None = None, idle_ms: int = IDLE_MS) -> StreamingQuery:
    """Append the sums of touched sessions below ``out``; a repeated batch overwrites its own folder, none is read."""

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/totals/batch_id={batch_id}")

    writer = stream_totals(entries, idle_ms).writeStream.outputMode("update").foreachBatch(save)
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": TRIGGER})).start()


def read_token_totals(spark: SparkSession, out: str) -> DataFrame:
    """Token sums and cost per session: the last row of each share, of the latest epoch of each file."""
    c = F.col
    rows = spark.read.schema(TOTALS + ", batch_id bigint").parquet(f"{out}/totals")
    last = rows.groupBy(*FILE, "agent_id", "share").agg(F.max_by(F.struct("epoch", *_SUMS), "batch_id").alias("s")).select(*FILE, "agent_id", "s.*")
    by_file = last.groupBy(*FILE, "agent_id", "epoch").agg(*[F.sum(n).alias(n) for n in _SUMS])
    latest = by_file.groupBy(*FILE, "agent_id").agg(F.max_by(F.struct(*_SUMS), "epoch").alias("s")).select(*FILE, "s.*")
    one = latest.groupBy(*FILE).agg(*[F.sum(n).alias(n) for n in _SUMS])
    total = sum((c(u) for u in USAGE[1:]), c(USAGE[0]))
    return one.select(*FILE, *USAGE, tokens.usd(c("cost_units")).alias("cost_usd"), total.alias("total_tokens"))


# --- session updates -------------------------------------------------------------------------------


def session_updates(view: SessionView, totals: DataFrame) -> DataFrame:
    """One row per session: counts, context, mode, state and totals (by project and session). Roles are ``messages.roles``."""
    c = F.col
    main = view.messages.filter(c("agent_id") == "")
    counts = main.groupBy(SID).agg(F.count(F.lit(1)).alias("message_count"), F.sum("item_count").alias("item_count"))
    context = messages.latest_context_tokens(main).select(SID, "context_tokens")
    mode = chunks.last_permission_mode(view.msgs.filter(c("agent_id") == "")).select(SID, "permission_mode")
    out = counts.join(context, SID).join(view.ongoing, SID, "left").join(mode, SID, "left").join(by_file(totals).drop("project_key"), SID, "left")
    # both names stand for the default mode
    named = F.coalesce(F.nullif("permission_mode", F.lit("")), F.lit("manual"))
    return plain_ids(out.withColumns({"ongoing": F.coalesce("ongoing", F.lit(False)), "permission_mode": named}))


def start_session_updates(lines: DataFrame, build, out: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """For each batch, call ``build(touched)`` for the (project_key, session_id) rows it touches and append what comes out.

    ``build`` returns session_updates of these sessions only. Nothing written before is read: ``start_watch`` follows the rows
    and tells the changes.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        touched = stage(batch.select(*FILE).distinct())
        if not touched.isEmpty():
            rows = build(touched).withColumn("seq", F.lit(batch_id).cast("bigint"))
            rows.write.mode("overwrite").parquet(f"{out}/current/batch_id={batch_id}")

    writer = lines.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": TRIGGER})).start()


_STATE = "seq bigint, message_count bigint, item_count bigint, ongoing boolean"
UPDATES = f"project_key string, session_id string, {_STATE}"
EMITTED = "project_key string, session_id string, message_count bigint, item_count bigint, ongoing boolean, reason string"


def _watch(stale_ms: int, keep_ms: int):
    """Remembers the last update of a session, and tells another message or item count, or being ongoing now or before.

    A timer tells the end of an ongoing session that fell silent; the state of a quiet one goes after ``keep_ms``.
    """

    def step(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        old = state.get if state.exists else (-1, 0, 0, False)
        if state.hasTimedOut:
            if not old[3]:
                state.remove()
                return
            now, reason = (old[1], old[2], False), "stale"
            state.update((old[0], *now))
        else:
            top = None  # one small row per update; only the latest matters
            for frame in frames:
                r = frame.loc[frame["seq"].idxmax()]
                if top is None or r["seq"] > top["seq"]:
                    top = r
            now, reason = (int(top["message_count"]), int(top["item_count"]), bool(top["ongoing"])), "change"
            state.update((int(top["seq"]), *now))
        state.setTimeoutDuration(stale_ms if now[2] else keep_ms)
        if now[:2] != tuple(old[1:3]) or now[2] or old[3]:
            yield pd.DataFrame([(*key, *now, reason)], columns=[*FILE, "message_count", "item_count", "ongoing", "reason"])

    return step


def watch_sessions(updates: DataFrame, stale_seconds: int = catalogue.STALE_SECONDS, keep_ms: int = KEEP_MS) -> DataFrame:
    """Stream of session changes from a stream of UPDATES rows, with the end of an ongoing session a minute after its last one."""
    return updates.groupBy(*FILE).applyInPandasWithState(
        _watch(stale_seconds * 1000, keep_ms), EMITTED, _STATE, "append", GroupStateTimeout.ProcessingTimeTimeout
    )


def start_watch(spark: SparkSession, out: str, checkpoint: str, trigger: dict | None = None, **limits) -> StreamingQuery:
    """Follow the rows of ``start_session_updates`` below ``out`` and append the changes worth telling to ``out/updates``.

    The timers ask for batches without data; a run with trigger availableNow ends only where
    spark.sql.streaming.noDataMicroBatches.enabled is false.
    """
    rows = spark.readStream.schema(UPDATES).option("recursiveFileLookup", "true").parquet(f"{out}/current")
    writer = watch_sessions(rows, **limits).writeStream.outputMode("append").format("parquet").option("path", f"{out}/updates")
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": TRIGGER})).start()
