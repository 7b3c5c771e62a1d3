import json
import os
import time

import pandas as pd
import pytest
from conftest import assistant, collect, txt, user, write_lines
from pyspark.sql import functions as F

from turnweave.operators.catalogue import token_totals
from turnweave.operators.entries import by_file, parse_entries, plain_ids
from turnweave.sources import tail
from turnweave.sources.transcripts import scan_transcripts
from turnweave.streaming import live


def turn(i, out, stop=None):
    return assistant(f"a{i}", [txt("t")], requestId=f"r{i // 2}", usage={"input_tokens": i, "output_tokens": out}, stop=stop)


ONCE = {"availableNow": True}


@pytest.fixture()
def bounded(spark):
    """With timers there is always a next batch; runs over what is there must not wait for them."""
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    yield
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")


def ended(q):
    assert q.awaitTermination(120) and q.exception() is None


def test_streamed_tokens_equal_batch(spark, bounded, tmp_path):
    """Two projects with one session id, snapshots that come late, a sub-agent file, a torn line and a file that starts anew."""
    root, state, out, ck = (str(tmp_path / n) for n in ("root", "state", "out", "ck"))
    agent = f"{root}/p/s/subagents/agent-x.jsonl"

    def step():
        entries = parse_entries(tail.tail_transcripts(spark, root, state))
        ended(live.start_token_totals(entries, out, ck, ONCE))

    def check():
        whole = by_file(parse_entries(scan_transcripts(spark, root)))
        want = collect(plain_ids(token_totals(whole, "live")), "project_key")
        got = collect(live.read_token_totals(spark, out).filter("total_tokens > 0").select(*want[0]), "project_key")
        assert got == want

    write_lines(f"{root}/p/s.jsonl", [turn(0, 5), turn(1, 9)])
    write_lines(f"{root}/q/s.jsonl", [turn(i, 100 + i) for i in range(9)])
    step()
    check()
    write_lines(f"{root}/p/s.jsonl", [turn(0, 5), turn(1, 9), turn(2, 1, "end_turn"), '{"type":"assist'], "")
    write_lines(agent, [turn(2, 700), turn(5, 11, "end_turn"), {**turn(6, 12), "requestId": ""}])
    step()
    write_lines(f"{root}/p/s.jsonl", [turn(0, 5), turn(1, 9), turn(2, 1, "end_turn"), turn(3, 80)])
    step()
    check()
    # a shorter file starts anew, and the sums of its other lines go although their shares see nothing new
    write_lines(f"{root}/q/s.jsonl", [turn(2, 3)])
    step()
    check()
    write_lines(f"{root}/q/s.jsonl", ['{"type":"user"}'])
    step()
    check()


class State:
    """What a stateful step sees of its state."""

    def __init__(self):
        self.get, self.exists, self.hasTimedOut, self.timeout = None, False, False, None

    def update(self, row):
        self.get, self.exists = row, True

    def remove(self):
        self.get, self.exists = None, False

    def setTimeoutDuration(self, ms):
        self.timeout = ms


def test_request_state_falls_after_idleness():
    """Snapshots go an idle time after the last line, sums stay."""
    state, step = State(), live._add_up(1500)
    row = lambda i, out, epoch=0: ("p", "s", epoch, f"r{i}", False, "", i, 1, out, 0, 0, out)
    names = ["project_key", "session_id", "epoch", "request_id", "has_stop", "agent_id", "line_no", *live._SUMS]
    feed = lambda *rows: [tuple(r[4:]) for f in step(("p", "s", 3), [pd.DataFrame(rows, columns=names)], state) for r in f.itertuples(index=False)]
    assert feed(*[row(i, 10) for i in range(500)]) == [(0, 500, 5000, 0, 0, 5000)]
    assert feed(row(7, 12), row(8, 9)) == [(0, 500, 5002, 0, 0, 5002)]
    full, state.hasTimedOut = len(state.get[0]), True
    assert state.timeout == 1500 and list(step(("p", "s", 3), [], state)) == [] and len(state.get[0]) < full / 100
    state.hasTimedOut = False
    assert feed(row(900, 1)) == [(0, 501, 5003, 0, 0, 5003)]
    assert feed(row(1, 4, epoch=1)) == [(1, 1, 4, 0, 0, 4)]
    assert feed(row(2, 4)) == [(1, 1, 4, 0, 0, 4)]  # a line of the file before


def test_watch_state_goes_after_silence():
    state, step = State(), live._watch(10, 99)
    rows = lambda *x: [pd.DataFrame([x], columns=["seq", "message_count", "item_count", "ongoing"])]
    told = lambda frames: [tuple(r) for f in step(("p", "s"), frames, state) for r in f.itertuples(index=False)]
    assert told(rows(1, 2, 3, True)) == [("p", "s", 2, 3, True, "change")] and state.timeout == 10
    state.hasTimedOut = True
    assert told([]) == [("p", "s", 2, 3, False, "stale")] and state.timeout == 99
    assert told([]) == [] and not state.exists


def test_watch_sessions(spark, tmp_path):
    """Only changes are told, and the end of an ongoing session that falls silent."""
    src, ck = str(tmp_path / "in"), str(tmp_path / "ck")
    batches = [[("p", "s", 1, 2, 3, False), ("q", "s", 1, 7, 7, False)], [("p", "s", 2, 2, 3, False)], [("p", "s", 3, 2, 4, False), ("p", "t", 3, 1, 0, True)]]
    seen = []

    def keep(df, _):
        seen.extend(df.collect())

    spark.createDataFrame([], live.UPDATES).write.parquet(src)
    stream = live.watch_sessions(spark.readStream.schema(live.UPDATES).option("maxFilesPerTrigger", 1).parquet(src), stale_seconds=3)
    q = stream.writeStream.outputMode("append").option("checkpointLocation", ck).foreachBatch(keep).trigger(processingTime="1 second").start()
    try:
        for rows in batches:
            spark.createDataFrame(rows, live.UPDATES).coalesce(1).write.mode("append").parquet(src)
            time.sleep(1)
        end = time.time() + 60
        while time.time() < end and not any(r["reason"] == "stale" for r in seen) and q.exception() is None:
            time.sleep(0.5)
    finally:
        q.stop()
    assert q.exception() is None
    told = sorted((r["project_key"], r["session_id"], r["item_count"], r["ongoing"], r["reason"]) for r in seen)
    assert told == [("p", "s", 3, False, "change"), ("p", "s", 4, False, "change"), ("p", "t", 0, False, "stale"), ("p", "t", 0, True, "change"), ("q", "s", 7, False, "change")]


def test_session_updates_stream(spark, bounded, tmp_path):
    """Each batch recomputes only touched sessions and tells only changes."""
    root, state, out, ck, ck2 = (str(tmp_path / n) for n in ("root", "state", "out", "ck", "ck2"))
    calls = []
    counts = {"v": 1}

    def build(touched):
        calls.append(sorted((r["project_key"], r["session_id"]) for r in touched.collect()))
        n = F.lit(counts["v"]).cast("bigint").alias("message_count")
        return touched.select("project_key", "session_id", n, F.lit(0).cast("bigint").alias("item_count"), F.lit(False).alias("ongoing"))

    write_lines(f"{root}/p/other.jsonl", ["{}"])
    for v in (1, 1, 2):
        counts["v"] = v
        os.makedirs(f"{root}/p", exist_ok=True)
        with open(f"{root}/p/a.jsonl", "a") as f:
            f.write("{}\n")
        ended(live.start_session_updates(tail.tail_transcripts(spark, root, state), build, out, ck, ONCE))
        ended(live.start_watch(spark, out, ck2, ONCE))
    assert calls == [[("p", "a"), ("p", "other")], [("p", "a")], [("p", "a")]]
    rows = spark.read.parquet(f"{out}/updates").collect()
    assert sorted((r["session_id"], r["message_count"]) for r in rows) == [("a", 1), ("a", 2), ("other", 1)]


def test_replayed_lines(spark, tmp_path):
    src = str(tmp_path / "in")
    schema = "session_id string, agent_id string, epoch bigint, uuid string, path string, line_no bigint, ts timestamp"
    rows = [("s", "", 0, "u1", "/s", 0, None), ("s", "", 0, "u1", "/s", 0, None), ("s", "", 0, "u2", "/s", 1, None)]
    rows += [("s", "", 0, "", "/s", 2, None), ("s", "", 0, "", "/s", 2, None), ("s", "", 0, "", "/s", 3, None)]
    df = spark.createDataFrame(rows, schema).withColumn("ts", F.lit("2026-01-01").cast("timestamp"))
    df.coalesce(1).write.parquet(src)
    q = live.drop_replayed(spark.readStream.schema(schema).parquet(src)).writeStream.format("memory").queryName("dedup_out").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("dedup_out").count() == 4
