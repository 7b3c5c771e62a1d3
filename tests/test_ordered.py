import random

import pytest
from conftest import collect, lines_frame
from folds import live_set, pair
from pyspark.sql import Window
from pyspark.sql import functions as F

from turnweave.operators import chain, chunks
from turnweave.operators.entries import parse_entries
from turnweave.plans.ordered import ordered_scan, text_parts


def test_scan_equals_plain_window(spark):
    """One hot key holds most rows; segments of 7 rows must not change the result."""
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.8 else f"k{rng.randrange(4)}", i * 3, rng.choice([None, 1, 2, 3])) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, o bigint, v int")
    got = ordered_scan(df, ["k"], "o", segment=7, before={"b": F.col("v")}, after={"a": F.col("v")}, totals={"t": F.col("v").cast("bigint")})
    w = Window.partitionBy("k").orderBy("o")
    down = Window.partitionBy("k").orderBy(F.desc("o")).rowsBetween(Window.unboundedPreceding, -1)
    want = df.select(
        "*",
        F.last("v", True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("b"),
        F.last("v", True).over(down).alias("a"),
        F.coalesce(F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)).alias("t"),
    )
    assert collect(got, "k", "o") == collect(want, "k", "o")


def test_text_parts_are_whole(spark):
    df = spark.createDataFrame([("k", i, "x" * (i % 5)) for i in range(50)], "k string, o bigint, t string")
    parts = collect(text_parts(df, ["k"], "o", "t", part_bytes=20, segment=4), "part_no")
    assert len(parts) > 3
    assert "\n".join(p["text"] for p in parts) == "\n".join("x" * (i % 5) for i in range(50))


def chain_cases():
    rng = random.Random(7)
    cases = []
    for case in range(40):
        n = rng.randrange(1, 30)
        rows = []
        for i in range(n):
            back = i - 1 if rng.random() < 0.7 else rng.randrange(-1, i)
            parent = f"n{back}" if back >= 0 else ""
            logical = ""
            if rng.random() < 0.15:
                parent, logical = "", f"n{rng.randrange(0, n)}"
            if rng.random() < 0.05:
                parent = "gone"
            if rng.random() < 0.05:
                parent = f"n{rng.randrange(0, n)}"
            leaf = f"n{rng.randrange(0, n)}" if rng.random() < 0.05 else ""
            rows.append((f"n{i}", parent, logical, leaf, rng.random() < 0.1))
        cases.append(rows)
    return cases


@pytest.mark.parametrize(("runs_per_task", "runs_per_row"), [(200_000, 64), (200_000, 0), (0, 0)])
def test_live_chain_equals_fold(spark, monkeypatch, runs_per_task, runs_per_row):
    """All three walks against the sequential rule, with branches, gaps and cycles."""
    monkeypatch.setattr(chain, "RUNS_PER_ROW", runs_per_row)
    cases = chain_cases()
    lines = {
        (f"s{i}", ""): [
            {"type": "user", "uuid": u, "parentUuid": p or None, "logicalParentUuid": g or None, "leafUuid": leaf, "isSidechain": side}
            for u, p, g, leaf, side in rows
        ]
        for i, rows in enumerate(cases)
    }
    entries = parse_entries(lines_frame(spark, lines)).cache()
    got = {}
    for r in chain.live_chain(entries, runs_per_task=runs_per_task, segment=5).collect():
        got.setdefault(r["session_id"], set()).add(r["uuid"])
    for i, rows in enumerate(cases):
        assert got.get(f"s{i}", set()) == live_set(rows), (i, rows)


def test_pairing_equals_fold(spark):
    rng = random.Random(3)
    events = [(i, rng.choice(["call", "result"]), rng.choice(["", "a", "b", "c"])) for i in range(300)]
    rows = [("s", "", 0, i, "assistant" if k == "call" else "meta", "tool_use" if k == "call" else "tool_result", k != "call", t, f"r{i}") for i, k, t in events]
    df = spark.createDataFrame(
        rows,
        "session_id string, agent_id string, chunk_no bigint, ord bigint, rule string, block_type string, is_meta boolean, tool_id string, result_text string",
    ).selectExpr("*", "cast(null as string) result_json", "false result_error", "'' block_advisor_model", "cast(null as timestamp) ts")
    out = chunks.pair_results(df.withColumn("ord", F.col("ord") * (1 << 20)), segment=9)
    got = collect(out, "ord")
    matched, orphans, pending = pair(events)
    assert {r["ord"] >> 20: int(r["answer"]["text"][1:]) for r in got if r["answer"]} == matched
    assert [r["ord"] >> 20 for r in got if r["is_result"] and not r["is_matched"]] == orphans
    assert {r["ord"] >> 20 for r in got if r["is_pending"]} == pending
