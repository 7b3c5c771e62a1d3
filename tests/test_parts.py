"""Long debug extras in parts against whole ones, and positions by range against a plain window."""

import random

from conftest import collect
from pyspark.sql import Window
from pyspark.sql import functions as F

from turnweave.operators import debug
from turnweave.plans.ordered import range_rank

HEAD = "2026-01-01T00:00:{:02d}.000Z [{}] {}"


def make(spark):
    r = random.Random(4)
    rows = []
    for i in range(25):
        kind = r.choice(["[cat] message", "Hook Pre:Tool (PreToolUse) success:", "Hook Stop (Stop) success:", "plain"])
        rows.append(HEAD.format(i, r.choice(["DEBUG", "WARN", "ERROR"]), kind))
        rows += ["".join(r.choice("abAB ") for _ in range(r.choice([1, 2, 3, 30, 200]))) + "x" for _ in range(r.randrange(0, 9))]
    return spark.createDataFrame([(f"s{n}", i, v) for n in range(2) for i, v in enumerate(rows[n:])], "session_id string, line_no bigint, value string")


def test_parts_change_no_rows_hits_or_commands(spark):
    lines = make(spark).cache()
    whole = debug.parse_debug(lines).cache()
    assert debug.debug_more(lines).count() == 0
    bare = [c for c in whole.columns if c != "extra"]
    for size in (1, 7, 64):
        entries, more = debug.parse_debug(lines, part_bytes=size, segment=3).cache(), debug.debug_more(lines, part_bytes=size, segment=3).cache()
        assert more.count() > 10
        assert collect(entries.select(*bare), "session_id", "entry_line") == collect(whole.select(*bare), "session_id", "entry_line")
        parts = {}
        for e in collect(entries, "session_id", "entry_line"):
            parts[e["session_id"], e["entry_line"]] = [e["extra"]]
        for m in collect(more, "session_id", "entry_line", "part_no"):
            parts[m["session_id"], m["entry_line"]].append(m["extra"])
        assert {k: "\n".join(v) for k, v in parts.items()} == {(e["session_id"], e["entry_line"]): e["extra"] for e in collect(whole)}
        hits = lambda df: {(e["session_id"], e["entry_line"]) for e in df.select("session_id", "entry_line").collect()}
        texts = [e["extra"] for e in collect(whole) if len(e["extra"]) > 40]
        r = random.Random(size)
        for query in ["abx\na", "x\n", "nowhere", *[t[i : i + n] for t in texts[:3] for i, n in [(r.randrange(20), r.choice([2, 9, 33]))]]]:
            assert hits(debug.filter_text(entries, query, more)) == hits(debug.filter_text(whole, query)), query
        assert collect(debug.debug_hooks(entries, more), "session_id", "entry_line") == collect(debug.debug_hooks(whole), "session_id", "entry_line")


def test_positions_by_range(spark):
    """One key within one time and rows without any, in a key that holds most of the table."""
    r = random.Random(5)
    rows = [("hot" if r.random() < 0.8 else f"k{i % 5}", r.choice([None, 7, 7, 7, 8]), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, t bigint, i bigint").repartition(5)
    want = df.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("t", "i")).cast("bigint"))
    got = range_rank(df, ["k"], ["t", "i"], "n")
    assert collect(got, "i") == collect(want, "i")
    spread = got.groupBy("k").agg(F.max("n")).count()
    assert spread == 6 and range_rank(df.limit(0), ["k"], ["t", "i"], "n").count() == 0
