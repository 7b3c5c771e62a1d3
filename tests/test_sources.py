import json
import os

from conftest import assistant, collect, txt, user, write_lines
from pyspark.sql import functions as F

from turnweave.operators.catalogue import build_sessions, join_liveness, join_names
from turnweave.operators.entries import parse_entries
from turnweave.sources import debuglog, sidecars, tables, transcripts


def test_line_numbers_do_not_depend_on_splits(spark, tmp_path):
    root = str(tmp_path / "projects")
    n = 1500
    write_lines(f"{root}/p1/s1.jsonl", [{"n": i, "pad": "x" * (i % 40)} for i in range(n)])
    write_lines(f"{root}/p1/s1/subagents/agent-a1.jsonl", [{"n": i} for i in range(5)])
    write_lines(f"{root}/p1/agent_old.jsonl", [{"n": 0}])
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    seen = []
    try:
        for size in ("4096", "134217728"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            rows = transcripts.scan_transcripts(spark, root).select("session_id", "agent_id", "file_role", "line_no", "value").collect()
            assert all(json.loads(r["value"])["n"] == r["line_no"] for r in rows)
            seen.append(sorted((r["session_id"], r["agent_id"], r["file_role"], r["line_no"]) for r in rows))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert seen[0] == seen[1] and len(seen[0]) == n + 5
    files = collect(transcripts.list_files(spark, root), "path")
    assert [(f["session_id"], f["agent_id"]) for f in files] == [("s1", ""), ("s1", "a1")]
    dirs = collect(transcripts.discover_project_dirs(transcripts.list_files(spark, root)))
    assert [d["project_key"] for d in dirs] == ["p1"]


def test_lines_are_not_sorted_to_be_numbered(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "projects")
    write_lines(f"{root}/p/s.jsonl", [{"n": i} for i in range(50)])
    for limit in (transcripts.BROADCAST_SPLITS, 0):
        monkeypatch.setattr(transcripts, "BROADCAST_SPLITS", limit)
        lines = transcripts.scan_transcripts(spark, root)
        assert all(json.loads(r["value"])["n"] == r["line_no"] for r in lines.collect())
        plan = lines._jdf.queryExecution().executedPlan().toString()
        for step in plan.split("\n"):
            assert not (("Sort [" in step or "Window [" in step) and "value#" in step), step
        assert ("ShuffledHashJoin" if limit == 0 else "BroadcastHashJoin") in plan


def test_sidecars_registry_outputs(spark, tmp_path):
    root = str(tmp_path)
    base = f"{root}/p/s/subagents"
    write_lines(f"{base}/agent-a.meta.json", [{"agentType": "Explore", "later": 1}])
    write_lines(f"{base}/agent-a.forked-skill.json", [{"attributionName": "fmt"}])
    write_lines(f"{base}/agent-b.meta.json", ["{broken"])
    got = {r["agent_id"]: r for r in collect(sidecars.scan_sidecars(spark, root))}
    assert got["a"]["agent_type"] == "Explore" and got["a"]["skill_name"] == "fmt"
    assert not got["b"]["agent_type"]
    reg = f"{root}/reg"
    write_lines(f"{reg}/1.json", [{"sessionId": "s", "name": " My name ", "status": "busy", "statusUpdatedAt": 1000, "pid": 7}])
    write_lines(f"{reg}/2.json", [{"sessionId": "t", "name": "  ", "status": 5, "pid": "x"}])
    write_lines(f"{reg}/3.json", ["nope"])
    registry = sidecars.scan_registry(spark, reg)
    rows = {r["session_id"]: r for r in collect(registry)}
    assert rows["s"]["name"] == "My name" and rows["s"]["pid"] == 7
    assert rows["t"]["name"] is None and rows["t"]["status"] is None and rows["t"]["pid"] is None
    sessions = spark.createDataFrame([("s",), ("t",)], "session_id string")
    assert {r["session_id"]: r["name"] for r in collect(join_names(sessions, registry))} == {"s": "My name", "t": None}
    pids = spark.createDataFrame([(7,)], "pid bigint")
    live = {r["session_id"]: r for r in collect(join_liveness(sessions, registry, pids, F.timestamp_seconds(F.lit(4))))}
    assert live["s"]["live_status"] == "busy" and live["s"]["idle_seconds"] == 3 and live["t"]["live_status"] is None
    dead = join_liveness(sessions, registry, pids.filter("pid < 0"), F.timestamp_seconds(F.lit(4)))
    assert all(r["live_status"] is None for r in collect(dead))
    os.makedirs(f"{root}/out")
    with open(f"{root}/out/big.txt", "w") as f:
        f.write("line 1\nline 2")
    outputs = sidecars.read_outputs(spark, f"{root}/out")
    texts = [f"<persisted-output>\nFull output saved to: {root}/out/big.txt\n</persisted-output>", "<persisted-output>\nFull output saved to: /none.txt\n", "plain"]
    blocks = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, result_text string")
    assert [r["result_text"] for r in collect(sidecars.resolve_persisted(blocks, outputs), "i")] == ["line 1\nline 2", texts[1], "plain"]


def test_debug_files_and_manifest(spark, tmp_path):
    write_lines(str(tmp_path / "d" / "s.txt"), ["2026-01-01T00:00:00.000Z [DEBUG] [c] m", " more"])
    rows = collect(debuglog.scan_debug_logs(spark, str(tmp_path / "d")), "line_no")
    assert [(r["session_id"], r["line_no"]) for r in rows] == [("s", 0), ("s", 1)]
    old = spark.createDataFrame([("a", 1, 5), ("b", 1, 5)], "path string, mtime int, file_size int")
    new = spark.createDataFrame([("a", 1, 5), ("b", 2, 5), ("c", 1, 1)], "path string, mtime int, file_size int")
    assert [r["path"] for r in collect(tables.changed_files(new, old), "path")] == ["b", "c"]


def test_catalogue_from_files(spark, tmp_path):
    root = str(tmp_path / "projects")
    usage = {"input_tokens": 10, "output_tokens": 1, "cache_creation": {"input_tokens": 4}}
    write_lines(
        f"{root}/p/s1.jsonl",
        [
            user("u1", "hello\nthere", cwd="/a", timestamp="2026-01-01T00:00:00Z", gitBranch="main"),
            assistant("a1", [txt("x" * 40)], "u1", requestId="r1", usage=usage, timestamp="2026-01-01T00:00:01Z"),
            assistant("a1b", [txt("x" * 40)], "u1", requestId="r1", usage={**usage, "output_tokens": 7}, stop="end_turn", timestamp="2026-01-01T00:00:02Z"),
            {"type": "system", "subtype": "x", "hookEvent": "DirectoryAdded", "directory": "/b", "cwd": "/c"},
            "{broken", "",
            {"type": "system", "subtype": "away_summary", "uuid": "w", "content": " recap text "},
            user("u2", "<channel source='x'>ping", "a1b", timestamp="2026-01-01T00:00:09.5Z", forkedFrom={"sessionId": "z"}),
        ],
    )
    write_lines(f"{root}/p/s1/subagents/agent-q.jsonl", [
        assistant("q1", [txt("y")], requestId="r1", usage={"output_tokens": 9}, stop="end_turn", model="claude-haiku-4-5"),
        assistant("q2", [txt("y")], usage={"input_tokens": 1000000}, model="claude-haiku-4-5"),
    ])
    entries = parse_entries(transcripts.scan_transcripts(spark, root)).cache()
    files = transcripts.list_files(spark, root)
    row = collect(build_sessions(entries, files, F.lit("2000-01-01").cast("timestamp")))[0]
    assert row["first_message"] == "hello there" and row["turn_count"] == 2
    assert row["cwd"] == "/a" and row["origin_dir"] == "/a" and row["dir_count"] == 3
    assert row["git_branch"] == "main" and row["permission_mode"] == "manual" and row["recap"] == "recap text"
    # r1: the complete row with most output wins, which is the agent's; q2 counts as it is
    assert row["output_tokens"] == 9 and row["input_tokens"] == 1000000 and row["total_tokens"] == 1000009
    assert abs(row["cost_usd"] - (9 * 5 / 1e6 + 3.0)) < 1e-9
    assert row["duration_ms"] == 2000 and row["model"] == "claude-sonnet-4"
    assert row["is_ongoing"]  # files are newer than the given time
    one = transcripts.session_by_id(build_sessions(entries, files, F.lit("2000-01-01").cast("timestamp")), "s1")
    assert one.count() == 1
    out = str(tmp_path / "out")
    tables.write_tables({"entries": entries.select("session_id", "line_no", "type", "content")}, out, buckets=4)
    assert tables.read_table(spark, out, "entries").count() == entries.count()
