"""The refreshed catalogue against one built anew, while files grow, shrink, go away and come back."""

import os

from conftest import assistant, call, collect, result, txt, user, write_lines
from pyspark.sql import functions as F

from turnweave.operators.entries import parse_entries
from turnweave.plans.views import session_catalogue
from turnweave.sources.transcripts import list_files, scan_transcripts
from turnweave.streaming import incremental

T = "2026-01-01T00:{:02d}:00.000Z"


def use(n):
    return {"input_tokens": n, "output_tokens": 1}


def lines(n, project):
    rows = [
        user("u1", "<command-name>/go</command-name>", cwd=f"/{project}", timestamp=T.format(0), gitBranch="main"),
        assistant("a1", [call("t1", "Read", file_path="/f")], "u1", requestId="r1", usage=use(100), timestamp=T.format(1), stop="tool_use"),
        user("u2", [result("t1", "x")], "a1", timestamp=T.format(2)),
        user("u3", "hello there", "u2", timestamp=T.format(3), cwd=f"/{project}/sub", permissionMode="plan"),
        assistant("a2", [txt("partly")], "u3", requestId="r2", usage=use(7), timestamp=T.format(4), model="claude-haiku-4-5"),
        assistant("a3", [txt("whole")], "u3", requestId="r2", usage=use(9), timestamp=T.format(5), stop="end_turn", model="claude-haiku-4-5"),
        {"type": "system", "subtype": "away_summary", "uuid": "w", "content": "recap"},
        assistant("a4", [call("t2", "SendMessage", type="shutdown_response", approve=True)], "a3", requestId="", usage=use(3), timestamp=T.format(6)),
        user("u4", [result("t2", "ok")], "a4", timestamp=T.format(7)),
        user("u5", "more", "u4", timestamp=T.format(8)),
        assistant("a5", [txt("end")], "u5", requestId="r5", usage=use(11), timestamp=T.format(9), stop="end_turn"),
    ]
    return rows[:n]


def check(spark, root, store):
    now = F.lit("2100-01-01").cast("timestamp")
    incremental.refresh_catalogue(spark, root, store, buckets=3)
    want = collect(session_catalogue(parse_entries(scan_transcripts(spark, root)), list_files(spark, root), now), "path")
    got = collect(incremental.read_catalogue(spark, store, now).select(*want[0]), "path")
    assert got == want
    return want


def test_refreshed_catalogue_equals_a_rebuild(spark, tmp_path):
    root, store = str(tmp_path / "root"), str(tmp_path / "store")
    p, q, agent = f"{root}/p/s.jsonl", f"{root}/q/s.jsonl", f"{root}/p/s/subagents/agent-x.jsonl"
    write_lines(p, lines(2, "p"))
    write_lines(q, lines(5, "q"))
    write_lines(f"{root}/q/t.jsonl", lines(1, "q"))
    check(spark, root, store)
    write_lines(p, lines(4, "p"))  # grows, with answers to what was asked before
    write_lines(agent, [assistant("x1", [txt("y")], requestId="r1", usage={"output_tokens": 900}, stop="end_turn"), assistant("x2", [txt("z")], usage=use(5))])
    check(spark, root, store)
    write_lines(p, lines(8, "p"))
    write_lines(q, lines(11, "q"))
    os.remove(f"{root}/q/t.jsonl")
    rows = check(spark, root, store)
    assert [r["project_key"] for r in rows] == ["p", "q"] and rows[0]["total_tokens"] != rows[1]["total_tokens"]
    write_lines(p, lines(11, "p"))
    write_lines(q, lines(3, "q"))  # shrinks
    os.remove(agent)
    write_lines(f"{root}/q/t.jsonl", lines(6, "q"))  # comes back
    check(spark, root, store)
    check(spark, root, store)  # nothing to do


def test_only_appended_bytes_are_parsed(spark, tmp_path, monkeypatch):
    root, store = str(tmp_path / "root"), str(tmp_path / "store")
    seen = []
    real = incremental.appended_lines

    def watched(ranges, *args):
        seen.extend((r["start"], r["end"]) for r in ranges.collect())
        return real(ranges, *args)

    monkeypatch.setattr(incremental, "appended_lines", watched)
    path = f"{root}/p/s.jsonl"
    write_lines(path, lines(5, "p"))
    first = os.path.getsize(path)
    incremental.refresh_catalogue(spark, root, store, buckets=2)
    write_lines(path, lines(6, "p"))
    incremental.refresh_catalogue(spark, root, store, buckets=2)
    assert seen == [(0, first), (first, os.path.getsize(path))]
