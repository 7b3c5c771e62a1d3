"""Two project directories that hold the same session id, through the plans."""

import os

from conftest import assistant, call, collect, result, txt, user, write_lines
from pyspark.sql import functions as F

from turnweave.operators.catalogue import token_totals
from turnweave.operators.entries import by_file, parse_entries, plain_ids
from turnweave.plans.views import _keyed, session_catalogue, session_view
from turnweave.sources import sidecars
from turnweave.sources.transcripts import list_files, scan_transcripts
from turnweave.streaming.live import session_updates

T = "2026-01-01T00:00:{:02d}.000Z"
NOW = "2026-01-01 00:10:00"


def write_both(root):
    usage = lambda n: {"input_tokens": n, "output_tokens": 1}
    for project, n, words in (("p", 100, "first"), ("q", 7, "second")):
        preview = f"<persisted-output>\nFull output saved to: {root}/saved/{project}.txt\n</persisted-output>"
        write_lines(f"{root}/t/{project}/s.jsonl", [
            user("u1", words, cwd=f"/{project}", timestamp=T.format(0)),
            assistant("a1", [call("t1", "Read", file_path="/f"), call("t2", "Agent", description="d")], "u1", requestId="r1", usage=usage(n), timestamp=T.format(1), stop="tool_use"),
            user("u2", [result("t1", preview)], "a1", timestamp=T.format(2)),
            user("u3", [result("t2", "ok")], "u2", timestamp=T.format(3), toolUseResult={"agentId": "x"}),
            assistant("a2", [txt("done " + words)], "u3", timestamp=T.format(4), stop="end_turn"),
        ])
        write_lines(f"{root}/t/{project}/s/subagents/agent-x.jsonl", [user("x1", "go " + words, timestamp=T.format(2)), assistant("x2", [txt("y")], "x1", requestId="r9", usage=usage(0), timestamp=T.format(3))])
        write_lines(f"{root}/t/{project}/s/subagents/agent-x.meta.json", [{"agentType": "type-" + project}])
        write_lines(f"{root}/saved/{project}.txt", ["whole output of " + project], end="")


def test_keys_come_apart_again(spark):
    df = spark.createDataFrame([("p", "s", 1), ("-a-b", "s-1", 2)], "project_key string, session_id string, n int")
    assert collect(plain_ids(by_file(df)), "n") == collect(df, "n")
    assert collect(plain_ids(by_file(df).drop("project_key")).select(*df.columns), "n") == collect(df, "n")


def test_catalogue_rows_of_one_id(spark, tmp_path):
    root = str(tmp_path)
    write_both(root)
    entries = parse_entries(scan_transcripts(spark, f"{root}/t")).cache()
    write_lines(f"{root}/reg/1.json", [{"sessionId": "s", "name": "N", "status": "busy", "statusUpdatedAt": 1, "pid": 7}])
    files = list_files(spark, f"{root}/t")
    verdict = files.filter("file_role = 'main' and project_key = 'q'").select("path", F.lit(True).alias("ongoing"))
    pids = spark.createDataFrame([(7,)], "pid bigint")
    rows = collect(session_catalogue(
        entries, files, F.lit("2100-01-01").cast("timestamp"), registry=sidecars.scan_registry(spark, f"{root}/reg"), live_pids=pids, verdicts=verdict
    ), "project_key")
    assert [(r["project_key"], r["session_id"], r["total_tokens"], r["first_message"], r["cwd"]) for r in rows] == [
        ("p", "s", 102, "first", "/p"), ("q", "s", 9, "second", "/q"),
    ]
    assert [os.path.basename(os.path.dirname(r["path"])) for r in rows] == ["p", "q"]
    assert [(r["is_ongoing"], r["name"], r["live_status"]) for r in rows] == [(False, "N", "busy"), (True, "N", "busy")]


def test_tables_with_and_without_projects_get_the_key(spark, tmp_path):
    root = str(tmp_path)
    write_both(root)
    ids = list_files(spark, f"{root}/t").select("project_key", "session_id").distinct()
    named = _keyed(sidecars.scan_sidecars(spark, f"{root}/t"), ids)
    assert sorted((r["session_id"], r["agent_type"]) for r in named.collect()) == [("p/s", "type-p"), ("q/s", "type-q")]
    plain = _keyed(spark.createDataFrame([("s", 1), ("z", 2)], "session_id string, n int"), ids)
    assert collect(plain, "session_id") == [{"session_id": "p/s", "n": 1}, {"session_id": "q/s", "n": 1}]


def test_views_of_one_id_with_saved_outputs(spark, tmp_path):
    root = str(tmp_path)
    write_both(root)
    entries = parse_entries(scan_transcripts(spark, f"{root}/t")).cache()
    outputs = sidecars.read_outputs(spark, f"{root}/saved")
    view = session_view(entries, F.lit(NOW).cast("timestamp"), sidecars=sidecars.scan_sidecars(spark, f"{root}/t"), outputs=outputs)
    msgs = collect(plain_ids(view.messages).filter("agent_id = ''"), "project_key", "msg_no")
    assert [(m["project_key"], m["session_id"], m["role"], m["content"]) for m in msgs] == [
        ("p", "s", "user", "first"), ("p", "s", "claude", "done first"), ("q", "s", "user", "second"), ("q", "s", "claude", "done second"),
    ]
    procs = collect(plain_ids(view.processes), "project_key")
    assert [(x["project_key"], x["agent_id"], x["prompt"], x["parent_task_id"]) for x in procs] == [
        ("p", "x", "go first", "t2"), ("q", "x", "go second", "t2"),
    ]
    read = collect(plain_ids(view.items).filter("tool_id = 't1'").select("project_key", "tool_result"), "project_key")
    assert read == [{"project_key": "p", "tool_result": "whole output of p"}, {"project_key": "q", "tool_result": "whole output of q"}]
    totals = plain_ids(token_totals(by_file(entries), "live"))
    updates = collect(session_updates(view, totals), "project_key")
    assert [(u["project_key"], u["session_id"], u["message_count"], u["input_tokens"], u["permission_mode"]) for u in updates] == [
        ("p", "s", 2, 100, "manual"), ("q", "s", 2, 7, "manual"),
    ]
