"""One session with sub-agents, through the whole view."""

from conftest import assistant, call, collect, lines_frame, result, txt, user
from pyspark.sql import functions as F

from turnweave.operators import chunks, messages, ongoing
from turnweave.operators.entries import parse_entries
from turnweave.plans.views import session_view

T = "2026-01-01T00:00:{:02d}.000Z"


def make(spark):
    main = [
        user("u1", "hello", timestamp=T.format(0)),
        assistant("a1", [{"type": "thinking", "thinking": "hm"}, txt("hi"), call("t1", "Read", file_path="/a/b/c.py", limit=5)],
                  "u1", timestamp=T.format(1), stop="tool_use", usage={"input_tokens": 5, "output_tokens": 7}),
        user("r1", [result("t1", "data")], "a1", timestamp=T.format(3)),
        assistant("a2", [call("t2", "Agent", description="dig", prompt="go", subagent_type="Explore")], "r1", timestamp=T.format(4)),
        user("r2", [result("t2", [txt("found"), txt("it")])], "a2", timestamp=T.format(9),
             toolUseResult={"agentId": "x1", "color": "red"}),
        assistant("a3", [txt("done")], "r2", timestamp=T.format(10), stop="end_turn"),
        user("u2", "more", "a3", timestamp=T.format(11), permissionMode="plan"),
        assistant("a4", [call("t3", "Skill", skill="fmt")], "u2", timestamp=T.format(12)),
    ]
    agent = [
        user("s1", "go", timestamp=T.format(5), isSidechain=True),
        assistant("s2", [call("t9", "Skill", skill="inner")], "s1", timestamp=T.format(6), isSidechain=True),
        {"type": "progress", "uuid": "s3", "data": {"type": "skill_progress", "agentId": "x2"}, "parentToolUseID": "t9",
         "isSidechain": True, "timestamp": T.format(7)},
    ]
    nested = [user("n1", "Base directory for this skill: /k/inner\nrest", timestamp=T.format(7), isSidechain=True),
              assistant("n2", [txt("ok")], "n1", timestamp=T.format(8), isSidechain=True)]
    lost = [user("l1", "orphan prompt", timestamp=T.format(20)), assistant("l2", [txt("x")], "l1", timestamp=T.format(21))]
    return lines_frame(spark, {("S", ""): main, ("S", "x1"): agent, ("S", "x2"): nested, ("S", "x3"): lost})


def test_session_view(spark):
    entries = parse_entries(make(spark)).cache()
    view = session_view(entries, F.lit("2026-01-01 00:00:30").cast("timestamp"))
    procs = {p["agent_id"]: p for p in collect(view.processes)}
    assert procs["x1"]["parent_task_id"] == "t2" and procs["x1"]["description"] == "dig"
    assert procs["x1"]["subagent_type"] == "Explore" and procs["x1"]["teammate_color"] == "red"
    assert procs["x2"]["parent_task_id"] == "t9" and procs["x2"]["description"] == "inner"
    # the only call left over is a Skill call, which is no agent call: x3 stays unlinked
    assert procs["x3"]["parent_task_id"] == "orphan-x3"
    edges = {(e["parent_agent"], e["tool_id"]): e["child_agent"] for e in collect(view.edges)}
    assert edges == {("", "t2"): "x1", ("x1", "t9"): "x2", ("", "orphan-x3"): "x3"}
    msgs = collect(view.messages.filter("agent_id = ''"), "msg_no")
    assert [m["role"] for m in msgs] == ["user", "claude", "user", "claude"]
    first = msgs[1]
    assert first["content"] == "hi\ndone" and first["thinking_count"] == 1 and first["tool_call_count"] == 2
    assert first["duration_ms"] == 9000 and first["tokens_raw"] == 12 and first["context_tokens"] == 5
    assert first["output_count"] == 2 and first["model"] == "sonnet4"
    items = collect(view.items.drop("tool_input").filter("agent_id = ''"), "chunk_no", "ord")
    kinds = [(i["item_type"], i["tool_name"], i["tool_summary"]) for i in items]
    assert kinds == [
        ("Thinking", "", ""), ("Output", "", ""), ("ToolCall", "Read", "b/c.py - lines 1-5"),
        ("Subagent", "Agent", "dig"), ("Output", "", ""), ("ToolCall", "Skill", "fmt"), ("Subagent", "Agent", ""),
    ]
    read = items[2]
    assert read["tool_result"] == "data" and read["duration_ms"] == 2000 and not read["is_deferred"]
    assert items[3]["tool_result"] == "found\nit"
    assert items[5]["is_deferred"] and not items[5]["is_orphan"]
    assert items[6]["is_orphan"] and items[6]["subagent_desc"] == "orphan prompt"
    assert collect(view.ongoing) == [{"session_id": "proj/S", "ongoing": True}]
    deep = ongoing.subagent_ongoing_deep(view.processes.selectExpr("session_id", "agent_id", "agent_id = 'x2' as ongoing"), view.edges)
    assert {d["agent_id"]: d["ongoing_deep"] for d in collect(deep)} == {"x1": True, "x2": True, "x3": False}
    linked = messages.attach_subagents(view.items, view.edges, view.processes, deep)
    shown = {i["tool_id"]: i for i in collect(linked.drop("tool_input")) if i["proc_id"]}
    assert shown["t2"]["proc_id"] == "x1" and shown["t2"]["subagent_ongoing"]
    assert shown["t9"]["subagent_desc"] == "inner"
    nest = collect(messages.nested_transcripts(view.edges), "root_tool", "depth")
    assert [(n["root_tool"], n["depth"], n["agent_id"]) for n in nest] == [("orphan-x3", 1, "x3"), ("t2", 1, "x1"), ("t2", 2, "x2")]
    last = collect(chunks.last_output(view.items), "agent_id", "chunk_no")
    assert [(x["agent_id"], x["output_type"]) for x in last] == [
        ("", "Text"), ("", "ToolCalls"), ("x1", "ToolCalls"), ("x2", "Text"), ("x3", "Text"),
    ]
    modes = {m["agent_id"]: m["permission_mode"] for m in collect(chunks.last_permission_mode(view.msgs))}
    assert modes[""] == "plan"
