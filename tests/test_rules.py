"""Parsing, classification and text rules on small hand-made lines."""

from conftest import assistant, call, collect, lines_frame, result, txt, user
from pyspark.sql import functions as F

from turnweave.functions import display, jsonx, text, tools
from turnweave.operators import catalogue, classify, entries as en


def parsed(spark, rows):
    return en.parse_entries(lines_frame(spark, {("s", ""): rows}))


def test_bad_lines(spark):
    rows = [
        "nonsense", '{"type":"user","uuid":"cut"', {"uuid": "no-type"}, {"type": "user"}, {"type": "x", "leafUuid": "l"},
        {"type": "user", "uuid": "flag", "isMeta": "yes"},
        '{"type":"assistant","uuid":"n","message":{"content":[{"type":"text","text":"abcdefgh"}],"usage":null}}',
        '{"type":"user","uuid":"sur","message":{"role":"user","content":"a\\\\ud83d b \\\\ud83d\\\\ude00 \\\\ude00"}}'.replace("\\\\", "\\"),
    ]
    got = {r["line_no"]: r for r in collect(parsed(spark, rows).drop("content", "blocks", "top_content", "tool_use_result", "data", "attachment", "hook_infos", "hook_specific_output"))}
    assert sorted(got) == [2, 3, 4, 5, 6, 7]
    assert {i for i in got if got[i]["is_entry"]} == {4, 6, 7}
    assert got[6]["has_usage"] and got[6]["input_tokens"] == 0
    assert got[7]["text"] == "a� b \U0001f600 �"
    tokens = collect(catalogue.token_rows(parsed(spark, rows)))
    assert [t["output_tokens"] for t in tokens] == [2]  # estimated from eight bytes


def test_classification(spark):
    denial = {"type": "permission-denial", "uuid": "d", "reason": "no", "toolName": "Bash"}
    rows = [
        (user("1", "<command-name>/go</command-name><command-args>now</command-args>"), ("user", "/go now")),
        (user("2", "<local-command-stdout> out </local-command-stdout>"), ("system", "out")),
        (user("3", "<bash-stdout></bash-stdout><bash-stderr>bad</bash-stderr>"), ("system", "")),
        (user("4", "<task-notification><status>failed</status><summary>it broke</summary></task-notification>"), ("system", "it broke")),
        (user("5", "<system-reminder>x</system-reminder>"), None),
        (user("6", "<system-reminder>x</system-reminder>real text"), ("user", "real text")),
        (user("7", "<local-command-caveat>c</local-command-caveat>"), None),
        (user("8", "[Request interrupted by user]"), None),
        (user("9", "Stop hook feedback:\n[a.sh]: too slow", isMeta=True), ("hook", "")),
        (user("10", "meta", isMeta=True), None),
        (user("11", '<teammate-message teammate_id="bob" color="red">hey</teammate-message>'), ("teammate", "hey")),
        (user("12", '<teammate-message teammate_id="bob">{"type": "idle_notification"}</teammate-message>'), None),
        (user("13", "Tool loaded.", toolUseResult={"matches": ["A", "B"]}), ("system", "Loaded: A, B")),
        (user("14", "sum", isCompactSummary=True), ("compact", "sum")),
        ({"type": "summary", "leafUuid": "x", "summary": "S"}, ("compact", "S")),
        ({"type": "system", "uuid": "15", "subtype": "away_summary", "content": "R"}, ("compact", "R")),
        ({"type": "system", "uuid": "16", "subtype": "stop_hook_summary", "hookCount": 1, "hookInfos": [{"command": "c"}]}, ("hook", "")),
        ({"type": "system", "uuid": "17", "subtype": "other"}, None),
        ({"type": "progress", "uuid": "18", "data": {"type": "hook_progress", "hookEvent": "PreToolUse", "hookName": "n", "command": "cmd"}}, ("hook", "")),
        ({"type": "progress", "uuid": "19", "data": {"type": "permission_denial", "reason": "r"}}, ("system", "Auto-mode denial: r")),
        ({"type": "progress", "uuid": "20", "toolUseId": "t", "seq": 1}, None),
        ({"type": "attachment", "uuid": "21", "attachment": {"hookEvent": "Stop2", "hookName": "h", "stderr": {"path": "/f", "preview": " p "}}}, ("hook", "")),
        (denial, ("system", 'Auto-mode denial: tool "Bash" — no')),
        (assistant("22", [txt("hi")], model="<synthetic>"), None),
        (assistant("23", []), None),
        (assistant("24", [txt("a"), {"type": "image"}, txt("b")]), ("ai", "a\n[Image attached]\nb")),
        (user("25", [result("t", "x"), txt("and text")]), ("user", "and text")),
        (user("26", [result("t", "x")]), ("ai", "")),
        (user("27", [{"type": "diagnostics"}]), ("user", "[Attachment: diagnostics]")),
        ({"type": "rate_limit_event", "uuid": "28"}, None),
        (user("29", '<cross-session-message from="x" from-name="Al">\nyo\n</cross-session-message>'), ("user", "[Al]: yo")),
        (user("30", "side", isSidechain=True), None),
    ]
    msgs = classify.classify(parsed(spark, [r for r, _ in rows])).drop("blocks")
    got = {m["line_no"]: m for m in collect(msgs)}
    for i, (row, want) in enumerate(rows):
        assert (got[i]["kind"], got[i]["text"]) == want if want else i not in got, (i, row, got.get(i))
    by = {rows[i][0].get("uuid"): m for i, m in got.items()}
    assert by["3"]["is_error"] and by["4"]["is_error"] and not by["2"]["is_error"]
    assert (by["9"]["hook_name"], by["9"]["hook_command"]) == ("a.sh", "too slow")
    assert (by["16"]["hook_name"], by["18"]["hook_command"]) == ("c", "cmd")
    assert (by["21"]["hook_command"], by["21"]["hook_output_path"]) == ("p", "/f")
    assert (by["11"]["teammate_id"], by["11"]["teammate_color"]) == ("bob", "red")
    audit = {r["rule"]: (r["lines"], r["dropped"]) for r in collect(classify.noise_audit(parsed(spark, [r for r, _ in rows])))}
    assert audit["noise_type"] == (2, True) and audit["user"] == (5, False)
    same = {"type": "summary", "leafUuid": "x", "summary": "S"}
    twice = [same, same, {**same, "agentName": "b"}, {**same, "agentName": "b"}]
    assert [r["line_no"] for r in collect(classify.dedup_summaries(parsed(spark, twice)).select("line_no"), "line_no")] == [0, 2]


SUMMARIES = [
    ("Read", {"file_path": "/a/b/c"}, "b/c"), ("Read", {"file_path": "/a/b/c", "limit": 3, "offset": 5}, "b/c - lines 5-7"), ("Read", {}, "Read"),
    ("Write", {"file_path": "c", "content": "1\n2\n3"}, "c - 3 lines"), ("Edit", {"file_path": "c", "old_string": "a", "new_string": "b"}, "c - 1 line"),
    ("Edit", {"file_path": "c", "old_string": "a\nb", "new_string": "b"}, "c - 2 -> 1 lines"), ("Bash", {"description": "d", "command": "x"}, "d: x"),
    ("Bash", {"command": ["ls", "-l"]}, '["ls","-l"]'), ("Grep", {"pattern": "p", "glob": "*.c", "path": "/x"}, '"p" in *.c'), ("Grep", {"pattern": "p", "path": "/x/y/"}, '"p" in y'),
    ("Glob", {"pattern": "*"}, '"*"'), ("Task", {"prompt": "go", "subagentType": "T"}, "T - go"), ("LSP", {"operation": "def", "filePath": "/a/b.c"}, "def - b.c"),
    ("WebFetch", {"url": "https://h.io:80/p?q"}, "h.io/p?q"), ("WebFetch", {"url": "plain"}, "plain"), ("WebSearch", {"query": "q"}, '"q"'),
    ("TodoWrite", {"todos": [1]}, "1 item"), ("TodoWrite", {"todos": "[1, 2]"}, "2 items"), ("NotebookEdit", {"notebook_path": "/n.ipynb", "edit_mode": "insert"}, "insert - n.ipynb"),
    ("TaskCreate", {"subject": "s"}, "s"), ("TaskUpdate", {"taskId": "1", "owner": "o"}, "#1 -> o"), ("SendMessage", {"type": "broadcast", "summary": "s"}, "Broadcast: s"),
    ("SendMessage", {"recipient": "r", "summary": "s"}, "To r: s"), ("SendMessage", {"type": "shutdown_response"}, "Shutdown response"), ("ToolSearch", {"query": "q"}, "q"),
    ("CronCreate", {"prompt": "p", "cron": "* *"}, "p (* *)"), ("CronDelete", {"id": "7"}, "Delete job 7"), ("CronList", {}, "List scheduled jobs"), ("TaskList", {}, "List tasks"),
    ("TaskGet", {"taskId": "3"}, "Get task #3"), ("TaskStop", {}, "Stop task"), ("TaskOutput", {"taskId": "3"}, "Output of #3"), ("TeamCreate", {"name": "n"}, "n"),
    ("TeamDelete", {}, "Delete team"), ("AskUserQuestion", {"questions": [{"header": "", "question": "why"}]}, "why"), ("Skill", {"skill": "k"}, "k"),
    ("Monitor", {"command": "c"}, "c"), ("ExitPlanMode", {"plan": "p"}, "ExitPlanMode"), ("Cd", {"path": "/a/b/c"}, "b/c"), ("mcp__s__do_it", {"query": "q"}, "do it - q"),
    ("mcp__s__do_it", {"b": "B", "a": 1, "ab": "AB"}, "do it - AB"), ("mcp__s__do_it", {}, "do it"), ("mcp____x", {"query": "q"}, "mcp____x"), ("Odd", {"z": "Z", "y": "Y"}, "Y"),
    ("Odd", {"n": 1}, "Odd"), ("Bash", {"command": "x" * 70}, "x" * 59 + "…"),
]


def test_tool_summaries(spark):
    import json

    df = spark.createDataFrame([(i, n, json.dumps(v)) for i, (n, v, _) in enumerate(SUMMARIES)], "i int, name string, v string")
    v = jsonx.normalize_tool_input(F.parse_json("v"))
    got = collect(df.select("i", tools.tool_summary(F.col("name"), v).alias("s")), "i")
    for r in got:
        assert r["s"] == SUMMARIES[r["i"]][2], SUMMARIES[r["i"]]
    cats = collect(spark.createDataFrame([("PowerShell",), ("mcp__a__b",), ("X",), ("SendMessage",)], "n string").select("n", tools.tool_category(F.col("n")).alias("c"), tools.mcp_display(F.col("n")).alias("d")), "n")
    assert [(r["n"], r["c"], r["d"]) for r in cats] == [("PowerShell", "Bash", "PowerShell"), ("SendMessage", "Task", "SendMessage"), ("X", "Other", "X"), ("mcp__a__b", "Mcp", "MCP a")]


def test_labels(spark):
    one = spark.range(1)
    val = lambda c: one.select(c.alias("v")).first()["v"]
    assert [val(display.short_model(F.lit(m))) for m in ("claude-opus-4-6", "claude-fable-5-20261001[1m]", "gpt", "a-20260101")] == ["opus4.6", "fable5", "gpt", "a"]
    assert val(display.trim_branch_suffix(F.lit("app-feature-x"), F.lit("feature/X"))) == "app"
    assert val(display.trim_branch_suffix(F.lit("app-main"), F.lit("main"))) == "app-main"
    assert val(text.truncate_word(F.lit("aaaa bbbb cccc"), 8)) == "aaaa…"
    assert val(text.truncate_word(F.lit("a" * 50), 8)) == "aaaaaaa…"
    assert val(text.orphan_description(F.lit("Base directory for this skill: /x/fmt\nrest"))) == "fmt"
    assert val(display.worktree_kind(F.lit("-a"), F.lit("-a-worktrees-b"))) == "worktrees"
    assert val(display.worktree_leaf(F.lit("-a"), F.lit("-a--claude-worktrees-b-c"), F.lit("claude-worktrees"))) == "b-c"
    ts = en.parse_ts(F.lit("2026-01-01T01:00:00.5+01:00"))
    assert val(F.unix_millis(ts)) == 1767225600500 and val(en.parse_ts(F.lit("soon"))) is None


def test_ongoing_scan(spark):
    approve = call("x", "SendMessage", type="shutdown_response", approve=True)
    cases = {
        "call": ([assistant("a", [call("t", "Bash")])], True),
        "answered": ([assistant("a", [call("t", "Bash")]), user("b", [result("t", "r")])], True),
        "text": ([assistant("a", [call("t", "Bash")]), assistant("b", [txt("done")])], False),
        "plan": ([assistant("a", [call("t", "ExitPlanMode")])], False),
        "approved": ([assistant("a", [approve]), user("b", [result("x", "ok")])], False),
        "rejected": ([assistant("a", [call("t", "Bash")]), user("b", [result("t", "r")], toolUseResult="User rejected tool use")], False),
        "stopped": ([assistant("a", [call("t", "Bash")]), user("b", "[Request interrupted by user]")], False),
        "again": ([assistant("a", [txt("x")]), assistant("b", [{"type": "thinking", "thinking": "y"}])], True),
        "inherited": ([assistant("a", [call("t", "Bash")], forkedFrom={})], None),
    }
    df = en.parse_entries(lines_frame(spark, {(n, ""): rows for n, (rows, _) in cases.items()}))
    got = {r["session_id"]: r["is_ongoing"] for r in collect(catalogue.scan_ongoing(df))}
    assert {n: got.get(n) for n in cases} == {n: want for n, (_, want) in cases.items()}
