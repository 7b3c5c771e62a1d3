"""Teams, project tree, debug log and picker on small hand-made rows."""

from conftest import assistant, call, collect, lines_frame, txt, user
from pyspark.sql import functions as F

from turnweave.operators import chunks, classify, debug, messages, picker, projects, subagents, teams, usage
from turnweave.operators.entries import parse_entries
from turnweave.plans.runtime import stage


def items_of(spark, rows, sid="s", agent=""):
    entries = parse_entries(lines_frame(spark, {(sid, agent): rows}))
    msgs = stage(chunks.assign_chunks(stage(classify.classify(entries, subagents=True))))
    return stage(chunks.build_items(stage(classify.explode_blocks(msgs))))


def test_team_board(spark):
    calls = [
        call("0", "TaskCreate", subject="before any team"),
        call("1", "TeamCreate", team_name="T", description="d"),
        call("2", "TaskUpdate", taskId="1", status="too early"),
        call("3", "TaskCreate", subject="one"),
        call("4", "Agent", name="w", team_name="T", prompt="p"),
        call("5", "TaskUpdate", taskId="1", status="active", subject="uno"),
        call("6", "TeamDelete"),
        call("7", "TaskUpdate", taskId="1", status="no team"),
        call("8", "TeamCreate", team_name="T"),
        call("9", "TaskCreate", subject="two"),
    ]
    lead = items_of(spark, [assistant("a", calls)])
    worker = items_of(spark, [assistant("b", [call("x", "TaskUpdate", taskId="1", status="done")])], agent="w1")
    procs = spark.createDataFrame(
        [("s", "w1", "w@T", "red", False, None)],
        "session_id string, agent_id string, proc_id string, teammate_color string, is_team boolean, start_time timestamp",
    )
    board = collect(teams.teams(lead, segment=3), "team_no")
    assert [(t["team_no"], t["name"], t["description"], t["deleted"]) for t in board] == [(1, "T", "d", True), (2, "T", "", False)]
    tasks = collect(teams.team_tasks(lead, procs, worker, segment=3), "team_no")
    assert [(t["team_no"], t["task_id"], t["subject"], t["status"], t["owner"]) for t in tasks] == [
        (1, "1", "uno", "done", "w"), (2, "1", "two", "pending", ""),
    ]
    assert [(m["team_no"], m["member"]) for m in collect(teams.team_members(lead))] == [(1, "w")]
    verdicts = spark.createDataFrame([("s", "w1", True)], "session_id string, agent_id string, chunks_ongoing boolean")
    state = collect(teams.member_state(teams.teams(lead), procs, verdicts), "team_no")
    assert [(m["team_no"], m["color"], m["ongoing"]) for m in state] == [(1, "red", True), (2, "red", True)]


def test_team_worker_sessions(spark):
    lead = [assistant("a", [call("1", "Agent", name="bob", team_name="T", prompt="p")])]
    bob = [user("u", "x"), user("v", "y", agentName="bob", teamName="T")]
    eve = [user("w", "y", agentName="eve", teamName="T")]
    entries = parse_entries(lines_frame(spark, {("lead", ""): lead, ("bob", ""): bob, ("eve", ""): eve}))
    workers = stage(subagents.team_workers(entries, items_of(spark, lead, "lead")))
    got = collect(workers)
    assert [(r["session_id"], r["worker_session"], r["agent_name"]) for r in got] == [("lead", "bob", "bob")]
    keys = {(r["session_id"], r["agent_id"]) for r in subagents.process_entries(entries, workers).collect()}
    assert keys == {("lead", "team:bob")}
    warm = parse_entries(lines_frame(spark, {("s", "w"): [user("1", "Warmup")], ("s", "x"): [user("2", "go")]}))
    assert {r["agent_id"] for r in subagents.process_entries(warm).collect()} == {"x"}


def session(sid, key, origin, ongoing=False, fork=None, day=1):
    return (sid, f"/h/.claude/projects/{key}/{sid}.jsonl", day, ongoing, fork, origin)


def test_project_tree(spark):
    rows = [
        session("a", "-w-app", "/w/app", day=3),
        session("b", "-w-app--claude-worktrees-fix", "/w/fix", ongoing=True),
        session("c", "-w-app-svc--worktrees-t1", "/w/t1"),
        session("d", "-w-lone--worktrees-z", "/w/z"),
        session("e", "-other", "/w/other", fork="a"),
        session("f", "-x", "/x", fork="g"),
        session("g", "-y", "/y", fork="f"),
        session("h", "-z", "/z", fork="f"),
    ]
    df = spark.createDataFrame(rows, "session_id string, path string, day int, is_ongoing boolean, forked_from_session_id string, origin_dir string")
    df = df.selectExpr("*", "timestamp_seconds(day * 86400) as mtime", "'' as cwd")
    roots = {r["session_id"]: r["root_id"] for r in collect(projects.fork_root(df))}
    assert roots == {"a": "a", "b": "b", "c": "c", "d": "d", "e": "a", "f": "f", "g": "g", "h": "f"}
    nodes = {n["key"]: (n["name"], n["session_count"]) for n in collect(projects.project_nodes(df))}
    assert nodes["-w-app"] == ("app", 2) and nodes["-x"] == ("x", 2) and "-other" not in nodes
    flat = [(r["name"], r["depth"], r["count"], r["is_group"], r["has_children"]) for r in projects.flat_items(df).collect()]
    assert flat == [
        ("All Projects", 0, 8, False, False),
        ("app", 0, 2, False, True),
        ("claude-worktrees", 1, 1, True, True),
        ("fix", 2, 1, False, False),
        ("svc", 1, 1, False, True),
        ("worktrees", 2, 1, True, True),
        ("t1", 3, 1, False, False),
        ("lone", 0, 0, False, True),
        ("worktrees", 1, 1, True, True),
        ("z", 2, 1, False, False),
        ("x", 0, 2, False, False),
        ("y", 0, 1, False, False),
    ]
    closed = [r["name"] for r in projects.flat_items(df, ["-w-app", "__group:worktrees:-w-lone"]).collect()]
    assert closed == ["All Projects", "app", "lone", "worktrees", "x", "y"]


def test_debug_log(spark):
    head = "2026-01-01T00:00:0{}.000Z [{}] {}"
    raw = [
        "stray", head.format(0, "WARN", "[net] slow"), head.format(1, "DEBUG", "[net] slow"), head.format(2, "WARN", "[other] slow"),
        head.format(3, "WARN", "slow"), "  at x", "", "  at y", head.format(4, "ERROR", "slow"),
        head.format(5, "DEBUG", "Hook PreToolUse:Bash (PreToolUse) success:"), "ran", head.format(6, "DEBUG", "Hook Stop (Stop) error:"),
    ]
    lines = spark.createDataFrame([("s", i, v) for i, v in enumerate(raw)], "session_id string, line_no bigint, value string")
    entries = stage(debug.parse_debug(lines, segment=3))
    got = collect(entries, "entry_line")
    assert [(e["level"], e["category"], e["message"], e["extra"], e["line_num"]) for e in got][:4] == [
        ("WARN", "net", "slow", "", 2), ("DEBUG", "net", "slow", "", 3), ("WARN", "other", "slow", "", 4), ("WARN", "", "slow", "  at x\n  at y", 5),
    ]
    warn = debug.collapse_duplicates(debug.filter_level(entries, "WARN"), segment=3)
    assert [(e["entry_line"], e["entry_count"]) for e in collect(warn, "entry_line")] == [(1, 2), (4, 1), (8, 1)]
    assert [e["entry_line"] for e in collect(debug.filter_text(entries, "AT Y"))] == [4]
    hooks = stage(debug.debug_hooks(entries))
    assert [(h["hook_event"], h["hook_name"], h["hook_command"]) for h in collect(hooks)] == [("PreToolUse", "Bash", "ran")]
    msgs = stage(classify.classify(parse_entries(lines_frame(spark, {
        ("s", ""): [user("1", "late", timestamp="2026-01-01T00:00:09Z"), user("2", "early", timestamp="2026-01-01T00:00:01Z")],
        ("t", ""): [user("3", "late", timestamp="2026-01-01T00:00:09Z"), user("4", "early", timestamp="2026-01-01T00:00:01Z")],
    }))))
    merged = collect(debug.merge_hooks(msgs, hooks).drop("blocks"), "session_id", "line_no")
    assert [(m["session_id"], m["kind"], m["text"]) for m in merged] == [
        ("s", "user", "early"), ("s", "hook", ""), ("s", "user", "late"), ("t", "user", "late"), ("t", "user", "early"),
    ]


def test_orphan_and_deferred_calls(spark):
    rows = [
        assistant("1", [call("a", "Bash"), call("a", "Bash"), call("b", "Bash")]), user("2", "go on"),
        assistant("3", [call("c", "Bash"), {"type": "thinking", "thinking": ""}, txt("")]),
        user("4", [{"type": "tool_result", "tool_use_id": "b", "content": "late"}]),
    ]
    staged = items_of(spark, rows)
    items = collect(staged.drop("tool_input"), "ord")
    assert [(i["tool_id"], i["item_type"], i["is_orphan"], i["is_deferred"]) for i in items] == [
        ("a", "ToolCall", False, False), ("a", "ToolCall", True, False), ("b", "ToolCall", True, False),
        ("c", "ToolCall", False, True), ("", "Output", False, False), ("", "Output", False, False),
    ]
    numbered = collect(chunks.number_items(staged).drop("tool_input"), "ord")
    assert [i["item_no"] for i in numbered] == [0, 1, 2, 0, 1, 2]


def test_churn_and_picker(spark):
    edits = items_of(spark, [assistant("1", [call("e", "Edit", file_path="f", old_string="a\nb\nb", new_string="b\nc"), call("x", "Edit", file_path="f")])])
    row = collect(usage.edit_churn(edits))[0]
    assert (row["edits"], row["removed"], row["added"], row["kept"]) == (1, 2, 1, 1)
    df = spark.createDataFrame([("s1", "Hello", None, "m", 5), ("s2", "", "r", "Opus", 1)], "session_id string, first_message string, recap string, model string, d int")
    df = df.selectExpr("*", "timestamp_seconds(d * 86400) as mtime")
    assert [r["session_id"] for r in collect(picker.search_sessions(df, "OPUS"))] == ["s2"]
    groups = picker.group_by_date(df, F.timestamp_seconds(F.lit(6 * 86400 + 60)))
    assert [(r["session_id"], r["date_group"]) for r in groups.collect()] == [("s1", "Yesterday"), ("s2", "This Week")]
    assert [r["title"] for r in collect(picker.session_title(df), "session_id")] == ["Hello", "s2"]
    msgs = spark.createDataFrame([("s", "", i, "user") for i in range(5)], "session_id string, agent_id string, msg_no bigint, role string")
    assert [r["msg_no"] for r in collect(messages.page(msgs, 3, 10), "msg_no")] == [3, 4]
    assert messages.page(msgs, 9, 2).count() == 0
    assert [len(r["roles"]) for r in collect(messages.roles(msgs, 2), "page_no")] == [2, 2, 1]
