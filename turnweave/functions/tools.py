"""Tool names: categories, MCP parts and one-line call summaries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .jsonx import field, first_string_value, get_display_str, get_num, get_str, is_object
from .text import truncate

# Category of each known tool.
CATEGORIES = {
    "Read": ["Read"],
    "Edit": ["Edit"],
    "Write": ["Write", "NotebookEdit"],
    "Bash": ["Bash", "PowerShell"],
    "Grep": ["Grep"],
    "Glob": ["Glob"],
    "Task": [
        "Task", "Agent", "TaskCreate", "TaskUpdate", "TaskList", "TaskGet", "TaskStop", "TaskOutput",
        "TeamCreate", "TeamDelete", "SendMessage",
    ],
    "Tool": [
        "Skill", "ToolSearch", "LSP", "TodoWrite", "Monitor", "AskUserQuestion", "ListMcpResourcesTool",
        "ReadMcpResourceTool", "EnterPlanMode", "ExitPlanMode", "EnterWorktree", "ExitWorktree", "Cd",
    ],
    "Web": ["WebFetch", "WebSearch"],
    "Cron": ["CronCreate", "CronDelete", "CronList"],
}
# Input fields that describe an MCP call, and those of any other unknown tool.
MCP_KEYS = [
    "url", "query", "selector", "expression", "fileKey", "nodeId", "issue_key", "page_url", "description",
    "prompt", "name", "path", "file", "command",
]
DEFAULT_KEYS = ["name", "path", "file", "query", "command"]
MCP_PATTERN = r"(?s)^mcp__(.+?)__(.+)\z"


def tool_category(name: Column) -> Column:
    expr = F.when(name.startswith("mcp__"), "Mcp")
    for category, names in CATEGORIES.items():
        expr = expr.when(name.isin(names), category)
    return expr.otherwise("Other")


def mcp_parts(name: Column) -> Column:
    """Struct (server, tool) of an MCP tool name; NULL for other names."""
    # an empty server name must not be skipped over: "mcp____x" is not an MCP name
    ok = name.rlike(MCP_PATTERN) & ~name.startswith("mcp____")
    return F.when(
        ok,
        F.struct(
            F.regexp_extract(name, MCP_PATTERN, 1).alias("server"), F.regexp_extract(name, MCP_PATTERN, 2).alias("tool")
        ),
    )


def mcp_display(name: Column) -> Column:
    return F.coalesce(F.concat(F.lit("MCP "), mcp_parts(name)["server"]), name)


def short_path_n(path: Column, n: int) -> Column:
    """Last n parts of a path."""
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda p: p != "")
    return F.array_join(F.slice(parts, F.greatest(F.size(parts) - n + 1, F.lit(1)), F.lit(n)), "/")


def file_base(path: Column) -> Column:
    """File name of a path; the path itself when it has none."""
    bare = F.regexp_replace(path, r"(/+\.?)+\z", "")
    last = F.element_at(F.split(bare, "/"), -1)
    return F.when((last == "") | (last == ".."), path).otherwise(last)


def line_count(s: Column) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit("\n"), F.lit(""))) + 1


def _first(*options: tuple[Column, Column], default: Column | str) -> Column:
    expr = F
    for cond, value in options:
        expr = expr.when(cond, value)
    return expr.otherwise(default)


# Input fields the summaries read: as strings only, as text of any type, and as numbers.
STRING_ARGS = [
    "content", "cron", "description", "edit_mode", "filePath", "id", "label", "new_string", "notebook_path", "old_string",
    "operation", "owner", "pattern", "query", "recipient", "skill", "status", "subagentType", "subject", "summary", "taskId", "type",
    *[k for k in MCP_KEYS if k not in ("query", "description")],
]
DISPLAY_ARGS = ["file_path", "command", "glob"]
NUMBER_ARGS = ["limit", "offset"]


def tool_args(v: Column) -> Column:
    """The input fields of ``tool_summary``, each read once."""
    return F.struct(
        *[get_str(v, f"$.{k}").alias(f"s_{k}") for k in STRING_ARGS],
        *[get_display_str(v, f"$.{k}").alias(f"d_{k}") for k in DISPLAY_ARGS],
        *[get_num(v, f"$.{k}").alias(f"n_{k}") for k in NUMBER_ARGS],
    )


def tool_summary(name: Column, v: Column, args: Column | None = None) -> Column:
    """One-line description of a tool call from its input.

    ``args``: a column that holds ``tool_args(v)``; worth a step of its own on large inputs. Without it, input
    and fields are bound to lambda variables, so that the plan holds ``v`` once.
    """
    if args is not None:
        return _summary(name, v, args)
    bound = F.transform(F.array(v), lambda x: F.get(F.transform(F.array(tool_args(x)), lambda a: _summary(name, x, a)), 0))
    return F.get(bound, 0)


def _summary(name: Column, v: Column, args: Column) -> Column:
    g = lambda k: args[f"s_{k}"] if k in STRING_ARGS else get_str(v, f"$.{k}")
    d = lambda k: args[f"d_{k}"]
    cat = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    has = lambda c: c != ""

    short = short_path_n(d("file_path"), 2)
    limit = args["n_limit"]
    offset = F.when(args["n_offset"] == 0, F.lit(1)).otherwise(args["n_offset"])
    span = cat(short, " - lines ", offset.cast("string"), "-", (offset + limit - 1).cast("string"))
    with_file = lambda tool, rest: F.when(d("file_path") == "", tool).otherwise(rest)
    old_n, new_n = line_count(g("old_string")), line_count(g("new_string"))
    edit = _first(
        ((g("old_string") == "") | (g("new_string") == ""), short),
        (old_n == new_n, cat(short, " - ", old_n.cast("string"), F.when(old_n > 1, " lines").otherwise(" line"))),
        default=cat(short, " - ", old_n.cast("string"), " -> ", new_n.cast("string"), " lines"),
    )
    desc, cmd = g("description"), d("command")
    bash = _first(
        (has(desc) & has(cmd), truncate(cat(desc, ": ", cmd), 60)),
        (has(desc), truncate(desc, 60)),
        (has(cmd), truncate(cmd, 60)),
        default="Bash",
    )
    quoted = cat('"', truncate(g("pattern"), 30), '"')
    in_path = F.when(has(g("path")), cat(quoted, " in ", file_base(g("path")))).otherwise(quoted)
    grep = _first((g("pattern") == "", F.lit("Grep")), (has(d("glob")), cat(quoted, " in ", d("glob"))), default=in_path)
    glob = F.when(g("pattern") == "", "Glob").otherwise(in_path)
    task_desc = F.when(has(desc), desc).otherwise(g("prompt"))
    kind = g("subagentType")
    task = _first(
        (has(task_desc) & has(kind), cat(kind, " - ", truncate(task_desc, 40))),
        (has(task_desc), truncate(task_desc, 40)),
        (has(kind), kind),
        default="Task",
    )
    op, lsp_file = g("operation"), g("filePath")
    lsp = _first((op == "", F.lit("LSP")), (has(lsp_file), cat(op, " - ", file_base(lsp_file))), default=op)
    url = g("url")
    after = F.regexp_extract(url, r"(?s)\A.*?://(.*)\z", 1)
    host = F.regexp_extract(after, r"(?s)\A([^/:]*)", 1)
    url_path = F.regexp_extract(after, r"(?s)\A[^/]*(/.*)?\z", 1)
    fetch = _first(
        (url == "", F.lit("WebFetch")),
        (url.contains("://") & has(host), truncate(cat(host, url_path), 50)),
        default=truncate(url, 50),
    )
    query = g("query")
    todos = F.try_variant_get(v, "$.todos", "array<variant>")
    todo = F.when(
        F.schema_of_variant(field(v, "$.todos")).startswith("ARRAY"),
        cat(F.size(todos).cast("string"), F.when(F.size(todos) == 1, " item").otherwise(" items")),
    ).otherwise("TodoWrite")
    book = g("notebook_path")
    notebook = _first(
        (book == "", F.lit("NotebookEdit")),
        (has(g("edit_mode")), cat(g("edit_mode"), " - ", file_base(book))),
        default=file_base(book),
    )
    update = F.array_join(
        F.array_compact(
            F.array(
                F.when(has(g("taskId")), cat("#", g("taskId"))),
                F.when(has(g("status")), g("status")),
                F.when(has(g("owner")), cat("-> ", g("owner"))),
            )
        ),
        " ",
    )
    to, note, kind_msg = g("recipient"), truncate(g("summary"), 30), g("type")
    send = _first(
        ((kind_msg == "shutdown_request") & has(to), cat("Shutdown ", to)),
        (kind_msg == "shutdown_response", F.lit("Shutdown response")),
        (kind_msg == "broadcast", cat("Broadcast: ", note)),
        (has(to), cat("To ", to, ": ", note)),
        default="Send message",
    )
    prompt, cron = g("prompt"), g("cron")
    cron_create = _first(
        (has(prompt) & has(cron), cat(truncate(prompt, 40), " (", cron, ")")),
        (has(prompt), truncate(prompt, 50)),
        (has(cron), cron),
        default="Create cron job",
    )
    header, question = get_str(v, "$.questions[0].header"), get_str(v, "$.questions[0].question")
    ask = _first((has(header), truncate(header, 50)), (has(question), truncate(question, 50)), default="Ask user")
    words = F.replace(mcp_parts(name)["tool"], F.lit("_"), F.lit(" "))
    mcp_detail = F.coalesce(*[F.nullif(g(k), F.lit("")) for k in MCP_KEYS], first_string_value(v))
    mcp = _first(
        (words.isNull(), name),
        (mcp_detail.isNotNull(), cat(words, " - ", truncate(mcp_detail, 40))),
        default=words,
    )
    common = F.coalesce(*[F.nullif(g(k), F.lit("")) for k in DEFAULT_KEYS])
    other = F.coalesce(truncate(common, 50), truncate(first_string_value(v), 40), name)
    or_text = lambda key, template, default: F.when(has(g(key)), template(g(key))).otherwise(default)

    return (
        F.when(~is_object(v) | v.isNull(), name)
        .when(name == "Read", with_file("Read", F.when(limit > 0, span).otherwise(short)))
        .when(
            name == "Write",
            with_file(
                "Write",
                F.when(has(g("content")), cat(short, " - ", line_count(g("content")).cast("string"), " lines")).otherwise(short),
            ),
        )
        .when(name == "Edit", with_file("Edit", edit))
        .when(name == "Bash", bash)
        .when(name == "Grep", grep)
        .when(name == "Glob", glob)
        .when(name.isin("Task", "Agent"), task)
        .when(name == "LSP", lsp)
        .when(name == "WebFetch", fetch)
        .when(name == "WebSearch", F.when(query == "", "WebSearch").otherwise(cat('"', truncate(query, 40), '"')))
        .when(name == "TodoWrite", todo)
        .when(name == "NotebookEdit", notebook)
        .when(name == "TaskCreate", or_text("subject", lambda x: truncate(x, 50), "Create task"))
        .when(name == "TaskUpdate", F.when(has(update), update).otherwise("Update task"))
        .when(name == "SendMessage", send)
        .when(name == "ToolSearch", or_text("query", lambda x: truncate(x, 50), "ToolSearch"))
        .when(name == "CronCreate", cron_create)
        .when(name == "CronDelete", or_text("id", lambda x: cat("Delete job ", x), "Delete cron job"))
        .when(name == "CronList", "List scheduled jobs")
        .when(name == "TaskList", "List tasks")
        .when(name == "TaskGet", or_text("taskId", lambda x: cat("Get task #", x), "Get task"))
        .when(name == "TaskStop", or_text("taskId", lambda x: cat("Stop task #", x), "Stop task"))
        .when(name == "TaskOutput", or_text("taskId", lambda x: cat("Output of #", x), "Task output"))
        .when(name == "TeamCreate", or_text("name", lambda x: truncate(x, 50), "Create team"))
        .when(name == "TeamDelete", or_text("name", lambda x: cat("Delete ", x), "Delete team"))
        .when(name == "AskUserQuestion", ask)
        .when(name == "Skill", or_text("skill", lambda x: x, "Skill"))
        .when(
            name == "Monitor",
            _first((has(g("label")), g("label")), (has(g("command")), truncate(g("command"), 60)), default="Monitor"),
        )
        .when(name.isin("EnterPlanMode", "ExitPlanMode", "EnterWorktree", "ExitWorktree"), name)
        .when(name == "Cd", or_text("path", lambda x: short_path_n(x, 2), "Cd"))
        .when(name.startswith("mcp__"), mcp)
        .otherwise(other)
    )


def is_shutdown_approval(name: Column, v: Column) -> Column:
    """A message that approves a shutdown request."""
    approved = (get_str(v, "$.type") == "shutdown_response") & F.coalesce(
        (F.schema_of_variant(field(v, "$.approve")) == "BOOLEAN") & F.try_variant_get(v, "$.approve", "boolean"), F.lit(False)
    )
    loose = F.coalesce(F.to_json(v).rlike(r'"approve"\s*:\s*true'), F.lit(False))
    return (name == "SendMessage") & (approved | loose)
