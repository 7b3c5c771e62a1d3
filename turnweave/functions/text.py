"""String rules of transcript texts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tags and markers of the transcript format.
STDOUT_TAG = "<local-command-stdout>"
STDERR_TAG = "<local-command-stderr>"
CAVEAT_TAG = "<local-command-caveat>"
REMINDER_TAG = "<system-reminder>"
BASH_STDOUT_TAG = "<bash-stdout>"
BASH_STDERR_TAG = "<bash-stderr>"
TASK_TAG = "<task-notification>"
INTERRUPTED = "[Request interrupted by user"
STOP_FEEDBACK = "Stop hook feedback:"
TEAMMATE_PATTERN = r'^<teammate-message\s+teammate_id="[^"]+"'
PROTOCOL_PATTERN = (
    r'^\s*\{\s*"type"\s*:\s*"(idle_notification|shutdown_approved|shutdown_request'
    r'|teammate_terminated|task_assignment)"'
)
PERSISTED_MARK = "<persisted-output>"
PERSISTED_PATH = r"(?m)Full output saved to:\s*(.+)$"


def utrim(c: Column) -> Column:
    """Trim all Unicode white space."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


def ltrim_ws(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+", "")


def starts(c: Column, *prefixes: str) -> Column:
    cond = F.lit(False)
    for p in prefixes:
        cond = cond | c.startswith(p)
    return cond


def tag_inner(c: Column, tag: str) -> Column:
    """Inner text of the first <tag>…</tag>, trimmed; NULL when the tag pair is absent."""
    pattern = rf"(?is)<{tag}>(.*?)</{tag}>"
    return F.when(c.rlike(pattern), utrim(F.regexp_extract(c, pattern, 1)))


def drop_tag(c: Column, tag: str) -> Column:
    return F.regexp_replace(c, rf"(?is)<{tag}>.*?</{tag}>", "")


def is_command_output(c: Column) -> Column:
    return starts(c, STDOUT_TAG, STDERR_TAG)


def extract_command_output(c: Column) -> Column:
    return F.coalesce(
        tag_inner(c, "local-command-stdout"), tag_inner(c, "local-command-stderr"), F.lit("")
    )


def extract_bash_output(c: Column) -> Column:
    return F.coalesce(tag_inner(c, "bash-stdout"), tag_inner(c, "bash-stderr"), F.lit(""))


def bash_failed(c: Column) -> Column:
    return F.coalesce(tag_inner(c, "bash-stderr"), F.lit("")) != ""


def extract_task_notification(c: Column) -> Column:
    bare = F.regexp_replace(utrim(F.regexp_replace(c, r"<[^>]+>", " ")), r"(?U)\s+", " ")
    return F.coalesce(tag_inner(c, "summary"), utrim(bare))


def task_failed(c: Column) -> Column:
    return F.coalesce(tag_inner(c, "status"), F.lit("")) == "failed"


def cross_session_text(c: Column) -> Column:
    """Unwrapped cross-session message with its sender's name; NULL for other texts."""
    pattern = r"(?s)^<cross-session-message\b[^>]*>\n?(.*?)\n?</cross-session-message>\z"
    inner = utrim(F.regexp_extract(c, pattern, 1))
    sender = utrim(F.regexp_extract(c, r'\bfrom-name="([^"]+)"', 1))
    named = F.when(sender != "", F.concat(F.lit("["), sender, F.lit("]: "), inner)).otherwise(inner)
    return F.when(c.rlike(pattern), named)


def command_name(c: Column) -> Column:
    """"/name" of a slash command; NULL when there is none."""
    pattern = r"<command-name>/([^<]+)</command-name>"
    return F.when(c.rlike(pattern), F.concat(F.lit("/"), utrim(F.regexp_extract(c, pattern, 1))))


def command_display(c: Column) -> Column:
    args = utrim(F.regexp_extract(c, r"<command-args>([^<]*)</command-args>", 1))
    name = command_name(c)
    return F.when(args != "", F.concat(name, F.lit(" "), args)).otherwise(name)


def sanitize_content(c: Column) -> Column:
    """Display form of a message text: command output, wrapper or slash command, else tags removed."""
    output = F.when(is_command_output(c), F.nullif(extract_command_output(c), F.lit("")))
    command = F.when(starts(c, "<command-name>", "<command-message>"), command_display(c))
    plain = c
    for tag in ("local-command-caveat", "system-reminder", "command-name", "command-message", "command-args"):
        plain = drop_tag(plain, tag)
    plain = F.regexp_replace(plain, r"(?is)<bash-input>(.*?)</bash-input>", "$1")
    cleaned = F.when(c.contains("<"), utrim(plain)).otherwise(utrim(c))
    # texts without any tag are the common case and skip the rules above
    return F.when(~c.contains("<"), utrim(c)).otherwise(
        F.coalesce(output, cross_session_text(c), command, cleaned)
    )


def is_pure_tag(c: Column, tag: str) -> Column:
    return c.startswith(tag) & c.endswith(tag.replace("<", "</"))


def teammate_id(c: Column) -> Column:
    return F.regexp_extract(c, r'teammate_id="([^"]+)"', 1)


def teammate_color(c: Column) -> Column:
    return F.regexp_extract(c, r'<teammate-message[^>]*\bcolor="([^"]+)"', 1)


def teammate_summary(c: Column) -> Column:
    return F.regexp_extract(c, r'<teammate-message[^>]*\bsummary="([^"]+)"', 1)


def teammate_content(c: Column) -> Column:
    pattern = r"(?s)<teammate-message[^>]*>(.*?)</teammate-message>"
    return F.when(c.rlike(pattern), utrim(F.regexp_extract(c, pattern, 1))).otherwise(c)


def is_teammate(c: Column) -> Column:
    return c.rlike(TEAMMATE_PATTERN)


def is_protocol(c: Column) -> Column:
    return c.rlike(PROTOCOL_PATTERN)


def hook_feedback(c: Column) -> tuple[Column, Column]:
    """(hook name, command) of a "Stop hook feedback" text that is already trimmed."""
    body = utrim(F.when(c.contains("\n"), F.regexp_replace(c, r"(?s)\A[^\n]*\n", "")).otherwise(""))
    pattern = r"(?s)\A\[(.*?)\]: (.*)\z"
    hit = body.rlike(pattern)
    name = F.when(hit, F.regexp_extract(body, pattern, 1)).otherwise("")
    command = F.when(hit, utrim(F.regexp_extract(body, pattern, 2))).otherwise(body)
    return name, command


def format_denial(reason: Column, tool: Column) -> Column:
    r, t = utrim(reason), utrim(tool)
    return (
        F.when((t == "") & (r == ""), F.lit("Auto-mode denial (no details)"))
        .when(t == "", F.concat(F.lit("Auto-mode denial: "), r))
        .when(r == "", F.concat(F.lit('Auto-mode denial: tool "'), t, F.lit('" not allowed')))
        .otherwise(F.concat(F.lit('Auto-mode denial: tool "'), t, F.lit('" — '), r))
    )


def truncate(c: Column, n: int) -> Column:
    """One line of at most n characters, with an ellipsis when cut."""
    line = F.replace(c, F.lit("\n"), F.lit(" "))
    return F.when(F.length(line) <= n, line).otherwise(F.concat(F.substring(line, 1, n - 1), F.lit("…")))


def truncate_word(c: Column, n: int) -> Column:
    """At most n characters, cut at a blank among the last 21 before the limit if there is one."""
    cut = n - 1
    low = max(cut - 20, 0)
    head = F.substring(c, 1, cut + 1)
    last_blank = F.length(head) - F.instr(F.reverse(head), " ")
    at_blank = (F.instr(head, " ") > 0) & (last_blank >= low)
    keep = F.when(at_blank, F.substring(c, F.lit(1), last_blank)).otherwise(F.substring(c, 1, cut))
    return F.when(F.length(c) <= n, c).otherwise(F.concat(keep, F.lit("…")))


def persisted_path(c: Column) -> Column:
    """Path of a tool output that was saved to a file; NULL for other texts."""
    path = F.trim(F.regexp_extract(c, PERSISTED_PATH, 1))
    return F.when(c.contains(PERSISTED_MARK), F.nullif(path, F.lit("")))


def orphan_description(c: Column) -> Column:
    """Label of an unlinked sub-agent from its prompt: skill directory name, else first line."""
    prefix = "Base directory for this skill: "
    first = F.regexp_replace(F.split_part(c, F.lit("\n"), F.lit(1)), r"\r\z", "")
    skill = F.element_at(F.split(F.substring(first, len(prefix) + 1, 1 << 20), "/"), -1)
    line = F.when(F.length(first) > 80, F.concat(F.substring(first, 1, 80), F.lit("…"))).otherwise(first)
    return F.when(c.startswith(prefix) & (skill != ""), skill).otherwise(line)
