"""Model, mode, date and path labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels of permission modes; other modes show as they are.
MODE_LABELS = {"acceptEdits": "auto-edit", "bypassPermissions": "yolo"}
DEFAULT_MODES = ["default", "manual"]
DEFAULT_BRANCHES = ["main", "master", "trunk", "develop", "dev"]
LONG_PATH = 200
WORKTREE_MARKS = ["--claude-worktrees-", "--worktrees-"]
DATE_GROUPS = ["Today", "Yesterday", "This Week", "This Month", "Older"]


def short_model(c: Column) -> Column:
    """Family and version of a model name: no vendor prefix, date or bracket suffix."""
    bare = F.regexp_replace(F.regexp_replace(c, r"(?s)\[.*\z", ""), r"^claude-", "")
    family = F.split_part(bare, F.lit("-"), F.lit(1))
    rest = F.split(F.regexp_replace(bare, r"(?s)\A[^-]*-", ""), "-")
    version = F.array_join(F.slice(F.filter(rest, lambda p: ~p.rlike(r"^[0-9]{8}$")), 1, 2), ".")
    return F.when(bare.contains("-"), F.concat(family, version)).otherwise(bare)


def short_mode(c: Column) -> Column:
    expr = F
    for mode, label in MODE_LABELS.items():
        expr = expr.when(c == mode, label)
    return expr.otherwise(c)


def is_default_mode(c: Column) -> Column:
    return c.isin(DEFAULT_MODES)


def date_group(mtime: Column, now: Column, tz: str = "UTC") -> Column:
    """Date group of a time as seen at ``now`` in a time zone."""
    day = F.to_date(F.from_utc_timestamp(mtime, tz))
    today = F.to_date(F.from_utc_timestamp(now, tz))
    return (
        F.when(day >= today, "Today")
        .when(day >= F.date_sub(today, 1), "Yesterday")
        .when(day >= F.date_sub(today, 7), "This Week")
        .when(day >= F.date_sub(today, 30), "This Month")
        .otherwise("Older")
    )


def date_group_rank(group: Column) -> Column:
    return F.array_position(F.array(*[F.lit(g) for g in DATE_GROUPS]), group).cast("int")


# --- project paths ---------------------------------------------------------------------------------


def project_key(path: Column) -> Column:
    """Project directory of a session file below a projects folder; "unknown" elsewhere."""
    key = F.regexp_extract(path, r"[/\\]\.claude[/\\]projects[/\\]([^/\\]+)", 1)
    return F.when(key == "", "unknown").otherwise(key)


def project_display_name(key: Column) -> Column:
    """Last part of a project key."""
    parts = F.filter(F.split(key, "-"), lambda p: p != "")
    parts = F.filter(F.flatten(F.transform(parts, lambda p: F.split(p, "/"))), lambda p: p != "")
    return F.when(F.size(parts) > 0, F.element_at(parts, -1)).otherwise(key)


def short_path(path: Column) -> Column:
    """Last part of a path."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    return F.when(F.size(parts) > 0, F.element_at(parts, -1)).otherwise(F.coalesce(path, F.lit("")))


def encode_path(path: Column) -> Column:
    return F.translate(path, "/._", "---")


def is_long_path(path: Column) -> Column:
    """Encoded names over 200 characters have no known project directory."""
    return F.length(encode_path(path)) > LONG_PATH


def trim_branch_suffix(name: Column, branch: Column) -> Column:
    """Directory name without a trailing "-branch" or "_branch", unless it is a default branch."""
    bare = F.regexp_replace(F.trim(branch), r"^(refs/heads/)+", "")
    token = F.regexp_replace(F.lower(F.regexp_replace(bare, r"(?U)[^\p{Alnum}]+", "-")), r"^-+|-+$", "")
    cut = F.regexp_replace(F.substring(name, F.lit(1), F.length(name) - F.length(token) - 1), r"[-_]+\z", "")
    ends = F.lower(name).endswith(F.concat(F.lit("-"), token)) | F.lower(name).endswith(F.concat(F.lit("_"), token))
    drop = (token != "") & ~token.isin(DEFAULT_BRANCHES) & ends & (cut != "")
    return F.when(drop, cut).otherwise(name)


def worktree_root(key: Column) -> Column:
    """Repository part of a worktree key; NULL for other keys."""
    at = [F.instr(key, m) for m in WORKTREE_MARKS]
    pos = F.when(at[0] > 1, at[0]).when(at[1] > 1, at[1])
    return F.when(pos.isNotNull(), F.substring(key, F.lit(1), pos - 1))


def worktree_kind(parent: Column, child: Column) -> Column:
    """"claude-worktrees", "worktrees" or NULL for a child key."""
    parts = F.split(child, "--")
    last = F.element_at(parts, -1)
    rest = F.substring(child, F.length(parent) + 1, F.length(child))
    by_part = F.when(last.startswith("claude-worktrees"), "claude-worktrees").when(last.startswith("worktrees"), "worktrees")
    return F.when(F.size(parts) > 1, by_part).otherwise(F.when(rest.startswith("-worktrees-"), "worktrees"))


def worktree_leaf(parent: Column, child: Column, kind: Column) -> Column:
    """Label of a worktree child."""
    parts = F.split(child, "--")
    last = F.element_at(parts, -1)
    prefix = F.concat(kind, F.lit("-"))
    by_part = F.when(
        F.startswith(last, prefix), F.substring(last, F.length(prefix) + 1, F.length(last))
    ).otherwise(project_display_name(child))
    skip = F.when(kind == "claude-worktrees", len("--claude-worktrees-")).otherwise(len("-worktrees-"))
    old = F.regexp_replace(F.substring(child, F.length(parent) + skip + 1, F.length(child)), r"^-+", "")
    return F.when(F.size(parts) > 1, by_part).otherwise(F.when(old != "", old).otherwise(project_display_name(child)))
