"""Projects of sessions and their tree."""

from __future__ import annotations

import math
from collections.abc import Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import display
from ..plans.runtime import durable, stage

SID = "session_id"


def _advance(links: DataFrame, rounds: int) -> DataFrame:
    """Follow (node, to) links by pointer doubling: 2^rounds steps, stopping where links end."""
    jump = links
    for _ in range(rounds):
        nxt = jump.select(F.col("node").alias("to"), F.col("to").alias("__to"))
        jump = durable(jump.join(nxt, "to", "left").select("node", F.coalesce("__to", "to").alias("to")))
        if jump.join(links.select(F.col("node").alias("to")), "to", "left_semi").isEmpty():
            break
    return jump


def fork_root(sessions: DataFrame) -> DataFrame:
    """(session_id, root_id): the last known ancestor by ``forked_from_session_id``.

    In a cycle every session is its own root, and a session outside takes the first one it reaches.
    """
    ids = sessions.select(F.col(SID).alias("to"))
    links = (
        sessions.filter(F.coalesce("forked_from_session_id", F.lit("")) != "")
        .select(F.col(SID).alias("node"), F.col("forked_from_session_id").alias("to"))
        .join(ids, "to", "left_semi")
        .select("node", "to")
    )
    links = durable(links)
    n = links.count()
    if n == 0:
        return sessions.select(SID, F.col(SID).alias("root_id"))
    rounds = math.ceil(math.log2(n + 1)) + 1
    ends = _advance(links, rounds)
    looped = ends.join(links.select(F.col("node").alias("to")), "to", "left_semi")
    if not looped.isEmpty():
        on_cycle = durable(looped.select(F.col("to").alias("node")).distinct())
        open_links = durable(links.join(on_cycle, "node", "left_anti"))
        ends = _advance(open_links, rounds) if not open_links.isEmpty() else open_links
    roots = ends.select(F.col("node").alias(SID), F.col("to").alias("root_id"))
    return sessions.select(SID).join(roots, SID, "left").select(SID, F.coalesce("root_id", SID).alias("root_id"))


def project_roots(sessions: DataFrame) -> DataFrame:
    """(session_id, root_id, root_key, root_origin) of each session's fork root."""
    anchors = sessions.select(
        F.col(SID).alias("root_id"),
        display.project_key(F.col("path")).alias("root_key"),
        F.coalesce("origin_dir", "cwd", F.lit("")).alias("root_origin"),
    )
    return fork_root(sessions).join(anchors, "root_id").select(SID, "root_id", "root_key", "root_origin")


def project_nodes(sessions: DataFrame) -> DataFrame:
    """(key, name, session_count, has_ongoing) per project of the fork roots, by name."""
    c = F.col
    rooted = sessions.select(SID, "path", "mtime", "is_ongoing").join(project_roots(sessions), SID)
    # the newest session names the project; of equal times the first path
    newest = F.min_by("root_origin", F.struct(F.coalesce(-F.unix_micros("mtime"), F.lit(2**63 - 1)).alias("t"), "path"))
    grouped = rooted.groupBy(c("root_key").alias("key")).agg(
        F.count(F.lit(1)).alias("session_count"), F.max("is_ongoing").alias("has_ongoing"), newest.alias("origin")
    )
    name = F.coalesce(F.nullif(display.short_path(c("origin")), F.lit("")), display.project_display_name(c("key")))
    return grouped.select("key", name.alias("name"), "session_count", "has_ongoing")


def _prefixes(key: Column) -> Column:
    """All parts of a key that end before one of its dashes."""
    cuts = F.transform(
        F.sequence(F.lit(2), F.greatest(F.length(key), F.lit(2))),
        lambda i: F.when(F.substring(key, i, F.lit(1)) == "-", F.substring(key, F.lit(1), i - 1)),
    )
    return F.array_compact(cuts)


def parent_by_prefix(nodes: DataFrame) -> DataFrame:
    """(key, parent_key): the longest other key that, with a dash, begins the key."""
    candidates = nodes.select("key", F.explode(_prefixes(F.col("key"))).alias("parent_key"))
    known = nodes.select(F.col("key").alias("parent_key"))
    return candidates.join(known, "parent_key").groupBy("key").agg(F.max_by("parent_key", F.length("parent_key")).alias("parent_key"))


def worktree_roots(nodes: DataFrame) -> DataFrame:
    """The nodes, with empty nodes for repositories known by their worktrees only."""
    root = display.worktree_root(F.col("key"))
    lonely = (
        nodes.join(parent_by_prefix(nodes), "key", "left_anti")
        .select(root.alias("key"))
        .filter(F.col("key").isNotNull())
        .distinct()
        .join(nodes, "key", "left_anti")
    )
    made = lonely.select(
        "key", display.project_display_name(F.col("key")).alias("name"),
        F.lit(0).cast("bigint").alias("session_count"), F.lit(False).alias("has_ongoing"),
    )
    return nodes.unionByName(made)


def project_tree(nodes: DataFrame) -> DataFrame:
    """(key, parent_key, name, session_count, has_ongoing, is_virtual) with nodes for middle parts."""
    c = F.col
    full = worktree_roots(nodes)
    placed = full.join(parent_by_prefix(full), "key", "left")
    suffix = F.substring(c("key"), F.length("parent_key") + 1, F.length("key"))
    parts = F.split(suffix, "--")
    middle = F.filter(
        F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda s: F.regexp_replace(s, r"^-+", "")), lambda s: s != ""
    )
    start = F.array(F.struct(c("parent_key").alias("key"), F.lit(None).cast("string").alias("up"), F.lit("").alias("seg")))
    chain = F.aggregate(
        middle,
        start,
        lambda acc, seg: F.concat(
            acc,
            F.array(
                F.struct(
                    F.concat(F.lit("__virtual:"), F.element_at(acc, -1)["key"], F.lit(":"), seg).alias("key"),
                    F.element_at(acc, -1)["key"].alias("up"),
                    seg.alias("seg"),
                )
            ),
        ),
    )
    chained = placed.withColumn("chain", F.when(c("parent_key").isNotNull(), chain))
    label = F.regexp_replace(suffix, r"^-+", "")
    named = F.coalesce(F.nullif("name", F.lit("")), F.nullif(label, F.lit("")), display.project_display_name(c("key")))
    real = chained.select(
        "key", F.element_at("chain", -1)["key"].alias("parent_key"), named.alias("name"), "session_count", "has_ongoing",
        F.lit(False).alias("is_virtual"),
    )
    virtual = (
        chained.select("session_count", "has_ongoing", F.explode(F.filter("chain", lambda x: x["up"].isNotNull())).alias("v"))
        .groupBy(c("v.key").alias("key"), c("v.up").alias("parent_key"), c("v.seg").alias("name"))
        .agg(F.sum("session_count").alias("session_count"), F.max("has_ongoing").alias("has_ongoing"))
        .withColumn("is_virtual", F.lit(True))
    )
    return real.unionByName(virtual)


def _by_name(c: Column) -> Column:
    return F.collate(c, "UNICODE")


def flatten_tree(tree: DataFrame, collapsed: Collection[str] = (), total: DataFrame | None = None) -> DataFrame:
    """Rows of the tree in display order, with worktree groups and without what is collapsed.

    One round per tree level. ``total``: a frame whose row count the "All Projects" row shows.
    """
    c = F.col
    hidden = list(collapsed)
    closed = lambda key: key.isin(hidden) if hidden else F.lit(False)
    step = lambda rank, name, key: F.struct(F.lit(rank).alias("g"), _by_name(name).alias("n"), key.alias("k"))
    tree = durable(tree)
    has_kids = tree.filter("parent_key is not null").select(c("parent_key").alias("key"), F.lit(True).alias("__kids")).distinct()
    nodes = durable(tree.join(has_kids, "key", "left").withColumn("has_children", F.coalesce("__kids", F.lit(False))).drop("__kids"))
    row = lambda df, key, name, depth, group, kids, path: df.select(
        key.alias("key"), name.alias("name"), c("session_count").alias("count"), c("has_ongoing").alias("ongoing"),
        depth.alias("depth"), F.lit(group).alias("is_group"), kids.alias("has_children"), (~closed(key)).alias("is_expanded"), path.alias("path"),
    )
    front = nodes.filter("parent_key is null").withColumns(
        {"depth": F.lit(0), "path": F.array(step(1, c("name"), c("key"))), "in_group": F.lit(False), "shown": c("name")}
    )
    rows = row(front, c("key"), c("shown"), c("depth"), False, c("has_children"), c("path"))
    while True:
        open_nodes = front.filter(c("has_children") & ~closed(c("key"))).select(
            c("key").alias("parent_key"), c("depth").alias("__d"), c("path").alias("__p"), c("in_group").alias("__in")
        )
        kids = nodes.join(open_nodes, "parent_key")
        kind = F.when(~c("__in"), display.worktree_kind(c("parent_key"), c("key")))
        kids = kids.withColumn("kind", kind)
        grouped = kids.filter("kind is not null")
        heads = (
            grouped.groupBy("parent_key", "kind", "__d")
            .agg(
                F.sum("session_count").alias("session_count"),
                F.max("has_ongoing").alias("has_ongoing"),
                F.min(_by_name(c("name"))).alias("first_name"),
                F.first("__p").alias("__p"),
            )
            .withColumn("group_key", F.concat(F.lit("__group:"), c("kind"), F.lit(":"), c("parent_key")))
            .withColumn("path", F.array_append("__p", step(0, c("first_name"), c("group_key"))))
        )
        rows = rows.unionByName(row(heads, c("group_key"), c("kind"), c("__d") + 1, True, F.lit(True), c("path")))
        inside = (
            grouped.drop("__p")
            .join(heads.filter(~closed(c("group_key"))).select("parent_key", "kind", c("path").alias("__p")), ["parent_key", "kind"])
            .withColumns(
                {
                    "shown": display.worktree_leaf(c("parent_key"), c("key"), c("kind")),
                    "depth": c("__d") + 2,
                    "path": F.array_append("__p", step(1, c("name"), c("key"))),
                    "in_group": F.lit(True),
                }
            )
        )
        plain = kids.filter("kind is null").withColumns(
            {"shown": c("name"), "depth": c("__d") + 1, "path": F.array_append("__p", step(1, c("name"), c("key"))), "in_group": F.lit(False)}
        )
        keep = [*nodes.columns, "depth", "path", "in_group", "shown"]
        # a collapsed group has a head but nothing inside, so the heads are added first
        front = durable(inside.select(*keep).unionByName(plain.select(*keep)))
        if front.isEmpty():
            break
        rows = rows.unionByName(row(front, c("key"), c("shown"), c("depth"), False, c("has_children"), c("path")))
    if total is not None:
        top = total.agg(F.count(F.lit(1)).alias("session_count"), F.lit(False).alias("has_ongoing"))
        first = top.select(
            F.lit(None).cast("string").alias("key"), F.lit("All Projects").alias("name"), c("session_count").alias("count"),
            c("has_ongoing").alias("ongoing"), F.lit(0).alias("depth"), F.lit(False).alias("is_group"), F.lit(False).alias("has_children"),
            F.lit(True).alias("is_expanded"), F.array(step(-1, F.lit(""), F.lit(""))).alias("path"),
        )
        rows = first.unionByName(rows)
    return rows.orderBy("path")


def flat_items(sessions: DataFrame, collapsed: Collection[str] = ()) -> DataFrame:
    """Project rows of the catalogue in display order, "All Projects" on top."""
    return flatten_tree(project_tree(stage(project_nodes(sessions))), collapsed, sessions)
