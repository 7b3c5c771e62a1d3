"""Trie of conversation prefixes by ROLLUP over positional turn columns.

Turns become ids (two 64-bit hashes of role and text, with the length of the text). A conversation is laid out in blocks of four
positional columns; each block carries the key of the node it continues from, which is the XOR of the hashes of all (position,
turn) pairs before it. GROUP BY block, key, ROLLUP(t1, t2, t3, t4) then aggregates all prefixes of all conversations together,
however long they are, and grouping_id tells the depth of each.

Sums over subtrees need no walk either. Conversations below a node are its members, so every sum over distinct nodes is turned
into one over conversations: each node is owned by its smallest member, what a conversation owns is the end of its path, and all
members of a node but the smallest own only nodes below it. A second ROLLUP adds up what members own.

No step holds a conversation or a node's members in one task: turns are numbered by range partitions, keys run over segments of
1,024 blocks, aggregation starts before the shuffle, and member lists are hashed from sorted pieces.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnweave.llm.common import stage

SLOTS = 4
SEGMENT = 1024
PIECE = 1024


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(c, p, t): turn p of conversation c from 0 on, by turn (null first); equal ones by role, then text.

    Null role or text counts as empty; rows without conv_id take no part; repeated rows are turns of their own. Of the table only
    conv_id, turn, role and text are read, whatever other columns there are.
    """
    t = conversations.select(
        F.col("conv_id").cast("long").alias("c"),
        "turn",
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).filter("c IS NOT NULL")
    # bodies are sorted only where a turn number occurs twice
    twice = t.groupBy("c", "turn").count().filter("count > 1").selectExpr("c c2", "turn turn2")
    said = t.join(twice, (F.col("c") == F.col("c2")) & F.col("turn").eqNullSafe(F.col("turn2")), "left")
    narrow = said.select(
        "c",
        "turn",
        F.when(F.col("c2").isNotNull(), F.struct("role", "text")).alias("tie"),
        F.struct(
            F.xxhash64("role", "text").alias("a"), F.xxhash64("text", F.lit(7), "role").alias("b"), F.length("text").cast("long").alias("len")
        ).alias("t"),
        F.monotonically_increasing_id().alias("row"),
    )
    order = [F.asc_nulls_first("turn"), "tie", "row"]
    ranged = stage(narrow.repartitionByRange("c", *order).withColumn("part", F.spark_partition_id()), "turns")
    inside = Window.partitionBy("c", "part").orderBy(*order)
    behind = Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = ranged.groupBy("c", "part").count().select("c", "part", F.sum("count").over(behind).alias("before")).filter("before > 0")
    placed = ranged.withColumn("n", F.row_number().over(inside) - 1).join(before, ["c", "part"], "left")
    return stage(placed.select("c", (F.col("n") + F.coalesce("before", F.lit(0))).cast("long").alias("p"), "t"), "numbered")


def share_openings(turns: DataFrame) -> DataFrame:
    """The rebuilt conversations of the contract: the first h turns of conversation c - c%100, then the own ones after h.

    h = crc32(c) % 6. (c, p, t) as before, with one row of null p and t for each conversation, so that none is lost.
    """
    h = F.crc32(F.col("c").cast("string").cast("binary")) % 6
    heads = turns.filter(F.col("p") < 5).groupBy("c").agg(F.array_sort(F.collect_list(F.struct("p", "t"))).alias("head"))
    ids = turns.select("c").distinct().withColumn("h", h.cast("int")).withColumn("base", F.expr("c - c % 100"))
    taken = F.when(F.col("head").isNotNull(), F.slice("head", F.lit(1), F.col("h"))).otherwise(F.expr("slice(array(struct(0L p, named_struct('a', 0L, 'b', 0L, 'len', 0L) t)), 1, 0)"))
    ids = stage(ids.join(heads.withColumnRenamed("c", "base"), "base", "left").select("c", "h", taken.alias("head")), "openings")
    opening = ids.select("c", F.explode("head").alias("x")).select("c", "x.p", "x.t")
    missing = ids.select("c", (F.col("h") - F.size("head")).alias("miss")).filter("miss > 0")
    own = turns.filter(F.col("p") >= h).join(missing, "c", "left")
    own = own.select("c", (F.col("p") - F.coalesce("miss", F.lit(0))).alias("p"), "t")
    return own.unionByName(opening).unionByName(ids.selectExpr("c", "CAST(NULL AS long) p", "NULL t").select("c", "p", F.col("t").cast(turns.schema["t"].dataType)))


def _marks(p: Column, t: Column) -> tuple[Column, Column]:
    """Two hashes of a turn at its position; 0 where there is none."""
    a, b = t["a"], t["b"]
    none = F.lit(0).cast("long")
    return (
        F.when(t.isNotNull(), F.xxhash64(p.cast("long"), a, b)).otherwise(none),
        F.when(t.isNotNull(), F.xxhash64(b, p.cast("long"), a)).otherwise(none),
    )


def _blocks(turns: DataFrame) -> DataFrame:
    """(c, block, t1 … t4, kx, ky, kl): blocks of positional columns with key and text length of what is before them."""
    x, y = _marks(F.col("p"), F.col("t"))
    slot = [F.max(F.when(F.col("p") % SLOTS == j, F.col("t"))).alias(f"t{j + 1}") for j in range(SLOTS)]
    rows = turns.withColumn("block", F.coalesce(F.expr(f"p div {SLOTS}"), F.lit(0)))
    adds = [F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"), F.sum("l").alias("l")]
    blocks = rows.withColumns({"x": x, "y": y, "l": F.coalesce(F.col("t.len"), F.lit(0))}).groupBy("c", "block").agg(*slot, *adds)
    blocks = stage(blocks.withColumn("seg", F.expr(f"block div {SEGMENT}")), "blocks")
    behind = Window.partitionBy("c").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    sums = blocks.groupBy("c", "seg").agg(*adds)
    carry = sums.select("c", "seg", F.bit_xor("x").over(behind).alias("cx"), F.bit_xor("y").over(behind).alias("cy"), F.sum("l").over(behind).alias("cl"))
    inside = Window.partitionBy("c", "seg").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    local = blocks.withColumns({"lx": F.bit_xor("x").over(inside), "ly": F.bit_xor("y").over(inside), "ll": F.sum("l").over(inside)})
    keyed = local.join(carry.filter("seg > 0"), ["c", "seg"], "left")
    both = lambda a, b: F.coalesce(a, zero).bitwiseXOR(F.coalesce(b, zero))
    return keyed.select(
        "c", "block", *[f"t{j + 1}" for j in range(SLOTS)], "x", "y", "l",
        both("lx", "cx").alias("kx"), both("ly", "cy").alias("ky"), (F.coalesce("ll", zero) + F.coalesce("cl", zero)).alias("kl"),
    )


def _rollup(blocks: DataFrame, measures: str) -> DataFrame:
    """All nodes with their key (x, y), parent's key (px, py), depth, last text's length and the length of the texts before it."""
    names = [f"t{j + 1}" for j in range(SLOTS)]
    rows = blocks.sparkSession.sql(
        f"SELECT block, kx, ky, kl, {', '.join(names)}, {SLOTS} - bit_count(grouping_id()) AS level, {measures} "
        f"FROM {{blocks}} GROUP BY block, kx, ky, kl, ROLLUP({', '.join(names)})",
        blocks=blocks,
    )
    # a prefix is a node where its last column holds a turn; the root is the empty prefix of the first block
    last = F.coalesce(*[F.col(n) for n in reversed(names)])
    turns = reduce(lambda a, b: a + b, [F.when(F.col(n).isNotNull(), 1).otherwise(0) for n in names])
    rows = rows.filter((turns == F.col("level")) & ((F.col("level") > 0) | (F.col("block") == 0)))
    first = F.col("block") * SLOTS
    marks = [_marks(first + j, F.col(n)) for j, n in enumerate(names)]
    lx, ly = _marks(first + F.col("level") - 1, last)
    x = reduce(Column.bitwiseXOR, [m[0] for m in marks], F.col("kx"))
    y = reduce(Column.bitwiseXOR, [m[1] for m in marks], F.col("ky"))
    zero = F.lit(0).cast("long")
    length = F.coalesce(last["len"], zero)
    upto = reduce(lambda a, n: a + F.coalesce(F.col(n)["len"], zero), names, F.col("kl"))
    own = {"block", "kx", "ky", "kl", "level", *names}
    return rows.select(
        x.alias("x"), y.alias("y"), x.bitwiseXOR(lx).alias("px"), y.bitwiseXOR(ly).alias("py"), (first + F.col("level")).cast("long").alias("depth"),
        length.alias("len"), (upto - length).alias("before"), *[c for c in rows.columns if c not in own],
    )


def _member_hashes(ends: DataFrame) -> DataFrame:
    """(x, y, ends_sha256) of each node's members (x, y, c): ids in order, joined by commas, hashed from sorted pieces."""

    def pieces(batches):
        held, key = [], None

        def out():
            return (*key, held[0], len(held), ",".join(map(str, held)))

        for pdf in batches:
            rows = []
            for x, y, c in zip(pdf["x"].tolist(), pdf["y"].tolist(), pdf["c"].tolist()):
                if held and (key != (x, y) or len(held) == PIECE):
                    rows.append(out())
                    held = []
                key = (x, y)
                held.append(c)
            yield pd.DataFrame(rows, columns=["x", "y", "first", "n", "part"])
        if held:
            yield pd.DataFrame([out()], columns=["x", "y", "first", "n", "part"])

    def hashes(batches):
        key, sha = None, None
        for pdf in batches:
            rows = []
            for x, y, part in zip(pdf["x"].tolist(), pdf["y"].tolist(), pdf["part"]):
                if key == (x, y):
                    sha.update(b"," + part.encode())
                    continue
                if key:
                    rows.append((*key, sha.hexdigest()))
                key, sha = (x, y), hashlib.sha256(part.encode())
            yield pd.DataFrame(rows, columns=["x", "y", "ends_sha256"])
        if key:
            yield pd.DataFrame([(*key, sha.hexdigest())], columns=["x", "y", "ends_sha256"])

    ranged = ends.repartitionByRange("x", "y", "c").sortWithinPartitions("x", "y", "c")
    parts = ranged.mapInPandas(pieces, "x long, y long, first long, n long, part string")
    return parts.repartition("x", "y").sortWithinPartitions("x", "y", "first").mapInPandas(hashes, "x long, y long, ends_sha256 string")


def trie(turns: DataFrame) -> DataFrame:
    """One row per distinct prefix of the conversations in (c, p, t), the empty one included; an empty table has no nodes.

    conv_id is the smallest member and names the node together with depth: the node's last turn is turn depth - 1 of that
    conversation. parent_conv_id is the parent's (root: null); n_convs counts members, n_children the nodes one turn longer,
    n_leaves the childless nodes of the subtree, saved_tokens the code points that sharing saves in it, and ends_sha256 hashes the
    ids of the members that end here. A row of null p stands for a conversation that may have no turns.
    """
    blocks = _blocks(turns)
    nodes = stage(_rollup(blocks, "min(c) AS m").select("x", "y", "px", "py", "depth", "len", "m"), "nodes")
    kids = nodes.filter("depth > 0").groupBy(F.col("px").alias("x"), F.col("py").alias("y")).agg(F.count(F.lit(1)).alias("n_children"))
    owners = nodes.join(kids, ["x", "y"], "left").groupBy(F.col("m").alias("c")).agg(
        F.sum("len").alias("owned"), F.min("depth").alias("top"), F.sum(F.expr("if(n_children IS NULL, 1L, 0L)")).alias("leaf")
    )
    convs = blocks.groupBy("c").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"), F.sum("l").alias("total"))
    convs = stage(convs.join(owners, "c", "left").fillna(0, ["owned", "leaf"]), "conversations")
    measures = "count(*) AS n, sum(total) AS totals, sum(owned) AS owns, sum(leaf) AS n_leaves, min(struct(c, owned, total, top)) AS w"
    summed = _rollup(blocks.drop("x", "y", "l").join(convs.drop("x", "y"), "c"), measures)
    # members' texts from here on, less what distinct nodes hold once
    saved = F.expr("totals - n * before - (owns - w.owned + w.total - before)")
    summed = summed.withColumns({"m": F.col("w.c"), "top": F.col("w.top"), "saved_tokens": saved})
    # the parent belongs to the same conversation but at the upper end of what that owns; one row a conversation looks it up.
    # A parent with very many children is a key that the adaptive skew join splits
    upper = nodes.filter("depth > 0").join(owners.select(F.col("c").alias("m"), "top"), "m").filter("depth = top").select("x", "y", "px", "py")
    above = upper.join(nodes.select(F.col("x").alias("px"), F.col("y").alias("py"), F.col("m").alias("above")), ["px", "py"]).select("x", "y", "above")
    out = summed.join(kids, ["x", "y"], "left").join(above, ["x", "y"], "left").join(_member_hashes(convs.select("x", "y", "c")), ["x", "y"], "left")
    return out.select(
        F.col("m").alias("conv_id"),
        "depth",
        F.expr("if(depth = 0, NULL, if(depth > top, m, above))").alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.coalesce("n_children", F.lit(0)).alias("n_children"),
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of a table of conversations as it stands; see ``numbered_turns`` for nulls and ties and ``trie`` for the result."""
    return trie(numbered_turns(conversations))


def trie_report(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations of op13."""
    return trie(share_openings(numbered_turns(conversations)))


_CRC = """xor(list_reduce(list_transform(string_split({0}, ''), lambda ch: ascii(ch)::BIGINT), lambda a, b:
  list_reduce(range(8), lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, xor(a, b)), 4294967295), 4294967295)"""

TRIE_SQL = f"""
WITH t AS (
  SELECT conv_id c, coalesce(role, '') r, coalesce(text, '') x, row_number() OVER (
    PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) p
  FROM conversations WHERE conv_id IS NOT NULL
), l AS (SELECT c, list({{'r': r, 'x': x}} ORDER BY p) l, {_CRC.format('c::VARCHAR')} % 6 h, c - c % 100 base FROM t GROUP BY c
), s AS (
  SELECT o.c, list_concat(CASE WHEN b.l IS NULL THEN [] ELSE list_slice(b.l, 1, o.h) END, list_slice(o.l, o.h + 1, len(o.l))) s
  FROM l o LEFT JOIN l b ON b.c = o.base
), prefixes AS (SELECT c, d, list_slice(s, 1, d) k, len(s) = d ends FROM (SELECT c, s, unnest(range(0, len(s) + 1)) d FROM s)
), nodes AS (
  SELECT d, k, count(*) n, min(c) c, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '') ids FROM prefixes GROUP BY d, k
), kids AS (SELECT d - 1 d, list_slice(k, 1, d - 1) k, count(*) n FROM nodes WHERE d > 0 GROUP BY 1, 2
), own AS (
  SELECT a.d, a.k, CASE WHEN b.n IS NULL THEN 1 ELSE 0 END leaf, CASE WHEN a.d > 0 THEN (a.n - 1) * length(a.k[a.d].x) ELSE 0 END saved
  FROM nodes a LEFT JOIN kids b ON a.d = b.d AND a.k = b.k
), sums AS (
  SELECT u d, list_slice(k, 1, u) k, sum(leaf)::BIGINT leaves, sum(saved)::BIGINT saved
  FROM (SELECT *, unnest(range(0, d + 1)) u FROM own) GROUP BY 1, 2
)
SELECT a.c conv_id, a.d depth, p.c parent_conv_id, a.n n_convs, coalesce(b.n, 0) n_children, m.leaves n_leaves,
  m.saved saved_tokens, sha256(a.ids) ends_sha256
FROM nodes a JOIN sums m ON a.d = m.d AND a.k = m.k LEFT JOIN kids b ON a.d = b.d AND a.k = b.k
LEFT JOIN nodes p ON p.d = a.d - 1 AND p.k = list_slice(a.k, 1, a.d - 1)
"""
