"""Mixing with odd rows and columns that are called like inner ones."""

from turnweave.llm import mixing
from turnweave.llm.common import aside


def test_clashing_columns_stay_or_are_replaced(spark):
    inner = {n: f"{n} string" for n in [*mixing.INNER, "_H", "kept0"]}
    names = list({n.lower(): n for n in inner}.values())
    schema = "doc_id bigint, text string, source string, size int, " + ", ".join(f"`{n}` string" for n in names)
    rows = [(i, "w " * (i % 9), f"s{i % 3}", -1, *[f"{n}{i}" for n in names]) for i in range(60)]
    rows += [(None, None, None, -1, *[None] * len(names)), (5, "", None, -1, *["x"] * len(names)), (5, "a b", "s1", -1, *["y"] * len(names)), (5, "a b", "s1", -1, *["y"] * len(names))]
    df = spark.createDataFrame(rows, schema)
    out = mixing.mix_sources(df)
    assert sorted(out.columns) == sorted([*[c for c in df.columns if c != "size"], *mixing.OWN])
    got = out.select(*df.columns).collect()
    assert len(got) == len(rows) and all(r["size"] == len((r["text"] or "").split()) for r in got)
    keep = lambda r: (r[0], r[1], r[2], *r[4:])
    assert sorted((keep(tuple(r)) for r in got), key=str) == sorted((keep(r) for r in rows), key=str)
    plain = mixing.mix_sources(df.select("doc_id", "text", "source"))
    pick = lambda d: sorted(map(str, d.select("doc_id", "text", "source", *mixing.OWN).collect()))
    assert pick(out) == pick(plain)
    assert mixing.mix_sources(df.limit(0)).count() == 0


def test_columns_step_aside_and_come_back(spark):
    df = spark.createDataFrame([(1, 2, 3)], "A int, kept0 int, c int")
    moved, back = aside(df, ["a"])
    assert moved.columns[1:] == ["kept0", "c"] and moved.columns[0] not in ("A", "kept0")
    assert moved.withColumnsRenamed(back).columns == df.columns


def test_positions_follow_the_schedule(spark):
    """By time 1/2, source 0 with slope 1/2 has spent T (1/2 - 1/8) of its target, source 2 T (1/2 + 1/8)."""
    df = spark.createDataFrame([(i, "w " * 10, f"s{i % 3}") for i in range(900)], "doc_id bigint, text string, source string")
    rows = mixing.mix_sources(df).filter("taken > 0").collect()
    for source, want in (("s0", 0.375), ("s1", 0.5), ("s2", 0.625)):
        own = [r for r in rows if r.source == source]
        first = [min(r.taken, r.size) for r in own if r.position < 0.5] + [r.taken - r.size for r in own if r.again is not None and r.again < 0.5]
        assert abs(sum(first) / own[0].target - want) < 0.02
