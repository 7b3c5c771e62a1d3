"""Mixing sources to target weights along a time-varying curriculum.

Targets: each source asks for its weight's share, up to ``most`` times its size, the excess shared anew
by weight (the level at which the capped shares use the budget up). A source's documents stand in the
order of md5(doc_id); whole passes come first, then a last pass up to the target's last word.

Curriculum: source s is drawn at time t in 0..1 with density 1 + a (2 t - 1), a its slope. Its tokens up to t
are T (t + a (t^2 - t)); inverting that at a document's cumulative tokens gives its training position.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnweave.llm.common import WORD, aside

OWN = ["size", "source_size", "target", "taken", "position", "again"]
INNER = ["_h", "_run", "_sum", "_before", "_s", "_r", "_in", "_from", "_goal", "_pass", "weight", "slope", "i", "cap"]
SLOPES = (0.5, 0.0, -0.5)  # by source, repeating


def sizes(docs: DataFrame) -> DataFrame:
    return docs.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))


def targets(by_source: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, weight, slope, target) from one row a source; the source table alone is sorted whole."""
    order = Window.orderBy(F.col("source").isNotNull().desc(), F.col("source").cast("binary"))
    s = by_source.withColumn("i", F.row_number().over(order) - 1)
    pick = lambda values: F.element_at(F.array(*[F.lit(float(v)) for v in values]), (F.col("i") % len(values) + 1).cast("int"))
    s = s.withColumn("weight", pick(weights)).withColumn("slope", pick(SLOPES)).withColumn("cap", most * F.col("source_size"))
    rank = Window.orderBy(F.col("cap") / F.col("weight"), "i")
    every, before = Window.partitionBy(F.lit(0)), rank.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("budget", share * F.sum("source_size").over(every))
    s = s.withColumn("full", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    s = s.withColumn("open", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    s = s.withColumn("level", (F.col("budget") - F.col("full")) / F.col("open"))
    # the level is that of the first source, by cap a weight, that stays under its cap
    s = s.withColumn("level", F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(every))
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("weight")))
    return s.select("source", "source_size", "weight", "slope", F.round(target, 6).alias("target"))


def mix_sources(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """All rows with size, source_size, target, taken, position and again (position of a second taking).

    Null text has size 0 and is taken for 0 words; null sources form one source, the last. Repeated ids
    and rows stand by id, then text. Position is null where nothing is taken. Running sums are taken in
    4,096 runs a source by leading hash digits, then over the runs, so that a large source is spread out. Columns called like one
    of the new ones are replaced by these; all other columns stay, whatever their names.
    """
    docs, back = aside(docs.drop(*OWN), INNER)
    base = sizes(docs).withColumn("_h", F.coalesce(F.md5(F.col("doc_id").cast("string")), F.lit("")))
    base = base.withColumn("_run", F.substring("_h", 1, 3))
    runs = base.groupBy("source", "_run").agg(F.sum("size").alias("_sum"))
    before = Window.partitionBy("source").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
    goal = targets(runs.groupBy("source").agg(F.sum("_sum").alias("source_size")), weights, share, most)
    runs = runs.join(goal.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s", "_sum")
    runs = runs.withColumnsRenamed({"source": "_s", "_run": "_r"})
    within = Window.partitionBy("source", "_run").orderBy("_h", "doc_id", "text").rowsBetween(Window.unboundedPreceding, -1)
    base = base.withColumn("_in", F.coalesce(F.sum("size").over(within), F.lit(0)))
    x = base.join(runs, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_run") == F.col("_r"))).drop("_s", "_r")
    x = x.withColumn("_from", F.col("_before") + F.col("_in")).withColumn("_goal", F.floor("target"))
    x = x.withColumn("_pass", F.when(F.col("source_size") > 0, F.floor(F.col("_goal") / F.col("source_size"))).otherwise(0))
    rest = F.col("_goal") - F.col("_pass") * F.col("source_size") - F.col("_from")
    x = x.withColumn("taken", (F.col("_pass") * F.col("size") + F.least("size", F.greatest(rest, F.lit(0)))).cast("long"))

    def when(done):
        f, a = done / F.col("target"), F.col("slope")
        root = (F.sqrt((1 - a) * (1 - a) + 4 * a * f) - (1 - a)) / (2 * a)
        return F.when(a == 0, f).otherwise(root)

    x = x.withColumn("position", F.when(F.col("taken") > 0, when(F.col("_from"))))
    x = x.withColumn("again", F.when(F.col("taken") > F.col("size"), when(F.col("_from") + F.col("source_size"))))
    return x.drop("_h", "_run", "_before", "_in", "_from", "_goal", "_pass", "weight", "slope").withColumnsRenamed(back)


def by_position(mixed: DataFrame) -> DataFrame:
    """Documents in training order: range parts by position, sorted within, ties by id."""
    return mixed.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")


MIX_SQL = r"""
WITH d AS (SELECT doc_id, source, text, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM d GROUP BY source),
w AS (SELECT *, (CASE i % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END)::DOUBLE AS weight, 2.0::DOUBLE * source_size AS cap FROM s),
l AS (SELECT *, (1.5::DOUBLE * (SELECT sum(source_size) FROM w) - coalesce(sum(cap) OVER b, 0))
    / ((SELECT sum(weight) FROM w) - coalesce(sum(weight) OVER b, 0)) AS level FROM w
    WINDOW b AS (ORDER BY cap / weight, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT max(level) AS level FROM l WHERE level * weight <= cap),
t AS (SELECT source, source_size, (CASE i % 3 WHEN 0 THEN 0.5 WHEN 1 THEN 0.0 ELSE -0.5 END)::DOUBLE AS slope, round(coalesce(least(cap, v.level * weight), cap), 6) AS target FROM l, v),
c AS (SELECT d.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR), doc_id, text
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM d),
p AS (SELECT c.doc_id, c.size, t.source_size, t.target, t.slope, c.before, floor(t.target)::BIGINT AS goal,
    CASE WHEN t.source_size > 0 THEN floor(t.target)::BIGINT // t.source_size ELSE 0 END AS passes
    FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source),
k AS (SELECT *, (passes * size + least(size, greatest(goal - passes * source_size - before, 0)))::BIGINT AS taken FROM p),
f AS (SELECT *, CASE WHEN taken > 0 THEN before / target END AS once, CASE WHEN taken > size THEN (before + source_size) / target END AS twice FROM k)
SELECT doc_id, size::BIGINT AS size, source_size, target, taken,
    CASE WHEN slope = 0 THEN once ELSE (sqrt((1 - slope) * (1 - slope) + 4 * slope * once) - (1 - slope)) / (2 * slope) END AS position,
    CASE WHEN slope = 0 THEN twice ELSE (sqrt((1 - slope) * (1 - slope) + 4 * slope * twice) - (1 - slope)) / (2 * slope) END AS again FROM f
"""
