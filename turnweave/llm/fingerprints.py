"""Consistent weighted sampling of word counts, in DataFrame functions only.

A word that occurs n times is n units, its first to its nth. A sample is the unit of least hash, so a word is drawn by its
weight, and a smaller count has the first units of a larger one: two texts agree in a sample with the probability of
their generalised Jaccard similarity. Counts are whole numbers, so units need no logarithms or divisions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnweave.llm.common import WORD

SAMPLES = 64
GROUP = 16  # samples computed together, so that the generated code stays small


def next_ids(docs: DataFrame) -> DataFrame:
    """(doc_id, next_id, half): the next lower id, the greatest after the least; half of the text's code points.

    Ids are sorted by ranges; only the ends of the ranges, one row each, are looked at together.
    """
    from turnweave.llm.common import stage

    ids = docs.groupBy("doc_id").agg(F.min_by(F.length("t"), "t").alias("n")).filter("doc_id is not null")
    ids = stage(ids.repartitionByRange("doc_id").withColumn("part", F.spark_partition_id()), "ids")
    w = Window.partitionBy("part").orderBy("doc_id")
    ends = ids.groupBy("part").agg(F.max("doc_id").alias("top"))
    last = ends.agg(F.max("top").alias("last"))
    ends = ends.withColumn("below", F.lag("top").over(Window.orderBy("part"))).join(F.broadcast(last))
    x = ids.withColumn("low", F.lag("doc_id").over(w)).join(F.broadcast(ends), "part")
    return x.selectExpr("doc_id", "coalesce(low, below, last) next_id", "n div 2 half")


def signatures(texts: DataFrame, key: list[str], samples: int = SAMPLES) -> DataFrame:
    """key and fingerprint of each row's text ``t``; rows of a key must lie together already.

    A sample is the least hash of a unit; words are counted by their hash, so no text takes part in a grouping.
    """
    words = texts.select(*key, F.explode_outer(F.regexp_extract_all(F.lower("t"), F.lit(WORD), F.lit(0))).alias("w"))
    terms = words.select(*key, F.when(F.col("w").isNotNull(), F.xxhash64("w")).alias("h")).groupBy(*key, "h").agg(F.count("h").alias("n"))
    units = terms.select(*key, "h", F.explode(F.sequence(F.lit(1).cast("long"), F.greatest("n", F.lit(1)))).alias("i"))
    units = units.select(*key, F.when(F.col("h").isNotNull(), F.xxhash64("h", "i")).alias("unit"))
    rows = units.select(*key, "unit", F.explode(F.array(*[F.lit(g) for g in range(-(-samples // GROUP))])).alias("g"))
    least = [F.min(F.when(F.col("unit").isNotNull(), F.xxhash64("unit", "g", F.lit(j)))).alias(f"m{j}") for j in range(GROUP)]
    parts = rows.groupBy(*key, "g").agg(*least)
    digits = F.concat_ws("", *[F.lpad(F.lower(F.hex(F.coalesce(f"m{j}", F.lit(0)))), 16, "0") for j in range(GROUP)])
    joined = parts.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("g", digits.alias("d")))).alias("all"))
    whole = F.array_join(F.transform("all", lambda x: x["d"]), "")
    return joined.select(*key, F.substring(whole, 1, 16 * samples).alias("fingerprint"))


def likeness(a, b, samples: int = SAMPLES):
    """Share of samples that agree; two texts without words are alike."""
    same = [F.when(F.substring(a, 16 * j + 1, 16) == F.substring(b, 16 * j + 1, 16), 1).otherwise(0) for j in range(samples)]
    return sum(same[1:], same[0]) / float(samples)


def fingerprint_report(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), one row an id.

    Null text is empty; texts without words have the fingerprint of zeros. Rows without an id are left out;
    of rows with one id the least text counts, so that "the next document" is defined.
    """
    from turnweave.llm.common import release, stage

    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t")).filter("doc_id is not null")
    links = stage(next_ids(d), "next")
    release(docs.sparkSession)
    own = d.groupBy("doc_id").agg(F.min("t").alias("t"))
    given = links.selectExpr("next_id doc_id", "doc_id owner", "half")
    parts = own.join(given, "doc_id").selectExpr("owner doc_id", "substring(t, 1, half) head")
    whole = own.join(parts, "doc_id").withColumn("n", F.length("t"))
    edited = F.concat(F.expr("substring(t, 1, n - n div 2)"), F.col("head"))
    whole = whole.select("doc_id", F.col("n").cast("long").alias("n_chars"), "t", edited.alias("edited"))
    both = whole.select("doc_id", F.explode(F.array(F.struct(F.lit(0).alias("e"), F.col("t")), F.struct(F.lit(1).alias("e"), F.col("edited").alias("t")))).alias("x"))
    prints = signatures(both.select("doc_id", "x.e", "x.t"), ["doc_id", "e"], samples).groupBy("doc_id").agg(
        F.max(F.when(F.col("e") == 0, F.col("fingerprint"))).alias("fingerprint"), F.max(F.when(F.col("e") == 1, F.col("fingerprint"))).alias("edited_fingerprint"),
    )
    prints = prints.select("doc_id", *[F.unhex(x).alias(x) for x in ("fingerprint", "edited_fingerprint")])  # half as wide as the digits
    one = whole.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256")).join(prints, "doc_id")
    one = stage(one, "prints")
    del prints, both, whole, parts, own
    release(docs.sparkSession)
    nxt = links.select("doc_id", "next_id").join(one.select(F.col("doc_id").alias("next_id"), F.col("fingerprint").alias("nf")), "next_id")
    out = one.join(nxt, "doc_id").select("doc_id", "n_chars", "edited_sha256", *[F.lower(F.hex(x)).alias(x) for x in ("fingerprint", "edited_fingerprint", "nf")])
    near = [likeness("fingerprint", x, samples).alias(y) for x, y in (("edited_fingerprint", "near_edited"), ("nf", "near_next"))]
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", *near)
