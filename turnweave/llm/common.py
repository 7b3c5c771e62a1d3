"""Helpers shared by the corpus operators: words, hashes, staged tables and connected components.

Words are runs of anything but space and the controls 9 to 13; A-Z are lower-cased, other letters stay.
Null text counts as empty everywhere. Hashes are 64 bits wide.
"""

from __future__ import annotations

import gc
import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_INV = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_TABLE = np.random.RandomState(7).randint(0, 1 << 62, 256, dtype=np.int64).astype(_U)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit words over all bits."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def word_hashes(text: str | None) -> np.ndarray:
    """One hash per word, in order; the same word gives the same hash wherever it stands."""
    raw = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    if not len(raw):
        return np.zeros(0, _U)
    inside = ~_SPACE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    powers = np.cumprod(np.full(len(raw), _BASE, _U))
    total = np.concatenate((np.zeros(1, _U), np.cumsum(_TABLE[_LOWER[raw]] * powers)))
    back = np.cumprod(np.full(len(raw) + 1, _INV, _U))
    return mix((total[end] - total[start]) * back[start] + (end - start).astype(_U))


def shingles(words: np.ndarray, k: int = 5) -> np.ndarray:
    """A hash for every run of k words in order; with fewer words, one for the whole sequence."""
    if not len(words):
        return words
    n = min(k, len(words))
    acc = np.full(len(words) - n + 1, _U(n), _U)
    with np.errstate(over="ignore"):
        for i in range(n):
            acc = acc * _BASE + words[i : len(words) - n + 1 + i]
    return mix(acc)


def shingle_set(text: str | None, k: int = 5) -> np.ndarray:
    return np.unique(shingles(word_hashes(text), k))


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write a table to the shared folder of the cluster and read it back; lineage ends here, and its shuffle files go."""
    from turnweave.plans.runtime import checkpoint_dir

    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    release(spark)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Remove staged tables that no later step reads."""
    spark = tables[0].sparkSession
    for name in {t.inputFiles()[0] for t in tables if t.inputFiles()}:
        at = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(name)).getParent()
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def aside(df: DataFrame, names) -> tuple[DataFrame, dict[str, str]]:
    """(table, way back): columns called like one of ``names``, in any case, step aside; ``withColumnsRenamed`` takes the way back."""
    taken, back = {n.lower() for n in names}, {}
    for i, c in enumerate(df.columns):
        if c.lower() in taken:
            new = f"kept{i}"
            while new.lower() in taken | {x.lower() for x in df.columns}:
                new += "_"
            back[new] = c
    return df.withColumnsRenamed({c: new for new, c in back.items()}), back


def release(spark) -> None:
    """Let Spark remove the shuffle files of finished steps now: it does so when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node reachable from each node that has an edge (a, b).

    Alternates large-star and small-star steps on staged tables until the edges stay the same; each
    step only joins and takes minima, so no group is ever gathered. No edges: an empty result.
    """
    e = edges.filter("a <> b").selectExpr("greatest(a, b) a", "least(a, b) b").distinct()
    e = stage(e, "edges")
    seen = None
    while True:
        both = e.union(e.select("b", "a")).toDF("u", "v")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").selectExpr("v a", "m b").filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").selectExpr("b a", "m b").union(least.selectExpr("a", "m b"))
        last, e = e, stage(small.filter("a <> b").distinct(), "edges")
        discard(last)
        state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    return e.selectExpr("a node", "b component").union(e.selectExpr("b", "b").distinct())
