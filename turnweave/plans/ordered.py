"""Ordered computations inside one session that no single task has to hold.

A plain window over a session sorts the whole session in one task, and one session may hold a large
share of all rows. Here a session is cut into segments of bounded order range. A window works inside
each segment, a small table with one row per segment carries the state from segment to segment, and
a join hands each segment its carry. Results equal those of the plain window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import stage

SEGMENT = 1 << 16
TEXT_PART_BYTES = 16 << 20


def _cols(order: str | Sequence[str]) -> list[str]:
    return [order] if isinstance(order, str) else list(order)


def ordered_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: str | Sequence[str],
    *,
    before: dict[str, Column] | None = None,
    after: dict[str, Column] | None = None,
    totals: dict[str, Column] | None = None,
    segment: int = SEGMENT,
    segment_by: Column | None = None,
) -> DataFrame:
    """Add order-bound columns per key.

    ``before``: last non-null value strictly before the row. ``after``: first non-null value strictly
    after it. ``totals``: running sum up to and including the row. ``order`` must be unique within a
    key; a single bigint column unless only ``totals`` are asked for, and then ``segment_by`` must
    rise with the order.
    """
    before, after, totals = before or {}, after or {}, totals or {}
    keys, order = list(keys), _cols(order)
    seg_expr = segment_by if segment_by is not None else F.expr(f"`{order[0]}` div {segment}")
    inputs = {f"__b_{n}": c for n, c in before.items()}
    inputs |= {f"__a_{n}": c for n, c in after.items()}
    inputs |= {f"__t_{n}": c for n, c in totals.items()}
    base = df.withColumns({**inputs, "__seg": seg_expr})

    part = Window.partitionBy(*keys, "__seg")
    ahead = part.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    upto = part.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    # looking ahead is looking back in descending order: frames that end at "unbounded following"
    # are recomputed for every row
    behind = part.orderBy(*[F.col(c).desc() for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    local = {f"__lb_{n}": F.last(f"__b_{n}", ignorenulls=True).over(ahead) for n in before}
    local |= {f"__la_{n}": F.last(f"__a_{n}", ignorenulls=True).over(behind) for n in after}
    local |= {f"__lt_{n}": F.sum(f"__t_{n}").over(upto) for n in totals}
    inner = base.withColumns(local)

    pos = F.col(order[0])
    aggs = [F.max_by(f"__b_{n}", F.when(F.col(f"__b_{n}").isNotNull(), pos)).alias(f"__b_{n}") for n in before]
    aggs += [F.min_by(f"__a_{n}", F.when(F.col(f"__a_{n}").isNotNull(), pos)).alias(f"__a_{n}") for n in after]
    aggs += [F.sum(f"__t_{n}").alias(f"__t_{n}") for n in totals]
    summary = base.groupBy(*keys, "__seg").agg(*aggs)
    back = Window.partitionBy(*keys).orderBy("__seg").rowsBetween(Window.unboundedPreceding, -1)
    fore = Window.partitionBy(*keys).orderBy(F.col("__seg").desc()).rowsBetween(Window.unboundedPreceding, -1)
    carry = summary.select(
        *keys,
        "__seg",
        *[F.last(f"__b_{n}", ignorenulls=True).over(back).alias(f"__cb_{n}") for n in before],
        *[F.last(f"__a_{n}", ignorenulls=True).over(fore).alias(f"__ca_{n}") for n in after],
        *[F.sum(f"__t_{n}").over(back).alias(f"__ct_{n}") for n in totals],
    )
    out = inner.join(carry, [*keys, "__seg"], "left")
    result = {n: F.coalesce(f"__lb_{n}", f"__cb_{n}") for n in before}
    result |= {n: F.coalesce(f"__la_{n}", f"__ca_{n}") for n in after}
    result |= {n: F.coalesce(f"__lt_{n}", F.lit(0)) + F.coalesce(f"__ct_{n}", F.lit(0)) for n in totals}
    keep = [c for c in df.columns if c not in result]
    return out.select(*keep, *[c.alias(n) for n, c in result.items()])


def text_parts(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    text: str,
    *,
    out: str = "text",
    sep: str = "\n",
    part_bytes: int = TEXT_PART_BYTES,
    segment: int = SEGMENT,
) -> DataFrame:
    """Join the texts of a group in order, as parts of bounded size.

    Nearly every group is one part. A group whose text is larger continues in part 1, 2, …; the
    parts joined by ``sep`` give the whole text.
    """
    size = F.octet_length(text).cast("bigint") + len(sep)
    sized = ordered_scan(
        df.select(*keys, order, text), keys, order, totals={"__end": size}, segment=segment
    )
    start = F.col("__end") - size
    rows = sized.withColumn("part_no", F.floor(start / F.lit(part_bytes)).cast("bigint"))
    joined = rows.groupBy(*keys, "part_no").agg(
        F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))).alias("__rows")
    )
    return joined.select(
        *keys, "part_no", F.array_join(F.transform("__rows", lambda r: r["t"]), sep).alias(out)
    )


def range_rank(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Add the 1-based position of each row in its key; ``order`` must be unique within a key, nulls come first.

    Rows are dealt out by sampled ranges of key and order, so a key of any size spreads over tasks, however its order values are
    bunched. Positions count inside a range; only one row a key and range is looked at in order. The rows are written once.
    """
    laid = stage(df.repartitionByRange(*keys, *order).withColumn("__part", F.spark_partition_id()))
    inside = F.row_number().over(Window.partitionBy(*keys, "__part").orderBy(*order))
    behind = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = laid.groupBy(*keys, "__part").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.select(*keys, "__part", F.sum("__n").over(behind).alias("__before")).filter("__before > 0")
    placed = laid.withColumn("__in", inside).join(before, [*keys, "__part"], "left")
    return placed.select(*df.columns, (F.col("__in") + F.coalesce("__before", F.lit(0))).cast("bigint").alias(name))


def first_k(df: DataFrame, keys: Sequence[str], order: str, k: int) -> DataFrame:
    """The first k rows of each key; Spark keeps at most k per key before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return df.withColumn("__rank", rank).filter(F.col("__rank") <= k).drop("__rank")
