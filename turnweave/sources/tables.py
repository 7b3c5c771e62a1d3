"""Change detection and table output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STAMP = ["path", "mtime", "file_size"]


def changed_files(listing: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files that are new or whose time or size differs from the saved manifest."""
    return listing.join(manifest.select(*STAMP), STAMP, "left_anti")


def touched_sessions(changed: DataFrame) -> DataFrame:
    return changed.select("project_key", "session_id").distinct()


def write_tables(tables: dict[str, DataFrame], out: str, buckets: int = 64, mode: str = "overwrite") -> None:
    """Write tables as Parquet below ``out``, partitioned by a hash of the session.

    Rows of one session lie together, and a rewrite touches only its buckets. Large sessions are
    spread over several files by their own rows. VARIANT columns are written as JSON text.
    """
    for name, df in tables.items():
        flat = df.select(
            *[F.to_json(c).alias(c) if t == "variant" else F.col(c) for c, t in df.dtypes]
        )
        if "session_id" in df.columns:
            flat = flat.withColumn("session_bucket", F.expr(f"pmod(xxhash64(session_id), {buckets})").cast("int"))
            # rebalance splits a bucket that holds a very large session into several tasks
            flat = flat.hint("rebalance", F.col("session_bucket"))
            writer = flat.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("session_bucket")
        else:
            writer = flat.write.mode(mode)
        writer.parquet(f"{out}/{name}")


def read_table(spark: SparkSession, out: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{out}/{name}")


def to_json_rows(df: DataFrame) -> DataFrame:
    """Rows as JSON text, as clients receive them."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))
