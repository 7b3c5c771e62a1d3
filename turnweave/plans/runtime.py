"""Session settings and durable intermediate results."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every plan here relies on. Time zone: naive timestamps are read as UTC.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}

# Sizes of tables that are joined by broadcast: by estimate, and as measured while a plan runs.
ESTIMATED, MEASURED = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
_GIVEN = "spark.turnweave.autoBroadcastJoinThreshold"


def configure(spark: SparkSession, *, measured: bool = True) -> SparkSession:
    """Apply the runtime settings to an existing session.

    ``measured``: the session's broadcast limit holds for what a shuffle has written, not for estimates. Spark counts a VARIANT
    column as 2 KB, so a few plain columns of a staged table with some of them are estimated at a hundredth of their size or less, and
    tables of any size went through the driver. Without it the limit that was given for estimates is put back.
    """
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    limit, given = spark.conf.get(ESTIMATED), spark.conf.get(_GIVEN, None)
    own = spark.conf.get(MEASURED, None) in (None, given)  # a limit that others set for measured sizes stays
    if measured and limit != "-1":
        spark.conf.set(_GIVEN, limit)
        if own:
            spark.conf.set(MEASURED, limit)
        spark.conf.set(ESTIMATED, "-1")
    elif not measured and limit == "-1" and given is not None:
        spark.conf.set(ESTIMATED, given)
        spark.conf.unset(_GIVEN)
        if own:
            spark.conf.unset(MEASURED)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the cluster; a temporary one only for local runs."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="turnweave-ckpt-")
    sc.setCheckpointDir(configured)
    return configured


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, so a lost executor costs no recomputation."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stage(df: DataFrame) -> DataFrame:
    """Write a table that several later steps read, as Parquet in the shared folder, and read it back.

    Steps that look at their input twice would otherwise double the work of all steps before them.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
