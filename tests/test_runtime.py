"""Broadcasts go by measured sizes: estimates of staged tables with VARIANT columns are far too small."""

import datetime

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from turnweave.plans.runtime import ESTIMATED, MEASURED, configure, stage

LIMIT = "10485760b"
KINDS = ["signup", "view", "click", "purchase", "error"]


@pytest.fixture
def limits(spark):
    """The session's limits, put back afterwards."""
    spark.conf.set(ESTIMATED, LIMIT)
    spark.conf.unset(MEASURED)
    yield spark
    configure(spark, measured=False)
    spark.conf.unset(ESTIMATED)
    spark.conf.unset(MEASURED)


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    """A directory with 80 events of 4 users."""
    start = datetime.datetime(2024, 1, 1)
    rows = [(i, start + datetime.timedelta(seconds=40 * i), i % 4, KINDS[(i + i // 4) % 5], float(i % 9), f'{{"k": {i * 7 % 100}}}') for i in range(80)]
    at = str(tmp_path_factory.mktemp("events"))
    spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string").write.parquet(f"{at}/events.parquet")
    return at


def planned(df):
    """The plan before anything is measured."""
    return df._jdf.queryExecution().sparkPlan().toString()


def joined(spark):
    wide = stage(spark.range(2000).select(F.col("id"), F.parse_json(F.concat(F.lit('{"a":'), F.col("id"), F.lit("}"))).alias("v")))
    return wide.select("id").join(wide.select("id").withColumn("twice", F.col("id") * 2), "id")


def test_estimates_make_no_broadcast(limits):
    df = joined(configure(limits))
    assert "BroadcastExchange" not in planned(df) and "SortMergeJoin" in planned(df)
    assert df.count() == 2000


def test_measured_tables_are_broadcast(limits):
    df = joined(configure(limits))
    df.collect()
    assert "BroadcastHashJoin" in df._jdf.queryExecution().executedPlan().toString()


def test_limits_are_put_back(limits):
    configure(configure(limits))
    assert (limits.conf.get(ESTIMATED), limits.conf.get(MEASURED)) == ("-1", LIMIT)
    configure(limits, measured=False)
    assert limits.conf.get(ESTIMATED) == LIMIT and limits.conf.get(MEASURED, None) is None
    limits.conf.set(MEASURED, "5m")
    configure(limits)
    assert (limits.conf.get(ESTIMATED), limits.conf.get(MEASURED)) == ("-1", "5m")
    configure(limits, measured=False)
    assert (limits.conf.get(ESTIMATED), limits.conf.get(MEASURED)) == (LIMIT, "5m")


@pytest.mark.parametrize("name", [
    "g02_live_chain", "g04_live_filter", "l12_agent_edges", "m08_context", "o06_ongoing_deep", "m01_messages", "m03_attached_agents", "k10_last_output",
    "t03_team_tasks", "x01_tool_usage", "c22_blocks", "k06_chunks", "k03_items", "l07_linked_agents", "t01_teams",
])
def test_queries_broadcast_no_estimate(limits, events, name):
    assert "BroadcastExchange" not in planned(__spark_entry__.queries()[name](limits, events))
