import json
import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("turnweave-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "6g")
        # a few rows per test: compiling the plans would take longer than running them
        .config("spark.sql.codegen.wholeStage", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("ckpt")))
        .config("spark.sql.streaming.stateStore.providerClass",
                "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def write_lines(path, rows, end="\n"):
    """Write dicts as JSON lines; strings go as they are."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    text = "\n".join(r if isinstance(r, str) else json.dumps(r, ensure_ascii=False) for r in rows)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text + end if rows else "")


def lines_frame(spark, sessions):
    """Numbered lines of {(session_id, agent_id): [rows]} without files."""
    out = []
    for (sid, agent), rows in sessions.items():
        for i, r in enumerate(rows):
            value = r if isinstance(r, str) else json.dumps(r, ensure_ascii=False)
            role = "subagent" if agent else "main"
            out.append((f"/p/proj/{sid}.jsonl", "proj", sid, agent, role, i, value))
    df = spark.createDataFrame(
        out,
        "path string, project_key string, session_id string, agent_id string, file_role string, line_no bigint, value string",
    )
    return df.selectExpr("*", "timestamp'2026-01-01 00:00:00' as mtime", "cast(1 as bigint) as file_size")


def collect(df, *order):
    rows = [r.asDict(recursive=True) for r in df.collect()]
    return sorted(rows, key=lambda r: tuple((r[o] is None, r[o]) for o in order)) if order else rows


def user(uuid, text, parent="", **kw):
    return {"type": "user", "uuid": uuid, "parentUuid": parent or None, "message": {"role": "user", "content": text}, **kw}


def assistant(uuid, blocks, parent="", model="claude-sonnet-4", stop=None, usage=None, **kw):
    msg = {"role": "assistant", "model": model, "content": blocks}
    if stop is not None:
        msg["stop_reason"] = stop
    if usage is not None:
        msg["usage"] = usage
    return {"type": "assistant", "uuid": uuid, "parentUuid": parent or None, "message": msg, **kw}


def call(id, name, /, **inp):
    return {"type": "tool_use", "id": id, "name": name, "input": inp}


def result(id, content, **kw):
    return {"type": "tool_result", "tool_use_id": id, "content": content, **kw}


def txt(s):
    return {"type": "text", "text": s}
