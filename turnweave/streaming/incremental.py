"""The session catalogue kept up to date by what was appended.

The store holds, per session file, what the catalogue needs to go on: request snapshots, first seen directories, shutdown
approvals and one row of marks. A refresh reads only the bytes behind what each file is known to hold, turns them into the same
tables and merges these into the buckets of the touched sessions, which are overwritten alone. Files that shrank or went away lose
what they had.

Sums are stored in one row with the number of bytes they cover, everything else merges to the same result when merged twice; so a
refresh that was cut off is simply run again. A last line without its break waits for it.
"""

from __future__ import annotations

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tokens
from ..operators import catalogue
from ..operators.classify import USAGE
from ..operators.entries import by_file, parse_entries, plain_ids
from ..plans.runtime import stage
from ..sources.tail import SPLIT_BYTES, _open, owned_lines
from ..sources.transcripts import list_files, with_file_identity

SID = "session_id"  # here the key of ``by_file``
BUCKETS = 64
FILES = "bucket int, project_key string, session_id string, agent_id string, file_role string, path string, mtime timestamp, upto bigint, loose struct<" + ", ".join(
    f"{u}:bigint" for u in (*USAGE, "units")
) + ">"


def _bucket(buckets: int) -> Column:
    return F.expr(f"pmod(xxhash64(session_id), {buckets})").cast("int")


def _read(spark: SparkSession, store: str, name: str, schema: str) -> DataFrame:
    try:
        spark.read.parquet(f"{store}/{name}").schema
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{store}/{name}")


def _write(df: DataFrame, store: str, name: str, buckets: int) -> None:
    """Overwrite the buckets that ``df`` has rows in; it may have been read from the same table."""
    rows = stage(df.withColumn("bucket", _bucket(buckets)))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{store}/{name}")


def appended_lines(ranges: DataFrame, split: int = SPLIT_BYTES) -> DataFrame:
    """Lines of the byte ranges (path, start, end), cut into splits; ``line_no`` is the place of a line's first byte."""

    def read(frames):
        for frame in frames:
            for path, start, end in zip(frame["path"], frame["start"], frame["end"]):
                disk, place = _open(path)
                rows, size = [], 0
                with disk.open_input_file(place) as f:
                    for at, line in owned_lines(f, start, end):
                        rows.append((path, at, line.decode("utf-8", "replace")))
                        size += len(line)
                        if size > 4 << 20:
                            yield pd.DataFrame(rows, columns=["path", "line_no", "value"])
                            rows, size = [], 0
                yield pd.DataFrame(rows, columns=["path", "line_no", "value"])

    cut = ranges.filter("end > start").select("path", F.explode(F.sequence("start", F.col("end") - 1, F.lit(split).cast("bigint"))).alias("start"), "end")
    pieces = cut.select("path", "start", F.least(F.col("end"), F.col("start") + split).alias("end"))
    return pieces.repartition("path", "start").mapInPandas(read, "path string, line_no bigint, value string")


def _snapshots(entries: DataFrame) -> DataFrame:
    """Best snapshot of each request of each file."""
    c = F.col
    rows = catalogue.token_rows(entries, "catalogue", extra=["path"]).filter(c("request_id") != "")
    units = tokens.cost_units(c("model"), *[c(u) for u in USAGE]).cast("bigint").alias("units")
    best = F.max(F.struct("has_stop", "output_tokens", "agent_id", "line_no", F.struct("model", *USAGE, units).alias("snap")))
    return rows.groupBy(SID, "path", "request_id").agg(best.alias("best"))


def _loose(entries: DataFrame) -> DataFrame:
    """Sums of the usage rows without a request id, by file; those of main files cost nothing in the catalogue."""
    c = F.col
    rows = catalogue.token_rows(entries, "catalogue", extra=["path"]).filter(c("request_id") == "")
    units = F.when(c("agent_id") != "", tokens.cost_units(F.lit(""), *[c(u) for u in USAGE])).otherwise(0).cast("bigint")
    return rows.groupBy("path").agg(F.struct(*[F.sum(u).alias(u) for u in USAGE], F.sum(units).alias("units")).alias("loose"))


def _marks(entries: DataFrame, known: DataFrame) -> DataFrame:
    """One row a session: everything of its main lines but requests and directories."""
    out = catalogue.attribute_marks(entries)
    for part in (catalogue.turn_parts(entries), catalogue.first_message_parts(entries), catalogue.recap_marks(entries), catalogue.activity_marks(entries, known)):
        out = out.join(part, SID, "left")
    return out


def _merge_marks(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old and new marks of a session, the new ones of later lines."""
    c = F.col
    first, last = F.min, F.max
    picks = {
        "cwd": last, "git_branch": last, "permission_mode": last, "forked_from_session_id": first, "model": first, "first_ts": first,
        "last_ts": last, "said": first, "command": first, "mark": last, "ended": last, "acted": last,
    }
    both = old.withColumn("part", F.lit(0)).unionByName(new.withColumn("part", F.lit(1)))
    of = lambda name, part: F.max(F.when(c("part") == part, c(name)))
    bridge = F.when((of("tail", 0) == 1) & (of("head", 1) == 0), 1).otherwise(0)
    turns = F.sum("turn_count") + bridge
    return both.groupBy(SID).agg(
        *[pick(n).alias(n) for n, pick in picks.items()], F.sum("line_count").alias("line_count"), turns.cast("bigint").alias("turn_count"),
        F.coalesce(of("head", 0), of("head", 1)).alias("head"), F.coalesce(of("tail", 1), of("tail", 0)).alias("tail"), F.max("upto").alias("upto"),
    )


def refresh_catalogue(spark: SparkSession, root: str, store: str, buckets: int = BUCKETS) -> None:
    """Bring the store up to the files below ``root``; ``read_catalogue`` shows it. The number of buckets is fixed by the first."""
    c = F.col
    listed = stage(by_file(list_files(spark, root)))
    saved = _read(spark, store, "files", FILES)
    # the marks say how much of a main file is in them; they may be ahead of the list after a cut off refresh
    shape = _marks(parse_entries(with_file_identity(appended_lines(spark.createDataFrame([], "path string, start bigint, end bigint")))), spark.createDataFrame([], f"{SID} string, tool_id string, approved bigint"))
    marks_schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in shape.schema) + ", upto bigint, bucket int"
    marks = _read(spark, store, "marks", marks_schema)
    ahead = marks.select(SID, c("upto").alias("__marked"))
    known = saved.join(ahead, SID, "left").select("path", c(SID).alias("__sid"), c("mtime").alias("__mtime"), c("upto").alias("__files_upto"), c("file_role").alias("__role"), "__marked", "loose")
    both = listed.join(known, "path", "full").withColumn("__key", F.coalesce(SID, "__sid"))
    before = F.when(F.coalesce("file_role", "__role") == "main", F.coalesce("__marked", F.lit(0))).otherwise(F.coalesce("__files_upto", F.lit(0)))
    size = F.coalesce("file_size", F.lit(0)).cast("bigint")
    state = both.withColumns({"before": before, "size": size, "gone": c(SID).isNull()}).withColumn("anew", (c("size") < c("before")) | c("gone"))
    moved = state.filter((c("size") != c("before")) | ~c("mtime").eqNullSafe(c("__mtime")) | (c("size") != F.coalesce("__files_upto", F.lit(-1))))
    moved = stage(moved.select("path", c("__key").alias(SID), "before", "size", "gone", "anew", "loose"))
    touched = [r[0] for r in moved.select(_bucket(buckets)).distinct().collect()]  # at most the number of buckets
    if not touched:
        return
    lost = moved.filter("anew").select("path", SID)
    ranges = moved.filter("NOT gone").select("path", F.when(c("anew"), 0).otherwise(c("before")).cast("bigint").alias("start"), c("size").alias("end"))
    entries = stage(parse_entries(by_file(with_file_identity(appended_lines(ranges)))))
    mine = lambda name, schema: _read(spark, store, name, schema + ", bucket int").filter(c("bucket").isin(touched)).drop("bucket")

    new = _snapshots(entries)
    old = mine("requests", ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in new.schema)).join(lost, ["path", SID], "left_anti")
    _write(old.unionByName(new).groupBy(SID, "path", "request_id").agg(F.max("best").alias("best")), store, "requests", buckets)

    main_lost = lost.select(SID, "path").filter(~c("path").contains("/subagents/")).select(SID)
    new = catalogue.seen_dirs(entries)
    old = mine("dirs", f"{SID} string, dir string, first_seen bigint").join(main_lost, SID, "left_anti")
    _write(old.unionByName(new).groupBy(SID, "dir").agg(F.min("first_seen").alias("first_seen")), store, "dirs", buckets)

    old = mine("approvals", f"{SID} string, tool_id string, approved bigint").join(main_lost, SID, "left_anti")
    approvals = stage(old.unionByName(catalogue.shutdown_approvals(entries)).groupBy(SID, "tool_id").agg(F.min("approved").alias("approved")))
    _write(approvals, store, "approvals", buckets)

    main_upto = moved.filter(~c("path").contains("/subagents/") & ~c("gone")).select(SID, c("size").alias("upto"))
    fresh = main_upto.join(_marks(entries, approvals), SID, "left").withColumn("line_count", F.coalesce("line_count", F.lit(0)))
    old = marks.filter(c("bucket").isin(touched)).drop("bucket").join(main_lost, SID, "left_anti")
    _write(_merge_marks(old, fresh.select(*old.columns)), store, "marks", buckets)

    # files last: what it says is covered is covered everywhere. Rows of files that are gone stay with nothing in them
    in_touched = listed.filter(_bucket(buckets).isin(touched)).select(*[n for n in listed.columns if n != "file_size"], c("file_size").cast("bigint").alias("upto"))
    kept = mine("files", FILES.removeprefix("bucket int, "))
    absent = kept.join(listed.select("path"), "path", "left_anti").withColumns({"upto": F.lit(0).cast("bigint"), "loose": F.lit(None).cast(kept.schema["loose"].dataType)})
    was = kept.join(lost.select("path"), "path", "left_anti").select("path", c("loose").alias("__was"))
    sums = F.struct(*[(F.coalesce(f"__was.{u}", F.lit(0)) + F.coalesce(f"__new.{u}", F.lit(0))).alias(u) for u in (*USAGE, "units")]).alias("loose")
    present = in_touched.join(was, "path", "left").join(_loose(entries).withColumnRenamed("loose", "__new"), "path", "left").select(*in_touched.columns, sums)
    _write(present.unionByName(absent.select(*present.columns)), store, "files", buckets)


def read_catalogue(spark: SparkSession, store: str, now: Column) -> DataFrame:
    """The catalogue as ``plans.views.session_catalogue`` gives it, from the store alone."""
    c = F.col
    files = spark.read.schema(FILES).parquet(f"{store}/files").filter("loose IS NOT NULL").drop("bucket")
    main = files.filter("file_role = 'main'").select(SID)
    live = lambda name: spark.read.parquet(f"{store}/{name}").drop("bucket")
    marks = live("marks").join(main, SID, "left_semi")
    best = live("requests").join(files.select("path"), "path", "left_semi").groupBy(SID, "request_id").agg(F.max("best").alias("best"))
    counted = [*USAGE, "units"]
    used = best.select(SID, *[c(f"best.snap.{u}").alias(u) for u in counted]).unionByName(files.select(SID, *[c(f"loose.{u}").alias(u) for u in counted]))
    totals = used.groupBy(SID).agg(*[F.sum(u).alias(u) for u in counted]).withColumn("total_tokens", sum((c(u) for u in USAGE[1:]), c(USAGE[0])))
    totals = totals.withColumn("cost_usd", tokens.usd(c("units"))).drop("units")
    origin = live("dirs").join(main, SID, "left_semi").groupBy(SID).agg(F.min_by("dir", "first_seen").alias("origin_dir"), F.count(F.lit(1)).alias("dir_count"))
    parts = [
        marks.select(SID, *catalogue.shown_attributes()), marks.select(SID, "turn_count"), marks.select(SID, catalogue.first_message_text().alias("first_message")),
        marks.select(SID, c("mark.recap").alias("recap")), totals, origin, marks.select(SID, catalogue.active_since().alias("is_ongoing")),
    ]
    return plain_ids(catalogue.assemble(files, parts, now))
