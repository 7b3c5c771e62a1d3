"""Debug logs: entries, filters, collapsing, hook messages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ordered import SEGMENT, TEXT_PART_BYTES, ordered_scan, range_rank, text_parts

SID = "session_id"
# Levels in rising order.
LEVELS = ["DEBUG", "WARN", "ERROR"]
LINE = r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3}Z)\s+\[(DEBUG|WARN|ERROR)\]\s+(.*)$"
CATEGORY = r"^\[([^\]]+)\]\s*(.*)$"
HOOK = r"^Hook ([^ (]+) \(([^)]+)\) (success|error|blocked):$"


def _placed(lines: DataFrame, segment: int) -> DataFrame:
    c = F.col
    trimmed = lines.select(SID, "line_no", F.regexp_replace("value", r"(?U)\s+\z", "").alias("v"))
    head = trimmed.withColumn("is_head", c("v").rlike(LINE))
    return ordered_scan(head, [SID], "line_no", segment=segment, before={"entry_line": F.when(c("is_head"), c("line_no"))})


def _extras(lines: DataFrame, segment: int, part_bytes: int) -> DataFrame:
    """Lines without a header, joined per entry in parts of bounded size."""
    more = _placed(lines, segment).filter(~F.col("is_head") & (F.col("v") != "") & F.col("entry_line").isNotNull())
    return text_parts(more, [SID, "entry_line"], "line_no", "v", out="extra", segment=segment, part_bytes=part_bytes)


def debug_more(lines: DataFrame, segment: int = SEGMENT, part_bytes: int = TEXT_PART_BYTES) -> DataFrame:
    """(session_id, entry_line, part_no, extra): what very long extras hold beyond the part that ``parse_debug`` shows.

    Parts joined by line breaks give the whole; part numbers rise but need not be dense.
    """
    parts = _extras(lines, segment, part_bytes)
    first = parts.groupBy(SID, "entry_line").agg(F.min("part_no").alias("__first"))
    return parts.join(first, [SID, "entry_line"]).filter("part_no > __first").drop("__first")


def parse_debug(lines: DataFrame, segment: int = SEGMENT, part_bytes: int = TEXT_PART_BYTES) -> DataFrame:
    """Debug entries of numbered lines (session_id, line_no, value), one row each.

    Lines without a header belong to the entry before; ``extra`` holds them joined. Of a very long extra it holds the first part,
    ``debug_more`` has the others, and the functions below take both.
    """
    c = F.col
    first = _extras(lines, segment, part_bytes).groupBy(SID, "entry_line").agg(F.min_by("extra", "part_no").alias("extra"))
    body = F.regexp_extract("v", LINE, 3)
    level = F.regexp_extract("v", LINE, 2)
    tagged = body.rlike(CATEGORY)
    trimmed = lines.select(SID, "line_no", F.regexp_replace("value", r"(?U)\s+\z", "").alias("v"))
    entries = trimmed.filter(c("v").rlike(LINE)).select(
        SID,
        c("line_no").alias("entry_line"),
        F.regexp_extract("v", LINE, 1).try_cast("timestamp").alias("ts"),
        level.alias("level"),
        (F.array_position(F.array(*[F.lit(x) for x in LEVELS]), level) - 1).cast("int").alias("level_rank"),
        F.when(tagged, F.regexp_extract(body, CATEGORY, 1)).otherwise("").alias("category"),
        F.when(tagged, F.regexp_extract(body, CATEGORY, 2)).otherwise(body).alias("message"),
    )
    return entries.join(first, [SID, "entry_line"], "left").withColumns(
        {
            "extra": F.coalesce("extra", F.lit("")),
            "part_no": F.lit(0).cast("bigint"),
            "line_num": c("entry_line") + 1,
            "entry_count": F.lit(1).cast("bigint"),
        }
    )


def filter_level(entries: DataFrame, level: str) -> DataFrame:
    return entries.filter(F.col("level_rank") >= LEVELS.index(level))


def _all_parts(entries: DataFrame, more: DataFrame) -> DataFrame:
    """The parts of the entries that have several, the first one with part number -1."""
    first = entries.join(more.select(SID, "entry_line").distinct(), [SID, "entry_line"], "left_semi")
    return first.select(SID, "entry_line", F.lit(-1).cast("bigint").alias("part_no"), "extra").unionByName(more.select(SID, "entry_line", "part_no", "extra"))


def filter_text(entries: DataFrame, query: str, more: DataFrame | None = None) -> DataFrame:
    """Entries with the query in message, category or extra, in any case; ``more``: the further parts of long extras.

    A match may lie across parts: the ends of an entry's parts, as long as the query, are joined in order and searched too.
    """
    if not query:
        return entries
    c = F.col
    q = F.lit(query.lower())
    has = lambda name: F.contains(F.lower(name), q)
    shown = has("message") | has("category") | has("extra")
    if more is None:
        return entries.filter(shown)
    n = 2 * len(query)  # lower case may be longer
    ends = F.when(F.length("extra") <= 2 * n, c("extra")).otherwise(F.concat(F.left("extra", F.lit(n)), F.lit("\0"), F.right("extra", F.lit(n))))
    parts = _all_parts(entries, more).select(SID, "entry_line", "part_no", ends.alias("e"), has("extra").alias("inside"))
    joined = parts.groupBy(SID, "entry_line").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part_no", "e"))), lambda x: x["e"]), "\n").alias("e"), F.max("inside").alias("inside")
    )
    deep = joined.filter(c("inside") | has("e")).select(SID, "entry_line", F.lit(True).alias("__deep"))
    return entries.join(deep, [SID, "entry_line"], "left").filter(shown | c("__deep")).drop("__deep")


def collapse_duplicates(entries: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Neighbouring entries with equal message and no extra become one with a count."""
    c = F.col
    plain = F.when(c("extra") == "", c("message"))
    mark = F.struct(plain.alias("m"))
    prev = ordered_scan(entries, [SID], "entry_line", segment=segment, before={"__prev": mark})
    same = plain.isNotNull() & (c("__prev")["m"] == plain)
    starts = prev.withColumn("__start", ~F.coalesce(same, F.lit(False)))
    island = ordered_scan(
        starts, [SID], "entry_line", segment=segment, before={"__head": F.when(c("__start"), c("entry_line"))}
    ).withColumn("__head", F.when(c("__start"), c("entry_line")).otherwise(c("__head")))
    counts = island.groupBy(SID, c("__head").alias("entry_line")).agg(F.count(F.lit(1)).alias("__n"))
    heads = entries.join(counts, [SID, "entry_line"])
    return heads.withColumn("entry_count", c("__n")).drop("__n")


def debug_hooks(entries: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """Hook runs told by the debug log; Stop hooks are in the transcript already. ``more``: further parts of long extras."""
    c = F.col
    full = F.regexp_extract("message", HOOK, 1)
    event = F.regexp_extract("message", HOOK, 2)
    colon = F.instr(full, ":")
    name = F.when(colon > 0, F.substring(full, colon + 1, F.length(full))).otherwise(full)
    hooks = entries.filter(c("message").rlike(HOOK) & (event != "Stop")).select(
        SID, "entry_line", "ts", event.alias("hook_event"), name.alias("hook_name"), c("extra").alias("hook_command")
    )
    if more is None:
        return hooks
    parts = _all_parts(hooks.withColumnRenamed("hook_command", "extra"), more.join(hooks.select(SID, "entry_line"), [SID, "entry_line"], "left_semi"))
    whole = parts.groupBy(SID, "entry_line").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part_no", "extra"))), lambda x: x["extra"]), "\n").alias("__whole")
    )
    return hooks.join(whole, [SID, "entry_line"], "left").withColumn("hook_command", F.coalesce("__whole", "hook_command")).drop("__whole")


def merge_hooks(msgs: DataFrame, hooks: DataFrame) -> DataFrame:
    """Messages with the hook runs of the debug log.

    Sessions that have such hooks are ordered by time (transcript before log, then line) and
    numbered anew; all others keep their lines.
    """
    c = F.col
    given = {
        SID: c(SID), "agent_id": F.lit(""), "line_no": c("entry_line"), "kind": F.lit("hook"), "rule": F.lit("debug_hook"),
        "ts": c("ts"), "hook_event": c("hook_event"), "hook_name": c("hook_name"), "hook_command": c("hook_command"),
        "is_meta": F.lit(True),
    }
    empty = {"string": F.lit(""), "boolean": F.lit(False), "int": F.lit(0), "bigint": F.lit(0).cast("bigint")}
    nulls = ("hook_output_path", "hook_metadata")
    added = hooks.select(
        *[given.get(n, F.lit(None).cast(t) if n in nulls else empty.get(t, F.lit(None).cast(t))).alias(n) for n, t in msgs.dtypes]
    )
    touched = hooks.select(SID, F.lit("").alias("agent_id")).distinct()
    keys = [SID, "agent_id"]
    both = msgs.join(touched, keys, "left_semi").withColumn("__src", F.lit(0)).unionByName(added.withColumn("__src", F.lit(1)))
    # places are found for narrow rows, then joined to the messages
    times = both.select(*keys, F.coalesce(F.unix_micros("ts"), F.lit(0)).alias("__t"), "__src", "line_no")
    place = range_rank(times, keys, ["__t", "__src", "line_no"], "__n").drop("__t")
    renumbered = both.join(place, [*keys, "__src", "line_no"]).withColumn("line_no", c("__n") - 1).select(*msgs.columns)
    return msgs.join(touched, keys, "left_anti").unionByName(renumbered)
