"""Roll-ups over items: tool usage and edit churn."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import jsonx, tools
from .entries import IDENTITY

SID = "session_id"


def tool_usage(items: DataFrame) -> DataFrame:
    """Calls, errors and time per category, tool and MCP server."""
    c = F.col
    calls = items.filter(c("item_type").isin("ToolCall", "Subagent"))
    name = c("raw_tool_name")
    return calls.groupBy(
        "tool_category", name.alias("tool"), F.coalesce(tools.mcp_parts(name)["server"], F.lit("")).alias("server")
    ).agg(
        F.count(F.lit(1)).alias("calls"),
        F.count_if(c("tool_error")).alias("errors"),
        F.count_if(c("is_orphan") | c("is_deferred")).alias("unresolved"),
        F.sum("duration_ms").alias("duration_ms"),
    )


def edit_calls(items: DataFrame) -> DataFrame:
    """(keys, call, file, old, new) of edit calls with all three texts."""
    c = F.col
    v = c("tool_input")
    texts = {"file_path": "file", "old_string": "old", "new_string": "new"}
    is_text = F.lit(True)
    for k in texts:
        is_text = is_text & F.coalesce(F.schema_of_variant(jsonx.field(v, f"$.{k}")) == "STRING", F.lit(False))
    return items.filter((c("raw_tool_name") == "Edit") & is_text).select(
        *IDENTITY, c("ord").alias("call"), *[jsonx.get_str(v, f"$.{k}").alias(n) for k, n in texts.items()]
    )


def line_churn(edits: DataFrame, keys: list[str]) -> DataFrame:
    """Lines removed, added and kept per edit (``old``, ``new``), by counting equal lines wherever they stand.

    Lines are counted per key and line before they meet, so repeated lines stay small.
    """
    c = F.col
    count = lambda side, n: (
        edits.select(*keys, F.explode(F.split(side, "\n")).alias("line")).groupBy(*keys, "line").agg(F.count(F.lit(1)).alias(n))
    )
    both = count("old", "o").join(count("new", "n"), [*keys, "line"], "full")
    o, n = F.coalesce("o", F.lit(0)), F.coalesce("n", F.lit(0))
    return both.groupBy(*keys).agg(
        F.sum(F.greatest(o - n, F.lit(0))).alias("removed"),
        F.sum(F.greatest(n - o, F.lit(0))).alias("added"),
        F.sum(F.least(o, n)).alias("kept"),
    )


def common_lines(old: list[str], new: list[str]) -> int:
    """Length of the longest common subsequence, by rows of bits: one step of whole-number arithmetic a line.

    Bit i of ``rows`` is 0 where the subsequence of the lines seen so far grows at line i of ``old``.
    """
    at: dict[str, int] = {}
    for i, line in enumerate(old):
        at[line] = at.get(line, 0) | 1 << i
    whole = (1 << len(old)) - 1
    rows = whole
    for line in new:
        hit = rows & at.get(line, 0)
        rows = ((rows + hit) | (rows - hit)) & whole
    return len(old) - rows.bit_count()


def line_diff(edits: DataFrame, keys: list[str]) -> DataFrame:
    """Lines removed, added and kept per edit (``old``, ``new``) of an ordered line diff that keeps as many lines as can be.

    Equal beginnings and ends are set apart first. An edit is one row, so the work is spread by edits.
    """

    def work(batches):
        for pdf in batches:
            out = []
            for old, new in zip(pdf["old"], pdf["new"]):
                a, b = old.split("\n"), new.split("\n")
                head = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
                c, d = a[head:], b[head:]
                tail = next((i for i, (x, y) in enumerate(zip(reversed(c), reversed(d))) if x != y), min(len(c), len(d)))
                kept = head + tail + common_lines(c[: len(c) - tail], d[: len(d) - tail])
                out.append((len(a) - kept, len(b) - kept, kept))
            counts = pd.DataFrame(out, columns=["removed", "added", "kept"])
            yield pd.concat([pdf[keys].reset_index(drop=True), counts], axis=1)

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in edits.select(*keys).schema.fields)
    texts = edits.filter("old IS NOT NULL AND new IS NOT NULL").select(*keys, "old", "new")
    return texts.mapInPandas(work, f"{fields}, removed bigint, added bigint, kept bigint")


def edit_churn(items: DataFrame) -> DataFrame:
    """Edit calls and churned lines per session and file."""
    edits = edit_calls(items)
    churn = line_diff(edits, [*IDENTITY, "call", "file"])
    return churn.groupBy(SID, "file").agg(
        F.count(F.lit(1)).alias("edits"), *[F.sum(x).alias(x) for x in ("removed", "added", "kept")]
    )
