"""Listing, search and totals over the session catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import display

SID = "session_id"


def search_sessions(sessions: DataFrame, query: str) -> DataFrame:
    """Case-insensitive match in name, first message, session id or model."""
    if not query:
        return sessions
    q = query.lower()
    cond = F.lit(False)
    for name in ("name", "first_message", SID, "model"):
        if name in sessions.columns:
            cond = cond | F.coalesce(F.contains(F.lower(name), F.lit(q)), F.lit(False))
    return sessions.filter(cond)


def filter_project(sessions: DataFrame, roots: DataFrame, key: str) -> DataFrame:
    """Sessions whose fork root lies in a project (``roots``: session_id, root_key)."""
    return sessions.join(roots.filter(F.col("root_key") == key).select(SID), SID, "left_semi")


def group_by_date(sessions: DataFrame, now: Column, tz: str = "UTC") -> DataFrame:
    """Sessions with their date group and its rank, newest first."""
    grouped = sessions.withColumn("date_group", display.date_group(F.col("mtime"), now, tz))
    ranked = grouped.withColumn("group_rank", display.date_group_rank(F.col("date_group")))
    return ranked.orderBy("group_rank", F.col("mtime").desc(), SID)


def catalogue_totals(sessions: DataFrame) -> DataFrame:
    return sessions.agg(
        F.count(F.lit(1)).alias("sessions"),
        F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("total_tokens"),
        F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("cost_usd"),
    )


def session_title(sessions: DataFrame) -> DataFrame:
    """Title: name, first message or id; the recap is the subtitle."""
    blank = F.lit("")
    name = F.nullif("name", blank) if "name" in sessions.columns else F.lit(None).cast("string")
    return sessions.withColumn("title", F.coalesce(name, F.nullif("first_message", blank), SID)).withColumn(
        "subtitle", F.col("recap")
    )


def sort_by_mtime(sessions: DataFrame, limit: int | None = None) -> DataFrame:
    """Newest first; with a limit, a top-k report."""
    out = sessions.orderBy(F.col("mtime").desc(), SID)
    return out if limit is None else out.limit(limit)
