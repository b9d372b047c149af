"""Event-time windows over findings; the same code serves batch and stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Ours: the rule engine itself has no event time.  Later rows are dropped by
# Spark and show up as numRowsDroppedByWatermark.
WATERMARK = "10 minutes"


def windowed_counts(hits: DataFrame, ts: str, width: str, slide: str | None = None) -> DataFrame:
    """``window, category, n``; tumbling, or sliding with ``slide``."""
    rows = hits.withWatermark(ts, WATERMARK) if hits.isStreaming else hits
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    return rows.groupBy(window.alias("window"), "category").agg(F.count(F.lit(1)).alias("n"))


def sessions(beats: DataFrame, key: str, ts: str, seconds: int) -> DataFrame:
    """``key, started, last_seen, silent_at, n``: runs of heartbeats with no silence of more than ``seconds`` between.

    Spark merges session windows before and after the shuffle, so a key sends one row for each run and
    task.  A stream emits a run once the watermark has passed its silence, and keeps open runs only.
    """
    rows = beats.select(key, F.col(ts).cast("timestamp").alias("at"))
    rows = rows.withWatermark("at", WATERMARK) if beats.isStreaming else rows
    run = F.session_window("at", f"{seconds} seconds").alias("run")
    out = rows.groupBy(key, run).agg(F.min("at").alias("started"), F.max("at").alias("last_seen"), F.count(F.lit(1)).alias("n"))
    return out.select(key, "started", "last_seen", F.col("run.end").alias("silent_at"), "n")
