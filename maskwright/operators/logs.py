"""Log parsing, search, notices, and the batch forms of the alert logic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import catalog
from ..functions.text import clip_words, mask_tokens, scrub_addresses
from .alerts import rate_limited


def parse_line(raw: Column) -> Column:
    """``struct(ts, level, text)`` of one audit-log line, tokens masked."""
    warn = F.startswith(raw, F.lit("[warn] "))
    stamped = F.rlike(raw, F.lit(r"(?s)^\[.{2}:.{2}:.{2}\] "))
    text = F.when(warn, F.substring(raw, F.lit(8), F.length(raw))).when(
        stamped, F.substring(raw, F.lit(12), F.length(raw))
    ).otherwise(raw)
    errors = "|".join(catalog.LOG_ERROR_WORDS)
    level = F.when(warn, F.when(F.rlike(text, F.lit(errors)), "error").otherwise("warn")).otherwise("info")
    return F.struct(
        F.when(~warn & stamped, F.substring(raw, 2, 8)).alias("ts"), level.alias("level"), mask_tokens(text).alias("text")
    )


def search(lines: DataFrame, raw: str, order: str, level: str = "all", q: str = "", limit: int = 200) -> DataFrame:
    """The newest ``limit`` matching lines of the whole log, with the number of all matches."""
    parsed = lines.where(F.col(raw) != "").select(order, parse_line(F.col(raw)).alias("p")).select(order, "p.*")
    keep = F.lit(True)
    if level == "warn":
        keep = keep & (F.col("level") != "info")
    if q:
        keep = keep & F.contains(F.lower("text"), F.lit(q.lower()))
    found = parsed.where(keep)
    total = found.agg(F.count(F.lit(1)).alias("total"))
    return found.orderBy(F.desc(order)).limit(limit).withColumn("total", total.scalar())


def recent_notices(notices: DataFrame, order: str, n: int = 3) -> DataFrame:
    """The newest ``n`` notices, and which of them is the headline (first error, else newest)."""
    top = notices.orderBy(F.desc(order)).limit(n)
    rank = F.row_number().over(W.orderBy(F.when(F.col("level") == "error", 0).otherwise(1), F.desc(order)))
    return top.withColumn("headline", rank == 1).withColumn("shown", clip_words(F.col("text"), 56))


def alert_key(level: Column, title: Column, message: Column) -> Column:
    """Identity of an alert after address scrubbing."""
    lvl = F.when(level == "critical", "critical").otherwise("warn")
    return F.concat_ws("\0", lvl, scrub_addresses(title), scrub_addresses(message))


def sent_alerts(alerts: DataFrame, key: str, ts: str, seconds: int = catalog.ALERT_INTERVAL_SECONDS) -> DataFrame:
    """Alerts that go out: suppressed within the interval since the last one *sent*."""
    return rate_limited(alerts, key, ts, seconds)


def with_previous(df: DataFrame, key: str, ts: str, value: Column, out: str, block_seconds: int = 86_400) -> DataFrame:
    """``value`` of the previous row of the same key, by time.

    Like ``lag`` over the whole key, but in blocks of time: a key with very many
    rows is spread over as many tasks as it has blocks.  Ties in time are broken
    by the value.
    """
    block = F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / (block_seconds * 1_000_000))
    rows = df.withColumns({"_v": value, "_block": block})
    order = F.struct(F.col(ts), F.col("_v"))
    ends = rows.groupBy(key, "_block").agg(F.max_by("_v", order).alias("_last"))
    before = F.lag("_last").over(W.partitionBy(key).orderBy("_block"))
    carried = ends.select(key, "_block", before.alias("_carried"))
    inside = W.partitionBy(key, "_block").orderBy(ts, "_v")
    ranked = rows.withColumns({"_in": F.lag("_v").over(inside), "_rn": F.row_number().over(inside)})
    return (
        ranked.join(carried, [key, "_block"])
        .withColumn(out, F.when(F.col("_rn") == 1, F.col("_carried")).otherwise(F.col("_in")))
        .drop("_v", "_block", "_in", "_rn", "_carried")
    )


def heartbeat_gaps(beats: DataFrame, key: str, ts: str, seconds: int = catalog.STALE_SECONDS) -> DataFrame:
    """Silences longer than ``seconds`` between two heartbeats of a key."""
    seen = with_previous(beats.select(key, ts), key, ts, F.col(ts), "_prev")
    gap = (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col("_prev").cast("timestamp"))) / 1_000_000
    return seen.where(gap > seconds).select(key, F.col("_prev").alias("last_seen"), F.col(ts).alias("back_at"))


def liveness(beats: DataFrame, key: str, ts: str, now: Column, seconds: int = catalog.STALE_SECONDS) -> DataFrame:
    """Per key: protected, or why not.  An undated heartbeat counts as none."""
    latest = beats.groupBy(key).agg(F.max(ts).alias("last_seen"))
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("last_seen").cast("timestamp"))) / 1_000_000
    alive = F.coalesce(age <= seconds, F.lit(False))
    return latest.select(
        key, "last_seen", alive.alias("ok"), F.when(~alive, "not responding").alias("reason")
    )


def latched_alerts(states: DataFrame, key: str, ts: str, bad: Column, good_first: bool = True) -> DataFrame:
    """One alert per change from good to bad; good again re-arms it.

    ``good_first``: a key that starts out bad has not lost anything yet.
    """
    marked = with_previous(states.select(key, ts, bad.alias("bad")), key, ts, F.col("bad").cast("int"), "_was")
    was_good = F.col("_was") == 0
    edge = was_good if good_first else F.coalesce(was_good, F.lit(True))
    return marked.where(F.col("bad") & edge).select(key, ts)


def reassembled(fragments: DataFrame, keys: list[str], seq: str = "seq", fragment: str = "fragment") -> DataFrame:
    """One text per block from its fragments in order; a block's own text bounds the group."""
    pieces = F.array_sort(F.collect_list(F.struct(F.col(seq), F.col(fragment))))
    return fragments.groupBy(*keys).agg(
        F.array_join(F.transform(pieces, lambda p: p[fragment]), "").alias("text")
    )
