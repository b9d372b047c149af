"""Retention: what a policy would remove, and an inventory of what it governs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import catalog


def policy(overrides: dict[str, float | None] | None = None) -> dict[str, float | None]:
    """Defaults overlaid by the configured values; unknown names are ignored."""
    given = overrides or {}
    return {k: given[k] if k in given else v for k, v in catalog.RETENTION_DEFAULTS.items()}


def forever(limit) -> bool:
    """0 or null keeps everything."""
    return not limit or limit <= 0


def older_than(ts: Column, now: Column, days: float) -> Column:
    if forever(days):
        return F.lit(False)
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))
    return F.coalesce(age > F.lit(int(days * 86_400_000_000)), F.lit(False))


def trim_by_age(records: DataFrame, ts_text: str, now: Column, days: float) -> DataFrame:
    """Drop records older than ``days``; undated and unreadable ones are kept."""
    return records.where(~older_than(F.try_to_timestamp(F.col(ts_text)), now, days))


def trim_by_size(
    lines: DataFrame, line: str, order: str, max_bytes: int, keep: float = catalog.SIZE_KEEP_FRACTION, block: int = 100_000
) -> DataFrame:
    """Above the limit, keep the newest lines that fit in ``keep`` of it.

    The running total is taken in two levels, sums per block of line numbers and
    then lines within their block, so no task sees the whole log.
    """
    if forever(max_bytes):
        return lines
    size = F.length(F.col(line)) + 1
    blocks = lines.withColumns({"_size": size, "_block": F.floor(F.col(order) / block)})
    sums = blocks.groupBy("_block").agg(F.sum("_size").alias("_sum"))
    newer = W.orderBy(F.desc("_block")).rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select("_block", F.coalesce(F.sum("_sum").over(newer), F.lit(0)).alias("_newer"))
    total = lines.agg(F.sum(size).alias("t")).scalar()
    inside = W.partitionBy("_block").orderBy(F.desc(order)).rowsBetween(W.unboundedPreceding, W.currentRow)
    # Blocks that cannot hold a kept line are dropped before their lines are sorted.
    reach = blocks.withColumn("_total", total).join(offsets, "_block").where(
        (F.col("_total") <= max_bytes) | (F.col("_newer") < max_bytes * keep)
    )
    running = F.col("_newer") + F.sum("_size").over(inside)
    return (
        reach.withColumn("_running", running)
        .where((F.col("_total") <= max_bytes) | (F.col("_running") <= max_bytes * keep))
        .drop("_size", "_block", "_newer", "_total", "_running")
    )


def keep_newest(files: DataFrame, name: str, keep: int, suffix: str | None = None) -> DataFrame:
    """The ``keep`` last names; names of other suffixes are not governed and stay."""
    governed = files if suffix is None else files.where(F.endswith(name, F.lit(suffix)))
    if forever(keep):
        return files
    kept = governed.orderBy(F.desc(name)).limit(keep)
    return kept if suffix is None else kept.unionByName(files.where(~F.endswith(name, F.lit(suffix))))


def keep_lines(lines: DataFrame, line: str, order: str, keep: int, max_bytes: int = catalog.LINE_LOG_MAX_BYTES) -> DataFrame:
    """Once a log exceeds the limit, only its last ``keep`` lines."""
    total = lines.agg(F.sum(F.length(F.col(line)) + 1).alias("t")).scalar()
    tail = lines.orderBy(F.desc(order)).limit(keep).withColumn("_total", total).where(F.col("_total") > max_bytes)
    whole = lines.withColumn("_total", total).where(F.col("_total") <= max_bytes)
    return whole.unionByName(tail).drop("_total")


def prune_by_age(files: DataFrame, name: str, ts: str, now: Column, days: float, pattern: str) -> DataFrame:
    """What stays: files whose name does not match, or that are young enough."""
    return files.where(~(F.rlike(name, F.lit(pattern)) & older_than(F.col(ts), now, days)))


def retention_actions(files: DataFrame, rules: dict[str, tuple[str, float | None]], now: Column) -> DataFrame:
    """Per target, how many files and bytes the policy would remove.

    ``files(target, name, modified, bytes)``; a rule is ``("days", n)`` or
    ``("keep", n)``.  What a "keep" rule retains is a top-k, so a huge target is
    not sorted in one task.
    """
    parts = []
    for target, (kind, limit) in rules.items():
        mine = files.where(F.col("target") == target)
        totals = [F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("b")]
        if forever(limit):
            continue
        if kind == "days":
            gone = mine.where(older_than(F.col("modified"), now, limit)).agg(*totals)
        else:
            kept = mine.orderBy(F.desc("name")).limit(int(limit)).agg(
                F.count(F.lit(1)).alias("kn"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("kb")
            )
            gone = mine.agg(*totals).select(
                (F.col("n") - kept.select("kn").scalar()).alias("n"), (F.col("b") - kept.select("kb").scalar()).alias("b")
            )
        parts.append(
            gone.select(
                F.lit(target).alias("target"), F.col("n").alias("removed_files"), F.col("b").cast("bigint").alias("freed_bytes")
            )
        )
    return reduce(DataFrame.unionByName, parts).where("removed_files > 0")


def retention_record(actions: DataFrame, ts: Column, trigger: str = "scheduled", enabled: bool = True) -> DataFrame:
    """One log row per pass, written even when nothing was removed."""
    return actions.agg(
        F.count(F.lit(1)).alias("action_count"),
        F.coalesce(F.sum("freed_bytes"), F.lit(0)).cast("bigint").alias("freed_bytes"),
        F.coalesce(F.sum("removed_files"), F.lit(0)).cast("bigint").alias("removed_files"),
        F.array_sort(F.collect_list(F.struct("target", "removed_files", "freed_bytes"))).alias("actions"),  # one per rule
    ).select(ts.alias("ts"), F.lit(trigger).alias("trigger"), F.lit(enabled).alias("enabled"), "*")


def rule_text(kind: str, limit) -> str:
    if forever(limit):
        return "kept forever"
    shown = int(limit) if float(limit).is_integer() else limit
    return {
        "days": f"records older than {shown} days removed",
        "keep": f"newest {shown} kept",
        "mb": f"trimmed above {shown} MB",
    }[kind]


def describe(files: DataFrame, rules: dict[str, tuple[str, float | None]]) -> DataFrame:
    """Size, count, last change and governing rule of every target, present or not."""
    spark = files.sparkSession
    governed = spark.createDataFrame([(t, rule_text(k, v)) for t, (k, v) in rules.items()], "target string, rule string")
    found = files.groupBy("target").agg(
        F.count(F.lit(1)).alias("records"), F.sum("bytes").alias("bytes"), F.max("modified").alias("modified")
    )
    return F.broadcast(governed).join(found, "target", "left").select(
        "target", F.col("records").isNotNull().alias("exists"), F.coalesce("records", F.lit(0)).alias("records"),
        F.coalesce("bytes", F.lit(0)).cast("bigint").alias("bytes"), "modified", "rule",
    )
