"""Job history: summary, health signals and trends.  The clock is always an argument."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def newest(df: DataFrame, n: int, ts: str = "ts", tie: str = "id") -> DataFrame:
    """The newest ``n`` records with their rank: a top-k, then a window over at most n rows."""
    top = df.orderBy(F.desc(ts), F.desc(tie)).limit(n)
    return top.withColumn("rn", F.row_number().over(W.orderBy(F.desc(ts), F.desc(tie))))


def job_summary(jobs: DataFrame, runs: int | None = None) -> DataFrame:
    """Rolled-up view over all runs, or over the newest ``runs`` of them."""
    n = jobs if runs is None else jobs.orderBy(F.desc("ts"), F.desc("id")).limit(runs)
    return n.agg(
        F.count(F.lit(1)).alias("runs"),
        F.max("ts").alias("last_run"),
        F.max(F.when(F.col("ok"), F.col("ts"))).alias("last_ok"),
        F.coalesce(~F.max_by("ok", F.struct("ts", "id")), F.lit(False)).alias("last_failed"),
        F.count_if(~F.col("ok")).alias("failures"),
        F.coalesce(F.sum("files_rewritten"), F.lit(0)).cast("bigint").alias("files_rewritten"),
    ).withColumn("never_run", F.col("runs") == 0)


def _hours(now: Column, ts: Column) -> Column:
    return (F.unix_micros(now.cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))) / 3.6e9


def job_metrics(jobs: DataFrame, now: Column) -> DataFrame:
    """One row with everything the job signals need, from the newest 20 runs."""
    rn, rewritten = F.col("rn"), F.coalesce("files_rewritten", F.lit(0))

    def median(lo, hi):
        return F.median(F.when(rn.between(lo, hi), rewritten))

    return newest(jobs, 20).agg(
        F.count(F.lit(1)).alias("runs"),
        F.max("ts").alias("latest"),
        F.coalesce(F.bool_or((rn == 1) & ~F.col("ok")), F.lit(False)).alias("last_failed"),
        F.max(F.when(rn == 1, F.col("exit_code"))).alias("exit_code"),
        F.count_if((rn <= 10) & ~F.col("ok")).alias("failed10"),
        F.coalesce(F.sum("verify_failures"), F.lit(0)).cast("bigint").alias("verify20"),
        F.max(F.when(rn == 1, rewritten)).alias("current"),
        median(2, 11).alias("base"),
        median(1, 5).alias("recent"),
        median(6, 15).alias("older"),
    ).withColumn("age_hours", _hours(now, F.col("latest")))


def retention_metrics(passes: DataFrame, now: Column) -> DataFrame:
    return newest(passes, 5).agg(
        F.count(F.lit(1)).alias("passes"), F.max("ts").alias("latest"),
        F.coalesce(F.sum("freed_bytes"), F.lit(0)).cast("bigint").alias("freed"),
        F.coalesce(F.sum("removed_files"), F.lit(0)).cast("bigint").alias("files"),
    ).withColumn("age_hours", _hours(now, F.col("latest")))


def _signals(metrics: DataFrame, rules: list[tuple[Column, str, Column]]) -> DataFrame:
    rows = F.array(
        *[F.when(c, F.struct(F.lit(sev).alias("severity"), title.alias("title"))) for c, sev, title in rules]
    )
    return metrics.select(F.inline(F.array_compact(rows)))


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def staleness(metrics: DataFrame, interval_minutes: int = 60) -> DataFrame:
    late = F.col("age_hours") > max(3.0, interval_minutes * 2 / 60)
    return _signals(metrics, [(late, "warning", _text("no run in ", F.round("age_hours").cast("bigint"), " hours"))])


def failure_signals(metrics: DataFrame) -> DataFrame:
    return _signals(
        metrics,
        [
            (F.col("last_failed"), "critical", _text("most recent run failed, exit code ", F.coalesce(F.col("exit_code").cast("string"), F.lit("?")))),
            (~F.col("last_failed") & (F.col("failed10") >= 3), "warning", _text(F.col("failed10"), " of the last 10 runs failed")),
        ],
    )


def verification_signal(metrics: DataFrame) -> DataFrame:
    return _signals(metrics, [(F.col("verify20") > 0, "critical", _text("verification failed on ", F.col("verify20"), " file(s)"))])


def spike_signal(metrics: DataFrame) -> DataFrame:
    c, b = F.col("current"), F.col("base")
    fires = (F.col("runs") >= 6) & (b >= 2) & (c >= b * 3) & (c >= 10)
    return _signals(metrics, [(fires, "warning", _text("spike: ", c, " files rewritten"))])


def trend_signal(metrics: DataFrame) -> DataFrame:
    fires = (F.col("runs") >= 10) & (F.col("older") >= 2) & (F.col("recent") >= F.col("older") * 2)
    return _signals(metrics, [(fires, "info", F.lit("upward trend in rewritten files"))])


def never_ran(metrics: DataFrame) -> DataFrame:
    return _signals(metrics, [(F.col("runs") == 0, "warning", F.lit("no run recorded yet"))])


def retention_signals(metrics: DataFrame, enabled: bool = True) -> DataFrame:
    if not enabled:
        return _signals(metrics, [(F.lit(True), "warning", F.lit("retention is disabled"))])
    some = F.col("passes") > 0
    much = (F.col("freed") > 20 * 1024 * 1024) | (F.col("files") > 100)
    return _signals(
        metrics,
        [
            (~some, "info", F.lit("no retention pass recorded yet")),
            (some & (F.col("age_hours") > 6), "warning", _text("no retention pass in ", F.round("age_hours").cast("bigint"), " hours")),
            (some & much, "info", _text("retention removed ", F.col("files"), " file(s) recently")),
        ],
    )


def all_signals(
    jobs: DataFrame, passes: DataFrame, now: Column, interval_minutes: int = 60, retention_enabled: bool = True
) -> DataFrame:
    """Every signal that fires, critical first."""
    m, r = job_metrics(jobs, now), retention_metrics(passes, now)
    ran = m.where("runs > 0")
    out = never_ran(m)
    for part in (
        staleness(ran, interval_minutes), failure_signals(ran), verification_signal(ran),
        spike_signal(ran), trend_signal(ran), retention_signals(r, retention_enabled),
    ):
        out = out.unionByName(part)
    rank = F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    return out.orderBy(rank, "title")
