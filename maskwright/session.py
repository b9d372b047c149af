"""Sessions for local runs and tests; on a cluster the caller brings its own."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


#: Span expressions nest lambdas; the analyzer resolves one level in each iteration.
ANALYZER_ITERATIONS = 400


def prepare(spark: SparkSession) -> SparkSession:
    """Let a session of any origin analyze the library's expressions."""
    if int(spark.conf.get("spark.sql.analyzer.maxIterations")) < ANALYZER_ITERATIONS:
        spark.conf.set("spark.sql.analyzer.maxIterations", ANALYZER_ITERATIONS)
    return spark


def local_session(app: str = "maskwright", cores: int | None = None) -> SparkSession:
    n = cores or int(os.environ.get("BENCH_CPUS", "8"))
    spark = (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)
