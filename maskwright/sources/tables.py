"""Columnar tables and stored intermediates."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import prepare


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(os.path.join(root, f"{name}.parquet"))


def text_units(spark: SparkSession, root: str, name: str, key: str, text: str, *extra: str) -> DataFrame:
    """A table as text units: ``unit`` (its key), ``text`` and the extra columns."""
    return table(spark, root, name).select(F.col(key).alias("unit"), F.col(text).alias("text"), *extra)


def dealt(df: DataFrame) -> DataFrame:
    """Narrow rows dealt evenly to all cores, for work that is heavy for each row.

    A file of one row group is read by one task, however large the cluster.
    """
    return df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism, *df.columns)


_LOCAL: dict[str, str] = {}


def work_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the store that driver and executors share (``spark.checkpoint.dir``).

    Only a local session may go without; one temporary folder then serves the whole session.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = _LOCAL.setdefault("base", tempfile.mkdtemp(prefix="maskwright-"))
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """Queries that run here leave no shuffle files behind; a second run of the same plan would shuffle again."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def stored(df: DataFrame, purpose: str, light: bool = False) -> DataFrame:
    """Write an expensive intermediate once and read it back.

    For results that a plan uses several times: a lost executor costs a re-read,
    and nothing is computed twice.  ``light`` ones take little disk: they are packed
    more tightly, and what was shuffled for them goes at the end of the query.
    """
    path = work_dir(df.sparkSession, purpose)
    if light:
        with freed(df.sparkSession):
            df.write.option("compression", "zstd").parquet(path)
    else:
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, n: int, purpose: str) -> DataFrame:
    """``stored`` in ``n`` Spark buckets by ``key``: rows that are brought together by ``key`` come to these files, which are not shuffled."""
    spark = df.sparkSession
    path = work_dir(spark, purpose)
    name = f"{purpose.replace('-', '_')}_{path[-32:]}"
    with freed(spark):
        df.write.bucketBy(n, key).option("path", path).option("compression", "zstd").saveAsTable(name)
    return spark.table(name)


def forgotten(df: DataFrame) -> None:
    """Deletes what ``stored`` wrote, once no plan that is still to run reads it."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)
