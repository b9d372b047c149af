"""Running streams to completion, and the incremental sweep as a stream."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import LabelKey
from ..operators.ruleset import RuleSet
from ..sources.tables import work_dir
from ..operators.sweep import append_job, job_record, manifest, sweep, unparsed


def run_to_table(stream: DataFrame, purpose: str, partitions: int | None = None) -> DataFrame:
    """Process everything that is available, exactly once, and return the written table."""
    spark = stream.sparkSession
    base = work_dir(spark, purpose)
    query = (
        stream.writeStream.format("parquet").outputMode("append")
        .option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def run_batches(stream: DataFrame, write, checkpoint: str) -> None:
    """Process everything that is available through a ``foreachBatch`` writer."""
    query = (
        stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()


def run_updates(stream: DataFrame, purpose: str) -> DataFrame:
    """Process everything that is available in update mode; every change of a group is a row."""
    spark = stream.sparkSession
    base = work_dir(spark, purpose)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={batch_id}")

    query = (
        stream.writeStream.foreachBatch(write).outputMode("update")
        .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.parquet(f"{base}/out").drop("batch")


def sweep_stream(rules: RuleSet, key: LabelKey, out: str):
    """A ``foreachBatch`` writer: new or changed units are swept, one job record per pass.

    The stream's checkpoint is what keeps finished units from being read again.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark, started = batch.sparkSession, time.monotonic()
        staged = f"{out}/staged/batch={batch_id}"
        sweep(batch, rules, key).write.mode("overwrite").parquet(staged)
        results = spark.read.parquet(staged)
        changed = results.where("status = 'changed'")
        changed.select("path", "text").write.mode("overwrite").parquet(f"{out}/rewritten/batch={batch_id}")
        manifest(results).write.mode("overwrite").parquet(f"{out}/manifest/batch={batch_id}")
        # what was written is read back and parsed; a replayed batch replaces its own record
        written = spark.read.schema(changed.select("path", "text").schema).parquet(f"{out}/rewritten/batch={batch_id}")
        failed = unparsed(written.join(batch.select("path", "format"), "path")).count()
        took = int(1000 * (time.monotonic() - started))
        record = job_record(results, f"batch-{batch_id}", F.current_timestamp(), "stream", F.lit(failed), took)
        append_job(record, f"{out}/jobs/batch={batch_id}", mode="overwrite")

    return write
