"""Rate-limited alerts without a task for each key: functions of time blocks, chained by pointer doubling.

An alert goes out if none *was sent* within the interval before it, so each decision depends on the
last one.  A block of time is a function, though: it takes the first alert sent in it to the last one.

1. Times of a key are cut into blocks of ``block_seconds``.  The alerts that may be the first one sent
   in a block are those of its first interval, and the first one after.
2. One backward pass over a block, by two indexes, gives for each of these where the next alert after the
   block's last sent one may be.  That is looked up in the next block's list, or is the next block's first.
3. Which of these links start at the key's first alert?  Reached alerts double each round, and the links
   of twice the length are joined from the links of the last round.
4. Each block with a reached alert is walked from there.

Nothing is grouped by the key but one row for each block, so a key with all rows has as many tasks as
it has blocks.  A block's own times of one key, without repeats, are held in memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.scan import count_up_to
from ..sources.tables import stored

#: Intervals that a block of the default length holds.
INTERVALS = 32


def _runs(batches: Iterator[pa.RecordBatch], by: tuple[str, ...]) -> Iterator[pa.Table]:
    """Runs of rows that agree in ``by``; the batches are sorted by it."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        keys = list(zip(*[rows[c].to_pylist() for c in by]))
        start = 0
        for i in range(1, len(keys) + 1):
            if i < len(keys) and keys[i] == keys[start]:
                continue
            if held and keys[start] != last:
                yield pa.concat_tables(held)
                held = []
            last = keys[start]
            held.append(rows.slice(start, i - start))
            start = i
    if held:
        yield pa.concat_tables(held)


def exits(times: np.ndarray, gap: int) -> np.ndarray:
    """For each time as the first one sent: when the next alert after the last one sent here may be."""
    following = np.searchsorted(times, times + gap)
    out = times + gap
    for i in range(len(times) - 1, -1, -1):
        if following[i] < len(times):
            out[i] = out[following[i]]
    return out


def block_functions(rows: DataFrame, gap: int, width: int) -> DataFrame:
    """``_key, _block, first, starts, ends``: the alerts that may be the first one sent in a block, and what they lead to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _runs(batches, ("_key", "_block")):
            times = block["_at"].to_numpy()
            number = block["_block"][0].as_py()
            n = min(len(times), int(np.searchsorted(times, number * width + gap)) + 1)
            yield pa.RecordBatch.from_arrays(
                [block["_key"].slice(0, 1).combine_chunks(), pa.array([number]), pa.array([int(times[0])]),
                 pa.array([times[:n].tolist()], pa.list_(pa.int64())), pa.array([exits(times, gap)[:n].tolist()], pa.list_(pa.int64()))],
                names=["_key", "_block", "first", "starts", "ends"],
            )

    dealt = rows.repartition("_key", "_block").sortWithinPartitions("_key", "_block", "_at")
    return dealt.select("_key", "_block", "_at").mapInArrow(run, "_key string, _block bigint, first bigint, starts array<bigint>, ends array<bigint>")


def links(blocks: DataFrame) -> DataFrame:
    """``_key, _at, to``: from a possible first alert of a block to the first alert that would go out after it."""
    after = F.lead("first").over(W.partitionBy("_key").orderBy("_block"))  # a row for each block
    placed = stored(blocks.withColumn("after", after), "alert-blocks")
    near = placed.select("_key", (F.col("_block") - 1).alias("_block"), F.col("starts").alias("then"), F.col("after").alias("later"), F.lit(True).alias("has"))
    joined = placed.join(near, ["_key", "_block"], "left").select(
        "_key", "then", "later", "has", "after", F.inline(F.arrays_zip("starts", "ends"))
    )
    found = F.get("then", count_up_to(F.col("then"), F.col("ends") - 1))
    to = F.when(F.col("has"), F.coalesce(found, F.col("later"))).otherwise(F.col("after"))
    return joined.select("_key", F.col("starts").alias("_at"), to.alias("to"))


def reached(jumps: DataFrame, first: DataFrame, rounds: int) -> DataFrame:
    """``_key, _at`` of the links' ends that ``first`` leads to, itself included, after ``rounds`` doublings."""
    here = first
    for turn in range(rounds):
        step = jumps.where(F.col("to").isNotNull())
        here = stored(here.union(here.join(step, ["_key", "_at"]).select("_key", F.col("to").alias("_at"))).distinct(), "alert-reached")
        if turn + 1 < rounds:
            twice = step.join(jumps.select("_key", F.col("_at").alias("to"), F.col("to").alias("next")), ["_key", "to"])
            jumps = stored(twice.select("_key", "_at", F.col("next").alias("to")), "alert-links")
    return here


def rate_limited(alerts: DataFrame, key: str, ts: str, seconds: int, block_seconds: int | None = None) -> DataFrame:
    """``key, ts`` of the alerts that go out: none within ``seconds`` after one that was sent.  Alerts without a time do not count."""
    gap = seconds * 1_000_000
    width = max(gap, (block_seconds or seconds * INTERVALS) * 1_000_000, 1)
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    kind = alerts.schema[key].dataType
    rows = alerts.select(F.col(key).cast("string").alias("_key"), at.alias("_at")).where("_key IS NOT NULL AND _at IS NOT NULL").distinct()
    rows = stored(rows.withColumn("_block", F.floor(F.col("_at") / width)), "alert-times")
    blocks = stored(block_functions(rows, gap, width), "alert-functions")
    first = blocks.groupBy("_key").agg(F.min("first").alias("_at"))
    most = blocks.groupBy("_key").count().agg(F.max("count")).first()[0] or 1
    here = reached(stored(links(blocks), "alert-links"), first, int(most).bit_length())
    begun = here.select("_key", F.floor(F.col("_at") / width).alias("_block"), F.col("_at").alias("begin"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _runs(batches, ("_key", "_block")):
            times, sent = block["_at"].to_numpy(), []
            i = int(np.searchsorted(times, block["begin"][0].as_py()))
            while i < len(times):
                sent.append(i)
                i = int(np.searchsorted(times, times[i] + gap))
            taken = block.take(pa.array(sent, pa.int64())).combine_chunks()
            yield pa.RecordBatch.from_arrays([taken["_key"].combine_chunks(), taken["_at"].combine_chunks()], names=["_key", "_at"])

    dealt = rows.join(begun, ["_key", "_block"]).repartition("_key", "_block").sortWithinPartitions("_key", "_block", "_at")
    out = dealt.select("_key", "_block", "_at", "begin").mapInArrow(walk, "_key string, _at bigint")
    return out.select(F.col("_key").cast(kind).alias(key), F.timestamp_micros("_at").alias(ts))
