"""Keyed state that ends: processors with timers on event time, kept in RocksDB.

A key that stays silent for ``idle_seconds`` of event time, by the watermark, is closed: what it still
holds is emitted and marked, and its state is removed.  So state follows the keys that are alive, not all
keys that ever were.  Rows later than the watermark are dropped by Spark, which counts them in the
query's progress (``numRowsDroppedByWatermark``).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import catalog

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb(spark: SparkSession):
    """State of the streams started inside is kept in RocksDB, on disk and with versions in the checkpoint."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield spark
    finally:
        spark.conf.set(_PROVIDER, before)


class _Timed(StatefulProcessor):
    """One timer for each key, moved on with each row's time."""

    def __init__(self, idle_seconds: int):
        self.idle_ms = idle_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.until = handle.getValueState("until", "ms bigint")
        self.open(handle)

    def open(self, handle: StatefulProcessorHandle) -> None:
        raise NotImplementedError

    def keep(self, newest_us: int) -> None:
        """Wait ``idle_ms`` after the newest row."""
        due = newest_us // 1000 + self.idle_ms
        if self.until.exists():
            held = self.until.get()[0]
            if held >= due:
                return
            self.handle.deleteTimer(held)
        self.until.update((due,))
        self.handle.registerTimer(due)

    def drop(self) -> None:
        if self.until.exists():
            self.handle.deleteTimer(self.until.get()[0])
            self.until.clear()

    def close(self) -> None:
        pass


def _rows(parts: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    return pd.concat(list(parts), ignore_index=True).sort_values(by, kind="stable")


def _run(rows: DataFrame, key: str, processor: StatefulProcessor, schema: str) -> DataFrame:
    return rows.groupBy(key).transformWithStateInPandas(processor, schema, "Append", "EventTime")


# ---------------------------------------------------------------- server-sent events

EVENTS = "stream_id string, n bigint, kind string, index int, name string, fragment string"
_COLUMNS = ["stream_id", "n", "kind", "index", "name", "fragment"]


def parsed_event(record: str) -> dict | None:
    """The JSON payload of a record's data lines, if it is one."""
    data = [line[5:].strip() for line in record.split("\n") if line.startswith("data:")]
    if not data:
        return None
    try:
        payload = json.loads("\n".join(data))
    except ValueError:
        return None
    return payload if isinstance(payload, dict) else None


class _Events(_Timed):
    """Chunks to records, records to whole tool inputs.

    ``rest`` is the unfinished record and the number of rows so far, ``blocks`` has the open blocks by index.
    """

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.rest = handle.getValueState("rest", "rest string, n bigint")
        self.blocks = handle.getMapState("blocks", "index int", "name string, held string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        rest, n = self.rest.get() if self.rest.exists() else ("", 0)
        parts = _rows(rows, ["seq"])
        *records, rest = (rest + "".join(parts["chunk"].fillna(""))).split("\n\n")
        out = []
        blocks = {}  # what this batch has touched; the rest stays in the store
        for record in records:
            self.one(record + "\n\n", blocks, out)
        if bool(parts["is_last"].any()):
            if rest:
                out.append(("record", None, None, rest))
            self.clear(out, blocks)
        else:
            for index, block in blocks.items():
                if block is not None:
                    self.blocks.updateValue((index,), (block[0], "".join(block[1])))
                elif self.blocks.containsKey((index,)):
                    self.blocks.removeKey((index,))
            self.rest.update((rest, n + len(out)))
            self.keep(int(parts["at"].max()))
        if out:
            yield self.numbered(key, n, out)

    def one(self, record: str, blocks: dict, out: list) -> None:
        event = parsed_event(record) or {}
        index, kind = event.get("index"), event.get("type")
        known = isinstance(index, int) and not isinstance(index, bool)
        if known and index not in blocks and self.blocks.containsKey((index,)):
            name, held = self.blocks.getValue((index,))
            blocks[index] = (name, [held])
        block = blocks.get(index) if known else None
        if kind == "content_block_start" and known and (event.get("content_block") or {}).get("type") == "tool_use":
            blocks[index] = (event["content_block"].get("name"), [])
            out.append(("record", index, None, record))
        elif kind == "content_block_delta" and block and (event.get("delta") or {}).get("type") == "input_json_delta":
            block[1].append(event["delta"].get("partial_json") or "")  # held until the block stops
        elif kind == "content_block_stop" and block:
            out.append(("input", index, block[0], "".join(block[1])))
            out.append(("record", index, None, record))
            blocks[index] = None
        else:
            out.append(("record", index if known else None, None, record))

    def clear(self, out: list, blocks: dict) -> None:
        """Blocks that never stopped leave as they are, marked; then nothing of the stream is kept."""
        for (index,), (name, held) in sorted(self.blocks.iterator(), key=lambda x: x[0][0]):
            if index not in blocks:
                blocks[index] = (name, [held])
        out += [("unfinished", i, b[0], "".join(b[1])) for i, b in sorted(blocks.items()) if b is not None]
        self.rest.clear()
        self.blocks.clear()
        self.drop()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        rest, n = self.rest.get() if self.rest.exists() else ("", 0)
        out = [("unfinished", None, None, rest)] if rest else []
        self.until.clear()  # its timer has just run
        self.clear(out, {})
        if out:
            yield self.numbered(key, n, out)

    def numbered(self, key, n: int, out: list) -> pd.DataFrame:
        rows = [(key[0], n + i, *row) for i, row in enumerate(out)]
        return pd.DataFrame(rows, columns=_COLUMNS).astype({"n": "int64", "index": "Int32"})


def event_stream(chunks: DataFrame, key: str, seq: str, chunk: str, ts: str, idle_seconds: int = 600, lateness: str = "10 minutes") -> DataFrame:
    """Rows of ``EVENTS`` from chunks cut anywhere; ``is_last`` marks a stream's last chunk.

    ``record`` rows are raw records that pass as they are, ``input`` rows whole tool inputs at their
    stop, and ``unfinished`` rows what an ended or silent stream left open.  ``n`` orders a stream's rows.
    """
    rows = chunks.select(
        F.col(key).cast("string").alias("stream_id"), F.col(seq).cast("bigint").alias("seq"), F.col(chunk).alias("chunk"), "is_last",
        F.col(ts).cast("timestamp").alias("ts"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at"),
    ).withWatermark("ts", lateness)
    return _run(rows, "stream_id", _Events(idle_seconds), EVENTS)


# ---------------------------------------------------------------- alerts and latches


class _Limit(_Timed):
    """The last alert sent; after the interval it decides nothing, so it is not kept longer."""

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.sent = handle.getValueState("sent", "at bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = self.sent.get()[0] if self.sent.exists() else None
        out = []
        for at in _rows(rows, ["at"])["at"]:
            if last is None or at - last >= self.idle_ms * 1000:
                last = int(at)
                out.append(last)
        if out:
            self.sent.update((last,))
            self.keep(last + 999)  # the timer's milliseconds are not before the interval's end
        if out:
            yield pd.DataFrame({"key": [key[0]] * len(out), "at": pd.Series(out, dtype="int64")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.sent.clear()
        self.until.clear()
        return iter(())


def limited_stream(alerts: DataFrame, key: str, ts: str, seconds: int = catalog.ALERT_INTERVAL_SECONDS, lateness: str = "10 minutes") -> DataFrame:
    """Alerts that go out, as ``stateful.alert_stream`` has them; a key's state ends with its interval."""
    rows = _timed(alerts, key, ts, lateness)
    out = _run(rows, "key", _Limit(seconds), "key string, at bigint")
    return out.select(F.col("key").alias(key), F.timestamp_micros("at").alias(ts))


class _Latch(_Timed):
    """When the key was last seen, and whether it was good; silence is told by the rows' own times, too."""

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.armed = handle.getValueState("armed", "armed boolean, at bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        armed, last = self.armed.get() if self.armed.exists() else (False, None)
        out, parts = [], _rows(rows, ["at", "bad"])
        for at, bad in zip(parts["at"], parts["bad"]):
            if bad and armed and at - last <= self.idle_ms * 1000:
                out.append(int(at))
            armed, last = not bad, at
        self.armed.update((bool(armed), int(last)))
        self.keep(int(parts["at"].max()))
        if out:
            yield pd.DataFrame({"key": [key[0]] * len(out), "at": pd.Series(out, dtype="int64")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.armed.clear()
        self.until.clear()
        return iter(())


def timed_latch(states: DataFrame, key: str, ts: str, bad: Column, idle_seconds: int, lateness: str = "10 minutes") -> DataFrame:
    """One alert for each change from good to bad; a key that is silent for ``idle_seconds`` starts anew."""
    out = _run(_timed(states, key, ts, lateness, bad.alias("bad")), "key", _Latch(idle_seconds), "key string, at bigint")
    return out.select(F.col("key").alias(key), F.timestamp_micros("at").alias(ts))


def _timed(rows: DataFrame, key: str, ts: str, lateness: str, *extra: Column) -> DataFrame:
    at = F.col(ts).cast("timestamp")
    return rows.select(F.col(key).cast("string").alias("key"), at.alias("ts"), F.unix_micros(at).alias("at"), *extra).withWatermark("ts", lateness)
