"""State that ends: framing, reassembly, alert limits and latches with timers."""

import datetime as dt
import json

from pyspark.sql import functions as F

from maskwright.streaming.timed import event_stream, limited_stream, rocksdb, timed_latch
from maskwright.sources.tables import work_dir
from tests.test_streaming import T0, replay

SCHEMA = "sid string, seq bigint, chunk string, is_last boolean, ts timestamp"


def run(spark, stream):
    """All rows, and the progress of each micro-batch."""
    base = work_dir(spark, "timed")
    with rocksdb(spark):
        query = (
            stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint")
            .trigger(availableNow=True).start()
        )
        query.awaitTermination()
    progress = [json.loads(p.json) if hasattr(p, "json") and not callable(p.json) else p for p in query.recentProgress]
    return spark.read.schema(stream.schema).parquet(f"{base}/out"), progress


def state(progress):
    ops = [p["stateOperators"][0] for p in progress if p["stateOperators"]]
    return ops[-1]["numRowsTotal"], sum(o["numRowsDroppedByWatermark"] for o in ops)


def sse(kind, index, **extra):
    return f"event: {kind}\ndata: " + json.dumps({"type": kind, "index": index, **extra}) + "\n\n"


def tool(index, name, pieces):
    out = sse("content_block_start", index, content_block={"type": "tool_use", "name": name})
    for p in pieces:
        out += sse("content_block_delta", index, delta={"type": "input_json_delta", "partial_json": p})
    return out + sse("content_block_stop", index)


def at(s):
    return T0 + dt.timedelta(seconds=s)


def test_any_cut_gives_the_same_events(spark, tmp_path):
    text = ": hello\n\n" + tool(0, "Edit", ['{"a": "x', "yé", '"}']) + "data: not json\n\n" + tool(1, "mcp__x", ["[1]"]) + sse("content_block_delta", 7, delta={"type": "text_delta", "text": "t"}) + "tail"
    batches, n = [[], [], []], 0
    for sid, size in (("a", 1), ("b", 7), ("c", 10_000)):
        cuts = [text[i : i + size] for i in range(0, len(text), size)]
        for i, c in enumerate(cuts):
            batches[min(2, 3 * i // len(cuts))].append((sid, i, c, i == len(cuts) - 1, at(i % 60)))
    out, progress = run(spark, event_stream(replay(spark, tmp_path, batches, SCHEMA), "sid", "seq", "chunk", "ts"))
    rows = {}
    for r in out.orderBy("stream_id", "n").collect():
        rows.setdefault(r.stream_id, []).append((r.n, r.kind, r["index"], r.name, r.fragment))
    assert rows["a"] == rows["b"] == rows["c"] and [r[0] for r in rows["a"]] == list(range(len(rows["a"])))
    assert [r[2:] for r in rows["a"] if r[1] == "input"] == [(0, "Edit", '{"a": "xyé"}'), (1, "mcp__x", "[1]")]
    assert rows["a"][-1] == (len(rows["a"]) - 1, "record", None, None, "tail")
    assert not any("partial_json" in r[4] for r in rows["a"] if r[1] == "record")
    assert state(progress) == (0, 0)  # finished streams keep nothing


def test_silent_streams_are_closed_and_late_rows_counted(spark, tmp_path):
    start = sse("content_block_start", 3, content_block={"type": "tool_use", "name": "Edit"})
    delta = sse("content_block_delta", 3, delta={"type": "input_json_delta", "partial_json": '{"half'})
    batches = [
        [("dead", 0, start + delta + "data: broken", False, at(0)), ("live", 0, "data: 1\n\n", False, at(0))],
        [("live", 1, "data: 2\n\n", False, at(5_000))],
        [("live", 2, "data: 3\n\n", False, at(5_100))],
        [("live", 3, "data: 4\n\n", False, at(5_200)), ("dead", 1, " too late\n\n", False, at(1))],  # filtered by the watermark of the batch before
    ]
    stream = event_stream(replay(spark, tmp_path, batches, SCHEMA), "sid", "seq", "chunk", "ts", idle_seconds=60, lateness="0 seconds")
    out, progress = run(spark, stream)
    dead = [(r.n, r.kind, r["index"], r.name, r.fragment) for r in out.where("stream_id = 'dead'").orderBy("n").collect()]
    assert dead == [(0, "record", 3, None, start), (1, "unfinished", None, None, "data: broken"), (2, "unfinished", 3, "Edit", '{"half')]
    assert state(progress)[1] == 1
    assert [r.fragment for r in out.where("stream_id = 'live'").orderBy("n").collect()] == [f"data: {i}\n\n" for i in (1, 2, 3, 4)]


def test_limits_and_latches_forget_silent_keys(spark, tmp_path):
    batches = [[("k", at(0)), ("k", at(200)), ("j", at(10))], [("k", at(299)), ("k", at(301)), ("k", at(500)), ("k", at(601))], [("z", at(90_000))], [("z", at(90_001))]]
    got, progress = run(spark, limited_stream(replay(spark, tmp_path / "l", batches, "key string, ts timestamp"), "key", "ts", 300))
    assert sorted((r.key, int((r.ts - T0).total_seconds())) for r in got.collect()) == [("j", 10), ("k", 0), ("k", 301), ("k", 601), ("z", 90_000)]
    assert state(progress)[0] <= 4  # of z only: its alert, its timer
    states = [[("a", at(0), False), ("b", at(0), False)], [("a", at(50), True)], [("c", at(9_000), False)], [("b", at(9_001), True), ("c", at(9_002), True)]]
    got, _ = run(spark, timed_latch(replay(spark, tmp_path / "s", states, "k string, ts timestamp, bad boolean"), "k", "ts", F.col("bad"), 100, "0 seconds"))
    assert sorted((r.k, int((r.ts - T0).total_seconds())) for r in got.collect()) == [("a", 50), ("c", 9_002)]
