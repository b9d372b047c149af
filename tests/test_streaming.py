import datetime as dt
import os

from pyspark.sql import functions as F

from maskwright.operators.ruleset import make_rules
from maskwright.streaming.jobs import run_to_table
from maskwright.streaming.stateful import (
    FRAGMENTS, alert_stream, frames, latch_stream, liveness_stream, reassemble_stream, reverse_batch,
)

T0 = dt.datetime(2024, 1, 1)


def replay(spark, tmp_path, batches, schema):
    """One file per micro-batch."""
    path, seen = tmp_path / "src", set()
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))
        # The file source orders by modification time, which may only have whole seconds.
        for part in set(path.glob("*.parquet")) - seen:
            seen.add(part)
            os.utime(part, (1_700_000_000 + i * 10,) * 2)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def test_blocks_split_across_batches(spark, tmp_path):
    def ev(index, seq, kind, name=None, fragment=None):
        return ("s", index, seq, kind, name, fragment)

    batches = [
        [ev(0, 1, "start", "Edit"), ev(0, 2, "delta", None, '{"p":"C:\\\\Users\\\\an'), ev(1, 3, "start", "mcp__zen__x"), ev(9, 4, "ping")],
        [ev(1, 5, "delta", None, '{"p":"C:\\\\Users\\\\anon"}'), ev(0, 6, "delta", None, 'on\\\\z"}')],
        [ev(1, 7, "stop"), ev(0, 8, "stop"), ev(2, 9, "delta", None, "orphan")],
    ]
    got = run_to_table(reassemble_stream(replay(spark, tmp_path, batches, FRAGMENTS)), "t")
    rows = {(r["index"], r.type): r for r in got.collect()}
    assert rows[0, "delta"].fragment == '{"p":"C:\\\\Users\\\\anon\\\\z"}' and rows[0, "delta"].name == "Edit"
    assert rows[1, "delta"].fragment == '{"p":"C:\\\\Users\\\\anon"}'
    assert rows[9, "ping"].seq == 4 and rows[2, "delta"].fragment == "orphan"
    assert got.where("type = 'stop'").count() == 2
    rules = make_rules(aliases=[("C:\\Users\\SOMEONE", "C:\\Users\\anon")], remote_prefixes=["mcp__zen__"])
    known = spark.createDataFrame([], "label string, value string")
    closed = got.where("type = 'delta' AND name IS NOT NULL")
    real = {r["index"]: r.fragment for r in reverse_batch(closed, ["stream_id", "index"], rules, known, True).collect()}
    assert real == {0: '{"p":"C:\\\\Users\\\\SOMEONE\\\\z"}', 1: '{"p":"C:\\\\Users\\\\anon"}'}


def test_frames_over_chunk_boundaries(spark, tmp_path):
    batches = [[("s", 1, "data: a\n", False)], [("s", 2, "\ndata: b\n\ndata", False)], [("s", 3, ": tail", True)]]
    got = run_to_table(frames(replay(spark, tmp_path, batches, "sid string, seq bigint, chunk string, is_last boolean"), "sid", "seq", "chunk"), "t")
    assert [r.record for r in got.orderBy("record_no").collect()] == ["data: a\n\n", "data: b\n\n", "data: tail"]


def test_rate_limit_counts_from_last_sent(spark, tmp_path):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    batches = [[("k", at(0)), ("k", at(200)), ("j", at(10))], [("k", at(299)), ("k", at(301)), ("k", at(500)), ("k", at(601))]]
    got = run_to_table(alert_stream(replay(spark, tmp_path, batches, "key string, ts timestamp"), "key", "ts", 300), "t")
    secs = sorted((r.key, int((r.ts - T0).total_seconds())) for r in got.collect())
    assert secs == [("j", 10), ("k", 0), ("k", 301), ("k", 601)]


def test_latch(spark, tmp_path):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    batches = [[("a", at(0), True), ("a", at(1), False), ("a", at(2), True)], [("a", at(3), True), ("a", at(4), False)], [("a", at(5), True)]]
    got = run_to_table(latch_stream(replay(spark, tmp_path, batches, "k string, ts timestamp, bad boolean"), "k", "ts", F.col("bad")), "t")
    assert sorted((r.ts - T0).seconds for r in got.collect()) == [2, 5]


def test_liveness(spark, tmp_path):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    batches = [[("a", at(0)), ("b", at(0))], [("b", at(100))], [("b", at(200))], [("b", at(290)), ("a", at(300))], [("b", at(380))]]
    stream = replay(spark, tmp_path, batches, "k string, ts timestamp")
    got = run_to_table(liveness_stream(stream, "k", "ts", 90, "0 seconds"), "t")
    states = [(r.k, r.state) for r in got.orderBy("ts").collect()]
    assert ("a", "down") in states and ("a", "up") in states


def test_a_table_streams_from_one_file_and_from_a_folder_of_files(spark, tmp_path):
    from maskwright.plans.registry import QUERIES

    rows = spark.createDataFrame([(1, "mail a@b.example", "en", "web"), (2, "nothing", "en", "web")], "doc_id long, text string, lang string, source string")
    (tmp_path / "folder").mkdir()
    (tmp_path / "single").mkdir()
    rows.repartition(2).write.parquet(f"{tmp_path}/folder/documents.parquet")
    rows.coalesce(1).write.parquet(f"{tmp_path}/one")
    next((tmp_path / "one").glob("part-*.parquet")).rename(tmp_path / "single" / "documents.parquet")
    for root in ("folder", "single"):
        done = QUERIES["stream_sweep"](spark, f"{tmp_path}/{root}").collect()
        assert [(r.path, r.text[:16]) for r in done] == [(1, "mail [PII:email:")], root


def test_the_number_of_micro_batches_does_not_grow_with_the_notes(spark, monkeypatch):
    from maskwright.plans.registry import QUERIES  # noqa: F401 - in the order that the modules need
    from maskwright.plans import streams
    from maskwright.streaming.jobs import run_batches
    from maskwright.sources.tables import work_dir

    monkeypatch.setattr(streams, "NOTES_IN_FILE", 20)
    seen = []
    units = streams.write_notes(spark, "/root/testdata/sf0.001", "batch-notes")
    run_batches(units, lambda batch, n: seen.append(batch.count()), work_dir(spark, "batches"))
    assert 2 <= len(seen) <= streams.NOTE_BATCHES + 1 and sum(seen) == 1500, seen
