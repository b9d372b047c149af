"""Line numbers of files read in splits, and runs of heartbeats."""

import datetime as dt

from pyspark.sql import functions as F

from maskwright.sources.files import numbered_lines
from maskwright.streaming.jobs import run_to_table
from maskwright.streaming.windows import sessions
from tests.test_streaming import T0, replay


def test_line_numbers_over_many_splits(spark, tmp_path):
    texts = {"a.txt": [f"a{i} " + "x" * (i % 90) for i in range(3000)], "sub/b.txt": ["", "b1", "", "", "b4"], "c.txt": [], "d.txt": ["y" * 50_000, "z", "é" * 9_000]}
    for name, lines in texts.items():
        path = tmp_path / "in" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("".join(line + "\n" for line in lines), encoding="utf-8")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for k, v in zip(before, ("4096", "1000")):
        spark.conf.set(k, v)
    try:
        rows = numbered_lines(spark, str(tmp_path / "in"))
        assert rows.select("at.block").distinct().count() > 20
        got = {}
        for r in rows.collect():
            got.setdefault(r.path.split("/in/")[1], []).append((r.line_no, r.line))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {k: sorted(v) for k, v in got.items()} == {k: list(enumerate(v, 1)) for k, v in texts.items() if v}


def test_runs_of_heartbeats(spark, tmp_path):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    rows = [("a", at(s)) for s in (0, 90, 90, 181, 400, 600)] + [("b", at(5)), ("b", None)]
    want = [("a", 0, 90, 180, 3), ("a", 181, 181, 271, 1), ("a", 400, 400, 490, 1), ("a", 600, 600, 690, 1), ("b", 5, 5, 95, 1)]

    def shown(df):
        secs = lambda t: int((t - T0).total_seconds())
        return sorted((r.k, secs(r.started), secs(r.last_seen), secs(r.silent_at), r.n) for r in df.collect())

    assert shown(sessions(spark.createDataFrame(rows, "k string, t timestamp"), "k", "t", 90)) == want
    batches = [[r for r in rows if r[1]][:2], [r for r in rows if r[1]][2:], [("z", at(5_000))]]
    closed = run_to_table(sessions(replay(spark, tmp_path, batches, "k string, t timestamp"), "k", "t", 90), "runs")
    assert shown(closed) == want  # the last key's run is still open


def test_json_line_queries_and_runs_have_units_of_their_own(spark, tmp_path):
    """``jsonl_lines`` and ``jsonl_rewrite`` read units by ``doc_id``, runs by ``path``."""
    from maskwright.plans import sweeps

    spark.createDataFrame([(7, "one a@b.example"), (8, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    lines = sweeps.jsonl_lines(spark, str(tmp_path)).where("doc_id = 7").orderBy("line_no").collect()
    assert [(r.line_no, r.status) for r in lines] == [(1, "unparsed"), (2, "json"), (3, "blank"), (4, "unparsed")]
    done = sweeps.jsonl_rewrite(spark, str(tmp_path)).where("doc_id = 7").collect()
    assert [(r.lines_changed, r.unparsed) for r in done] == [(1, 2)]
    assert sweeps.run_units(spark, str(tmp_path)).columns[0] == "path"
