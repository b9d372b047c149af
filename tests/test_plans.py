"""What the plans must look like at scale."""

from pyspark.sql import functions as F

from maskwright.operators.findings import findings, scan_totals
from maskwright.operators.ruleset import make_rules, pattern_named
from maskwright.operators.spans import redact
from maskwright.operators.sweep import to_examine
from maskwright.plans.base import STD_RULES

DATA = "/root/testdata/sf0.001"


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_findings_are_one_narrow_stage(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    plan = physical(findings(docs, ["doc_id"], "text", STD_RULES))
    assert "Exchange" not in plan and "Python" not in plan
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_totals_shuffle_one_row_per_task(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    plan = physical(scan_totals(docs, "text", STD_RULES))
    assert plan.count("Exchange") == 1 and "partial_sum" in plan


def test_filters_reach_the_scan(spark, key):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("lang = 'en'")
    plan = physical(docs.select(redact(F.col("text"), make_rules([pattern_named("email")]), key).text))
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,en)]" in plan


def test_index_skip_does_not_read_content(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x")
    inv = spark.read.format("binaryFile").load(str(tmp_path)).select("path", F.col("modificationTime").alias("modification_time"), "length")
    index = spark.createDataFrame([], "path string, modification_time timestamp, length bigint, rules_fp string")
    assert "content" not in physical(to_examine(inv, index, "fp"))


def test_offsets_back_render_each_note_once(spark, key):
    from maskwright.operators.render import render
    from maskwright.plans.notes import notes
    from maskwright.plans.registry import QUERIES

    def times(df):
        return df._jdf.queryExecution().optimizedPlan().toString().count("xox[")

    assert times(QUERIES["offset_back_mapping"](spark, DATA)) == times(notes(spark, DATA).select(render(F.col("text"), STD_RULES, key).alias("r")))


def test_notes_are_dealt_to_all_cores(spark):
    from maskwright.plans.notes import notes

    made = notes(spark, DATA)
    rows = made.select("unit", F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert len(rows) > spark.sparkContext.defaultParallelism / 2 and max(r["count"] for r in rows) < 0.5 * made.count()
