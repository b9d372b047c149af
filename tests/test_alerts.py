"""Rate-limited alerts by functions of time blocks, against the plain rule."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from maskwright.operators.alerts import block_functions, rate_limited
from maskwright.operators.logs import sent_alerts

T0 = dt.datetime(2024, 1, 1)


def plain(rows, seconds):
    last, out = {}, []
    for k, t in sorted((k, t) for k, t in rows if k is not None and t is not None):
        if k not in last or (t - last[k]).total_seconds() >= seconds:
            last[k] = t
            out.append((k, t))
    return out


@pytest.mark.parametrize("seed, spread, block", [(1, 2_000, None), (2, 200_000, 100), (3, 50_000, 60), (4, 300, 1000)])
def test_equals_the_plain_rule(spark, seed, spread, block):
    rnd = random.Random(seed)
    rows = [(rnd.choice("aaaabc"), T0 + dt.timedelta(seconds=rnd.randrange(spread), microseconds=rnd.randrange(3))) for _ in range(500)]
    rows += rows[:50] + [(None, T0), ("a", None), ("z", T0 - dt.timedelta(days=20_000))]
    df = spark.createDataFrame(rows, "k string, t timestamp")
    got = rate_limited(df, "k", "t", 60, block)
    assert sorted((r.k, r.t) for r in got.collect()) == plain(rows, 60)


def test_exact_interval_and_empty(spark):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    df = spark.createDataFrame([(1, at(0)), (1, at(299)), (1, at(300)), (1, at(599)), (1, at(600)), (2, at(5))], "k int, t timestamp")
    got = sorted((r.k, int((r.t - T0).total_seconds())) for r in sent_alerts(df, "k", "t", 300).collect())
    assert got == [(1, 0), (1, 300), (1, 600), (2, 5)]
    assert sent_alerts(df.limit(0), "k", "t", 300).count() == 0


def test_one_key_is_many_tasks(spark):
    """A key with all rows is spread over blocks, in every shuffle that carries alerts."""
    rows = spark.range(20_000).select(F.expr("if(id < 0, 'x', 'k')").alias("_key"), (F.col("id") * 1_000_000).alias("_at"))
    width = 60 * 32 * 1_000_000
    cut = rows.withColumn("_block", F.floor(F.col("_at") / width))
    plan = block_functions(cut, 60_000_000, width)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(_key#\d+, _block#\d+", plan)
    used = cut.repartition(8, "_key", "_block").withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()
    assert len(used) >= 4 and max(r["count"] for r in used) < 15_000
