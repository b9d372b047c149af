from pyspark.sql import functions as F

from maskwright.functions.regexes import literal_source
from maskwright.operators.dictionary import literal_hits


def test_equals_the_guarded_regex(spark):
    values = ["MYBOX", "Jane Q. Testerson", "a_b", "Ünï", "x1"]
    texts = ["MYBOXMYBOX MYBOXES xMYBOX mybox.", "jane q. testerson; Jane  Q. Testerson", "a_b a_bc A_B", "ünï ÜNÏ ünïs", "x1x1x1 x1 (x1)", "", None]
    units = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    literals = spark.createDataFrame([(v, True) for v in values] + [("(edge)", True), ("free", False)], "value string, boundary boolean")
    got = sorted((r.id, r.start, r.end, r.value) for r in literal_hits(units, ["id"], "text", literals).collect())
    want = []
    for v in values:
        row = units.select("id", "text", F.regexp_extract_all("text", F.lit(literal_source(v, True)), F.lit(0)).alias("m")).collect()
        for r in row:
            at = 0
            for m in r.m or []:
                at = r.text.index(m, at)
                want.append((r.id, at, at + len(m), v))
                at += len(m)
    assert [(i, e - s, v) for i, s, e, v in got] == [(i, e - s, v) for i, s, e, v in sorted(want)]


def test_the_plan_does_not_grow_with_the_dictionary(spark):
    def size(n):
        literals = spark.range(n).select(F.format_string("name%d", "id").alias("value"), F.lit(True).alias("boundary"))
        units = spark.createDataFrame([(0, "name7 name70000")], "id int, text string")
        hits = literal_hits(units, ["id"], "text", literals)
        return len(hits._jdf.queryExecution().optimizedPlan().toString()), hits.count()

    (few, a), (many, b) = size(10), size(100_000)
    assert (a, b) == (1, 2) and many < few + 200


def test_texts_are_cut_once_for_all_lengths(spark):
    units = spark.createDataFrame([(1, "one two three, one")], "id int, text string")
    literals = spark.createDataFrame([("one", True), ("two three", True), ("one two three", True)], "value string, boundary boolean")
    hits = literal_hits(units, ["id"], "text", literals)
    assert sorted((r.start, r.value) for r in hits.collect()) == [(0, "one"), (0, "one two three"), (4, "two three"), (15, "one")]
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Union" not in plan


def test_folded_hashes_miss_nothing_that_lower_case_finds(spark):
    units = spark.createDataFrame([(1, "İzmir ΟΔΟΣ οδος ςσςσ"), (2, "x" * 132 + " " + "ab" * 70)], "id int, text string")
    literals = spark.createDataFrame([(v, True) for v in ("İZMİR", "İzmir", "οδος", "ςσ", "x" * 66, "ab" * 35)], "value string, boundary boolean")
    got = {(r.id, r.start, r.end) for r in literal_hits(units, ["id"], "text", literals).collect()}
    assert {(1, 0, 5), (1, 11, 15)} <= got
    # copies count by the shortest word they repeat, which no literal is here
    assert not [g for g in got if g[0] == 2]
