import datetime as dt

from pyspark.sql import functions as F

from maskwright.operators import resolve as X
from maskwright.operators import vault as V
from maskwright.operators.joins import is_small, lookup
from maskwright.operators.ruleset import make_rules, pattern_named
from maskwright.operators.spans import redact

RULES = make_rules([pattern_named("email")])
DAY = dt.datetime(2024, 1, 10)


def entries(spark):
    rows = [("L1", "old", DAY - dt.timedelta(days=40)), ("L1", "new", DAY), ("L2", "x", DAY - dt.timedelta(days=31)), ("L3", None, DAY)]
    return spark.createDataFrame(rows, "label string, value string, last_seen timestamp")


def test_vault_life_cycle(spark):
    v = V.build(entries(spark))
    assert {(r.label, r.value) for r in v.collect()} == {("L1", "new"), ("L2", "x")}
    assert [r.label for r in V.unexpired(v, F.lit(DAY)).collect()] == ["L1"]
    assert [r.label for r in V.capped(v, 1).collect()] == ["L1"]
    again = V.touched(v, spark.createDataFrame([("L2",)], "label string"), F.lit(DAY))
    assert V.unexpired(again, F.lit(DAY)).count() == 2


def test_encryption(spark):
    v = V.build(entries(spark)).select("label", "value")
    enc = V.encrypted(v, F.lit(b"\x01" * 32)).persist()
    assert {r.value for r in V.decrypted(enc, F.lit(b"\x01" * 32)).collect()} == {"new", "x"}
    assert V.decrypted(enc, F.lit(b"\x02" * 32)).count() == 0
    moved = enc.withColumn("label", F.lit("L9"))
    assert V.decrypted(moved, F.lit(b"\x01" * 32)).count() == 0


def test_resolution_modes(spark, key):
    known_label = spark.range(1).select(redact(F.lit("a@b.co"), RULES, key).text.alias("l")).first().l
    unknown = "[PII:email:0000000000000000]"
    docs = spark.createDataFrame([(1, f"x {known_label} y"), (2, f"{known_label} {unknown}"), (3, "none")], "id int, text string")
    known = spark.createDataFrame([(known_label, "a@b.co")], "label string, value string")
    for bounded in (True, False):
        soft = {r.id: r.text for r in X.resolve_from_vault(docs, ["id"], "text", known, bounded).collect()}
        assert soft == {1: "x a@b.co y", 2: f"a@b.co {unknown}", 3: "none"}
        hard = {r.id: r.text for r in X.resolve_from_vault(docs, ["id"], "text", known, bounded, strict=True).collect()}
        assert hard == {1: "x a@b.co y", 2: None, 3: "none"}


def test_lookup_equals_plain_join(spark):
    left = spark.range(2000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    right = spark.createDataFrame([("hot", 1), ("7", 2)], "k string, v int")
    want = sorted(left.join(right, "k", "left").select("id", "v").collect())
    for bounded in (False, True):
        assert sorted(lookup(left, right, "k", bounded).select("id", "v").collect()) == want
    assert is_small(right, 2) and not is_small(right, 1)


def test_edits(spark, key):
    docs = spark.createDataFrame([(1, "to a@b.co and c@d.co, bye bye"), (2, "plain text")], "id int, text string")
    red = {r.id: r.t for r in docs.select("id", redact(F.col("text"), RULES, key).text.alias("t")).collect()}
    lab = red[1][3:31]
    rows = [
        (1, 1, f"to {lab} and", f"for {lab}"), (1, 2, "bye", "x"), (1, 3, red[1][5:40], "x"), (1, 4, "nope", "x"),
        (1, 5, "to ", "[PII:email:0000000000000000]"), (1, 6, "", "x"), (2, 1, "plain", "fancy"), (9, 1, "a", "b"),
    ]
    edits = spark.createDataFrame(rows, "id int, edit_id int, old string, new string")
    done = X.translate_edits(docs, edits, ["id"], "text", RULES, key)
    got = {(r.id, r.edit_id): (r.status, r.real_old, r.real_new) for r in done.collect()}
    assert got[1, 1] == ("ok", "to a@b.co and", "for a@b.co")
    assert [got[1, i][0] for i in range(2, 7)] == ["ambiguous", "inside_span", "not_found", "unknown_label", "empty"]
    assert got[2, 1] == ("ok", "plain", "fancy") and got[9, 1][0] == "no_unit"
    accepted = {r.id: r.accepted for r in X.all_or_nothing(done, ["id"]).select("id", "accepted").distinct().collect()}
    assert accepted == {1: False, 2: True, 9: False}


def test_overlapping_occurrences_are_ambiguous(spark, key):
    docs = spark.createDataFrame([(1, "aaa")], "id int, text string")
    edits = spark.createDataFrame([(1, 1, "aa", "b")], "id int, edit_id int, old string, new string")
    assert X.translate_edits(docs, edits, ["id"], "text", RULES, key).first().status == "ambiguous"


def test_record_fields(spark, key):
    lab = spark.range(1).select(redact(F.lit("a@b.co"), RULES, key).text.alias("l")).first().l
    climb = "[PII:email:1111111111111111]"
    known = spark.createDataFrame([(lab, "a@b.co"), (climb, "../../x")], "label string, value string")
    rows = [
        (1, "Read", "file_path", f"d/{lab}"), (2, "Read", "file_path", f"d/{climb}"), (3, "Grep", "glob", "[PII:email:2222222222222222]"),
        (4, "mcp__zen__x", "q", lab), (5, "mcp__local__x", "q", lab), (6, "Read", "file_path", "plain"), (7, "Write", "content", climb),
    ]
    recs = spark.createDataFrame(rows, "id int, kind string, field string, value string")
    got = {r.id: (r.outcome, r.value) for r in X.resolve_fields(recs, ["id"], known, ("mcp__zen__",), True).collect()}
    assert got[1] == ("pathResolved", "d/a@b.co") and got[2] == ("pathUnsafe", f"d/{climb}")
    assert got[3][0] == "patternLabelUnresolved" and got[4] == ("remote", lab) and got[5] == ("resolved", "a@b.co")
    assert got[6] == ("noLabel", "plain") and got[7] == ("resolved", "../../x")


def test_a_unit_with_many_edits_is_dealt_to_packs(spark, key):
    from maskwright.operators import resolve

    docs = spark.createDataFrame([(1, "".join(f"w{i:04d} " for i in range(700)) + "me@x.org"), (2, "alone me@x.org")], "unit int, text string")
    rows = [(1, i, f"w{i:04d} ", f"v{i}") for i in range(700)] + [(2, 0, "alone", "x"), (3, 0, "a", "b")]
    edits = spark.createDataFrame(rows, "unit int, edit_id int, old string, new string")
    packs = resolve.packed_edits(edits, ["unit"]).collect()
    assert len([p for p in packs if p.unit == 1]) == 3 and sum(len(p._pack) for p in packs) == 702
    rules = make_rules([pattern_named("email")])
    got = resolve.translate_edits(docs, edits, ["unit"], "text", rules, key).collect()
    assert {(r.unit, r.edit_id): (r.status, r.real_old, r.real_new) for r in got} == {
        (u, i): ("no_unit", None, None) if u == 3 else ("ok", old, new) for u, i, old, new in rows
    }


def test_offsets_by_binary_search(spark):
    from pyspark.sql import functions as F

    from maskwright.operators.render import map_back

    spans = [(2, 5, 2, 10), (7, 7, 12, 15), (9, 12, 17, 17)]
    kind = "array<struct<src_start:int,src_end:int,out_start:int,out_end:int>>"
    df = spark.range(25).select(F.col("id").cast("int").alias("o"), F.lit(None).cast(kind).alias("none"))
    df = df.crossJoin(spark.createDataFrame([(spans,)], f"spans {kind}"))

    def plain(o):
        if any(s[2] < o < s[3] for s in spans):
            return None
        return o + sum((s[1] - s[0]) - (s[3] - s[2]) for s in spans if s[2] < o)

    got = {r.o: r.m for r in df.select("o", map_back(F.col("o"), F.col("spans")).alias("m")).collect()}
    assert got == {o: plain(o) for o in range(25)}


def test_notes_and_their_vault_come_from_one_redaction(spark, monkeypatch):
    from maskwright.operators import vault
    from maskwright.plans import vaults
    from maskwright.plans.registry import QUERIES

    calls = []
    real = vaults.redact
    for module in (vault, vaults):
        monkeypatch.setattr(module, "redact", lambda *a, **k: calls.append(1) or real(*a, **k))
    for name in ("rehydrate_capped", "rehydrate_deep", "rehydrate_strict", "field_resolution", "lookup_sources"):
        calls.clear()
        QUERIES[name](spark, "/root/testdata/sf0.001")
        assert len(calls) == 1, name


def test_batches_of_edits_are_translated_once(spark):
    from maskwright.plans.registry import QUERIES

    plan = QUERIES["edit_batches"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "translated-" in plan or "regexp_replace" not in plan
