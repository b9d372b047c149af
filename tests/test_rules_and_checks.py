import json

import pytest
from pyspark.sql import functions as F

from maskwright.functions import catalog
from maskwright.functions.keys import attach_key, detach_key, key_frame, label, LabelKey, subkey
from maskwright.operators import rules as C
from maskwright.operators import verify as Q
from maskwright.operators.ruleset import all_patterns, default_rewrites, make_rules, row_hash

DOC = {
    "literals": ["Jane Q. Testerson", "ab", {"value": "PHONE1234567", "boundary": False}, "Your Full Name"],
    "patterns": [
        {"name": "email", "regex": dict((n, r) for n, r, _ in catalog.DEFAULT_PATTERNS)["email"], "flags": "gi"},
        {"name": "bad", "regex": "^(a+)+$", "flags": "g"},
        {"name": "ip", "regex": "\\b8\\.8\\.8\\.8\\b", "flags": "g"},
    ],
    "aliases": [{"real": "C:\\Users\\SOMEONE", "alias": "C:\\Users\\anon"}, {"real": "ab", "alias": "x"}],
    "remoteTools": ["mcp__zen__"],
    "normalize": {"timezone": True, "rewrites": [{"name": "x", "regex": "foo", "replace": "bar"}, {"name": "broken", "regex": "(", "replace": ""}]},
}


def test_rules_document(spark, tmp_path):
    path = tmp_path / "rules.json"
    path.write_text(json.dumps(DOC, indent=2))
    tables = C.read_rules(spark, str(path))
    with pytest.raises(C.DisabledRules) as caught:
        C.rule_set(tables)
    assert [(s, n) for s, n, _ in caught.value.rows] == [("patterns", "bad"), ("rewrites", "broken")]
    rs = C.rule_set(tables, accept_disabled=True)
    assert {(x.value, x.boundary) for x in rs.literals} == {("Jane Q. Testerson", False), ("PHONE1234567", False)}
    assert [p.name for p in rs.patterns] == ["email", "ip"] and rs.patterns[0].hint and rs.patterns[1].hint is None
    assert [a.real for a in rs.aliases] == ["C:\\Users\\SOMEONE"]
    assert rs.timezone and [r.name for r in rs.rewrites] == ["x"] and rs.remote_prefixes == ("mcp__zen__",)
    assert rs.categories == ["email", "ip", "personal"]
    assert rs.fingerprint != make_rules(all_patterns()).fingerprint


def test_uncompilable_patterns_are_reported(spark):
    cols = "position bigint, name string, category string, regex string, flags string"
    patterns = spark.createDataFrame([(0, "order", None, "[A-Z]+-[0-9]{6}", "g"), (1, "open", None, "(unclosed", "g"), (2, "ok", None, "x1", "g")], cols)
    aliases = spark.createDataFrame([], "real string, alias string")
    found = {(r.severity, r.name): r.message for r in C.config_findings(patterns, aliases).collect()}
    assert found["error", "open"] == "does not compile" and ("error", "ok") not in found
    assert found["error", "order"] == "starts with an unbounded repeat"


def test_fingerprints_do_not_collide(spark):
    def of(*rows):
        return C.fingerprint({"patterns": spark.createDataFrame(list(rows), "name string, regex string")}).first().fingerprint

    prints = [of(("a|b", "c")), of(("a", "b|c")), of((None, "c")), of(("~", "c")), of(("n", "c")), of(("1:n", "c"))]
    assert len(set(prints)) == len(prints)
    one, other = make_rules(literals=["abcd|efgh"]), make_rules(literals=["abcd", "efgh"])
    assert one.fingerprint != other.fingerprint
    assert row_hash("x", None) != row_hash("x", "n") and row_hash("x", "ab", "c") != row_hash("x", "a", "bc")


def test_shipped_patterns_pass_the_lint(spark):
    df = spark.createDataFrame([(p.name, p.regex) for p in all_patterns()], "name string, regex string")
    assert C.disabled_patterns(df).count() == 0
    assert all(C.is_compilable(spark, p.regex) for p in all_patterns())


def test_adoption_is_verified(spark):
    cols = "position bigint, name string, category string, regex string, flags string"
    have = spark.createDataFrame([(0, "a", None, "x", "g")], cols)
    new = spark.createDataFrame([(1, "a", None, "y", "g"), (2, "b", None, "x", "g"), (3, "c", None, "(a+)+", "g"), (4, "d", None, "z", "g")], cols)
    out = C.adopt_patterns(have, new)
    assert {(r.name, r.outcome) for r in out.collect()} == {("a", "skipped"), ("b", "skipped"), ("c", "rejected"), ("d", "added")}
    merged = C.adopted(have, out)
    assert C.adoption_verified(have, out, merged) and not C.adoption_verified(have, out, have)


def test_alias_risk_negatives(apply):
    risks = apply(C.alias_risk, ["host", " Server ", "Zed", "", "MACHINE-A1", "C:\\Users\\anon", "longplainword"])
    assert [bool(r) for r in risks] == [True, True, True, True, False, False, False]


def test_probes(spark, key):
    rules = make_rules(all_patterns(), ["Jane"], [("REAL-HOST", "MACHINE-A1")], default_rewrites(), True)
    status = {r.category: r.status for r in Q.category_probes(spark, rules, key).collect()}
    assert all(status[c] == "ok" for c in catalog.CATEGORY_PROBES) and status["iban"] == "no probe"
    missing = {r.category: r.status for r in Q.category_probes(spark, make_rules([all_patterns()[1]]), key).collect()}
    assert missing["email"] == missing["ip"] == "missing"
    assert {r.status for r in Q.normalization_probes(spark, rules, key).collect()} == {"ok"}
    assert {r.status for r in Q.normalization_probes(spark, make_rules(all_patterns()), key).collect()} == {"leaks"}
    (alias,) = Q.alias_checks(spark, rules).collect()
    assert alias.risk is None and not alias.survives


def test_keys_stay_out_of_plans(spark, tmp_path):
    key = subkey(b"\x07" * 32, "label")
    path = str(tmp_path / "key")
    key_frame(spark, key).write.parquet(path)
    df = spark.createDataFrame([("v",), ("w",)], "value string")
    keyed = attach_key(df, spark.read.parquet(path))
    out = detach_key(keyed.withColumn("label", label(F.col("value"), F.lit("email"), LabelKey.attached())))
    public = df.withColumn("label", label(F.col("value"), F.lit("email"), LabelKey.public(key)))
    assert sorted(out.collect()) == sorted(public.collect())
    plan = out._jdf.queryExecution().toString().lower()
    assert bytes(b ^ 0x36 for b in key).hex() not in plan


def test_self_test_over_a_whole_configuration(spark, key):
    from maskwright.api import self_test

    good = make_rules(all_patterns(), ["Jane", "Jane Q. Testerson"], [("REAL-HOST", "MACHINE-A1")], default_rewrites(), True)
    assert {r.status for r in self_test(spark, good, key).collect()} <= {"ok", "no probe"}
    bad = make_rules(all_patterns()[1:2], ["Jane"], [("REAL-HOST", "host")])
    status = {(r.section, r.check): r.status for r in self_test(spark, bad, key).collect()}
    assert status["categories", "email"] == "missing" and status["aliases", "host"] == "risky"
    assert status["normalization", "regional locale"] == "leaks"


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_units_that_stay_are_searched_once(spark):
    rules = make_rules(all_patterns())
    rows = [("a@b.example", "a@b.example"), ("a@b.example c@d.example", "x"), ("x", "a@b.example"), (None, None), (None, "a@b.example"), ("a@b.example", None)]
    df = spark.createDataFrame(rows, "before string, after string")
    r = Q.effect(df, "before", "after", rules).first()
    assert (r.pii_before, r.pii_after, r.identical, r.units, r.removed) == (4, 3, 1, 6, 1)
    plan = optimized(Q.effect(df, "before", "after", rules))
    assert "WHEN (before#" in plan and "THEN null" in plan


def test_a_report_searches_the_texts_once(spark):
    from maskwright.operators import findings as R

    docs = spark.createDataFrame([(1, "a@b.example\nsome thenon"), (2, None), (3, "c@d.example c@d.example")], "doc_id long, text string")
    hits = R.detailed_findings(docs, ["doc_id"], "text", make_rules(all_patterns()), None)
    lines = R.report_lines(hits, "doc_id")
    assert "regexp_replace" in optimized(hits) and "regexp_replace" not in optimized(lines)
    assert [r.line_text for r in lines.collect()][0].startswith("3   (2 occurrences)") and lines.count() == 5


def test_a_literals_regex_is_built_once_for_all_shapes(spark, key):
    from maskwright.operators.ruleset import RuleSet

    lits = spark.createDataFrame([("Jane", True), ("a-b", False)], "value string, boundary boolean")
    for df in (Q.shape_self_test(lits, RuleSet(), key), Q.leak_audit(lits, RuleSet(), key)):
        above, below = optimized(df).split("Generate inline")
        assert "RepartitionByExpression" in below  # few bytes would be one task
        assert "regexp_replace(value#" not in above and "RLIKE" not in above
