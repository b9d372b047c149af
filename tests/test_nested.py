import json

from pyspark.sql import functions as F

from maskwright.operators.nested import (
    distinct_first, json_skeleton, json_transform, map_policy, map_policy_hits, pseudonymize_field, transform_columns,
)
from maskwright.operators.ruleset import make_rules, pattern_named
from maskwright.operators.spans import redact

RULES = make_rules([pattern_named("email")])


def hide(key):
    return lambda t: redact(t, RULES, key).text


def test_body_walk_skips_opaque_blocks_and_other_columns(spark, key):
    block = {"type": "text", "text": "a@b.co"}
    thinking = {"type": "thinking", "text": "a@b.co"}
    df = spark.createDataFrame(
        [([block, thinking], [{"role": "user", "content": [block, thinking]}], ["a@b.co"], {"a@b.co": "c@d.co"})],
        "system array<struct<type:string,text:string>>, "
        "messages array<struct<role:string,content:array<struct<type:string,text:string>>>>, "
        "tools array<string>, extra map<string,string>",
    )
    row = transform_columns(df, ["system", "messages", "extra"], hide(key)).first()
    assert row.system[0].text.startswith("[PII:email:") and row.system[1].text == "a@b.co"
    content = row.messages[0].content
    assert content[0].text.startswith("[PII:") and content[1].text == "a@b.co"
    assert row.tools == ["a@b.co"]
    assert list(row.extra) == ["a@b.co"] and row.extra["a@b.co"].startswith("[PII:")


def test_json_text_keeps_everything_but_strings(apply, key):
    raw = '{ "a@b.co" : "x \\"q\\" a@b.co \\u00e9", "n":1.50, "e":1e3, "z":[true,null,"plain\\/x"] }'
    (out,) = apply(lambda t: json_transform(t, hide(key)), [raw])
    assert out.startswith('{ "a@b.co" : "x \\"q\\" [PII:email:') and '"n":1.50, "e":1e3, "z":[true,null,"plain\\/x"] }' in out
    assert json.loads(out)["a@b.co"].endswith(" é")
    assert apply(lambda t: json_transform(t, hide(key)), ["{bad a@b.co", '"a@b.co"', ""])[0] == "{bad a@b.co"


def test_json_long_strings(apply, key):
    raw = json.dumps({"k": ("\\" + '"') * 50_000 + " a@b.co"})
    (out,) = apply(lambda t: json_transform(t, hide(key)), [raw])
    assert json.loads(out)["k"].startswith(("\\" + '"') * 50_000 + " [PII:email:")


def test_skeleton_sees_structure_only(apply):
    same = apply(json_skeleton, ['{"b": "x: y", "a": [1, "q\\"r"]}', '{"a":[1,"other"],"b":""}', '{"a":[2,"other"],"b":""}', "{"])
    assert same[0] == same[1] != same[2] and same[3] is None


def test_header_policy(spark):
    df = spark.createDataFrame([({"Accept-Language": "pt-PT", "Via": "x", "X-Real-IP": "1.2.3.4", "x-ok": "v"},)], "h map<string,string>")
    row = df.select(
        map_policy(F.col("h")).alias("on"), map_policy(F.col("h"), mode="off").alias("off"),
        map_policy(F.col("h"), keep=["Via"], extra={"x-ok": None}).alias("tuned"), map_policy_hits(F.col("h")).alias("hits"),
    ).first()
    assert row.on == {"Accept-Language": "en-US,en;q=0.9", "x-ok": "v"}
    assert len(row.off) == 4 and row.tuned == {"Accept-Language": "en-US,en;q=0.9", "Via": "x"}
    assert sorted(row.hits) == ["accept-language", "via", "x-real-ip"]


def test_pseudonym_modes(apply, key):
    texts = ['{"device_id":"abc","k":1}', '{"device_id":5}', "not json", '{"other":"x"}']
    stable = apply(lambda t: pseudonymize_field(t, "device_id", "stable", key), texts)
    assert stable[1:] == texts[1:] and json.loads(stable[0])["k"] == 1 and len(json.loads(stable[0])["device_id"]) == 64
    session = apply(lambda t: pseudonymize_field(t, "device_id", "session", key, F.lit("s1")), texts)
    assert json.loads(session[0])["device_id"] == "s1"


def test_distinct_first_equals_direct(spark, key):
    df = spark.createDataFrame([(i, f"t{i % 3} a{i % 3}@b.co" if i % 5 else None) for i in range(60)], "id int, text string")
    fn = hide(key)
    got = {r.id: r.out for r in distinct_first(df, "text", "out", fn).collect()}
    want = {r.id: r.out for r in df.select("id", fn(F.col("text")).alias("out")).collect()}
    assert got == want
