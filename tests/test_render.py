import pytest
from pyspark.sql import functions as F

from maskwright.operators.aliases import to_alias, to_real
from maskwright.operators.normalize import normalize, normalize_in_turn
from maskwright.operators.render import map_to_source, render, rendered_text
from maskwright.operators.ruleset import Rewrite, all_patterns, default_rewrites, make_rules

PATHS = make_rules(aliases=[("C:\\Users\\SOMEONE", "C:\\Users\\anon"), ("REAL-HOST", "safe-host")])
NORM = make_rules(rewrites=default_rewrites(), timezone=True)


@pytest.mark.parametrize(
    "text, want",
    [
        ("C:\\Users\\SOMEONE\\x", "C:\\Users\\anon\\x"),
        ("C:/Users/SOMEONE/x", "C:/Users/anon/x"),
        ("c:\\\\users\\\\someone\\\\y", "C:\\\\Users\\\\anon\\\\y"),
        ("on real-host now", "on safe-host now"),
        ("nothing", "nothing"),
    ],
)
def test_alias_keeps_separators(apply, text, want):
    (r,) = apply(lambda t: to_alias(t, PATHS), [text])
    assert r.text == want
    (back,) = apply(lambda t: to_real(t, PATHS), [r.text])
    assert back.text.lower() == text.lower()


def test_nested_roots_longest_first(apply):
    rules = make_rules(aliases=[("C:\\Users\\SOMEONE", "U"), ("C:\\Users\\SOMEONE\\work", "W")])
    (r,) = apply(lambda t: to_alias(t, rules), ["in C:\\Users\\SOMEONE\\work and C:\\Users\\SOMEONE"])
    assert (r.text, r["count"]) == ("in W and U", 2)


def test_word_alias_is_guarded(apply):
    rules = make_rules(aliases=[("MYBOX", "MACHINE-A1")])
    (r,) = apply(lambda t: to_alias(t, rules), ["MYBOX MYBOXES mybox$1"])
    assert r.text == "MACHINE-A1 MYBOXES MACHINE-A1$1"


@pytest.mark.parametrize(
    "text, want",
    [
        ("commit at 2026-09-17 21:08:56 +0530 done", "commit at 2026-09-17T15:38:56Z done"),
        ("at 2026-09-17T21:08:56+05:30 ok", "at 2026-09-17T15:38:56Z ok"),
        ("at 2026-09-17 08:00:00 -0700 ok", "at 2026-09-17T15:00:00Z ok"),
        ("at 2026-09-17T21:08:56.250+05:30 ok", "at 2026-09-17T15:38:56.250Z ok"),
        ("at 2026-01-01T00:10:00.5+0530 ok", "at 2025-12-31T18:40:00.500Z ok"),
        ("bad 2026-13-17 21:08:56 +0530 x", "bad 2026-13-17T21:08:56+0000 x"),
        ("TZ is +0530 here", "TZ is +0000 here"),
        ("offset=+0530", "offset=+0000"),
        ("version 2.10.1234567890", "version 2.10.1234567890"),
        ("const id = 1234567890;", "const id = 1234567890;"),
        ("sha 9f8e7d6c5b4a39281706", "sha 9f8e7d6c5b4a39281706"),
        ("-0700.50 and +5 items", "-0700.50 and +5 items"),
        ("Windows 11 Pro 10.0.22631", "Windows 11"),
        ("TZ=Europe/Lisbon LANG=pt_PT.UTF-8", "TZ=UTC LANG=en_US.UTF-8"),
    ],
)
def test_normalize(apply, text, want):
    (one,) = apply(lambda t: normalize(t, NORM), [text])
    assert one.text == want
    assert apply(lambda t: normalize_in_turn(t, NORM), [text]) == [want]


def test_single_pass_differs_from_sequence(apply):
    rules = make_rules(rewrites=[Rewrite("a", "ab", "g", "bc"), Rewrite("b", "bc", "g", "X")])
    assert apply(lambda t: normalize(t, rules).text, ["abc bc"]) == ["bcc X"]
    assert apply(lambda t: normalize_in_turn(t, rules), ["abc bc"]) == ["Xc X"]


def test_missing_group_is_empty(apply):
    rules = make_rules(rewrites=[Rewrite("x", "(a)|b", "g", "<$1$2>")])
    assert apply(lambda t: normalize(t, rules).text, ["ab"]) == ["<a><>"]


RULES = make_rules(
    all_patterns(), ["Jane Q. Testerson"], [("C:\\Users\\SOMEONE", "C:\\Users\\anonymous"), ("REAL-HOST", "H")],
    default_rewrites(), True,
)
TEXT = "Jane Q. Testerson on REAL-HOST in c:/users/someone/x mailed a@b.co at 2026-09-17 21:08:56 +0530 from 8.8.8.8 end"


def test_render_and_map_back(spark, key):
    df = spark.createDataFrame([(TEXT,)], "text string").withColumn("r", render(F.col("text"), RULES, key))
    r = df.first().r
    assert "c:/users/someone" not in r.text.lower() and r.aliased == 2 and r.normalized == 1
    assert [s.category for s in r.redact_spans] == ["personal", "email", "ip"]
    offsets = df.select(
        F.posexplode(F.transform(F.sequence(F.lit(0), F.length("r.text")), lambda o: map_to_source(o, F.col("r.stages"))))
    ).collect()
    mapped = [x.col for x in offsets]
    assert mapped[0] == 0 and mapped[-1] == len(TEXT)
    kept = [(o, m) for o, m in enumerate(mapped[:-1]) if m is not None]
    assert sorted(m for _, m in kept) == [m for _, m in kept]
    assert r.text.index(" mailed ") in dict(kept) and TEXT[dict(kept)[r.text.index(" mailed ")] :].startswith(" mailed ")
    inside = r.text.index("[PII:email") + 3
    assert mapped[inside] is None


def test_render_is_idempotent(apply, key):
    once = apply(lambda t: rendered_text(t, RULES, key), [TEXT])
    assert apply(lambda t: rendered_text(t, RULES, key), once) == once
