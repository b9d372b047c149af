import hashlib
import hmac
import random
import re

import pytest

from maskwright.functions.regexes import FIELD_MARK, MATCH_MARK, count_groups, js_template, to_java
from maskwright.operators.ruleset import (
    Pattern, all_patterns, make_rules, optional_patterns, pattern_named, shipped_hint,
)
from maskwright.operators.spans import redact
from maskwright.plans.base import TEST_KEY

PHONE = Pattern("phone", r"(?<![\d.])\d{3}[ .-]\d{3}[ .-]\d{4}(?![\d.])", "g")
EMAIL = pattern_named("email")


def label(category, value):
    mac = hmac.new(TEST_KEY, value.encode(), hashlib.sha256).hexdigest()[:16]
    return f"[PII:{category}:{mac}]"


def redactor(rules, key):
    return lambda t: redact(t, rules, key)


def test_crossing_pattern_and_literal(apply, key):
    rules = make_rules(
        [EMAIL, Pattern("crossing-head", "abcdefPHONE1234567", "gi")], [("PHONE1234567SECRETXYZ", False)]
    )
    (r,) = apply(redactor(rules, key), ["xx abcdefPHONE1234567SECRETXYZ yy"])
    assert r.text == f"xx {label('crossing-head', 'abcdefPHONE1234567')}{label('personal', 'SECRETXYZ')} yy"


def test_crossing_literals(apply, key):
    rules = make_rules(literals=["123 Main", "Main Street Apt 4"])
    (r,) = apply(redactor(rules, key), ["address: 123 Main Street Apt 4 done"])
    assert "Street Apt 4" not in r.text and r.text.startswith("address: ") and r.text.endswith(" done")


def test_pattern_beats_shorter_literal_at_same_start(apply, key):
    (r,) = apply(redactor(make_rules([EMAIL], ["Jane"]), key), ["mail jane.test@example.org now"])
    assert [s.category for s in r.spans] == ["email"]


def test_guard_allows_copies_but_not_longer_words(apply, key):
    (r,) = apply(redactor(make_rules(literals=["MYBOX"]), key), ["MYBOXMYBOX MYBOXES xMYBOX"])
    assert len(r.spans) == 2 and r.text.endswith(" MYBOXES xMYBOX")


def test_unguarded_literal_inside_a_word(apply, key):
    (r,) = apply(redactor(make_rules(literals=["Jane Q. Testerson"]), key), ["xxxjane q. testersonYYY"])
    assert r.text == "xxx" + label("personal", "jane q. testerson") + "YYY"


def test_literal_folds_unicode_case(apply, key):
    (r,) = apply(redactor(make_rules(literals=["Éloïse"]), key), ["ask éLOÏSE or Éloïses"])
    assert [s.value for s in r.spans] == ["éLOÏSE"]


def test_short_and_placeholder_literals_are_dropped():
    rules = make_rules(literals=["ab", " Your Full Name ", "abc"])
    assert [x.value for x in rules.literals] == ["abc"]


def test_offsets_are_code_points(apply, key):
    (r,) = apply(redactor(make_rules([EMAIL]), key), ["😀é jane@x.co!"])
    s = r.spans[0]
    assert (s.real_start, s.real_end, s.value) == (3, 12, "jane@x.co")
    assert r.text[s.red_start : s.red_end] == s.label


def test_texts_holding_the_internal_marks(apply, key):
    text = f"{MATCH_MARK}a{FIELD_MARK} jane@x.co {MATCH_MARK}"
    (r,) = apply(redactor(make_rules([EMAIL]), key), [text])
    assert r.text == text.replace("jane@x.co", label("email", "jane@x.co"))


def test_empty_and_null(apply, key):
    rows = apply(redactor(make_rules([EMAIL]), key), ["", None])
    assert rows[0].text == "" and rows[1].text is None and not rows[1].spans


@pytest.mark.parametrize("seed", [1])
def test_generated_texts(apply, key, seed):
    """Slices of both texts agree with the spans, and an independent scan agrees on them."""
    rng = random.Random(seed)
    parts = ["Jane Q. Testerson", "x@y.co", "555-123-4567", "plain", " ", "42", "é→", "123 Main", "Main Street", "\n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 14))) for _ in range(200)]
    rules = make_rules([EMAIL, PHONE], ["Jane Q. Testerson", "123 Main", "Main Street"])
    regexes = [
        ("email", re.compile(EMAIL.regex, re.I | re.A)),
        ("phone", re.compile(PHONE.regex, re.A)),
        ("personal", re.compile("Jane Q\\. Testerson", re.I)),
        ("personal", re.compile("Main Street", re.I)),
        ("personal", re.compile("123 Main", re.I)),
    ]
    for text, r in zip(texts, apply(redactor(rules, key), texts)):
        found = [(m.start(), -m.end(), o, c) for o, (c, rx) in enumerate(regexes) for m in rx.finditer(text)]
        want, cursor = [], 0
        for start, neg, _, cat in sorted(found):
            if -neg > cursor:
                want.append((max(start, cursor), -neg, cat))
                cursor = -neg
        assert [(s.real_start, s.real_end, s.category) for s in r.spans] == want, text
        for s in r.spans:
            assert text[s.real_start : s.real_end] == s.value
            assert r.text[s.red_start : s.red_end] == s.label == label(s.category, s.value)


def samples():
    return [
        "AIza" + "f" * 35, "ghp_" + "a" * 36, "sk-proj-" + "c" * 40, "npm_" + "i" * 36,
        'api_key = "' + "m" * 32 + '"', "AKIA" + "A1" * 8, "xoxb-" + "1" * 12, "-----BEGIN EC PRIVATE KEY-----",
        "eyJ" + "a" * 9 + "." + "b" * 9 + "." + "c" * 9, "Bearer " + "t" * 24 + "==", "sk-ant-" + "z" * 22,
        "rk_test_" + "q" * 16, "SG." + "a" * 16 + "." + "b" * 16, "hf_" + "h" * 30, "mysql://u:p@h", "4" + "1" * 15,
        "DE89370400440532013000", "2345 6789 0123", "ABCDE1234F", "123-45-6789", "203.0.113.47",
        "2001:0db8:85a3:0000:0000:8a2e:0370:7334", "3c:22:fb:9a:1d:4e", "+1 415 555 0134",
        "https://github.com/org-a/repo-b", "é" + "AKIA" + "B2" * 8,
    ]


def test_shipped_set_is_idempotent(apply, key):
    rules = make_rules(all_patterns())
    texts = [f"value {s} end" for s in samples()]
    once = [r.text for r in apply(redactor(rules, key), texts)]
    assert all(o != t for o, t in zip(once, texts))
    assert [r.text for r in apply(redactor(rules, key), once)] == once


def test_look_alikes_are_left_alone(apply, key):
    texts = [
        "14:22:05", "cafe::babe", "::1", "127.0.0.1 10.1.2.3 192.168.0.9 172.20.1.1 1.2.3.400",
        "000-12-3456 666-12-3456 900-12-3456 123-00-4567 123-45-0000", "1.555 123 4567", "sk-short", "AIzaTooShort",
    ]
    rules = make_rules(all_patterns())
    assert [r.text for r in apply(redactor(rules, key), texts)] == texts


def test_labels_are_protected(apply, key):
    """``api-key:<hex>`` inside a label has the shape of a key assignment."""
    lab = label("google-api-key", "x")
    (r,) = apply(redactor(make_rules(optional_patterns()), key), [f"keep {lab} and api_key = {'k' * 20}"])
    assert r.text.startswith(f"keep {lab} and ") and r.text.count("[PII:") == 2


def test_every_hint_holds_for_its_pattern(spark, key, apply):
    """A gate must never hide a match: with and without hints, the result is the same."""
    gated = make_rules(all_patterns())
    bare = make_rules([Pattern(p.name, p.regex, p.flags) for p in all_patterns()])
    texts = samples() + [f"{a} {b}" for a, b in zip(samples(), reversed(samples()))]
    assert [r.text for r in apply(redactor(gated, key), texts)] == [r.text for r in apply(redactor(bare, key), texts)]
    assert all(shipped_hint(p.name) for p in all_patterns())


def test_dialect_helpers():
    assert count_groups(r"(a)(?:b)(?<n>c)(?<=d)\((e)[(]") == 3
    assert js_template("Windows $1", 1) == "Windows $1"
    assert js_template("a$2b$12", 1) == "ab$1\\2"
    assert js_template("c:\\x", 0) == "c:\\\\x"
    assert to_java(r"a\sb").startswith("a[\\t") and to_java(r"[^\s:]").endswith("x{feff}:]")


def test_time_grows_with_the_text(spark):
    """40,000 hits in one text, and twice as many in about twice the time."""
    import time

    from maskwright.operators.findings import findings
    from maskwright.operators.ruleset import make_rules, pattern_named
    from pyspark.sql import functions as F

    rules = make_rules([pattern_named("email")])
    took = {}
    for n in (2_000, 40_000, 80_000):
        df = spark.range(1).select("id", F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.concat(F.lit("mail u"), i.cast("string"), F.lit("@x.example.org now"))), "\n").alias("text"))
        df = spark.createDataFrame([(0, df.first().text)], "id int, text string")
        started = time.perf_counter()
        rows = findings(df, ["id"], "text", rules).agg(F.count("*").alias("n"), F.max("end").alias("e")).first()
        took[n] = time.perf_counter() - started
        assert rows.n == n
    assert took[40_000] < 20 and took[80_000] < 3 * took[40_000] + 2
