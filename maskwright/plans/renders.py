"""Alias, normalization, rendering and nested-data queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.aliases import sanitize, to_alias, to_real
from ..operators.nested import (
    deep_transform, json_transform, map_policy, map_policy_hits, pseudonymize_field, skip_opaque, transform_columns,
)
from ..operators.normalize import blank_offsets, dates_to_utc, normalize, normalize_in_turn
from ..operators.render import map_to_source, render
from ..operators.ruleset import default_rewrites, make_rules, pattern_named
from ..operators.spans import redact
from ..sources.tables import table
from .base import (
    STD_LITERAL, STD_PATTERNS, STD_RULES, hmac_sql, label_sql, query, quoted, redacted_ctes, span_ctes,
    test_key,
)
from .notes import NOTES_SQL, notes
from .scans import EMAIL, docs

ALIAS_RULES = make_rules(
    aliases=[("C:\\Users", "D:\\Home"), ("gitlab.org", "forge.test"), ("DESK-", "HOST-")]
)


def alias_sql(text: str) -> str:
    out = f"regexp_replace({text}, '(?i)C:([\\\\/]+)Users', 'D:\\1Home', 'g')"
    out = f"regexp_replace({out}, '(?i)gitlab\\.org', 'forge.test', 'g')"
    return f"regexp_replace({out}, '(?i)DESK-', 'HOST-', 'g')"


def real_sql(text: str) -> str:
    out = f"regexp_replace({text}, '(?i)D:([\\\\/]+)Home', 'C:\\1Users', 'g')"
    out = f"regexp_replace({out}, '(?i)forge\\.test', 'gitlab.org', 'g')"
    return f"regexp_replace({out}, '(?i)HOST-', 'DESK-', 'g')"


@query("alias_docs", f"WITH {NOTES_SQL} SELECT unit, {alias_sql('text')} AS text FROM notes")
def alias_docs(spark, root):
    return notes(spark, root).select("unit", to_alias(F.col("text"), ALIAS_RULES).text.alias("text"))


@query("unalias_docs", f"WITH {NOTES_SQL} SELECT unit, {real_sql(alias_sql('text'))} AS text FROM notes")
def unalias_docs(spark, root):
    aliased = notes(spark, root).select("unit", to_alias(F.col("text"), ALIAS_RULES).text.alias("a"))
    return aliased.select("unit", to_real(F.col("a"), ALIAS_RULES).text.alias("text"))


@query(
    "collapsed_alias",
    f"WITH {NOTES_SQL} SELECT unit, regexp_replace(text, '(?i)C:[\\\\/]+Users', 'HOMEDIR', 'g') AS text, "
    "CAST(len(regexp_extract_all(text, '(?i)C:[\\\\/]+Users')) AS BIGINT) AS n FROM notes",
)
def collapsed_alias(spark, root):
    rules = make_rules(aliases=[("C:\\Users", "HOMEDIR")])
    r = notes(spark, root).select("unit", to_alias(F.col("text"), rules).alias("r"))
    return r.select("unit", "r.text", F.col("r.count").cast("bigint").alias("n"))


@query(
    "sanitize_docs",
    "WITH x AS (SELECT doc_id, text, regexp_replace(text, '(?i)thenon', 'example-user', 'g') AS a FROM documents) "
    "SELECT doc_id, regexp_replace(a, '(?i)erbl', 'example-user', 'g') AS text, "
    "CAST(len(regexp_extract_all(text, '(?i)thenon')) + len(regexp_extract_all(a, '(?i)erbl')) AS BIGINT) AS replaced FROM x",
)
def sanitize_docs(spark, root):
    rules = make_rules(aliases=[("thenon", "NAME-A1"), ("erbl", "NAME-B2")])
    done = sanitize(docs(spark, root), "text", rules)
    return done.select("doc_id", "text", F.col("replaced").cast("bigint").alias("replaced"))


DATETIME_RX = r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?\s?[+-]\d{2}:?\d{2}\b"
_OFF = r"regexp_extract(v, '([+-])(\d{2}):?(\d{2})$', "
_FRAC = r"regexp_extract(v, ':\d{2}(\.\d+)', 1)"
_OK = (
    "CAST(substr(v, 6, 2) AS INT) BETWEEN 1 AND 12 AND CAST(substr(v, 9, 2) AS INT) BETWEEN 1 AND 31 "
    "AND CAST(substr(v, 12, 2) AS INT) < 24 AND CAST(substr(v, 15, 2) AS INT) < 60 AND CAST(substr(v, 18, 2) AS INT) < 60 "
    f"AND CAST({_OFF}2) AS INT) < 24 AND CAST({_OFF}3) AS INT) < 60"
)
_INSTANT = (
    "make_timestamp(CAST(substr(v, 1, 4) AS BIGINT), CAST(substr(v, 6, 2) AS BIGINT), 1, CAST(substr(v, 12, 2) AS BIGINT), "
    "CAST(substr(v, 15, 2) AS BIGINT), CAST(substr(v, 18, 2) AS DOUBLE)) + to_days(CAST(substr(v, 9, 2) AS INT) - 1) "
    f"- to_minutes(CASE WHEN {_OFF}1) = '-' THEN -1 ELSE 1 END * (CAST({_OFF}2) AS INT) * 60 + CAST({_OFF}3) AS INT)))"
)
UTC_SQL = (
    f"CASE WHEN {_OK} THEN strftime({_INSTANT}, '%Y-%m-%dT%H:%M:%S') || "
    f"CASE WHEN {_FRAC} = '' THEN '' ELSE rpad(left({_FRAC}, 4), 4, '0') END || 'Z' "
    f"ELSE substr(v, 1, 10) || 'T' || substr(v, 12, 8) || {_FRAC} || '+0000' END"
)


def replaced_ctes(src: str, keys: str, text: str, regex: str, value: str, name: str) -> str:
    """Replace matches of one regex by an SQL expression over the match ``v``."""
    return (
        f"{name}_m AS (SELECT {keys}, {text}, regexp_extract_all({text}, {quoted(regex)}) AS ms, "
        f"string_split_regex({text}, {quoted(regex)}) AS gs FROM {src}), "
        f"{name}_u AS (SELECT {keys}, unnest(range(1, len(ms) + 1)) AS i, unnest(ms) AS v, unnest(gs[1:len(ms)]) AS g FROM {name}_m WHERE len(ms) > 0), "
        f"{name}_h AS (SELECT {keys}, string_agg(g || {value}, '' ORDER BY i) AS head FROM {name}_u GROUP BY {keys}), "
        f"{name} AS (SELECT {', '.join('m.' + k.strip() for k in keys.split(','))}, "
        f"CASE WHEN h.head IS NULL THEN m.{text} ELSE h.head || m.gs[-1] END AS text FROM {name}_m m LEFT JOIN {name}_h h USING ({keys}))"
    )


@query(
    "normalize_ts",
    f"WITH {NOTES_SQL}, {replaced_ctes('notes', 'unit', 'text', DATETIME_RX, UTC_SQL, 'utc')} SELECT unit, text FROM utc",
)
def normalize_ts(spark, root):
    return notes(spark, root).select("unit", dates_to_utc(F.col("text")).text.alias("text"))


_BARE_SQL = r"regexp_replace(text, '(^|[\s=])[+-]\d{4}($|[^\d.])', '\1+0000\2', 'g')"


@query("bare_offsets", f"WITH {NOTES_SQL} SELECT unit, {_BARE_SQL} AS text FROM notes")
def bare_offsets(spark, root):
    return notes(spark, root).select("unit", blank_offsets(F.col("text")).alias("text"))


def rewrites_sql(text: str) -> str:
    os_build, tz, _ = default_rewrites()
    out = f"regexp_replace({text}, {quoted(os_build.regex)}, 'Windows \\1', 'g')"
    out = f"regexp_replace({out}, {quoted(tz.regex)}, 'UTC', 'g')"
    return f"regexp_replace({out}, '\\b[a-z]{{2}}_[A-Z]{{2}}\\b', 'en_US', 'g')"


REWRITE_RULES = make_rules(rewrites=default_rewrites())
NORMALIZE_RULES = make_rules(rewrites=default_rewrites(), timezone=True)


@query("rewrite_chain", f"WITH {NOTES_SQL} SELECT unit, {rewrites_sql('text')} AS text FROM notes")
def rewrite_chain(spark, root):
    return notes(spark, root).select("unit", normalize_in_turn(F.col("text"), REWRITE_RULES).alias("text"))


@query(
    "normalize_single_pass",
    f"WITH {NOTES_SQL}, {replaced_ctes('notes', 'unit', 'text', DATETIME_RX, UTC_SQL, 'utc')} "
    f"SELECT unit, {rewrites_sql(_BARE_SQL)} AS text FROM utc",
)
def normalize_single_pass(spark, root):
    return notes(spark, root).select("unit", normalize(F.col("text"), NORMALIZE_RULES).text.alias("text"))


RENDER_RULES = make_rules(
    STD_PATTERNS, [STD_LITERAL], [(a.real, a.alias) for a in ALIAS_RULES.aliases], default_rewrites(), True
)


@query(
    "render_pipeline",
    f"WITH {NOTES_SQL}, {redacted_ctes('notes', 'unit')}, aliased AS (SELECT unit, {alias_sql('out')} AS text FROM redacted), "
    f"{replaced_ctes('aliased', 'unit', 'text', DATETIME_RX, UTC_SQL, 'utc')}, "
    f"n AS (SELECT unit, count(*) AS k FROM spans GROUP BY unit) "
    f"SELECT utc.unit, {rewrites_sql(_BARE_SQL)} AS text, CAST(coalesce(k, 0) AS BIGINT) AS spans FROM utc LEFT JOIN n ON n.unit = utc.unit",
)
def render_pipeline(spark, root):
    r = notes(spark, root).select("unit", render(F.col("text"), RENDER_RULES, test_key()).alias("r"))
    return r.select("unit", "r.text", F.size("r.redact_spans").cast("bigint").alias("spans"))


@query(
    "offset_back_mapping",
    f"WITH {NOTES_SQL}, {span_ctes('notes', 'unit')} "
    "SELECT unit, s AS start, e AS stop, CAST(NULL AS BIGINT) AS inside FROM spans",
)
def offset_back_mapping(spark, root):
    # exploded, so that the optimizer does not repeat the render for each of its fields
    r = notes(spark, root).select("unit", F.explode(F.array(render(F.col("text"), STD_RULES, test_key()))).alias("r"))
    probes = r.select("unit", F.col("r.stages").alias("stages"), F.explode("r.redact_spans").alias("s"))
    at = lambda c: map_to_source(c, F.col("stages")).cast("bigint")
    return probes.select(
        "unit", at(F.col("s.red_start")).alias("start"), at(F.col("s.red_end")).alias("stop"),
        at(F.col("s.red_start") + 1).alias("inside"),
    )


PAGES_RULES = make_rules([EMAIL, pattern_named("credit-card")])


@query(
    "field_selective",
    f"WITH {redacted_ctes('pages', 'page_id', 'html', PAGES_RULES)} "
    "SELECT page_id, url, out AS html FROM redacted JOIN pages USING (page_id)",
)
def field_selective(spark, root):
    pages = table(spark, root, "pages")
    return transform_columns(pages, ["html"], lambda t: redact(t, PAGES_RULES, test_key()).text)


_LINES = (
    "lines AS (SELECT doc_id, i, CASE WHEN i % 5 = 0 THEN 'thinking' ELSE 'text' END AS kind, t AS text FROM "
    "(SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS i, unnest(string_split(text, chr(10))) AS t FROM documents))"
)


@query(
    "nested_blocks",
    f"WITH {_LINES}, {redacted_ctes('lines', 'doc_id, i')} SELECT r.doc_id, r.i, l.kind AS type, "
    "CASE WHEN l.kind = 'thinking' THEN l.text ELSE r.out END AS text FROM redacted r JOIN lines l USING (doc_id, i)",
)
def nested_blocks(spark, root):
    """An array of typed blocks per document, as message content is stored."""
    blocks = F.transform(
        F.split("text", "\n", -1),
        lambda line, i: F.struct(
            F.when(i % 5 == 0, "thinking").otherwise("text").alias("type"), line.alias("text")
        ),
    )
    df = docs(spark, root).select("doc_id", blocks.alias("content"))
    done = df.select(
        "doc_id",
        deep_transform(
            F.col("content"), df.schema["content"].dataType,
            lambda t: redact(t, STD_RULES, test_key()).text,
        ).alias("content"),
    )
    return done.select("doc_id", F.posexplode("content").alias("i", "b")).select(
        "doc_id", F.col("i").cast("bigint").alias("i"), "b.type", "b.text"
    )


@query(
    "opaque_skip",
    f"WITH {redacted_ctes('documents', 'doc_id')} SELECT doc_id, "
    "CASE WHEN doc_id % 3 = 0 THEN text ELSE out END AS text FROM redacted",
)
def opaque_skip(spark, root):
    kind = F.when(F.col("doc_id") % 3 == 0, "image").otherwise("text")
    return docs(spark, root).select(
        "doc_id", skip_opaque(kind, F.col("text"), lambda t: redact(t, STD_RULES, test_key()).text).alias("text")
    )


EMAIL_RULES = make_rules([EMAIL])
_KEEP = "a.b@example.org"


@query(
    "json_deep_transform",
    f"WITH {NOTES_SQL}, {redacted_ctes('notes', 'unit', rules=EMAIL_RULES)} "
    "SELECT unit, '{\"id\": ' || unit || ', \"note\":  ' || CAST(to_json(out) AS VARCHAR) || ', \"keep\": [1.50, \"' || "
    f"{label_sql(quoted(_KEEP), quoted('email'))} || '\", null]}}' AS json FROM redacted",
)
def json_deep_transform(spark, root):
    quoted_text = F.to_json(F.struct(F.col("text").alias("v")))
    raw = F.concat(
        F.lit('{"id": '), F.col("unit").cast("string"), F.lit(', "note":  '),
        F.substring(quoted_text, F.lit(6), F.length(quoted_text) - 6),
        F.lit(f', "keep": [1.50, "{_KEEP}", null]}}'),
    )
    made = notes(spark, root).select("unit", raw.alias("raw"))
    return made.select(
        "unit", json_transform(F.col("raw"), lambda t: redact(t, EMAIL_RULES, test_key()).text).alias("json")
    )


@query(
    "header_policy",
    "WITH h AS (SELECT event_id, 'Accept-Language' AS name, event_type AS value FROM events UNION ALL "
    "SELECT event_id, 'via', props FROM events UNION ALL SELECT event_id, 'x-user', CAST(user_id AS VARCHAR) FROM events UNION ALL "
    "SELECT event_id, 'X-Stainless-OS', 'Linux' FROM events UNION ALL SELECT event_id, 'x-team', event_type FROM events) "
    "SELECT event_id, name, CASE lower(name) WHEN 'accept-language' THEN 'en-US,en;q=0.9' WHEN 'x-team' THEN 'team' ELSE value END AS value, "
    "CAST(3 AS BIGINT) AS hits FROM h WHERE name <> 'via'",
)
def header_policy(spark, root):
    headers = F.create_map(
        F.lit("Accept-Language"), F.col("event_type"), F.lit("via"), F.col("props"),
        F.lit("x-user"), F.col("user_id").cast("string"), F.lit("X-Stainless-OS"), F.lit("Linux"),
        F.lit("x-team"), F.col("event_type"),
    )
    keep, extra = ["x-stainless-os"], {"x-team": "team"}
    df = table(spark, root, "events").select("event_id", headers.alias("h"))
    hits = F.size(map_policy_hits(F.col("h"), keep, extra)).cast("bigint")
    return df.select(
        "event_id", hits.alias("hits"), F.explode(map_policy(F.col("h"), keep, extra)).alias("name", "value")
    )


@query(
    "pseudonymize_user",
    "SELECT event_id, CASE WHEN event_id % 10 = 0 THEN '{\"device_id\": ' || user_id || ', \"props\": ' || props || '}' "
    "WHEN event_id % 10 = 1 THEN 'device_id=u' || user_id "
    f"ELSE '{{\"device_id\": \"' || {hmac_sql(chr(39) + 'u' + chr(39) + ' || user_id')} || '\", \"props\": ' || props || '}}' END AS json FROM events",
)
def pseudonymize_user(spark, root):
    """Only a string ``device_id`` in parseable JSON is replaced."""
    user = F.col("user_id").cast("string")
    kind = F.col("event_id") % 10
    raw = (
        F.when(kind == 0, F.concat(F.lit('{"device_id": '), user, F.lit(', "props": '), "props", F.lit("}")))
        .when(kind == 1, F.concat(F.lit("device_id=u"), user))
        .otherwise(F.concat(F.lit('{"device_id": "u'), user, F.lit('", "props": '), "props", F.lit("}")))
    )
    df = table(spark, root, "events").select("event_id", raw.alias("raw"))
    return df.select("event_id", pseudonymize_field(F.col("raw"), "device_id", "stable", test_key()).alias("json"))
