"""Rule-table queries.  The rules are derived from the business tables, so they grow with them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import catalog
from ..operators import findings as R
from ..operators import rules as C
from ..operators.ruleset import make_rules
from ..sources.tables import table
from .base import STD_RULES, query, quoted, span_ctes
from .notes import NOTES_SQL, notes
from .scans import docs

_LIT = (
    "CASE c_custkey % 6 WHEN 0 THEN '  ' || c_name || ' ' WHEN 1 THEN 'ab' WHEN 2 THEN 'YOUR full name' "
    "WHEN 3 THEN 'User_' || c_custkey WHEN 4 THEN c_mktsegment ELSE 'é' || c_custkey END"
)
_BOUND = "CASE c_custkey % 5 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END"
_PAT_NAME = "CASE WHEN p_size < 3 THEN NULL ELSE 'pat-' || p_partkey % 700 END"
_PAT = (
    "CASE p_partkey % 8 WHEN 0 THEN '\\b' || p_brand || '-[0-9]{4}\\b' WHEN 1 THEN '^(a+)+$' WHEN 2 THEN '[A-Za-z]+@x' "
    "WHEN 3 THEN NULL WHEN 4 THEN '(?:x|y){1,8}z' WHEN 5 THEN '(?:[a-z]*)*q' WHEN 6 THEN p_type || '\\d{2,}' ELSE '\\w*' || p_name END"
)
_REAL = "CASE s_suppkey % 4 WHEN 0 THEN 'C:\\Users\\' || s_name WHEN 1 THEN 'ab' WHEN 2 THEN s_name ELSE 'MACHINE-A1' END"
_ALIAS = (
    "CASE s_suppkey % 7 WHEN 0 THEN 'host' WHEN 1 THEN ' Server ' WHEN 2 THEN 'Zed' WHEN 3 THEN '' "
    "WHEN 4 THEN 'MACHINE-A1' WHEN 5 THEN 'C:\\Users\\anon' ELSE 'longplainword' END"
)
LIT_SQL = f"lits AS (SELECT {_LIT} AS value, {_BOUND} AS boundary FROM customer)"
PAT_SQL = f"pats AS (SELECT p_partkey AS position, {_PAT_NAME} AS name, {_PAT} AS regex, CASE p_partkey % 2 WHEN 0 THEN 'g' ELSE 'gi' END AS flags, p_size FROM part)"
ALI_SQL = f"alis AS (SELECT {_REAL} AS real, {_ALIAS} AS alias FROM supplier)"
_PLACE = ", ".join(quoted(x) for x in catalog.PLACEHOLDER_LITERALS)
KEPT_SQL = (
    f"{LIT_SQL}, kept AS (SELECT trim(value) AS value, coalesce(boundary, regexp_full_match(trim(value), '[\\p{{L}}\\p{{N}}_]+')) AS boundary "
    f"FROM lits WHERE length(trim(value)) >= 3 AND lower(trim(value)) NOT IN ({_PLACE}))"
)
VERDICT = (
    f"CASE WHEN regexp_matches(regex, {quoted(C.NESTED_REPEAT)}) THEN 'nested unbounded repeat' "
    f"WHEN regexp_matches(regex, {quoted(C.LEADING_REPEAT)}) THEN 'starts with an unbounded repeat' END"
)
_RISKY = ", ".join(quoted(x) for x in catalog.RISKY_ALIASES)
RISK = (
    f"CASE WHEN alias = '' THEN 'empty' WHEN lower(trim(alias)) IN ({_RISKY}) THEN 'everyday name: ' || trim(alias) "
    "WHEN length(trim(alias)) < 8 AND regexp_full_match(trim(alias), '[A-Za-z]+') THEN 'plain word of ' || length(trim(alias)) || ' letters: ' || trim(alias) END"
)


def _expr(sql: str):
    # The derived values are plain CASE expressions; Spark needs its own escapes.
    return F.expr(sql.replace("\\", "\\\\"))


def literals(spark, root):
    return table(spark, root, "customer").select(_expr(_LIT).alias("value"), _expr(_BOUND).alias("boundary"))


def patterns(spark, root):
    return table(spark, root, "part").select(
        F.col("p_partkey").alias("position"), _expr(_PAT_NAME).alias("name"), _expr(_PAT).alias("regex"),
        F.when(F.col("p_partkey") % 2 == 0, "g").otherwise("gi").alias("flags"), "p_size",
    )


def aliases(spark, root):
    return table(spark, root, "supplier").select(_expr(_REAL).alias("real"), _expr(_ALIAS).alias("alias"))


@query("literal_normalization", f"WITH {KEPT_SQL} SELECT value, boundary FROM kept")
def literal_normalization(spark, root):
    return C.literal_rules(literals(spark, root))


@query(
    "boundary_decision",
    f"WITH {KEPT_SQL} SELECT boundary, CAST(count(*) AS BIGINT) AS n FROM kept GROUP BY boundary",
)
def boundary_decision(spark, root):
    return C.literal_rules(literals(spark, root)).groupBy("boundary").agg(F.count(F.lit(1)).alias("n"))


# Runs of copies: each edge of a run that touches a word character costs one copy.
_RUNS = (
    "WITH r AS (SELECT doc_id, regexp_extract_all(text, '(?i)(?:{v})+') AS ms, string_split_regex(text, '(?i)(?:{v})+') AS gs FROM documents), "
    "u AS (SELECT doc_id, unnest(ms) AS m, unnest(gs[1:len(ms)]) AS before, unnest(gs[2:len(ms) + 1]) AS after FROM r WHERE len(ms) > 0), "
    "c AS (SELECT doc_id, greatest(length(m) // {n} - CASE WHEN regexp_matches(before, '[\\p{{L}}\\p{{N}}_]$') THEN 1 ELSE 0 END "
    "- CASE WHEN regexp_matches(after, '^[\\p{{L}}\\p{{N}}_]') THEN 1 ELSE 0 END, 0) AS n FROM u) "
    "SELECT doc_id, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY doc_id HAVING sum(n) > 0"
)


@query("edge_boundary", _RUNS.format(v="the", n=3))
def edge_boundary(spark, root):
    """A guarded literal: whole words and runs of copies of itself, nothing inside words."""
    hits = R.findings(docs(spark, root), ["doc_id"], "text", make_rules(literals=["the"]))
    return hits.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "alternation_priority",
    f"WITH {NOTES_SQL}, {span_ctes('notes', 'unit')} SELECT category, left(value, 7) AS head, CAST(count(*) AS BIGINT) AS n FROM spans GROUP BY ALL",
)
def alternation_priority(spark, root):
    """In a bucket the first listed alternative wins: ``sk-ant-`` is an openai-key here."""
    hits = R.findings(notes(spark, root), ["unit"], "text", STD_RULES)
    return hits.groupBy("category", F.substring("value", 1, 7).alias("head")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "rule_statistics",
    f"WITH {KEPT_SQL}, {PAT_SQL}, ok AS (SELECT * FROM pats WHERE regex IS NOT NULL AND {VERDICT} IS NULL) "
    "SELECT CAST((SELECT count(*) FROM kept) AS BIGINT) AS literals, CAST((SELECT count(*) FROM ok) AS BIGINT) AS patterns, "
    "CAST((SELECT count(DISTINCT name) FROM ok) + 1 AS BIGINT) AS categories",
)
def rule_statistics(spark, root):
    return C.rule_statistics(literals(spark, root), patterns(spark, root))


@query(
    "pattern_lint",
    f"WITH {PAT_SQL} SELECT position, name, regex, {VERDICT} AS verdict FROM pats WHERE regex IS NOT NULL",
)
def pattern_lint(spark, root):
    return C.linted_patterns(patterns(spark, root)).select("position", "name", "regex", "verdict")


@query(
    "disabled_patterns",
    f"WITH {PAT_SQL} SELECT position, name, {VERDICT} AS verdict FROM pats WHERE regex IS NOT NULL AND {VERDICT} IS NOT NULL",
)
def disabled_patterns(spark, root):
    return C.disabled_patterns(patterns(spark, root)).select("position", "name", "verdict")


@query(
    "pattern_audit",
    f"WITH {PAT_SQL} SELECT CAST(count(*) AS BIGINT) AS configured, CAST(count({VERDICT}) AS BIGINT) AS unsafe FROM pats",
)
def pattern_audit(spark, root):
    return C.pattern_audit(patterns(spark, root))


_ADOPT = (
    f"{PAT_SQL}, ex AS (SELECT * FROM pats WHERE p_size > 25), inc AS (SELECT * FROM pats WHERE p_size <= 25 AND regex IS NOT NULL), "
    "o AS (SELECT position, name, regex, CASE WHEN name IN (SELECT name FROM ex WHERE name IS NOT NULL) THEN 'name already present' "
    "WHEN regex IN (SELECT regex FROM ex WHERE regex IS NOT NULL) THEN 'identical regex already present' "
    f"ELSE {VERDICT} END AS reason, {VERDICT} AS verdict FROM inc), "
    "p AS (SELECT *, CASE WHEN reason LIKE '%already present' THEN 'skipped' WHEN verdict IS NOT NULL THEN 'rejected' ELSE 'added' END AS outcome FROM o)"
)


@query("adopt_patterns", f"WITH {_ADOPT} SELECT position, name, outcome, reason FROM p")
def adopt_patterns(spark, root):
    pats = patterns(spark, root)
    done = C.adopt_patterns(pats.where("p_size > 25"), pats.where("p_size <= 25"))
    return done.select("position", "name", "outcome", "reason")


@query(
    "adopted_patterns",
    f"WITH {_ADOPT} SELECT position, name, regex FROM ex UNION ALL SELECT position, name, regex FROM p WHERE outcome = 'added'",
)
def adopted_patterns(spark, root):
    pats = patterns(spark, root)
    existing = pats.where("p_size > 25").select("position", "name", "regex")
    return C.adopted(existing, C.adopt_patterns(existing, pats.where("p_size <= 25")))


@query(
    "alias_filter",
    f"WITH {ALI_SQL} SELECT real, alias FROM alis WHERE length(trim(real)) >= 3 AND length(trim(alias)) >= 1",
)
def alias_filter(spark, root):
    return C.alias_rules(aliases(spark, root))


@query("alias_risk", f"WITH {ALI_SQL} SELECT real, alias, {RISK} AS risk FROM alis")
def alias_risk(spark, root):
    return aliases(spark, root).withColumn("risk", C.alias_risk(F.col("alias")))


_DEPTH = "len(string_split_regex({c}, '[\\\\/]+'))"


@query(
    "alias_segments",
    f"WITH {ALI_SQL} SELECT real, alias, {_DEPTH.format(c='real')} <> {_DEPTH.format(c='alias')} AS mismatch FROM alis",
)
def alias_segments(spark, root):
    return aliases(spark, root).withColumn("mismatch", C.segment_mismatch(F.col("real"), F.col("alias")))


@query(
    "config_errors",
    f"WITH {PAT_SQL}, {ALI_SQL}, bad AS (SELECT coalesce(name, '?') AS name, {VERDICT} AS v FROM pats WHERE regex IS NOT NULL AND {VERDICT} IS NOT NULL) "
    "SELECT 'error' AS severity, 'patterns' AS section, name, v AS message FROM bad UNION ALL "
    "SELECT 'warning', 'patterns', name, 'disabled: ' || v FROM bad UNION ALL "
    f"SELECT 'error', 'aliases', alias, {RISK} FROM alis WHERE {RISK} IS NOT NULL UNION ALL "
    "SELECT 'error', 'aliases', alias, 'real and alias must not be identical' FROM alis WHERE real = alias UNION ALL "
    "SELECT 'warning', 'aliases', alias, 'different number of path segments' FROM alis WHERE length(trim(real)) >= 3 AND length(trim(alias)) >= 1 "
    f"AND {_DEPTH.format(c='real')} <> {_DEPTH.format(c='alias')}",
)
def config_errors(spark, root):
    return C.config_findings(patterns(spark, root), aliases(spark, root))


@query(
    "config_masking",
    f"WITH {LIT_SQL}, {ALI_SQL} SELECT 'literal' AS section, '***' AS value, CAST(length(value) AS BIGINT) AS length, NULL AS alias FROM lits "
    "UNION ALL SELECT 'alias', '***', length(real), alias FROM alis",
)
def config_masking(spark, root):
    lits = C.masked_literals(literals(spark, root)).select(
        F.lit("literal").alias("section"), "value", F.col("length").cast("bigint").alias("length"),
        F.lit(None).cast("string").alias("alias"),
    )
    als = C.masked_aliases(aliases(spark, root)).select(
        F.lit("alias").alias("section"), F.col("real").alias("value"),
        F.col("real_length").cast("bigint").alias("length"), "alias",
    )
    return lits.unionByName(als)


def _lane(i: int) -> str:
    return f"CAST(sum(CAST('0x' || substr(h, {1 + 8 * i}, 8) AS BIGINT)) AS VARCHAR)"


QUOTED = {name: f"'{name}'" for name in ("literals", "patterns", "aliases")}


def _framed(*fields: str) -> str:
    texts = [f"CAST({f} AS VARCHAR)" for f in fields]
    return " || ".join(f"coalesce(length({t}) || ':' || {t}, 'n')" for t in texts)


@query(
    "rules_fingerprint",
    f"WITH {LIT_SQL}, {PAT_SQL}, {ALI_SQL}, h AS (SELECT sha256({_framed(QUOTED['literals'], 'value', 'boundary')}) AS h FROM lits "
    f"UNION ALL SELECT sha256({_framed(QUOTED['patterns'], 'position', 'name', 'regex', 'flags')}) FROM pats "
    f"UNION ALL SELECT sha256({_framed(QUOTED['aliases'], 'real', 'alias')}) FROM alis) "
    f"SELECT sha256(count(*) || ':' || {_lane(0)} || ':' || {_lane(1)} || ':' || {_lane(2)} || ':' || {_lane(3)}) AS fingerprint FROM h",
)
def rules_fingerprint(spark, root):
    return C.fingerprint(
        {
            "literals": literals(spark, root),
            "patterns": patterns(spark, root).drop("p_size"),
            "aliases": aliases(spark, root),
        }
    )
