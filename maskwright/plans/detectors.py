"""Detector queries: every shipped pattern on its own, over all text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import catalog
from ..functions.text import count_substring, mask_tokens, scrub_addresses
from ..operators.findings import findings
from ..operators.ruleset import all_patterns, make_rules, pattern_named
from ..sources.tables import table
from .base import SECRET_HEX, query, quoted
from .notes import ALL_TEXT_SQL, NOTES_SQL, all_text, notes

_OUT = "SELECT src, unit, value, CAST(count(*) AS BIGINT) AS n FROM hits GROUP BY src, unit, value"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
# A mark after every character outside the class stands in for the lookbehind;
# the character that follows a match is consumed, its mark is left for the next.
_M = "\x01"


def _marked_sql(outside: str, pattern: str, group: int = 1) -> str:
    marked = f"regexp_replace(text, '([{outside}])', '\\1' || chr(1), 'g')"
    return f"replace(unnest(regexp_extract_all({marked}, {pattern}, {group})), chr(1), '')"


def _sql(values: str, where: str = "TRUE") -> str:
    return (
        f"WITH {ALL_TEXT_SQL}, raw AS (SELECT src, unit, {values} AS value FROM all_text), "
        f"hits AS (SELECT * FROM raw WHERE {where}) {_OUT}"
    )


def _rx(pattern: str) -> str:
    """A SQL literal in which the mark is spelled ``chr(1)``."""
    return " || chr(1) || ".join(quoted(part) for part in pattern.split(_M))


_SEP = f"(?:[ -]{_M}|\\.)"
_PHONE = (
    f"(?:^|{_M})((?:\\+{_M}\\d{{1,3}}{_SEP}?)?(?:\\({_M}\\d{{3}}\\){_M}(?:[ \\t\\n\\x0b\\f\\r\\x{{a0}}]{_M})?|\\d{{3}}{_SEP})"
    f"\\d{{3}}{_SEP}\\d{{4}})(?:[^\\d.]|$)"
)
_IPV6 = (
    f"(?:^|{_M})((?i:(?:[0-9a-f]{{1,4}}:){{7}}[0-9a-f]{{1,4}}|(?:[0-9a-f]{{1,4}}:){{2,7}}:"
    f"(?:[0-9a-f]{{1,4}}(?::[0-9a-f]{{1,4}})*)?))(?:[^\\w:]|$)"
)
_SPECIAL = {
    "phone": _sql(_marked_sql(r"^\d.", _rx(_PHONE))),
    "ip": _sql(
        _marked_sql(r"^\d.", _rx(f"(?:^|{_M})((?:{_OCTET}\\.){{3}}{_OCTET})(?:[^\\d.]|$)")),
        r"NOT regexp_matches(value, '^(?:10\.|127\.|0\.|169\.254\.|192\.168\.|172\.(?:1[6-9]|2\d|3[01])\.|255\.)')",
    ),
    "ipv6": _sql(_marked_sql(r"^\w:", _rx(_IPV6))),
    "mac": _sql(
        _marked_sql(r"^\w:-", _rx(f"(?:^|{_M})((?i:(?:[0-9a-f]{{2}}[:-]){{5}}[0-9a-f]{{2}}))(?:[^\\w:-]|$)"))
    ),
    "git-org": _sql(
        r"unnest(regexp_extract_all(text, '(?:github|gitlab|bitbucket)\.(?:com|org)[/:]([A-Za-z0-9._-]+)', 1))"
    ),
    "git-repo": _sql(
        r"unnest(regexp_extract_all(text, '(?:github|gitlab|bitbucket)\.(?:com|org)[/:][A-Za-z0-9._-]{1,64}/([A-Za-z0-9._-]+)', 1))"
    ),
    "us-ssn": _sql(
        r"unnest(regexp_extract_all(text, '\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b'))",
        "left(value, 3) NOT IN ('000', '666') AND left(value, 1) <> '9' "
        "AND substr(value, 5, 2) <> '00' AND right(value, 4) <> '0000'",
    ),
}


def _plain_sql(pattern) -> str:
    flag = "(?i)" if pattern.insensitive else ""
    return _sql(f"unnest(regexp_extract_all(text, {quoted(flag + pattern.regex)}))")


def _register(pattern):
    name = "detect_" + pattern.name.replace("-", "_")
    sql = _SPECIAL.get(pattern.name) or _plain_sql(pattern)

    @query(name, sql)
    def run(spark, root, pattern=pattern):
        hits = findings(all_text(spark, root), ["src", "unit"], "text", make_rules([pattern]))
        return hits.groupBy("src", "unit", "value").agg(F.count(F.lit(1)).alias("n"))


for _p in all_patterns() + [SECRET_HEX]:
    _register(_p)


@query(
    "identity_counts",
    "SELECT doc_id, CAST((length(text) - length(replace(text, 'thenon', ''))) / 6 AS BIGINT) AS identity, "
    "CAST((length(text) - length(replace(text, 'erbl', ''))) / 4 AS BIGINT) AS other FROM documents "
    "WHERE contains(text, 'thenon') OR contains(text, 'erbl')",
)
def identity_counts(spark, root):
    docs = table(spark, root, "documents")
    return (
        docs.where(F.contains("text", F.lit("thenon")) | F.contains("text", F.lit("erbl")))
        .select(
            "doc_id",
            count_substring(F.col("text"), F.lit("thenon")).cast("bigint").alias("identity"),
            count_substring(F.col("text"), F.lit("erbl")).cast("bigint").alias("other"),
        )
    )


@query(
    "timezone_counts",
    f"WITH {NOTES_SQL} SELECT unit, CAST((length(text) - length(replace(text, '+0530', ''))) / 5 AS BIGINT) AS n "
    "FROM notes WHERE contains(text, '+0530')",
)
def timezone_counts(spark, root):
    return notes(spark, root).where(F.contains("text", F.lit("+0530"))).select(
        "unit", count_substring(F.col("text"), F.lit("+0530")).cast("bigint").alias("n")
    )


@query(
    "address_scrub",
    f"WITH {ALL_TEXT_SQL} SELECT src, unit, "
    f"regexp_replace(regexp_replace(text, {quoted(catalog.IPV4_ANY)}, {quoted(catalog.ADDRESS_MASK)}, 'g'), "
    f"{quoted('(?i)' + catalog.IPV6_ANY)}, {quoted(catalog.ADDRESS_MASK)}, 'g') AS text FROM all_text",
)
def address_scrub(spark, root):
    return all_text(spark, root).select("src", "unit", scrub_addresses(F.col("text")).alias("text"))


@query(
    "token_mask",
    f"WITH {NOTES_SQL}, u AS (SELECT unit, text FROM notes UNION ALL SELECT page_id, url FROM pages) "
    f"SELECT unit, regexp_replace(text, {quoted('(?i)' + catalog.LOG_TOKEN)}, '\\1[redacted]', 'g') AS text FROM u",
)
def token_mask(spark, root):
    urls = table(spark, root, "pages").select(F.col("page_id").alias("unit"), F.col("url").alias("text"))
    return notes(spark, root).unionByName(urls).select("unit", mask_tokens(F.col("text")).alias("text"))
