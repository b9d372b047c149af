"""Text units derived from ``orders``: one note per order, each kind of value in turn.

The driver's texts hold only a few kinds of personal data, so detector queries
also read these notes, which grow with the table.  The same template is filled
by a Spark expression and by SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import dealt, table

# {h} 32 hex digits, {H} the same in upper case, {h2}/{h4} their first digits,
# {d8}/{d4}/{d3} decimal digits, {n} 0..299, {m} 0..12
TEMPLATES = [
    "mail user{d4}@Host{d3}.example.com or USER{d3}@x.org now",
    "call +1 415 {d3} {d4} or ({d3}) {d3}-{d4}, not 1.{d3} {d3} {d4}",
    "see https://github.com/org-{d4}/repo.{d3} or git@gitlab.org:team-{d3}/app-{d4}",
    "from 203.0.113.{n} via 10.0.0.{n} and 172.{n}.3.4 8.8.{n}.8",
    "at 2001:db8:{h4}:0:0:8a2e:370:{h4} and {h4}:{h4}::1 on 14:22:05",
    "nic 3c:22:{h2}:{h2}:1d:4e and 3C-22-{h2}-{h2}-1D-4E",
    "key AKIA{H16} kept",
    "use ghp_{h}{h4} here",
    "use xoxb-{d8}-{h} here",
    "-----BEGIN RSA PRIVATE KEY----- {h}",
    "jwt eyJ{h}.{h}.{h16} sent",
    "Authorization: Bearer {h}.{h4}==",
    'API_KEY = "{h}" and client-secret:{h16}',
    "sk-proj-{h} or sk-{h}",
    "sk-ant-{h}{h4}",
    "pk_live_{h16} and rk_test_{h}",
    "AIza{h}abc fine",
    "SG.{h16}.{h} mail",
    "npm_{h}{h4} pushed",
    "hf_{h} pulled",
    "postgresql://svc:{h16}@db.example.com/x mongodb+srv://a:{d8}@m",
    "card 4{d8}{d4}{d3} or 37{d8}{d4}1",
    "iban DE{d2}{d8}{d8} pays",
    "id {d8}{d4} or {d4} {d4} {d4}",
    "pan ABCDE{d4}F ok",
    "ssn {d3}-{d2}-{d4} or 900-12-{d4}",
    "commit at 2026-{m2}-17 21:08:56 +0530 and 2026-01-02T03:04:05.{d3}-07:00 in TZ +0530 x",
    "Windows 11 Pro 10.0.{d4} LANG=pt_PT.UTF-8 TZ=Europe/Lisbon",
    "C:\\Users\\CLERK{d2}\\work and c:/users/clerk{d2}/x on DESK-{d3}",
    "http://host/_dash?t={h}&x=1 [warn] egress REFUSED for 1.2.3.{n}",
    "order note without anything, ref {d4}",
]

_KEY = "o_orderkey"


def _spark_parts() -> dict[str, Column]:
    h = F.md5(F.col(_KEY).cast("string"))
    d8 = F.lpad(((F.col(_KEY) * 7919 + 12345) % 100000000).cast("string"), 8, "0")
    return {
        "h": h, "h16": F.substring(h, 1, 16), "H16": F.upper(F.substring(h, 1, 16)),
        "h2": F.substring(h, 1, 2), "h4": F.substring(h, 1, 4),
        "d8": d8, "d4": F.substring(d8, 5, 4), "d3": F.substring(d8, 6, 3), "d2": F.substring(d8, 7, 2),
        "n": (F.col(_KEY) % 300).cast("string"), "m2": F.lpad((F.col(_KEY) % 14).cast("string"), 2, "0"),
    }


_SQL_H = f"md5(CAST({_KEY} AS VARCHAR))"
_SQL_D = f"lpad(CAST(({_KEY} * 7919 + 12345) % 100000000 AS VARCHAR), 8, '0')"
_SQL_PARTS = {
    "h": _SQL_H, "h16": f"substr({_SQL_H}, 1, 16)", "H16": f"upper(substr({_SQL_H}, 1, 16))",
    "h2": f"substr({_SQL_H}, 1, 2)", "h4": f"substr({_SQL_H}, 1, 4)",
    "d8": _SQL_D, "d4": f"substr({_SQL_D}, 5, 4)", "d3": f"substr({_SQL_D}, 6, 3)", "d2": f"substr({_SQL_D}, 7, 2)",
    "n": f"CAST({_KEY} % 300 AS VARCHAR)", "m2": f"lpad(CAST({_KEY} % 14 AS VARCHAR), 2, '0')",
}


def _pieces(template: str) -> list[tuple[bool, str]]:
    out, rest = [], template
    while "{" in rest:
        head, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        if head:
            out.append((False, head))
        out.append((True, name))
    if rest:
        out.append((False, rest))
    return out


def filled(template: str) -> Column:
    """A template filled from the order's key."""
    parts = _spark_parts()
    return F.concat(*[parts[x] if var else F.lit(x) for var, x in _pieces(template)])


def filled_sql(template: str) -> str:
    return " || ".join(_SQL_PARTS[x] if var else "'" + x.replace("'", "''") + "'" for var, x in _pieces(template))


def notes(spark: SparkSession, root: str, ts: bool = False) -> DataFrame:
    """``unit, text`` (and ``ts``) for every order."""
    kind = F.col(_KEY) % len(TEMPLATES)
    text = None
    for i, template in enumerate(TEMPLATES):
        value = filled(template)
        text = F.when(kind == i, value) if text is None else text.when(kind == i, value)
    orders = dealt(table(spark, root, "orders").select(_KEY, *(["o_orderdate"] if ts else [])))
    extra = [F.col("o_orderdate").alias("ts")] if ts else []
    return orders.select(F.col(_KEY).alias("unit"), text.alias("text"), *extra)


def _sql_text() -> str:
    cases = []
    for i, template in enumerate(TEMPLATES):
        cases.append(f"WHEN {_KEY} % {len(TEMPLATES)} = {i} THEN {filled_sql(template)}")
    return "CASE " + " ".join(cases) + " END"


NOTES_SQL = f"notes AS (SELECT {_KEY} AS unit, {_sql_text()} AS text, o_orderdate AS ts FROM orders)"


def all_text(spark: SparkSession, root: str) -> DataFrame:
    """Notes, documents and pages as one set of units ``(src, unit, text)``."""
    docs = (table(spark, root, "documents").select(
        F.lit("documents").alias("src"), F.col("doc_id").alias("unit"), "text"))
    pages = (table(spark, root, "pages").select(
        F.lit("pages").alias("src"), F.col("page_id").alias("unit"), F.col("html").alias("text")))
    made = notes(spark, root).select(F.lit("notes").alias("src"), "unit", "text")
    return docs.unionByName(pages).unionByName(made)


ALL_TEXT_SQL = (
    NOTES_SQL
    + ", all_text AS (SELECT 'documents' AS src, doc_id AS unit, text FROM documents "
    "UNION ALL SELECT 'pages', page_id, html FROM pages UNION ALL SELECT 'notes', unit, text FROM notes)"
)
