"""Span, count and report queries over documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.keys import label
from ..functions.text import line_context, line_of
from ..operators import findings as R
from ..operators.nested import distinct_first, run_statistics
from ..operators.render import render
from ..operators.ruleset import make_rules, pattern_named
from ..operators.spans import candidates, category_counts, gate, redact, working_copy
from ..sources.tables import table, text_units
from .base import (
    AROUND, NO_LOOKS, SECRET_HEX, STD_PATTERNS, STD_RULES, around_ctes, label_sql, quoted, redacted_ctes, span_ctes, query,
    test_key,
)

EMAIL = pattern_named("email")
EMAIL_RX = quoted("(?i)" + EMAIL.regex)
DOCS = "documents"
SPANS = span_ctes(DOCS, "doc_id")
REDACTED = redacted_ctes(DOCS, "doc_id")
LINE = "CAST(s.s - length(replace(substr(d.text, 1, s.s), chr(10), '')) + 1 AS BIGINT)"
WS = r"[\s\x{0b}\x{a0}\x{feff}\x{2028}\x{2029}\p{Zs}]+"
CONTEXT = (
    f"substr(regexp_replace(regexp_replace(string_split(d.text, chr(10))[{LINE}], '^{WS}', ''), '{WS}$', ''), 1, 200)"
)


def docs(spark, root, *extra):
    return text_units(spark, root, "documents", "doc_id", "text", *extra).withColumnRenamed("unit", "doc_id")


def std_findings(spark, root, *extra):
    return R.findings(docs(spark, root, *extra), ["doc_id", *extra], "text", STD_RULES)


@query(
    "email_by_lang",
    f"SELECT lang, 'email' AS category, CAST(sum(len(regexp_extract_all(text, {EMAIL_RX}))) AS BIGINT) AS n "
    f"FROM documents WHERE len(regexp_extract_all(text, {EMAIL_RX})) > 0 GROUP BY lang",
)
def email_by_lang(spark, root):
    return R.unit_counts(docs(spark, root, "lang"), ["lang"], "text", make_rules([EMAIL]))


@query(
    "candidate_spans",
    f"WITH {SPANS} SELECT doc_id, CAST(s AS BIGINT) AS start, CAST(e AS BIGINT) AS stop, category FROM cand",
)
def candidate_spans(spark, root):
    found = F.when(gate(F.col("text"), STD_RULES), candidates(working_copy(F.col("text")), STD_RULES))
    return docs(spark, root).select("doc_id", F.explode(found).alias("c")).select(
        "doc_id", F.col("c.s").cast("bigint").alias("start"), (-F.col("c.ne")).cast("bigint").alias("stop"),
        F.col("c.v").alias("category"),
    )


@query("resolved_spans", f"WITH {SPANS} SELECT doc_id, s AS start, e AS stop, category, value FROM spans")
def resolved_spans(spark, root):
    return std_findings(spark, root).select(
        "doc_id", F.col("start").cast("bigint"), F.col("end").cast("bigint").alias("stop"), "category", "value"
    )


@query(
    "label_values",
    f"WITH {SPANS} SELECT DISTINCT category, value, {label_sql('value', 'category')} AS label FROM spans",
)
def label_values(spark, root):
    pairs = std_findings(spark, root).select("category", "value").distinct()
    return pairs.withColumn("label", label(F.col("value"), F.col("category"), test_key()))


@query("redact_docs", f"WITH {REDACTED} SELECT doc_id, out AS text FROM redacted")
def redact_docs(spark, root):
    return docs(spark, root).select("doc_id", redact(F.col("text"), STD_RULES, test_key()).text.alias("text"))


@query(
    "label_protection",
    f"WITH {REDACTED} SELECT doc_id, 'x secret_key: ' || out AS text, TRUE AS stable FROM redacted WHERE out <> text",
)
def label_protection(spark, root):
    """Already redacted text behind a colliding pattern: labels stay intact."""
    key = test_key()
    once = docs(spark, root).select(
        "doc_id", F.explode(F.array(redact(F.col("text"), STD_RULES, key).text)).alias("once"), "text"
    ).where(F.col("once") != F.col("text"))
    fed = once.select("doc_id", F.concat(F.lit("x secret_key: "), F.col("once")).alias("fed"))
    again = fed.select("doc_id", "fed", redact(F.col("fed"), STD_RULES, key).text.alias("text"))
    return again.select("doc_id", "text", (F.col("text") == F.col("fed")).alias("stable"))


@query(
    "unit_counts",
    f"WITH {SPANS} SELECT doc_id, category, CAST(count(*) AS BIGINT) AS n FROM spans GROUP BY ALL",
)
def unit_counts(spark, root):
    return R.unit_counts(docs(spark, root), ["doc_id"], "text", STD_RULES)


@query(
    "count_maps",
    f"WITH {SPANS}, c AS (SELECT doc_id, category, count(*) AS n FROM spans GROUP BY ALL) "
    "SELECT doc_id, string_agg(category || '=' || n, ' ' ORDER BY category) AS counts FROM c GROUP BY doc_id",
)
def count_maps(spark, root):
    r = docs(spark, root).select("doc_id", redact(F.col("text"), STD_RULES, test_key()).spans.alias("s"))
    m = F.array_sort(F.map_entries(category_counts(F.col("s"))))
    shown = F.array_join(F.transform(m, lambda e: F.concat(e.key, F.lit("="), e.value.cast("string"))), " ")
    return r.select("doc_id", F.explode(F.filter(F.array(shown), lambda x: x != "")).alias("counts"))


@query(
    "scan_totals",
    f"WITH {SPANS}, h AS (SELECT doc_id, count(*) AS n FROM spans GROUP BY 1) "
    "SELECT CAST(count(*) AS BIGINT) AS units, CAST(count(h.n) AS BIGINT) AS units_with, "
    "CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(coalesce(h.n, 0)) AS BIGINT) AS hits "
    "FROM documents d LEFT JOIN h ON h.doc_id = d.doc_id",
)
def scan_totals(spark, root):
    return R.scan_totals(docs(spark, root), "text", STD_RULES)


@query(
    "scan_groups",
    f"WITH {SPANS}, h AS (SELECT doc_id, count(*) AS n FROM spans GROUP BY 1) "
    "SELECT source, CAST(count(*) AS BIGINT) AS units, CAST(count(h.n) AS BIGINT) AS units_with, "
    "CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(coalesce(h.n, 0)) AS BIGINT) AS hits "
    "FROM documents d LEFT JOIN h ON h.doc_id = d.doc_id GROUP BY ROLLUP (source)",
)
def scan_groups(spark, root):
    return R.scan_totals(docs(spark, root, "source"), "text", STD_RULES, ["source"])


@query(
    "scan_by_source_rollup",
    f"WITH {SPANS} SELECT d.source, category, CAST(count(*) AS BIGINT) AS n "
    "FROM spans JOIN documents d USING (doc_id) GROUP BY ROLLUP (d.source, category)",
)
def scan_by_source_rollup(spark, root):
    return R.grouped_counts(docs(spark, root, "source"), "source", "text", STD_RULES)


@query(
    "line_numbers",
    f"WITH {SPANS} SELECT s.doc_id, s.s AS start, {LINE} AS line FROM spans s JOIN documents d USING (doc_id)",
)
def line_numbers(spark, root):
    hits = R.findings(docs(spark, root), ["doc_id", "text"], "text", STD_RULES)
    return hits.select(
        "doc_id", F.col("start").cast("bigint"), line_of(F.col("text"), F.col("start")).cast("bigint").alias("line")
    )


@query(
    "context_lines",
    f"WITH {SPANS} SELECT s.doc_id, s.s AS start, {CONTEXT} AS context FROM spans s JOIN documents d USING (doc_id)",
)
def context_lines(spark, root):
    hits = R.findings(docs(spark, root), ["doc_id", "text"], "text", STD_RULES)
    line = line_of(F.col("text"), F.col("start"))
    return hits.select(
        "doc_id", F.col("start").cast("bigint"), line_context(F.col("text"), line).alias("context")
    )


@query("distinct_first", f"WITH {REDACTED} SELECT doc_id, out AS rendered FROM redacted")
def distinct_first_docs(spark, root):
    done = distinct_first(
        docs(spark, root), "text", "rendered", lambda t: redact(t, STD_RULES, test_key()).text
    )
    return done.select("doc_id", "rendered")


@query(
    "run_statistics",
    f"WITH {SPANS}, u AS (SELECT text, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text), "
    "h AS (SELECT doc_id, count(*) AS n FROM spans GROUP BY 1) "
    "SELECT CAST(sum(copies - 1) AS BIGINT) AS memo_hit, CAST(count(*) AS BIGINT) AS memo_miss, "
    "CAST(sum(length(text)) AS BIGINT) AS walked_chars, CAST(sum(coalesce(n, 0)) AS BIGINT) AS redacted, "
    "CAST(0 AS BIGINT) AS aliased, CAST(0 AS BIGINT) AS normalized "
    "FROM u LEFT JOIN h USING (doc_id)",
)
def run_stats(spark, root):
    return run_statistics(docs(spark, root), "text", lambda t: render(t, STD_RULES, test_key()))


IDENTITY_RULES = make_rules(STD_PATTERNS, aliases=[("thenon", "NAME-A1"), ("erbl", "NAME-B2")])
IDENTITY_SPANS = span_ctes(DOCS, "doc_id", rules=make_rules(STD_PATTERNS))


def _offsets_sql(value: str, category: str) -> str:
    return (
        f"SELECT doc_id, CAST(sum(len(g)) OVER w + (i - 1) * {len(value)} AS BIGINT) AS s, "
        f"'{category}' AS category, '{value}' AS value FROM (SELECT doc_id, unnest(range(1, len(gs))) AS i, "
        f"unnest(gs[1:len(gs) - 1]) AS g FROM (SELECT doc_id, string_split(text, '{value}') AS gs FROM documents)) "
        "WINDOW w AS (PARTITION BY doc_id ORDER BY i)"
    )


ALL_HITS = (
    f"{IDENTITY_SPANS}, hits AS (SELECT doc_id, s, category, value FROM spans UNION ALL "
    f"{_offsets_sql('thenon', 'identity')} UNION ALL {_offsets_sql('erbl', 'identity')} "
    f"UNION ALL {_offsets_sql('tion', 'timezone')})"
)


def all_hits(spark, root, context=False):
    """Every kind of finding; a frequent string stands in for the local offset."""
    return R.detailed_findings(docs(spark, root), ["doc_id"], "text", IDENTITY_RULES, "tion", context)


@query(
    "findings_table",
    f"WITH {ALL_HITS} SELECT s.doc_id, s.s AS off, {LINE} AS line, s.category, s.value, {CONTEXT} AS context "
    "FROM hits s JOIN documents d USING (doc_id)",
)
def findings_table(spark, root):
    hits = all_hits(spark, root, context=True)
    return hits.withColumns({"off": F.col("off").cast("bigint"), "line": F.col("line").cast("bigint")})


@query(
    "category_totals",
    f"WITH {ALL_HITS} SELECT coalesce(category, 'TOTAL') AS category, CAST(count(*) AS BIGINT) AS n "
    "FROM hits GROUP BY ROLLUP (category)",
)
def category_totals(spark, root):
    return R.category_totals(all_hits(spark, root).select("category"))


@query(
    "severity_first",
    f"WITH {ALL_HITS}, u AS (SELECT doc_id, CAST(count(*) AS BIGINT) AS n, "
    "bool_or(category IN ('identity', 'personal')) AS severe FROM hits GROUP BY doc_id) "
    "SELECT * FROM u ORDER BY severe DESC, n DESC, doc_id",
)
def severity_first(spark, root):
    hits = all_hits(spark, root).select("doc_id", "category")
    return R.severity_order(hits, ["doc_id"])


@query(
    "publish_gate",
    f"WITH {ALL_HITS}, p AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1), "
    "w AS (SELECT unnest(['identity', 'email', 'personal']) AS category), "
    "g AS (SELECT category, count(*) AS n FROM hits WHERE doc_id IN (SELECT doc_id FROM p) GROUP BY category) "
    "SELECT category, CAST(coalesce(n, 0) AS BIGINT) AS n, CASE WHEN coalesce(n, 0) > 0 THEN 'FAILED' ELSE 'PASSED' END AS verdict "
    "FROM w LEFT JOIN g USING (category)",
)
def publish_gate(spark, root):
    published = table(spark, root, "labels").where("quality = 1")
    return R.publish_gate(all_hits(spark, root), published, ["doc_id"], ["identity", "email", "personal"])


@query(
    "tracked_split",
    f"WITH {SPANS}, p AS (SELECT DISTINCT doc_id FROM labels), u AS (SELECT doc_id, count(*) AS n FROM spans GROUP BY 1) "
    "SELECT p.doc_id IS NOT NULL AS published, CAST(sum(n) AS BIGINT) AS hits, CAST(count(*) AS BIGINT) AS units "
    "FROM u LEFT JOIN p ON p.doc_id = u.doc_id GROUP BY 1",
)
def tracked_split(spark, root):
    return R.published_split(std_findings(spark, root), table(spark, root, "labels"), ["doc_id"])


@query(
    "publish_set_only",
    f"WITH {SPANS} SELECT doc_id, s AS start, category FROM spans WHERE doc_id IN (SELECT doc_id FROM labels)",
)
def publish_set_only(spark, root):
    from ..sources.files import only_published

    kept = only_published(docs(spark, root), table(spark, root, "labels"), ["doc_id"])
    hits = R.findings(kept, ["doc_id"], "text", STD_RULES)
    return hits.select("doc_id", F.col("start").cast("bigint"), "category")


@query(
    "change_log",
    f"WITH {SPANS} SELECT s.doc_id, {LINE} AS line, s.category, s.value AS before, "
    f"{label_sql('s.value', 's.category')} AS after FROM spans s JOIN documents d USING (doc_id)",
)
def change_log(spark, root):
    log = R.change_log(docs(spark, root), ["doc_id"], "text", STD_RULES, test_key())
    return log.withColumn("line", F.col("line").cast("bigint"))


@query(
    "report_lines",
    f"WITH {ALL_HITS}, x AS (SELECT s.*, {LINE} AS line, {CONTEXT} AS context FROM hits s JOIN documents d USING (doc_id)), "
    "u AS (SELECT doc_id, count(*) AS n, bool_or(category IN ('identity', 'personal')) AS severe FROM hits GROUP BY doc_id) "
    "SELECT doc_id, CAST(0 AS BIGINT) AS off, doc_id || '   (' || n || CASE WHEN n = 1 THEN ' occurrence)' ELSE ' occurrences)' END || "
    "CASE WHEN severe THEN '  [severe]' ELSE '' END AS line_text FROM u UNION ALL "
    "SELECT doc_id, s + 1, '  line ' || lpad(CAST(line AS VARCHAR), 6, ' ') || '  [' || category || ']  ' || value || "
    "CASE WHEN context <> '' AND context <> value THEN chr(10) || '              | ' || context ELSE '' END FROM x",
)
def report_lines(spark, root):
    lines = R.report_lines(all_hits(spark, root, context=True), "doc_id")
    return lines.select("doc_id", F.col("off").cast("bigint"), "line_text")


@query(
    "audit_lines",
    f"WITH {SPANS}, c AS (SELECT d.source, category, count(*) AS n FROM spans JOIN documents d USING (doc_id) GROUP BY ALL), "
    "w AS (SELECT source, sum(length(text)) AS chars FROM documents GROUP BY source), "
    "l AS (SELECT source, string_agg(category || '=' || n, ' ' ORDER BY category) AS cats FROM c GROUP BY source) "
    "SELECT w.source, 'walked=' || printf('%.1f', round(chars / 1024.0, 1)) || 'KB | ' || coalesce(cats, 'redacted=none') || ' aliased=0' AS line "
    "FROM w LEFT JOIN l ON l.source = w.source",
)
def audit_lines(spark, root):
    counts = R._row_counts(docs(spark, root, "source"), ["source", "doc_id"], "text", STD_RULES)
    per_cat = counts.groupBy("source", "category").agg(
        F.count(F.lit(1)).alias("n"),
    )
    walked = table(spark, root, "documents").groupBy("source").agg(F.sum(F.length("text")).alias("chars"))
    # At most one entry per category and source.
    maps = per_cat.where("category IS NOT NULL").groupBy("source").agg(
        F.map_from_entries(F.collect_list(F.struct("category", "n"))).alias("counts")
    )
    joined = walked.join(maps, "source", "left")
    empty = F.create_map().cast("map<string,bigint>")
    return joined.select(
        "source",
        R.audit_line(F.coalesce("counts", empty), F.col("chars"), F.lit(0)).alias("line"),
    )


def _profile_sql() -> str:
    ctes, counts = [], []
    for i, p in enumerate(STD_PATTERNS):
        flag = "(?i)" if p.insensitive else ""
        if p.name in AROUND:
            ctes.append(around_ctes(i, DOCS, "doc_id", "text", flag, [], [(0, p.name, AROUND[p.name])]))
            counts.append(f"SELECT '{p.name}' AS name, count(*) AS k FROM d{i} GROUP BY doc_id UNION ALL SELECT '{p.name}', 0")
        else:
            rx = quoted(flag + NO_LOOKS.get(p.name, p.regex))
            counts.append(f"SELECT '{p.name}' AS name, len(regexp_extract_all(text, {rx})) AS k FROM documents")
    return (
        "WITH " + ", ".join(ctes) + ", n AS (" + " UNION ALL ".join(counts)
        + ") SELECT name, CAST(sum(k) AS BIGINT) AS hits, CAST(count(*) FILTER (k > 0) AS BIGINT) AS units, "
        "CASE WHEN sum(k) = 0 THEN 'nothing matches in this corpus' ELSE 'look at the matches first' END AS verdict FROM n GROUP BY name"
    )


@query("pattern_corpus_profile", _profile_sql())
def pattern_corpus_profile(spark, root):
    return R.pattern_profile(docs(spark, root), "text", STD_PATTERNS)
