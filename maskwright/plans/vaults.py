"""Vault, resolution and edit queries over the order notes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.keys import label
from ..functions.text import title_case
from ..operators import resolve as X
from ..operators import vault as V
from ..operators.spans import redact
from ..sources.tables import stored, table
from .base import STD_RULES, label_sql, query, quoted, redacted_ctes, span_ctes, test_key
from .notes import NOTES_SQL, notes

SPANS = f"{NOTES_SQL}, {span_ctes('notes', 'unit')}"
VAULT = (
    f"{SPANS}, vault AS (SELECT {label_sql('value', 'category')} AS label, arg_max(value, n.ts) AS value, "
    "max(n.ts) AS last_seen FROM spans JOIN notes n USING (unit) GROUP BY 1)"
)
REDACTED_VAULT = VAULT.replace(span_ctes("notes", "unit"), redacted_ctes("notes", "unit"))


def entries(spark, root):
    return V.vault_entries(notes(spark, root, ts=True), "text", "ts", STD_RULES, test_key())


def vault(spark, root):
    return V.build(entries(spark, root))


def clock(spark, root):
    """The run clock is the newest order, never the wall clock."""
    return table(spark, root, "orders").agg(F.max("o_orderdate").alias("now")).scalar()


def redacted_notes(spark, root):
    """Redacted notes as the stored table that resolution jobs start from, ``unit, ts, r``: one pass for texts and vault."""
    done = notes(spark, root, ts=True).select("unit", "ts", redact(F.col("text"), STD_RULES, test_key()).alias("r"))
    return stored(done, "redacted-notes")


def shown(done):
    return done.select("unit", F.col("r.text").alias("text"))


def vault_of(done):
    return V.build(V.span_entries(done, F.col("r.spans"), "ts"))


@query("vault_build", f"WITH {VAULT} SELECT label, value, CAST(last_seen AS VARCHAR) AS last_seen FROM vault")
def vault_build(spark, root):
    return vault(spark, root).withColumn("last_seen", F.date_format("last_seen", "yyyy-MM-dd HH:mm:ss"))


_TTL = "last_seen > (SELECT max(o_orderdate) FROM orders) - INTERVAL 700 DAY"


@query("vault_ttl", f"WITH {VAULT} SELECT label, value FROM vault WHERE {_TTL}")
def vault_ttl(spark, root):
    v = vault(spark, root).withColumn("_now", clock(spark, root))
    return V.unexpired(v, F.col("_now"), 700).select("label", "value")


@query("vault_top", f"WITH {VAULT} SELECT label, value FROM vault ORDER BY last_seen DESC, label LIMIT 100")
def vault_top(spark, root):
    return V.capped(vault(spark, root), 100).select("label", "value")


@query(
    "vault_touch",
    f"WITH {VAULT}, u AS (SELECT DISTINCT {label_sql('value', 'category')} AS label FROM spans JOIN notes n USING (unit) "
    "WHERE n.ts > (SELECT max(o_orderdate) FROM orders) - INTERVAL 365 DAY) "
    "SELECT label, CAST(CASE WHEN label IN (SELECT label FROM u) THEN (SELECT max(o_orderdate) FROM orders) ELSE last_seen END AS VARCHAR) AS last_seen FROM vault",
)
def vault_touch(spark, root):
    """Reading a label (here: by the notes of the last year) refreshes it."""
    recent_notes = notes(spark, root, ts=True).withColumn("_now", clock(spark, root)).where(
        F.col("ts") > F.col("_now") - F.expr("INTERVAL 365 DAY")
    )
    used = V.vault_entries(recent_notes, "text", "ts", STD_RULES, test_key())
    fresh = V.touched(vault(spark, root), used, clock(spark, root))
    return fresh.select("label", F.date_format("last_seen", "yyyy-MM-dd HH:mm:ss").alias("last_seen"))


@query(
    "vault_merge",
    f"WITH {SPANS}, e AS (SELECT {label_sql('value', 'category')} AS label, value, n.ts FROM spans JOIN notes n USING (unit)) "
    "SELECT label, arg_max(value, ts) AS value, CAST(max(ts) AS VARCHAR) AS last_seen FROM e GROUP BY label",
)
def vault_merge(spark, root):
    """A vault built from half of the notes, then merged with the other half."""
    parts = [
        V.vault_entries(notes(spark, root, ts=True).where(c), "text", "ts", STD_RULES, test_key())
        for c in ("unit % 2 = 0", "unit % 2 = 1")
    ]
    merged = V.merge(V.build(parts[0]), parts[1])
    return merged.withColumn("last_seen", F.date_format("last_seen", "yyyy-MM-dd HH:mm:ss"))


@query("vault_encrypted", f"WITH {VAULT} SELECT label, value, TRUE AS hidden FROM vault")
def vault_encrypted(spark, root):
    """Written encrypted, read back; a wrong key would read nothing."""
    key = F.lit(b"\x11" * 32)
    v = vault(spark, root).select("label", "value")
    enc = V.encrypted(v, key).withColumn("hidden", F.length("value") >= 28)
    return V.decrypted(enc, key)


@query("rehydrate_own", f"WITH {NOTES_SQL} SELECT unit, text FROM notes")
def rehydrate_own(spark, root):
    r = notes(spark, root).select("unit", redact(F.col("text"), STD_RULES, test_key()).alias("r"))
    return r.select("unit", X.rehydrate(F.col("r.text"), F.col("r.spans")).alias("text"))


# Only values used recently are known, so some labels stay.
_RECENT = f"known AS (SELECT label FROM vault WHERE {_TTL})"
_FILLED = (
    f"parts AS (SELECT p.*, {label_sql('p.value', 'p.category')} AS label FROM placed p), "
    "filled AS (SELECT d.unit, string_agg(substr(d.text, CAST(prev + 1 AS BIGINT), CAST(s - prev AS BIGINT)) || "
    "CASE WHEN p.label IN (SELECT label FROM known) THEN p.value ELSE p.label END, '' ORDER BY s) AS head, max(e) AS last, "
    "bool_or(p.label NOT IN (SELECT label FROM known)) AS open FROM parts p JOIN notes d ON p.unit = d.unit GROUP BY d.unit)"
)
_WHOLE = "CASE WHEN f.last IS NULL THEN d.text ELSE f.head || substr(d.text, CAST(f.last + 1 AS BIGINT)) END"


def recent(spark, root, done):
    v = vault_of(done).withColumn("_now", clock(spark, root))
    return V.unexpired(v, F.col("_now"), 700).select("label", "value")


@query(
    "rehydrate_vault",
    f"WITH {REDACTED_VAULT}, {_RECENT}, {_FILLED} SELECT d.unit, {_WHOLE} AS text FROM notes d LEFT JOIN filled f ON f.unit = d.unit",
)
def rehydrate_vault(spark, root):
    done = redacted_notes(spark, root)
    return X.resolve_from_vault(shown(done), ["unit"], "text", recent(spark, root, done))


@query(
    "rehydrate_capped",
    f"WITH {REDACTED_VAULT}, known AS (SELECT label FROM vault ORDER BY last_seen DESC, label LIMIT 1000), {_FILLED} "
    f"SELECT d.unit, {_WHOLE} AS text FROM notes d LEFT JOIN filled f ON f.unit = d.unit",
)
def rehydrate_capped(spark, root):
    """A capped vault is small by construction: one pass, no join."""
    done = redacted_notes(spark, root)
    top = stored(V.capped(vault_of(done), 1000), "capped-vault")  # counted, then read
    return X.resolve_from_vault(shown(done), ["unit"], "text", top, bounded=True)


@query(
    "rehydrate_strict",
    f"WITH {REDACTED_VAULT}, {_RECENT}, {_FILLED} SELECT d.unit, CASE WHEN f.open AND d.unit % 3 <> 0 THEN NULL "
    f"WHEN d.unit % 3 = 0 THEN d.text ELSE {_WHOLE} END AS text FROM notes d LEFT JOIN filled f ON f.unit = d.unit",
)
def rehydrate_strict(spark, root):
    """Own spans of every third note, the vault for all others."""
    done = redacted_notes(spark, root)
    own = F.when(F.col("unit") % 3 == 0, F.col("r.spans")).otherwise(F.slice("r.spans", 1, 0))
    flat = done.select("unit", "r.text", own.alias("spans"))
    return X.resolve_labels(flat, ["unit"], "text", "spans", recent(spark, root, done)).select("unit", "text")


@query(
    "rehydrate_deep",
    f"WITH {REDACTED_VAULT}, {_RECENT}, {_FILLED} SELECT d.unit, CASE WHEN f.open THEN r.out ELSE {_WHOLE} END AS text, "
    "d.unit % 5 AS n FROM notes d JOIN redacted r ON r.unit = d.unit LEFT JOIN filled f ON f.unit = d.unit",
)
def rehydrate_deep(spark, root):
    redacted = redacted_notes(spark, root)
    nested = shown(redacted).select(
        "unit", F.struct(F.array(F.struct("text", (F.col("unit") % 5).alias("n"))).alias("items")).alias("body")
    )
    done = X.resolve_deep(nested, ["unit"], "body", recent(spark, root, redacted))
    return done.select("unit", F.col("body.items")[0].text.alias("text"), F.col("body.items")[0].n.alias("n"))


_CATS = ["personal", "email"]
_TITLE = "upper(left(part, 1)) || substr(part, 2)"
_DERIVED = (
    "lits AS (SELECT DISTINCT p_name AS v FROM part UNION SELECT DISTINCT s_name FROM supplier), "
    "forms AS (SELECT v AS value FROM lits UNION SELECT lower(v) FROM lits UNION SELECT upper(v) FROM lits UNION "
    f"SELECT list_aggregate(list_transform(regexp_extract_all(lower(v), '[\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+'), lambda part: {_TITLE}), 'string_agg', '') FROM lits), "
    f"derived AS (SELECT {label_sql('value', 'category')} AS label, value FROM forms, (SELECT unnest({_CATS}) AS category))"
)


def literals(spark, root):
    parts = table(spark, root, "part").select(F.col("p_name").alias("v"))
    return parts.unionByName(table(spark, root, "supplier").select(F.col("s_name").alias("v"))).distinct()


def derived(spark, root):
    return V.derived_labels(literals(spark, root), "v", _CATS, test_key())


@query("derived_labels", f"WITH {_DERIVED} SELECT label, value FROM derived")
def derived_labels(spark, root):
    return derived(spark, root)


_USES = (
    f"uses AS (SELECT {label_sql('s_name', quoted('personal'))} AS label FROM supplier UNION ALL "
    f"SELECT {label_sql('upper(p_name)', quoted('email'))} FROM part UNION ALL SELECT {label_sql('c_name', quoted('personal'))} FROM customer UNION ALL "
    f"SELECT {label_sql('value', 'category')} FROM spans)"
)


@query(
    "lookup_sources",
    f"WITH {VAULT}, {_DERIVED}, {_USES} SELECT CASE WHEN label IN (SELECT label FROM vault) THEN 'cacheHit' "
    "WHEN label IN (SELECT label FROM derived) THEN 'literalDerived' ELSE 'unresolved' END AS source, CAST(count(*) AS BIGINT) AS n FROM uses GROUP BY 1",
)
def lookup_sources(spark, root):
    key = test_key()

    def labelled(name, value, category):
        return table(spark, root, name).select(
            F.concat(F.lit("use "), label(value, F.lit(category), key)).alias("text")
        )

    done = redacted_notes(spark, root)
    used = (
        labelled("supplier", F.col("s_name"), "personal")
        .unionByName(labelled("part", F.upper("p_name"), "email"))
        .unionByName(labelled("customer", F.col("c_name"), "personal"))
        .unionByName(shown(done).select("text"))
    )
    known = V.dictionary(vault_of(done), derived(spark, root))
    return X.label_sources(used, "text", known)


@query(
    "title_spelling",
    "SELECT p_partkey, list_aggregate(list_transform(regexp_extract_all(lower(v), '[\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+'), "
    f"lambda part: {_TITLE}), 'string_agg', '') AS title FROM (SELECT p_partkey, p_name || '-o''' || p_type || ' x' || p_brand AS v FROM part)",
)
def title_spelling(spark, root):
    v = F.concat("p_name", F.lit("-o'"), "p_type", F.lit(" x"), "p_brand")
    return table(spark, root, "part").select("p_partkey", title_case(v).alias("title"))


# Records whose fields name paths, patterns and content, one label in each.
_KIND = "CASE unit % 4 WHEN 0 THEN 'Read' WHEN 1 THEN 'Grep' WHEN 2 THEN 'mcp__zen__send' ELSE 'Write' END"
_FIELD = "CASE unit % 4 WHEN 0 THEN 'file_path' WHEN 1 THEN 'glob' WHEN 2 THEN 'body' ELSE 'content' END"
_REC = (
    f"rec AS (SELECT r.unit, {_KIND.replace("unit", "r.unit")} AS kind, {_FIELD.replace("unit", "r.unit")} AS field, CASE WHEN r.unit % 3 = 0 THEN '../' ELSE '' END || r.out AS value, "
    f"CASE WHEN r.unit % 3 = 0 THEN '../' ELSE '' END || {_WHOLE} AS full_text, coalesce(f.open, FALSE) AS open, f.last IS NOT NULL AS labelled "
    "FROM redacted r JOIN notes d ON d.unit = r.unit LEFT JOIN filled f ON f.unit = r.unit), "
    "outc AS (SELECT *, CASE WHEN kind LIKE 'mcp\\_\\_zen\\_\\_%' ESCAPE '\\' THEN 'remote' "
    "WHEN kind = 'Read' THEN CASE WHEN NOT labelled THEN 'noLabel' WHEN open THEN 'pathLabelUnresolved' ELSE 'pathResolved' END "
    "WHEN kind = 'Grep' THEN CASE WHEN open THEN 'patternLabelUnresolved' ELSE 'resolved' END "
    "ELSE CASE WHEN open THEN 'labelSurvivedWrite' ELSE 'resolved' END END AS outcome FROM rec)"
)
_REC_HEAD = f"WITH {REDACTED_VAULT}, {_RECENT}, {_FILLED}, {_REC} "


def resolved_records(spark, root):
    climb = F.when(F.col("unit") % 3 == 0, "../").otherwise("")
    done = redacted_notes(spark, root)
    records = shown(done).select(
        "unit", F.expr(_KIND).alias("kind"), F.expr(_FIELD).alias("field"), F.concat(climb, "text").alias("value")
    )
    return X.resolve_fields(records, ["unit"], recent(spark, root, done), ("mcp__zen__",))


@query(
    "field_resolution",
    _REC_HEAD + "SELECT unit, kind, field, outcome, CASE WHEN outcome IN ('resolved', 'pathResolved') THEN full_text ELSE value END AS value FROM outc",
)
def field_resolution(spark, root):
    return resolved_records(spark, root).select("unit", "kind", "field", "outcome", "value")


@query(
    "resolution_outcomes",
    _REC_HEAD + "SELECT outcome, CAST(count(*) AS BIGINT) AS n FROM outc GROUP BY outcome",
)
def resolution_outcomes(spark, root):
    return X.outcome_counts(resolved_records(spark, root))


@query(
    "destination_policy",
    "SELECT event_id, CASE WHEN event_type || '__x' LIKE 'error%' OR event_type || '__x' LIKE 'view%' THEN TRUE ELSE FALSE END AS remote FROM events",
)
def destination_policy(spark, root):
    name = F.concat("event_type", F.lit("__x"))
    return table(spark, root, "events").select("event_id", X.is_remote(name, ("error", "view")).alias("remote"))


@query(
    "path_safety",
    "WITH p AS (SELECT o_orderkey, 'a/' || o_orderkey || '/../b' AS before, CASE o_orderkey % 4 WHEN 0 THEN 'a/../../b' WHEN 1 THEN 'x\\..\\y' "
    "WHEN 2 THEN 'n' || chr(0) || 'l' ELSE 'a..b/...' END AS after FROM orders) SELECT o_orderkey, "
    "contains(after, chr(0)) OR len(list_filter(string_split_regex(after, '[\\\\/]+'), lambda x: x = '..')) > "
    "len(list_filter(string_split_regex(before, '[\\\\/]+'), lambda x: x = '..')) AS unsafe FROM p",
)
def path_safety(spark, root):
    k = F.col("o_orderkey")
    before = F.concat(F.lit("a/"), k.cast("string"), F.lit("/../b"))
    after = F.when(k % 4 == 0, "a/../../b").when(k % 4 == 1, "x\\..\\y").when(k % 4 == 2, "n\0l").otherwise("a..b/...")
    return table(spark, root, "orders").select("o_orderkey", X.is_unsafe_path(before, after).alias("unsafe"))


# Edits against rendered notes: around the first label, into it, absent, repeated.
_RED = (
    "red AS (SELECT *, CAST(s + coalesce(sum(23 + length(category) - (e - s)) OVER (PARTITION BY unit ORDER BY s "
    "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS rs FROM spans), "
    "reds AS (SELECT *, rs + 23 + length(category) AS re, row_number() OVER (PARTITION BY unit ORDER BY s) AS k FROM red)"
)
_EDITS = (
    f"{_RED}, base AS (SELECT f.unit, f.rs, f.re, r.out, r.text, f.value AS val, {label_sql('f.value', 'f.category')} AS label FROM reds f JOIN redacted r USING (unit) WHERE k = 1), "
    "edits AS (SELECT unit, 1 AS edit_id, substr(out, greatest(rs - 4, 0) + 1, re + 4 - greatest(rs - 4, 0)) AS old, '<' || label || '>' AS new, greatest(rs - 4, 0) AS a, least(re + 4, length(out)) AS b, out, text, val FROM base "
    "UNION ALL SELECT unit, 2, substr(out, rs + 3, re - rs), 'x', rs + 2, least(re + 2, length(out)), out, text, val FROM base "
    "UNION ALL SELECT unit, 3, 'no such text', 'x', NULL, NULL, out, text, val FROM base "
    "UNION ALL SELECT unit, 4, 'e', 'x', NULL, NULL, out, text, val FROM base "
    "UNION ALL SELECT unit, 5, substr(out, 1, rs), '[PII:email:0000000000000000]', 0, rs, out, text, val FROM base WHERE rs > 6), "
    "seen AS (SELECT e.*, CASE WHEN old = '' THEN 0 ELSE (length(out) - length(replace(out, old, ''))) / length(old) END AS times FROM edits e), "
    "mapped AS (SELECT s.*, coalesce(s.a, instr(out, old) - 1) AS fa, coalesce(s.b, instr(out, old) - 1 + length(old)) AS fb FROM seen s), "
    "ends AS (SELECT m.unit, m.edit_id, "
    "m.fa - coalesce(sum(CASE WHEN r.rs < m.fa THEN (r.re - r.rs) - (r.e - r.s) END), 0) AS ra, "
    "m.fb - coalesce(sum(CASE WHEN r.rs < m.fb THEN (r.re - r.rs) - (r.e - r.s) END), 0) AS rb, "
    "bool_or((r.rs < m.fa AND m.fa < r.re) OR (r.rs < m.fb AND m.fb < r.re)) AS inside FROM mapped m LEFT JOIN reds r ON r.unit = m.unit GROUP BY m.unit, m.edit_id, m.fa, m.fb), "
    "done AS (SELECT m.unit, m.edit_id, CASE WHEN old = '' THEN 'empty' WHEN times = 0 THEN 'not_found' WHEN times > 1 THEN 'ambiguous' WHEN inside THEN 'inside_span' "
    "WHEN m.edit_id = 5 THEN 'unknown_label' ELSE 'ok' END AS status, substr(text, CAST(ra + 1 AS BIGINT), CAST(rb - ra AS BIGINT)) AS real_old, "
    "new, val FROM mapped m JOIN ends USING (unit, edit_id))"
)
_EDIT_HEAD = f"WITH {NOTES_SQL}, {redacted_ctes('notes', 'unit')}, {_EDITS} "


def edits(spark, root):
    r = notes(spark, root).select("unit", F.explode(F.array(redact(F.col("text"), STD_RULES, test_key()))).alias("r"))
    first = r.where(F.size("r.spans") > 0).select("unit", F.col("r.text").alias("out"), F.col("r.spans")[0].alias("s"))
    rs, re_, out = F.col("s.red_start"), F.col("s.red_end"), F.col("out")
    lo = F.greatest(rs - 4, F.lit(0))

    def edit(n, old, new):
        return F.struct(F.lit(n).alias("edit_id"), old.alias("old"), new.alias("new"))

    rows = F.array(
        edit(1, F.substring(out, lo + 1, re_ + 4 - lo), F.concat(F.lit("<"), F.col("s.label"), F.lit(">"))),
        edit(2, F.substring(out, rs + 3, re_ - rs), F.lit("x")),
        edit(3, F.lit("no such text"), F.lit("x")),
        edit(4, F.lit("e"), F.lit("x")),
        edit(5, F.substring(out, F.lit(1), rs), F.lit("[PII:email:0000000000000000]")),
    )
    made = first.select("unit", F.inline(rows), rs.alias("rs")).where("edit_id <> 5 OR rs > 6").drop("rs")
    return stored(made, "edits")


def translated(spark, root):
    return X.translate_edits(notes(spark, root), edits(spark, root), ["unit"], "text", STD_RULES, test_key())


@query(
    "edit_translation",
    _EDIT_HEAD + "SELECT unit, edit_id, status, CASE WHEN status = 'ok' THEN real_old END AS real_old, CASE WHEN status = 'ok' THEN "
    "CASE WHEN edit_id = 1 THEN '<' || val || '>' ELSE new END END AS real_new FROM done",
)
def edit_translation(spark, root):
    return translated(spark, root)


@query(
    "edit_batches",
    _EDIT_HEAD + ", two AS (SELECT * FROM done WHERE edit_id IN (1, 4)) SELECT unit, edit_id, status, bool_and(status = 'ok') OVER (PARTITION BY unit) AS accepted FROM two",
)
def edit_batches(spark, root):
    two = X.translate_edits(
        notes(spark, root), edits(spark, root).where("edit_id IN (1, 4)"), ["unit"], "text", STD_RULES, test_key()
    )
    two = stored(two, "translated")  # read twice below
    return X.all_or_nothing(two, ["unit"]).select("unit", "edit_id", "status", "accepted")
