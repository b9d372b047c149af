"""Source, sink, sweep and verification queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import catalog
from ..operators import rules as C
from ..operators import sweep as S
from ..operators import verify as Q
from ..operators.nested import json_skeleton
from ..operators.ruleset import RuleSet, make_rules
from ..operators.spans import redact
from ..sources import files as I
from ..sources.tables import table, work_dir
from .base import STD_RULES, label_sql, query, quoted, redacted_ctes, span_ctes, test_key
from .configs import ALI_SQL, KEPT_SQL, RISK, aliases, literals
from .notes import NOTES_SQL, notes
from .scans import EMAIL, docs

# --- sources ------------------------------------------------------------------------------


@query("file_inventory")
def file_inventory(spark, root):
    """The files of the data set itself, from metadata only."""
    return I.inventory(spark, root).select(
        F.regexp_extract("path", r"[^/]+$", 0).alias("name"), "length", I.extension(F.col("path")).alias("ext")
    )


@query(
    "first_target_wins",
    "SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL AND l.quality = 1 THEN 'good' WHEN l.doc_id IS NOT NULL THEN 'labelled' ELSE 'all' END AS target "
    "FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id",
)
def first_target_wins(spark, root):
    labels = table(spark, root, "labels")
    parts = [
        ("good", labels.where("quality = 1").select("doc_id")),
        ("labelled", labels.select("doc_id")),
        ("all", table(spark, root, "documents").select("doc_id")),
    ]
    return I.first_target_wins(parts, "doc_id").select("doc_id", "target")


_PATH = (
    "CASE o_orderkey % 7 WHEN 0 THEN '/w/.git/' WHEN 1 THEN '/w/node_modules/x/' WHEN 2 THEN '/state/' ELSE '/w/src/' END || 'f' || o_orderkey || "
    "CASE o_orderkey % 5 WHEN 0 THEN '.PNG' WHEN 1 THEN '.jsonl' WHEN 2 THEN '.json' WHEN 3 THEN '.ico' ELSE '.txt' END"
)
_INV = f"inv AS (SELECT {_PATH} AS path, o_orderdate AS modification_time, CAST(floor(o_totalprice * 30) AS BIGINT) AS length FROM orders)"


def inventory(spark, root):
    return table(spark, root, "orders").select(
        F.expr(_PATH).alias("path"), F.col("o_orderdate").alias("modification_time"),
        F.floor(F.col("o_totalprice") * 30).cast("bigint").alias("length"), "o_orderkey", "o_orderstatus", "o_orderpriority",
    )


@query(
    "size_capped_source",
    f"WITH {_INV} SELECT path, length, CASE WHEN length < {catalog.REPORT_MAX_BYTES} THEN 'read' ELSE 'too_large' END AS state FROM inv WHERE NOT regexp_matches(path, '/(\\.git|node_modules|\\.playwright-mcp)/') "
    "AND NOT starts_with(path, '/state/') AND lower(path) NOT LIKE '%.png' AND lower(path) NOT LIKE '%.ico'",
)
def size_capped_source(spark, root):
    limited = I.within_limits(inventory(spark, root), catalog.REPORT_MAX_BYTES, exclude=["/state/"])
    return limited.select("path", "length", "state")


@query(
    "format_routing",
    f"WITH {_INV} SELECT path, CASE WHEN path LIKE '%.jsonl' THEN 'jsonl' WHEN path LIKE '%.json' THEN 'json' ELSE 'text' END AS format FROM inv "
    "WHERE lower(path) NOT LIKE '%.png'",
)
def format_routing(spark, root):
    kept = inventory(spark, root).where(I.is_text_path(F.col("path")))
    return I.with_format(kept).select("path", "format")


_JSONL = "text || chr(10) || '{\"id\": ' || doc_id || ', \"s\": \"a@b.example\"}' || chr(10) || '  ' || chr(10) || '{bad ' || doc_id"
_LINES = (
    f"raws AS (SELECT doc_id, {_JSONL} AS raw FROM documents), "
    "jl AS (SELECT doc_id, unnest(range(1, len(string_split(raw, chr(10))) + 1)) AS line_no, unnest(string_split(raw, chr(10))) AS line FROM raws)"
)


def jsonl_units(spark, root):
    raw = F.concat(
        "text", F.lit('\n{"id": '), F.col("doc_id").cast("string"), F.lit(', "s": "a@b.example"}\n  \n{bad '),
        F.col("doc_id").cast("string"),
    )
    return docs(spark, root).select("doc_id", raw.alias("raw"))


@query(
    "jsonl_lines",
    f"WITH {_LINES} SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, line, CASE WHEN trim(line) = '' THEN 'blank' WHEN json_valid(line) THEN 'json' ELSE 'unparsed' END AS status FROM jl",
)
def jsonl_lines(spark, root):
    lines = I.jsonl_lines(jsonl_units(spark, root), ["doc_id"])
    return lines.withColumn("line_no", F.col("line_no").cast("bigint"))


EMAIL_RULES = make_rules([EMAIL])
_DOC_JSON = "CASE unit % 3 WHEN 0 THEN '{\"u\":' || unit || ',\"m\":\"a@b.example\"}' WHEN 1 THEN '{' || chr(10) || '  \"m\": \"a@b.example\"' || chr(10) || '}' || chr(10) ELSE '{not json a@b.example' END"
_MAIL = label_sql("'a@b.example'", "'email'")


@query(
    "json_documents",
    f"WITH d AS (SELECT o_orderkey AS unit, {_DOC_JSON.replace('unit', 'o_orderkey')} AS raw FROM orders) "
    f"SELECT unit, replace(raw, 'a@b.example', {_MAIL}) AS text, NOT contains(rtrim(raw, chr(10) || ' '), chr(10)) AS compact, CAST(1 AS BIGINT) AS lines_changed FROM d",
)
def json_documents(spark, root):
    """One JSON document per unit keeps its layout; broken ones are text."""
    raw = (
        F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit('{"u":'), F.col("o_orderkey").cast("string"), F.lit(',"m":"a@b.example"}')))
        .when(F.col("o_orderkey") % 3 == 1, F.lit('{\n  "m": "a@b.example"\n}\n'))
        .otherwise(F.lit("{not json a@b.example"))
    )
    units = table(spark, root, "orders").select("o_orderkey").select(F.col("o_orderkey").alias("unit"), raw.alias("raw"))
    done = units.select("unit", "raw", S.rewritten(F.col("raw"), F.lit("json"), EMAIL_RULES, test_key()).alias("r"))
    return done.select(
        "unit", "r.text", I.is_compact(F.col("raw")).alias("compact"), F.col("r.lines_changed").cast("bigint").alias("lines_changed")
    )


@query(
    "jsonl_rewrite",
    f"WITH {_LINES} SELECT doc_id, string_agg(CASE WHEN json_valid(line) THEN replace(line, 'a@b.example', {_MAIL}) ELSE line END, chr(10) ORDER BY line_no) AS text, "
    "CAST(count(*) FILTER (json_valid(line) AND contains(line, 'a@b.example')) AS BIGINT) AS lines_changed, "
    "CAST(count(*) FILTER (trim(line) <> '' AND NOT json_valid(line)) AS BIGINT) AS unparsed FROM jl GROUP BY doc_id",
)
def jsonl_rewrite(spark, root):
    done = jsonl_units(spark, root).select(
        "doc_id", S.rewritten(F.col("raw"), F.lit("jsonl"), EMAIL_RULES, test_key()).alias("r")
    )
    return done.select(
        "doc_id", "r.text", F.col("r.lines_changed").cast("bigint").alias("lines_changed"), F.col("r.unparsed").cast("bigint").alias("unparsed")
    )


_LOG = "CASE event_id % 9 WHEN 0 THEN '{\"ts\": broken' ELSE '{\"ts\": \"' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '\", \"id\": ' || event_id || ', \"ok\": true}' END"


def event_log(spark, root):
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    raw = F.when(F.col("event_id") % 9 == 0, '{"ts": broken').otherwise(
        F.concat(F.lit('{"ts": "'), stamp, F.lit('", "id": '), F.col("event_id").cast("string"), F.lit(', "ok": true}'))
    )
    return table(spark, root, "events").select(F.col("event_id").alias("line_no"), raw.alias("raw"))


@query(
    "newest_records",
    f"WITH l AS (SELECT {_LOG} AS raw FROM events), j AS (SELECT raw FROM l WHERE json_valid(raw)) "
    "SELECT json_extract_string(raw, '$.ts') AS ts, CAST(json_extract_string(raw, '$.id') AS BIGINT) AS id, TRUE AS ok FROM j ORDER BY ts DESC, id DESC LIMIT 50",
)
def newest_records(spark, root):
    return I.newest_records(event_log(spark, root), "raw", "ts string, id bigint, ok boolean", 50)


@query("log_tail", f"SELECT event_id AS line_no, {_LOG} AS raw FROM events ORDER BY event_id DESC LIMIT 100")
def log_tail(spark, root):
    return I.tail(event_log(spark, root), 100)


# --- clean index --------------------------------------------------------------------------

FP = "fp-now"
_IDX = (
    "idx AS (SELECT i.path, i.modification_time, i.length + CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS length, "
    "CASE WHEN o_orderpriority = '1-URGENT' THEN 'fp-old' ELSE 'fp-now' END AS rules_fp FROM (SELECT *, "
    f"{_PATH} AS path, o_orderdate AS modification_time, CAST(floor(o_totalprice * 30) AS BIGINT) AS length FROM orders) i WHERE o_orderpriority <> '5-LOW')"
)
_KNOWN = "(path, modification_time, length) IN (SELECT (path, modification_time, length) FROM idx WHERE rules_fp = 'fp-now')"


def index(spark, root):
    inv = inventory(spark, root).where("o_orderpriority <> '5-LOW'")
    return inv.select(
        "path", "modification_time",
        (F.col("length") + F.when(F.col("o_orderstatus") == "P", 1).otherwise(0)).alias("length"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "fp-old").otherwise(FP).alias("rules_fp"),
    )


@query("incremental_skip", f"WITH {_INV}, {_IDX} SELECT path, length FROM inv WHERE NOT ({_KNOWN})")
def incremental_skip(spark, root):
    return S.to_examine(inventory(spark, root), index(spark, root), FP).select("path", "length")


@query("index_invalidation", f"WITH {_IDX} SELECT path, length FROM idx WHERE rules_fp = 'fp-now'")
def index_invalidation(spark, root):
    return S.usable_index(index(spark, root), FP).select("path", "length")


@query(
    "index_statistics",
    f"WITH {_INV}, {_IDX} SELECT CAST(count(*) FILTER ({_KNOWN}) AS BIGINT) AS hits, CAST(count(*) FILTER (NOT ({_KNOWN})) AS BIGINT) AS misses, "
    "CAST((SELECT count(*) FROM idx WHERE rules_fp = 'fp-now') AS BIGINT) AS entries FROM inv",
)
def index_statistics(spark, root):
    return S.index_statistics(inventory(spark, root), index(spark, root), FP)


_STATUS = "CASE o_orderkey % 3 WHEN 0 THEN 'clean' WHEN 1 THEN 'changed' ELSE 'verified' END"


def examined(spark, root):
    done = S.to_examine(inventory(spark, root), index(spark, root), FP)
    return done.select("path", "modification_time", (F.col("length") + 7).alias("length"), F.expr(_STATUS).alias("status"))


@query(
    "index_update",
    f"WITH {_INV}, {_IDX}, ex AS (SELECT *, CAST(regexp_extract(path, 'f([0-9]+)', 1) AS BIGINT) AS k FROM inv WHERE NOT ({_KNOWN})) "
    "SELECT path, length FROM idx WHERE rules_fp = 'fp-now' AND path NOT IN (SELECT path FROM ex) UNION ALL SELECT path, length + 7 FROM ex WHERE k % 3 <> 1",
)
def index_update(spark, root):
    return S.updated_index(index(spark, root), examined(spark, root), FP).select("path", "length")


@query(
    "index_prune",
    f"WITH {_INV}, {_IDX} SELECT path, length FROM idx WHERE path IN (SELECT path FROM inv WHERE length < 8000000)",
)
def index_prune(spark, root):
    return S.pruned_index(index(spark, root), inventory(spark, root).where("length < 8000000")).select("path", "length")


@query(
    "recent_skip",
    f"WITH {_INV} SELECT path, epoch_ms((SELECT max(o_orderdate) FROM orders)) - epoch_ms(modification_time) < CAST(60000 AS BIGINT) * 1440 * 30 AS recent FROM inv",
)
def recent_skip(spark, root):
    now = table(spark, root, "orders").agg(F.max("o_orderdate").alias("n")).scalar()
    inv = inventory(spark, root).withColumn("_now", now)
    return S.split_recent(inv, F.col("_now"), 1440 * 30).select("path", "recent")


# --- sweep --------------------------------------------------------------------------------

_RED = redacted_ctes("documents", "doc_id")
_CHANGED = "SELECT doc_id, out, text, length(text) AS length FROM redacted WHERE out <> text"


def swept(spark, root):
    units = docs(spark, root).select(
        F.col("doc_id").alias("path"), F.lit("2024-01-01").cast("timestamp").alias("modification_time"),
        F.length("text").alias("length"), F.lit("text").alias("format"), F.col("text").alias("raw"),
    )
    return S.sweep(units, STD_RULES, test_key())


@query("rewrite_changed", f"WITH {_RED} SELECT doc_id AS path, out AS text FROM redacted WHERE out <> text")
def rewrite_changed(spark, root):
    return swept(spark, root).where("status = 'changed'").select("path", "text")


@query(
    "dry_run",
    f"WITH {_RED} SELECT CAST(count(*) AS BIGINT) AS examined, CAST(count(*) FILTER (out <> text) AS BIGINT) AS would_change, "
    "CAST(sum(CASE WHEN out <> text THEN length(text) ELSE 0 END) AS BIGINT) AS backup_bytes, CAST(0 AS BIGINT) AS unparsed FROM redacted",
)
def dry_run(spark, root):
    return S.dry_run(swept(spark, root))


@query("preimage_backup", f"WITH {_RED} SELECT doc_id AS path, text AS raw FROM redacted WHERE out <> text")
def preimage_backup(spark, root):
    return swept(spark, root).where("status = 'changed'").select("path", "raw")


@query(
    "run_manifest",
    f"WITH {_RED}, c AS (SELECT doc_id, category, count(*) AS n FROM spans GROUP BY ALL) "
    "SELECT doc_id AS path, CAST(1 AS BIGINT) AS lines_changed, CAST(length(text) AS BIGINT) AS bytes, string_agg(category || '=' || n, ' ' ORDER BY category) AS categories "
    "FROM redacted JOIN c USING (doc_id) GROUP BY doc_id, text",
)
def run_manifest(spark, root):
    rows = S.manifest(swept(spark, root))
    shown = F.array_join(
        F.transform(F.array_sort(F.map_entries("categories")), lambda e: F.concat(e.key, F.lit("="), e.value.cast("string"))), " "
    )
    return rows.select(
        "path", F.col("lines_changed").cast("bigint").alias("lines_changed"), F.col("bytes").cast("bigint").alias("bytes"), shown.alias("categories")
    )


@query("manifest_totals", f"WITH {_RED} SELECT category, CAST(count(*) AS BIGINT) AS n FROM spans GROUP BY category")
def manifest_totals(spark, root):
    return S.manifest_totals(S.manifest(swept(spark, root)))


@query(
    "scan_summary_json",
    f"WITH {_RED}, t AS (SELECT category, count(*) AS n FROM spans GROUP BY category) "
    "SELECT '{\"units_scanned\":' || (SELECT count(*) FROM documents) || ',\"units_with\":' || (SELECT count(DISTINCT doc_id) FROM spans) || "
    "',\"totals\":{' || (SELECT string_agg('\"' || category || '\":' || n, ',' ORDER BY category) FROM t) || '}}' AS summary",
)
def scan_summary_json(spark, root):
    per_unit = swept(spark, root).select(F.coalesce("categories", F.create_map().cast("map<string,int>")).alias("categories"))
    return S.scan_summary(per_unit)




@query(
    "most_affected",
    "WITH g AS (SELECT user_id, string_agg('{\"id\": ' || event_id || ', \"m\": \"' || event_type || '@x.example' || '\"}', chr(10) ORDER BY event_id) AS raw, count(*) AS n "
    "FROM events WHERE event_type IN ('error', 'view') GROUP BY user_id) SELECT user_id AS path, CAST(n AS BIGINT) AS lines_changed FROM g ORDER BY n DESC, user_id LIMIT 10",
)
def most_affected(spark, root):
    """Users' error and view events as JSON-lines units; every line holds a mail address."""
    line = F.concat(F.lit('{"id": '), F.col("event_id").cast("string"), F.lit(', "m": "'), "event_type", F.lit('@x.example"}'))
    lines = table(spark, root, "events").where(F.col("event_type").isin("error", "view")).select("user_id", "event_id", line.alias("line"))
    # A user's lines are one unit of text here; sweeping them line by line keeps a
    # very active user from becoming one huge row.
    done = lines.select("user_id", "line", F.explode(F.array(S.rewritten(F.col("line"), F.lit("jsonl"), EMAIL_RULES, test_key()))).alias("r"))
    per_user = done.groupBy(F.col("user_id").alias("path")).agg(F.sum("r.lines_changed").alias("lines_changed"))
    return S.most_affected(per_user.withColumn("status", F.lit("changed")))


@query(
    "detail_tail",
    "SELECT doc_id, CASE WHEN length(text) > 2000 THEN '[cut to the last 2000 characters]' || chr(10) || right(text, 2000) ELSE text END AS detail, "
    "length(text) > 0 AS has_log FROM documents",
)
def detail_tail(spark, root):
    return table(spark, root, "documents").select(
        "doc_id", S.tail_truncated(F.col("text"), 2000).alias("detail"), (F.length("text") > 0).alias("has_log")
    )


@query(
    "job_record",
    f"WITH {_RED} SELECT 'run-1' AS id, 'scheduled' AS trigger, TRUE AS ok, CAST(count(*) AS BIGINT) AS files_scanned, "
    "CAST(count(*) FILTER (out <> text) AS BIGINT) AS files_rewritten, CAST(0 AS BIGINT) AS verify_failures FROM redacted",
)
def job_record(spark, root):
    row = S.job_record(swept(spark, root), "run-1", F.lit("2024-01-01").cast("timestamp"), "scheduled", F.lit(0), 0)
    return row.select("id", "trigger", "ok", "files_scanned", "files_rewritten", "verify_failures")


# --- verification -------------------------------------------------------------------------

# Conversation lines, and a damaged copy: strings change, a number changes, lines
# break, a conversation loses its last line, one is missing, one grows.
_BEFORE = (
    "CASE WHEN (conv_id + turn) % 11 = 10 THEN 'not json ' || turn ELSE '{\"role\": \"' || role || '\", \"n\": ' || turn || ', \"t\": \"' || replace(replace(text, chr(10), ' '), '\"', '') || '\"}' END"
)
_AFTER = (
    "CASE WHEN (conv_id + turn) % 11 = 10 THEN CASE WHEN conv_id % 4 = 0 THEN line || '!' ELSE line END WHEN (conv_id + turn) % 11 = 1 THEN replace(line, '\"n\": ', '\"n\": 1') "
    "WHEN (conv_id + turn) % 11 = 2 THEN left(line, 10) WHEN (conv_id + turn) % 11 = 3 THEN replace(line, 'role\": \"', 'role\": \"x') ELSE line END"
)
_VERIFY = (
    f"b AS (SELECT conv_id AS file, turn + 1 AS line_no, conv_id, turn, {_BEFORE} AS line FROM conversations), mx AS (SELECT file, max(line_no) AS m FROM b GROUP BY file), "
    f"a AS (SELECT b.file, b.line_no, {_AFTER} AS line FROM b JOIN mx USING (file) WHERE b.file % 13 <> 5 AND NOT (b.file % 13 = 6 AND b.line_no = m AND m > 1) "
    "UNION ALL SELECT file, m + 1, '{}' FROM mx WHERE file % 13 = 7), "
    "f AS (SELECT coalesce(b.file, a.file) AS file, coalesce(b.line_no, a.line_no) AS line_no, b.line AS b, a.line AS a FROM b FULL OUTER JOIN a ON a.file = b.file AND a.line_no = b.line_no), "
    "cnt AS (SELECT file, count(b) AS nb, count(a) AS na FROM f GROUP BY file), "
    "sk AS (SELECT f.*, nb, na, CASE WHEN json_valid(b) THEN regexp_replace(b, '\"[^\"]*\"', 's', 'g') END AS sb, CASE WHEN json_valid(a) THEN regexp_replace(a, '\"[^\"]*\"', 's', 'g') END AS sa FROM f JOIN cnt USING (file)), "
    "p AS (SELECT file, line_no, CASE WHEN na = 0 THEN 'missing' WHEN na < nb THEN 'line_count_shrank' WHEN b IS NULL THEN 'appended' WHEN trim(b) = '' AND trim(a) = '' THEN 'blank' "
    "WHEN sb IS NULL THEN CASE WHEN a = b THEN 'unparsed_kept' WHEN line_no = nb THEN 'partial_last_line' ELSE 'unparseable_original_modified' END "
    "WHEN sa IS NULL THEN 'no_longer_parses' WHEN sb <> sa THEN 'structure_changed' WHEN a <> b THEN 'strings_changed' ELSE 'identical' END AS problem FROM sk)"
)


def before_after(spark, root):
    conv = table(spark, root, "conversations")
    b = conv.select(
        F.col("conv_id").alias("file"), (F.col("turn") + 1).alias("line_no"), "conv_id", "turn",
        F.expr(_BEFORE.replace("chr(10)", "char(10)")).alias("line"),
    )
    last = b.groupBy("file").agg(F.max("line_no").alias("m"))
    kept = b.join(last, "file").where("file % 13 <> 5 AND NOT (file % 13 = 6 AND line_no = m AND m > 1)")
    a = kept.select("file", "line_no", F.expr(_AFTER).alias("line"))
    grown = last.where("file % 13 = 7").select("file", (F.col("m") + 1).alias("line_no"), F.lit("{}").alias("line"))
    return b.select("file", "line_no", "line"), a.unionByName(grown)


@query("verify_full_outer", f"WITH {_VERIFY} SELECT file, line_no, problem FROM p")
def verify_full_outer(spark, root):
    return Q.line_problems(*before_after(spark, root))


_COUNTS = (
    "SELECT problem, CAST(CASE WHEN problem IN ('missing', 'line_count_shrank') THEN count(DISTINCT file) ELSE count(*) END AS BIGINT) AS n FROM p GROUP BY problem"
)


@query("verify_counts", f"WITH {_VERIFY} {_COUNTS}")
def verify_counts(spark, root):
    return Q.problem_counts(Q.line_problems(*before_after(spark, root)))


@query(
    "verify_first_problems",
    f"WITH {_VERIFY} SELECT * FROM p WHERE problem IN ('missing', 'line_count_shrank', 'no_longer_parses', 'structure_changed', 'unparseable_original_modified') ORDER BY file, line_no LIMIT 20",
)
def verify_first_problems(spark, root):
    return Q.first_problems(Q.line_problems(*before_after(spark, root)))


@query(
    "post_write_parse",
    f"WITH {_VERIFY} SELECT file, CAST(count(*) FILTER (trim(line) <> '' AND NOT json_valid(line)) AS BIGINT) AS failures FROM a GROUP BY file "
    "HAVING count(*) FILTER (trim(line) <> '' AND NOT json_valid(line)) > 0",
)
def post_write_parse(spark, root):
    return Q.parse_failures(before_after(spark, root)[1])


_EFFECT = (
    f"{span_ctes('documents', 'doc_id')}, e AS (SELECT CAST((SELECT count(*) FROM spans) AS BIGINT) AS pii_before, "
    "CAST((SELECT count(*) FROM spans WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS BIGINT) AS pii_after, "
    "CAST(count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM labels) OR doc_id NOT IN (SELECT doc_id FROM spans)) AS BIGINT) AS identical, "
    "CAST(count(*) AS BIGINT) AS units FROM documents)"
)


def effect(spark, root):
    """Only labelled documents were rewritten, so some personal data remains."""
    members = table(spark, root, "labels").select("doc_id").distinct().withColumn("_m", F.lit(True))
    pairs = docs(spark, root).join(members, "doc_id", "left").select(
        F.col("text").alias("before"),
        F.when(F.col("_m"), redact(F.col("text"), STD_RULES, test_key()).text).otherwise(F.col("text")).alias("after"),
    )
    return Q.effect(pairs, "before", "after", STD_RULES)


@query(
    "scrub_effect",
    f"WITH {_EFFECT} SELECT *, pii_before - pii_after AS removed, CASE WHEN pii_before > 0 THEN round((pii_before - pii_after) * 100.0 / pii_before, 1) ELSE 0 END AS pct FROM e",
)
def scrub_effect(spark, root):
    return effect(spark, root)


@query(
    "scrub_verdict",
    f"WITH {_VERIFY}, q AS ({_COUNTS}), {_EFFECT}, n AS (SELECT CAST(sum(n) AS BIGINT) AS bad FROM q WHERE problem IN ('missing', 'line_count_shrank', 'no_longer_parses', 'structure_changed', 'unparseable_original_modified')) "
    "SELECT bad, pii_after, CASE WHEN bad = 0 AND pii_after = 0 THEN 'CLEAN' WHEN bad = 0 THEN 'STRUCTURALLY CLEAN' ELSE bad || ' INTEGRITY PROBLEM(S)' END AS verdict FROM n, e",
)
def scrub_verdict(spark, root):
    problems = Q.problem_counts(Q.line_problems(*before_after(spark, root)))
    return Q.verdict(problems, effect(spark, root)).select("bad", "pii_after", "verdict")


@query(
    "json_skeletons",
    "SELECT event_id, '{\"a\":\"s\",\"b\":{\"k\":' || regexp_extract(props, '[0-9]+') || '},\"z\":[1,\"s\",null,true]}' AS skeleton FROM events",
)
def json_skeletons(spark, root):
    raw = F.concat(
        F.lit('{"z": [1, "x: \\"y\\"", null, true], "a": "'), "event_type", F.lit('", "b": '), "props", F.lit("}")
    )
    return table(spark, root, "events").select("event_id", json_skeleton(raw).alias("skeleton"))


# --- literal audits -------------------------------------------------------------------------

_SHAPES = ", ".join(
    "(" + quoted(name) + ", " + quoted(t.replace("{{", "{").replace("}}", "}")) + ")" for name, t in catalog.AUDIT_SHAPES
)
_AUDIT_LITS = f"{KEPT_SQL}, one AS (SELECT value, bool_or(boundary) AS boundary FROM kept GROUP BY value)"
# Without lookaround: runs of copies, each unguarded edge of a run saves one copy.
_LEAKS = (
    "sh AS (SELECT * FROM (VALUES " + _SHAPES + ") AS s(shape, tpl)), "
    "tx AS (SELECT value, boundary, shape, lower(replace(replace(replace(tpl, '{v}', value), '{U}', upper(value)), '{l}', lower(value))) AS t, lower(value) AS v FROM one, sh), "
    "bad AS (SELECT value, shape, boundary AND regexp_matches(v, '^[\\p{L}\\p{N}_]') AND regexp_matches(replace(t, v, chr(1)), '[\\p{L}\\p{N}_]\\x01') OR "
    "boundary AND regexp_matches(v, '[\\p{L}\\p{N}_]$') AND regexp_matches(replace(t, v, chr(1)), '\\x01[\\p{L}\\p{N}_]') OR contains('[pii:personal:', v) AS leak FROM tx)"
)


def audit_literals(spark, root):
    kept = C.literal_rules(literals(spark, root))
    return (kept.groupBy("value").agg(F.bool_or("boundary").alias("boundary")))


@query("literal_leak_audit", f"WITH {_AUDIT_LITS}, {_LEAKS} SELECT value, shape, leak FROM bad")
def literal_leak_audit(spark, root):
    return Q.leak_audit(audit_literals(spark, root), RuleSet(), test_key())


@query(
    "literal_failed_shapes",
    f"WITH {_AUDIT_LITS}, {_LEAKS} SELECT value, CAST(count(*) FILTER (leak) AS BIGINT) AS leaks, coalesce(string_agg(shape, ', ' ORDER BY shape) FILTER (leak), '') AS failed FROM bad GROUP BY value",
)
def literal_failed_shapes(spark, root):
    return Q.failed_shapes(Q.leak_audit(audit_literals(spark, root), RuleSet(), test_key()))


@query(
    "literal_self_test",
    f"WITH {_AUDIT_LITS}, n AS (SELECT count(*) AS n, count(*) FILTER (boundary AND regexp_full_match(value, '[\\p{{L}}\\p{{N}}_]+')) AS w, "
    "count(*) FILTER (boundary AND regexp_matches(value, '^[\\p{L}\\p{N}_]|[\\p{L}\\p{N}_]$')) AS g FROM one), s AS (SELECT unnest(range(0, 20)) AS k) "
    "SELECT CAST(k AS INT) AS shape_no, CAST(n AS BIGINT) AS tested, CAST(CASE WHEN k IN (14, 16) THEN g - w ELSE 0 END AS BIGINT) AS leaked, "
    "CAST(CASE WHEN k IN (14, 16) THEN w ELSE 0 END AS BIGINT) AS embedded FROM n, s",
)
def literal_self_test(spark, root):
    return Q.shape_self_test(audit_literals(spark, root), RuleSet(), test_key())


@query(
    "overmatch_notes",
    f"WITH {_AUDIT_LITS} SELECT value, concat_ws('; ', CASE WHEN length(value) <= 3 THEN 'three characters at most, so found within other words' WHEN length(value) <= 5 THEN 'five characters at most, may be an everyday word' END, "
    "CASE WHEN regexp_full_match(value, '[0-9]+') AND length(value) <= 9 THEN 'digits only, like many numbers in logs' END, "
    "CASE WHEN regexp_full_match(value, '[A-Za-z]+') AND length(value) <= 6 THEN 'one plain word of few letters' END) AS notes FROM one",
)
def overmatch_notes(spark, root):
    return audit_literals(spark, root).select("value", Q.risk_notes(F.col("value")).alias("notes"))


@query(
    "alias_self_test",
    f"WITH {ALI_SQL} SELECT real, alias, {RISK} AS risk, contains(alias, real) AS survives FROM alis",
)
def alias_self_test(spark, root):
    return Q.alias_table_checks(aliases(spark, root))


@query(
    "line_numbers",
    "SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id // 1000 ORDER BY doc_id) AS BIGINT) AS line_no, text FROM documents",
)
def line_numbers(spark, root):
    """Documents written as JSON lines, a thousand ids a file, and read in splits with their line numbers."""
    base = work_dir(spark, "line-numbers")
    rows = table(spark, root, "documents").select("doc_id", "text", F.floor(F.col("doc_id") / 1000).alias("part"))
    lines = rows.repartition("part").sortWithinPartitions("part", "doc_id").select("part", F.to_json(F.struct("doc_id", "text")).alias("value"))
    lines.write.partitionBy("part").text(base)
    read = I.jsonl_source(spark, base).where("status = 'json'")
    fields = F.from_json("line", "doc_id bigint, text string").alias("r")
    return read.select("line_no", fields).select("r.doc_id", "line_no", "r.text")


# --- JSON lines and runs that can be resumed --------------------------------------------------------


def run_units(spark, root):
    """Each document as JSON lines: its text as a value, a blank line, and a broken line with the same text."""
    flat = F.regexp_replace("text", r"[\r\n]", " ")
    raw = F.concat(F.to_json(F.struct(F.col("text").alias("t"))), F.lit("\n\n{broken "), flat)
    return table(spark, root, "documents").where("text IS NOT NULL").select(
        F.col("doc_id").alias("path"), F.lit("2024-01-01").cast("timestamp").alias("modification_time"),
        F.length(raw).cast("bigint").alias("length"), F.lit("jsonl").alias("format"), raw.alias("raw"),
    )


@query(
    "run_manifest_jsonl",
    f"WITH {_RED}, c AS (SELECT doc_id, category, count(*) AS n FROM spans GROUP BY ALL) "
    "SELECT doc_id AS path, CAST(1 AS BIGINT) AS lines_changed, CAST(1 AS BIGINT) AS unparsed, string_agg(category || '=' || n, ' ' ORDER BY category) AS categories "
    "FROM c GROUP BY doc_id",
)
def run_manifest_jsonl(spark, root):
    """What a pass replaces in JSON lines: the line that does not parse is kept, and its hits do not count."""
    done = S.sweep(run_units(spark, root), STD_RULES, test_key()).where("status = 'changed'")
    shown = F.array_join(
        F.transform(F.array_sort(F.map_entries("categories")), lambda e: F.concat(e.key, F.lit("="), e.value.cast("string"))), " "
    )
    return done.select("path", *[F.col(c).cast("bigint").alias(c) for c in ("lines_changed", "unparsed")], shown.alias("categories"))


@query(
    "run_ledger",
    f"WITH {_RED}, n AS (SELECT count(*) AS examined, count(*) FILTER (out <> text) AS changed FROM redacted) "
    "SELECT step, CAST(CASE WHEN step = 'staged' THEN examined ELSE changed END AS BIGINT) AS units, 0::BIGINT AS skipped "
    "FROM n, (SELECT unnest(['staged', 'backup', 'rewritten', 'manifest', 'committed']) AS step)",
)
def run_ledger(spark, root):
    """The steps of a run that broke off after its backup and was resumed."""
    out = work_dir(spark, "ledger")
    results = swept(spark, root)
    S.run_steps(results, out, "r1", until="backup")
    S.run_steps(results.where("1 = 0"), out, "r1")  # the staged part counts, not what is passed again
    return S.ledger(spark, out).select("step", "units", "skipped")
