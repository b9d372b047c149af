"""Job history, retention, log and alert queries, all derived from ``events`` and ``orders``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import catalog
from ..functions.text import clip_words
from ..operators import insights as N
from ..operators import logs as L
from ..operators import retention as T
from ..operators.findings import findings
from ..sources.tables import table
from .base import STD_RULES, query, span_ctes
from .notes import NOTES_SQL, notes

_JOBS = (
    "jobs AS (SELECT date_trunc('hour', ts) AS ts, strftime(date_trunc('hour', ts), '%Y%m%d%H') AS id, "
    "count(*) FILTER (event_type = 'error') < 3 AS ok, count(*) AS files_scanned, "
    "count(*) FILTER (event_type = 'purchase') * CASE WHEN extract(hour FROM date_trunc('hour', ts)) % 5 = 4 THEN 9 ELSE 1 END AS files_rewritten, "
    "count(*) FILTER (value > 200) AS verify_failures, CASE WHEN count(*) FILTER (event_type = 'error') < 3 THEN 0 ELSE 1 END AS exit_code FROM events GROUP BY date_trunc('hour', ts)), "
    "clock AS (SELECT max(ts) + INTERVAL 9 HOUR AS now FROM events)"
)
_RANKED = "r AS (SELECT *, row_number() OVER (ORDER BY ts DESC, id DESC) AS rn FROM jobs)"
_METRICS = (
    f"{_JOBS}, {_RANKED}, m AS (SELECT count(*) AS runs, max(ts) AS latest, bool_or(rn = 1 AND NOT ok) AS last_failed, max(CASE WHEN rn = 1 THEN exit_code END) AS exit_code, "
    "count(*) FILTER (rn <= 10 AND NOT ok) AS failed10, sum(verify_failures) AS verify20, max(CASE WHEN rn = 1 THEN files_rewritten END) AS cur, "
    "median(CASE WHEN rn BETWEEN 2 AND 11 THEN files_rewritten END) AS base, median(CASE WHEN rn BETWEEN 1 AND 5 THEN files_rewritten END) AS recent, "
    "median(CASE WHEN rn BETWEEN 6 AND 15 THEN files_rewritten END) AS older, epoch((SELECT now FROM clock) - max(ts)) / 3600.0 AS age FROM r WHERE rn <= 20)"
)


def jobs(spark, root):
    hour = F.date_trunc("hour", "ts").alias("ts")
    kind = F.col("event_type")
    errors = F.count_if(kind == "error")
    per = table(spark, root, "events").groupBy(hour).agg(
        (errors < 3).alias("ok"), F.count(F.lit(1)).alias("files_scanned"), F.count_if(kind == "purchase").alias("_p"),
        F.count_if(F.col("value") > 200).alias("verify_failures"), F.when(errors < 3, 0).otherwise(1).alias("exit_code"),
    )
    boost = F.when(F.hour("ts") % 5 == 4, 9).otherwise(1)
    return per.withColumns({"id": F.date_format("ts", "yyyyMMddHH"), "files_rewritten": F.col("_p") * boost}).drop("_p")


def clock(spark, root):
    return table(spark, root, "events").agg((F.max("ts") + F.expr("INTERVAL 9 HOUR")).alias("now")).scalar()


@query(
    "job_summary",
    f"WITH {_JOBS}, {_RANKED} SELECT CAST(count(*) AS BIGINT) AS runs, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_run, "
    "strftime(max(CASE WHEN ok THEN ts END), '%Y-%m-%d %H:%M:%S') AS last_ok, bool_or(rn = 1 AND NOT ok) AS last_failed, "
    "CAST(count(*) FILTER (NOT ok) AS BIGINT) AS failures, CAST(sum(files_rewritten) AS BIGINT) AS files_rewritten, count(*) = 0 AS never_run FROM r",
)
def job_summary(spark, root):
    fmt = "yyyy-MM-dd HH:mm:ss"
    s = N.job_summary(jobs(spark, root))
    return s.withColumns({"last_run": F.date_format("last_run", fmt), "last_ok": F.date_format("last_ok", fmt)})


def _signal(name, sql, fn):
    @query(name, f"WITH {_METRICS} {sql}")
    def run(spark, root):
        return fn(N.job_metrics(jobs(spark, root), clock(spark, root)))


_STALE = "SELECT 'warning' AS severity, 'no run in ' || CAST(round(age) AS BIGINT) || ' hours' AS title FROM m WHERE age > 3"
_FAILED = (
    "SELECT 'critical' AS severity, 'most recent run failed, exit code ' || exit_code AS title FROM m WHERE last_failed UNION ALL "
    "SELECT 'warning', failed10 || ' of the last 10 runs failed' FROM m WHERE NOT last_failed AND failed10 >= 3"
)
_VERIFY = "SELECT 'critical' AS severity, 'verification failed on ' || CAST(verify20 AS BIGINT) || ' file(s)' AS title FROM m WHERE verify20 > 0"
_SPIKE = "SELECT 'warning' AS severity, 'spike: ' || cur || ' files rewritten' AS title FROM m WHERE runs >= 6 AND base >= 2 AND cur >= base * 3 AND cur >= 10"
_TREND = "SELECT 'info' AS severity, 'upward trend in rewritten files' AS title FROM m WHERE runs >= 10 AND older >= 2 AND recent >= older * 2"
_signal("staleness_signal", _STALE, N.staleness)
_signal("failure_signals", _FAILED, N.failure_signals)
_signal("verification_signal", _VERIFY, N.verification_signal)
_signal("spike_signal", _SPIKE, N.spike_signal)
_signal("trend_signal", _TREND, N.trend_signal)


@query(
    "job_metrics",
    f"WITH {_METRICS} SELECT CAST(runs AS BIGINT) AS runs, CAST(failed10 AS BIGINT) AS failed10, CAST(verify20 AS BIGINT) AS verify20, "
    "CAST(cur AS BIGINT) AS current, CAST(base AS DOUBLE) AS base, CAST(recent AS DOUBLE) AS recent, CAST(older AS DOUBLE) AS older FROM m",
)
def job_metrics(spark, root):
    """The numbers behind the signals, including the medians of spike and trend."""
    return N.job_metrics(jobs(spark, root), clock(spark, root)).select(
        "runs", "failed10", "verify20", "current", "base", "recent", "older"
    )


_PASSES = (
    "passes AS (SELECT date_trunc('day', ts) AS ts, strftime(date_trunc('day', ts), '%Y%m%d') AS id, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) * 1000 AS freed_bytes, "
    "count(*) FILTER (event_type = 'view') AS removed_files FROM events GROUP BY date_trunc('day', ts)), "
    "rm AS (SELECT count(*) AS passes, max(ts) AS latest, sum(freed_bytes) AS freed, sum(removed_files) AS files, "
    "epoch((SELECT now FROM clock) - max(ts)) / 3600.0 AS age FROM (SELECT * FROM passes ORDER BY ts DESC, id DESC LIMIT 5))"
)
_RETENTION = (
    "SELECT 'info' AS severity, 'no retention pass recorded yet' AS title FROM rm WHERE passes = 0 UNION ALL "
    "SELECT 'warning', 'no retention pass in ' || CAST(round(age) AS BIGINT) || ' hours' FROM rm WHERE passes > 0 AND age > 6 UNION ALL "
    "SELECT 'info', 'retention removed ' || CAST(files AS BIGINT) || ' file(s) recently' FROM rm WHERE passes > 0 AND (freed > 20971520 OR files > 100)"
)


def passes(spark, root):
    per = table(spark, root, "events").groupBy(F.date_trunc("day", "ts").alias("ts")).agg(
        (F.sum(F.floor("value").cast("bigint")) * 1000).alias("freed_bytes"),
        F.count_if(F.col("event_type") == "view").alias("removed_files"),
    )
    return per.withColumn("id", F.date_format("ts", "yyyyMMdd"))


@query("retention_signals", f"WITH {_JOBS}, {_PASSES} {_RETENTION}")
def retention_signals(spark, root):
    return N.retention_signals(N.retention_metrics(passes(spark, root), clock(spark, root)))


@query(
    "signal_list",
    f"WITH {_METRICS}, {_PASSES} " + " UNION ALL ".join([_STALE, _FAILED, _VERIFY, _SPIKE, _TREND, _RETENTION]),
)
def signal_list(spark, root):
    return N.all_signals(jobs(spark, root), passes(spark, root), clock(spark, root))


# --- retention ------------------------------------------------------------------------------

_STAMP = "CASE WHEN o_orderkey % 17 = 0 THEN 'undated' WHEN o_orderkey % 19 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') END"


@query(
    "retention_age",
    f"WITH r AS (SELECT o_orderkey, {_STAMP} AS stamp FROM orders) SELECT o_orderkey FROM r "
    "WHERE try_strptime(stamp, '%Y-%m-%dT%H:%M:%S') IS NULL OR try_strptime(stamp, '%Y-%m-%dT%H:%M:%S') >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 900 DAY",
)
def retention_age(spark, root):
    k = F.col("o_orderkey")
    stamp = F.when(k % 17 == 0, "undated").when(k % 19 == 0, F.lit(None)).otherwise(
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    )
    orders = table(spark, root, "orders")
    now = orders.agg(F.max("o_orderdate").alias("n")).scalar()
    records = orders.select("o_orderkey", stamp.alias("stamp"), now.alias("_now"))
    return T.trim_by_age(records, "stamp", F.col("_now"), 900).select("o_orderkey")


def _size_sql(max_bytes: str) -> str:
    return (
        "WITH l AS (SELECT event_id, props, sum(length(props) + 1) OVER (ORDER BY event_id DESC) AS run, sum(length(props) + 1) OVER () AS total FROM events) "
        f"SELECT event_id, props FROM l WHERE total <= {max_bytes} OR run <= {max_bytes} * 0.6"
    )


@query("retention_size", _size_sql("5000"))
def retention_size(spark, root):
    lines = table(spark, root, "events").select("event_id", "props")
    return T.trim_by_size(lines, "props", "event_id", 5000, block=500)


@query("retention_size_below", _size_sql("900000000000"))
def retention_size_below(spark, root):
    lines = table(spark, root, "events").select("event_id", "props")
    return T.trim_by_size(lines, "props", "event_id", 900_000_000_000)


_NAME = "'run-' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') || CASE o_orderkey % 3 WHEN 0 THEN '.log' WHEN 1 THEN '.raw.jsonl' ELSE '.manifest.json' END"
_TARGET = "CASE o_orderkey % 3 WHEN 0 THEN 'runs' WHEN 1 THEN 'raw' ELSE 'manifests' END"
_FILES = f"files AS (SELECT {_TARGET} AS target, {_NAME} AS name, o_orderdate AS modified, CAST(floor(o_totalprice) AS BIGINT) AS bytes FROM orders)"


def run_files(spark, root):
    return table(spark, root, "orders").select(
        F.expr(_TARGET).alias("target"), F.expr(_NAME.replace("VARCHAR", "STRING")).alias("name"),
        F.col("o_orderdate").alias("modified"), F.floor("o_totalprice").cast("bigint").alias("bytes"),
    )


def order_clock(spark, root):
    return table(spark, root, "orders").agg(F.max("o_orderdate").alias("n")).scalar()


@query(
    "keep_newest",
    f"WITH {_FILES} SELECT name FROM files WHERE name NOT LIKE '%.log' UNION ALL SELECT name FROM (SELECT name FROM files WHERE name LIKE '%.log' ORDER BY name DESC LIMIT 200)",
)
def keep_newest(spark, root):
    return T.keep_newest(run_files(spark, root).select("name"), "name", 200, ".log")


@query(
    "keep_last_lines",
    "WITH t AS (SELECT sum(length(props) + 1) AS b FROM events) SELECT event_id FROM events WHERE (SELECT b FROM t) <= 4096 UNION ALL "
    "SELECT event_id FROM (SELECT event_id FROM events ORDER BY event_id DESC LIMIT 500) WHERE (SELECT b FROM t) > 4096",
)
def keep_last_lines(spark, root):
    lines = table(spark, root, "events").select("event_id", "props")
    return T.keep_lines(lines, "props", "event_id", 500, 4096).select("event_id")


@query(
    "prune_by_age",
    f"WITH {_FILES} SELECT name FROM files WHERE NOT (name LIKE '%.raw.jsonl' AND (SELECT max(o_orderdate) FROM orders) - modified > INTERVAL 365 DAY)",
)
def prune_by_age(spark, root):
    files = run_files(spark, root).withColumn("_now", order_clock(spark, root))
    return T.prune_by_age(files, "name", "modified", F.col("_now"), 365, r"(?i)\.raw\.jsonl$").select("name")


RETENTION_RULES = {"runs": ("keep", 200), "raw": ("days", 365), "manifests": ("keep", 100), "absent": ("days", 0)}
_ACTIONS = (
    "acts AS (SELECT 'runs' AS target, count(*) - least(count(*), 200) AS removed_files, sum(bytes) - (SELECT sum(bytes) FROM (SELECT bytes FROM files WHERE target = 'runs' ORDER BY name DESC LIMIT 200)) AS freed_bytes FROM files WHERE target = 'runs' "
    "UNION ALL SELECT 'raw', count(*), coalesce(sum(bytes), 0) FROM files WHERE target = 'raw' AND (SELECT max(o_orderdate) FROM orders) - modified > INTERVAL 365 DAY "
    "UNION ALL SELECT 'manifests', count(*) - least(count(*), 100), sum(bytes) - (SELECT sum(bytes) FROM (SELECT bytes FROM files WHERE target = 'manifests' ORDER BY name DESC LIMIT 100)) FROM files WHERE target = 'manifests')"
)


def actions(spark, root):
    files = run_files(spark, root).withColumn("_now", order_clock(spark, root))
    return T.retention_actions(files, RETENTION_RULES, F.col("_now"))


@query(
    "retention_actions",
    f"WITH {_FILES}, {_ACTIONS} SELECT target, CAST(removed_files AS BIGINT) AS removed_files, CAST(freed_bytes AS BIGINT) AS freed_bytes FROM acts WHERE removed_files > 0",
)
def retention_actions(spark, root):
    return actions(spark, root)


@query(
    "retention_record",
    f"WITH {_FILES}, {_ACTIONS} SELECT 'scheduled' AS trigger, TRUE AS enabled, CAST(count(*) AS BIGINT) AS action_count, CAST(sum(freed_bytes) AS BIGINT) AS freed_bytes, "
    "CAST(sum(removed_files) AS BIGINT) AS removed_files FROM acts WHERE removed_files > 0",
)
def retention_record(spark, root):
    row = T.retention_record(actions(spark, root), F.lit("2024-01-01").cast("timestamp"))
    return row.select("trigger", "enabled", "action_count", "freed_bytes", "removed_files")


@query(
    "retention_inventory",
    f"WITH {_FILES}, g AS (SELECT * FROM (VALUES ('runs', 'newest 200 kept'), ('raw', 'records older than 365 days removed'), ('manifests', 'newest 100 kept'), ('absent', 'kept forever')) AS v(target, rule)) "
    "SELECT g.target, count(f.target) > 0 AS exists, CAST(count(f.target) AS BIGINT) AS records, CAST(coalesce(sum(bytes), 0) AS BIGINT) AS bytes, strftime(max(modified), '%Y-%m-%d') AS modified, rule "
    "FROM g LEFT JOIN files f ON f.target = g.target GROUP BY g.target, rule",
)
def retention_inventory(spark, root):
    d = T.describe(run_files(spark, root), RETENTION_RULES)
    return d.withColumn("modified", F.date_format("modified", "yyyy-MM-dd"))


# --- logs -----------------------------------------------------------------------------------

_RAW = (
    "CASE event_type WHEN 'error' THEN '[warn] ' || CASE WHEN event_id % 3 = 0 THEN 'egress REFUSED for user ' ELSE 'slow answer, user ' END || user_id "
    "WHEN 'view' THEN '[' || strftime(ts, '%H:%M:%S') || '] GET /page?t=' || md5(CAST(event_id AS VARCHAR)) || '&n=' || user_id "
    "WHEN 'click' THEN '[info] Click by ' || user_id ELSE event_type || ' of user ' || user_id END"
)
_LOG = f"log AS (SELECT event_id, {_RAW} AS raw FROM events)"
_TEXT = "CASE WHEN starts_with(raw, '[warn] ') THEN substr(raw, 8) WHEN regexp_matches(raw, '^\\[..:..:..\\] ') THEN substr(raw, 12) ELSE raw END"
_PARSED = (
    f"parsed AS (SELECT event_id, CASE WHEN NOT starts_with(raw, '[warn] ') AND regexp_matches(raw, '^\\[..:..:..\\] ') THEN substr(raw, 2, 8) END AS ts, "
    f"CASE WHEN starts_with(raw, '[warn] ') THEN CASE WHEN regexp_matches(raw, '{'|'.join(catalog.LOG_ERROR_WORDS)}') THEN 'error' ELSE 'warn' END ELSE 'info' END AS level, "
    f"regexp_replace({_TEXT}, '(?i){catalog.LOG_TOKEN}', '\\1[redacted]', 'g') AS text FROM log)"
)


def log(spark, root):
    kind, user = F.col("event_type"), F.col("user_id").cast("string")
    raw = (
        F.when(kind == "error", F.concat(F.lit("[warn] "), F.when(F.col("event_id") % 3 == 0, "egress REFUSED for user ").otherwise("slow answer, user "), user))
        .when(kind == "view", F.concat(F.lit("["), F.date_format("ts", "HH:mm:ss"), F.lit("] GET /page?t="), F.md5(F.col("event_id").cast("string")), F.lit("&n="), user))
        .when(kind == "click", F.concat(F.lit("[info] Click by "), user))
        .otherwise(F.concat(kind, F.lit(" of user "), user))
    )
    return table(spark, root, "events").select("event_id", raw.alias("raw"))


@query("log_parse", f"WITH {_LOG}, {_PARSED} SELECT event_id, ts, level, text FROM parsed")
def log_parse(spark, root):
    return log(spark, root).select("event_id", L.parse_line(F.col("raw")).alias("p")).select("event_id", "p.*")


@query(
    "log_search",
    f"WITH {_LOG}, {_PARSED}, f AS (SELECT *, CAST(count(*) OVER () AS BIGINT) AS total FROM parsed WHERE level <> 'info' AND contains(lower(text), 'user 1')) "
    "SELECT event_id, ts, level, text, total FROM f ORDER BY event_id DESC LIMIT 50",
)
def log_search(spark, root):
    return L.search(log(spark, root), "raw", "event_id", "warn", "USER 1", 50)


_CLIPPED = (
    "CASE WHEN length(t) <= 56 THEN t ELSE regexp_replace(CASE WHEN length(left(t, 56)) - strpos(reverse(left(t, 56)), ' ') > 56 * 0.6 AND strpos(reverse(left(t, 56)), ' ') > 0 "
    "THEN left(t, 56 - strpos(reverse(left(t, 56)), ' ')) ELSE left(t, 56) END, '[,;:]$', '') || '…' END"
)


@query(
    "recent_notices",
    f"WITH {_LOG}, {_PARSED}, w AS (SELECT event_id, level, text FROM parsed WHERE level <> 'info' ORDER BY event_id DESC LIMIT 3) "
    "SELECT event_id, level, row_number() OVER (ORDER BY CASE WHEN level = 'error' THEN 0 ELSE 1 END, event_id DESC) = 1 AS headline, text AS shown FROM w",
)
def recent_notices(spark, root):
    notices = log(spark, root).select("event_id", L.parse_line(F.col("raw")).alias("p")).where("p.level <> 'info'")
    top = L.recent_notices(notices.select("event_id", "p.level", "p.text"), "event_id")
    return top.select("event_id", "level", "headline", "shown")


@query(
    "clip_words",
    f"WITH c AS (SELECT doc_id, trim(regexp_replace(text, '[\\s\\x{{0b}}\\x{{a0}}\\x{{feff}}\\x{{2028}}\\x{{2029}}\\p{{Zs}}]+', ' ', 'g')) AS t FROM documents) SELECT doc_id, {_CLIPPED} AS shown FROM c",
)
def clipped(spark, root):
    return table(spark, root, "documents").select("doc_id", clip_words(F.col("text"), 56).alias("shown"))


# --- alerts, liveness, windows ----------------------------------------------------------------

@query(
    "alert_rate_limit",
    "WITH RECURSIVE a AS (SELECT DISTINCT user_id % 20 AS u, ts FROM events WHERE event_type = 'error'), "
    "s AS (SELECT u, min(ts) AS ts FROM a GROUP BY u UNION ALL SELECT s.u, (SELECT min(a.ts) FROM a WHERE a.u = s.u AND a.ts >= s.ts + INTERVAL 6 HOUR) AS ts FROM s WHERE s.ts IS NOT NULL) "
    "SELECT 'warn' || chr(0) || 'bad' || chr(0) || 'group ' || u || ' at [address redacted]' AS key, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts FROM s WHERE ts IS NOT NULL",
)
def alert_rate_limit(spark, root):
    message = F.concat(F.lit("group "), (F.col("user_id") % 20).cast("string"), F.lit(" at 10.1.2.3"))
    errors = table(spark, root, "events").where("event_type = 'error'").select(
        L.alert_key(F.lit("warn"), F.lit("bad"), message).alias("key"), "ts"
    )
    sent = L.sent_alerts(errors, "key", "ts", 6 * 3600)
    return sent.select("key", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"))


@query(
    "alert_rate_limit_one_key",
    "WITH RECURSIVE a AS MATERIALIZED (SELECT DISTINCT ts FROM events), "
    "n AS MATERIALIZED (SELECT x.ts, y.ts AS after FROM a x ASOF JOIN a y ON x.ts + INTERVAL 10 MINUTE <= y.ts), "
    "s AS (SELECT min(ts) AS ts FROM a UNION ALL SELECT n.after FROM s JOIN n ON n.ts = s.ts) "
    "SELECT 'all' AS key, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts FROM s WHERE ts IS NOT NULL",
)
def alert_rate_limit_one_key(spark, root):
    """Every event is an alert of one key."""
    sent = L.sent_alerts(table(spark, root, "events").select(F.lit("all").alias("key"), "ts"), "key", "ts", 600)
    return sent.select("key", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"))


@query(
    "heartbeat_gaps",
    "WITH g AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS prev FROM events) "
    "SELECT user_id, strftime(prev, '%Y-%m-%d %H:%M:%S.%f') AS last_seen, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS back_at FROM g WHERE epoch_us(ts) - epoch_us(prev) > 36000000000",
)
def heartbeat_gaps(spark, root):
    gaps = L.heartbeat_gaps(table(spark, root, "events"), "user_id", "ts", 36_000)
    fmt = "yyyy-MM-dd HH:mm:ss.SSSSSS"
    return gaps.select("user_id", F.date_format("last_seen", fmt).alias("last_seen"), F.date_format("back_at", fmt).alias("back_at"))


@query(
    "liveness",
    "WITH l AS (SELECT user_id, max(ts) AS t FROM events GROUP BY user_id) SELECT user_id, epoch_us((SELECT max(ts) FROM events)) - epoch_us(t) <= 36000000000 AS ok, "
    "CASE WHEN epoch_us((SELECT max(ts) FROM events)) - epoch_us(t) > 36000000000 THEN 'not responding' END AS reason FROM l",
)
def liveness(spark, root):
    events = table(spark, root, "events")
    now = events.agg(F.max("ts").alias("n")).scalar()
    beats = events.select("user_id", "ts")
    return L.liveness(beats, "user_id", "ts", now, 36_000).select("user_id", "ok", "reason")


@query(
    "latched_alerts",
    "WITH g AS (SELECT user_id, ts, value > 50 AS bad, lag(value > 50) OVER (PARTITION BY user_id ORDER BY ts, CAST(value > 50 AS INT)) AS was FROM events) "
    "SELECT user_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts FROM g WHERE bad AND was = FALSE",
)
def latched_alerts(spark, root):
    alerts = L.latched_alerts(table(spark, root, "events"), "user_id", "ts", F.col("value") > 50)
    return alerts.select("user_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"))


@query("fragments_batch", "SELECT conv_id, turn, text FROM conversations")
def fragments_batch(spark, root):
    """Texts cut into pieces of seven characters and put together again."""
    return L.reassembled(fragments(spark, root), ["conv_id", "turn"])


def fragments(spark, root):
    conv = table(spark, root, "conversations")
    n = F.ceil(F.length("text") / 7).cast("int")
    pieces = F.transform(
        F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.alias("seq"), F.substring(F.col("text"), i * 7 + 1, F.lit(7)).alias("fragment"))
    )
    return conv.where("text <> ''").select("conv_id", "turn", F.inline(pieces))


@query(
    "windowed_counts",
    f"WITH {NOTES_SQL}, {span_ctes('notes', 'unit')} SELECT strftime(date_trunc('day', n.ts), '%Y-%m-%d') AS day, category, CAST(count(*) AS BIGINT) AS n "
    "FROM spans JOIN notes n USING (unit) GROUP BY ALL",
)
def windowed_counts(spark, root):
    from ..streaming.windows import windowed_counts as count

    hits = findings(notes(spark, root, ts=True), ["ts"], "text", STD_RULES)
    return count(hits, "ts", "1 day").select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "category", "n")
