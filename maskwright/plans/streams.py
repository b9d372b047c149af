"""Streaming queries: the tables are replayed as streams and checked against batch SQL."""

from __future__ import annotations

import math
import time

from pyspark.sql import functions as F

from ..functions.keys import label
from ..operators import logs as L
from ..operators.ruleset import make_rules

from ..sources.tables import stored, table, work_dir
from ..streaming.jobs import run_batches, run_to_table, run_updates, sweep_stream
from ..streaming.redaction import current_vault, fail_closed, render_stream, vault_upsert
from ..streaming.stateful import alert_stream, latch_stream, reassemble_stream, reverse_batch
from ..streaming.timed import event_stream, limited_stream, rocksdb
from ..streaming.windows import sessions, windowed_counts
from .base import ORACLES, STD_RULES, label_sql, query, redacted_ctes, test_key
from .notes import NOTES_SQL, notes
from .scans import EMAIL
from .vaults import VAULT

EMAIL_RULES = make_rules([EMAIL])


def stream(spark, root, name):
    """A table as a stream, whether it is one file or a folder of files.

    A pattern, even for one path, lets the file source list either.
    """
    schema = table(spark, root, name).schema
    reader = spark.readStream.schema(schema)
    return reader.option("maxBytesPerTrigger", BATCH_BYTES).parquet(f"{root.rstrip('/')}/{name}.parque[t]")


#: A micro-batch takes files up to so many bytes (one at least).
BATCH_BYTES = str(4 << 30)
#: Notes of one file at most, and the micro-batches they are replayed in.
NOTES_IN_FILE = 200_000
NOTE_BATCHES = 3


def write_notes(spark, root, purpose):
    """The notes as files, so that they can be replayed in several micro-batches.

    Every micro-batch costs some seconds of planning, so their number does not grow with the notes.
    """
    path = work_dir(spark, purpose)
    made = notes(spark, root, ts=True).withColumn("ts", F.col("ts").cast("timestamp"))
    made.write.option("maxRecordsPerFile", NOTES_IN_FILE).parquet(path)
    files = len(spark.read.parquet(path).inputFiles())
    batch = max(4, math.ceil(files / NOTE_BATCHES))
    return spark.readStream.schema("unit bigint, text string, ts timestamp").option("maxFilesPerTrigger", batch).parquet(path)


@query("stream_redaction", f"WITH {redacted_ctes('documents', 'doc_id')} SELECT doc_id, out AS text FROM redacted")
def stream_redaction(spark, root):
    docs = stream(spark, root, "documents").select("doc_id", "text")
    return run_to_table(render_stream(docs, "text", STD_RULES, test_key()), "redaction")


@query(
    "stream_fail_closed",
    "SELECT event_id, CASE WHEN event_id % 6 = 0 THEN '{broken ' || event_type ELSE '{\"n\": ' || props || ', \"t\": \"' || event_type || '\"}' END AS body, event_id % 6 <> 0 AS rendered FROM events",
)
def stream_fail_closed(spark, root):
    """Unparseable bodies pass on the side; the rest goes through the renderer."""
    body = F.when(F.col("event_id") % 6 == 0, F.concat(F.lit("{broken "), "event_type")).otherwise(
        F.concat(F.lit('{"n": '), "props", F.lit(', "t": "'), "event_type", F.lit('"}'))
    )
    base = work_dir(spark, "fail-closed")
    events = stream(spark, root, "events").select("event_id", body.alias("body"))
    run_batches(events, fail_closed("body", EMAIL_RULES, test_key(), f"{base}/ok", f"{base}/passed"), f"{base}/checkpoint")
    ok = spark.read.parquet(f"{base}/ok").select("event_id", "body", F.lit(True).alias("rendered"))
    return ok.unionByName(spark.read.parquet(f"{base}/passed").select("event_id", "body", F.lit(False).alias("rendered")))


@query("stream_reassembly", "SELECT conv_id, turn, text FROM conversations WHERE text <> ''")
def stream_reassembly(spark, root):
    """Fragments of all turns of a conversation arrive interleaved; blocks close one by one."""
    conv = stream(spark, root, "conversations").where("text <> ''")
    n = F.ceil(F.length("text") / 9).cast("int")
    empty = F.lit(None).cast("string")
    pieces = F.concat(
        F.array(F.struct(F.lit(0).cast("bigint").alias("seq"), F.lit("start").alias("type"), empty.alias("fragment"))),
        F.transform(
            F.sequence(F.lit(0), n - 1),
            lambda i: F.struct(
                (i + 1).cast("bigint").alias("seq"), F.lit("delta").alias("type"),
                F.substring(F.col("text"), i * 9 + 1, F.lit(9)).alias("fragment"),
            ),
        ),
        F.array(F.struct((n + 1).cast("bigint").alias("seq"), F.lit("stop").alias("type"), empty.alias("fragment"))),
    )
    events = conv.select(
        F.col("conv_id").cast("string").alias("stream_id"), F.col("turn").cast("int").alias("index"),
        F.col("role").alias("name"), F.inline(pieces),
    )
    done = run_to_table(reassemble_stream(events), "reassembly").where("type = 'delta'")
    return done.select(
        F.col("stream_id").cast("bigint").alias("conv_id"), F.col("index").cast("bigint").alias("turn"), F.col("fragment").alias("text")
    )


@query("stream_alerts", ORACLES["alert_rate_limit"])
def stream_alerts(spark, root):
    message = F.concat(F.lit("group "), (F.col("user_id") % 20).cast("string"), F.lit(" at 10.1.2.3"))
    errors = stream(spark, root, "events").where("event_type = 'error'").select(
        L.alert_key(F.lit("warn"), F.lit("bad"), message).alias("key"), "ts"
    )
    sent = run_to_table(alert_stream(errors, "key", "ts", 6 * 3600), "alerts")
    return sent.select("key", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"))


@query("stream_latch", ORACLES["latched_alerts"])
def stream_latch(spark, root):
    fired = run_to_table(latch_stream(stream(spark, root, "events"), "user_id", "ts", F.col("value") > 50), "latch")
    return fired.select(F.col("user_id").cast("bigint").alias("user_id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"))


@query("stream_vault", f"WITH {VAULT} SELECT label, value, CAST(last_seen AS VARCHAR) AS last_seen FROM vault")
def stream_vault(spark, root):
    base = work_dir(spark, "vault")
    units = write_notes(spark, root, "vault-notes")
    run_batches(units, vault_upsert("text", "ts", STD_RULES, test_key(), f"{base}/vault"), f"{base}/checkpoint")
    v = current_vault(spark, f"{base}/vault")
    return v.withColumn("last_seen", F.date_format("last_seen", "yyyy-MM-dd HH:mm:ss"))


@query(
    "stream_windowed_counts",
    "WITH h AS (SELECT time_bucket(INTERVAL 6 HOUR, ts) AS w, event_type AS category FROM events) "
    "SELECT strftime(w, '%Y-%m-%d %H') AS start, category, CAST(count(*) AS BIGINT) AS n FROM h GROUP BY ALL",
)
def stream_windowed_counts(spark, root):
    """Every change of a window is written, so the last windows are there before the watermark closes them."""
    events = stream(spark, root, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("category"))
    changes = run_updates(windowed_counts(events, "ts", "6 hours"), "windows")
    done = changes.groupBy("window", "category").agg(F.max("n").alias("n"))  # a count only grows
    return done.select(F.date_format("window.start", "yyyy-MM-dd HH").alias("start"), "category", "n")


@query(
    "stream_sweep",
    f"WITH {redacted_ctes('documents', 'doc_id')} SELECT doc_id AS path, out AS text FROM redacted WHERE out <> text",
)
def stream_sweep(spark, root):
    base = work_dir(spark, "sweep")
    units = stream(spark, root, "documents").select(
        F.col("doc_id").alias("path"), F.lit("2024-01-01").cast("timestamp").alias("modification_time"),
        F.length("text").cast("bigint").alias("length"), F.lit("text").alias("format"), F.col("text").alias("raw"),
    )
    run_batches(units, sweep_stream(STD_RULES, test_key(), base), f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/rewritten").select("path", "text")


# --- silence ---------------------------------------------------------------------------------------

_SILENCE = 36_000
_RUNS = (
    "WITH g AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) <= 36000000000 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), "
    "i AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM g), "
    "r AS (SELECT user_id, min(ts) AS a, max(ts) AS b, count(*) AS n FROM i GROUP BY user_id, run) "
    "SELECT user_id, strftime(a, '%Y-%m-%d %H:%M:%S.%f') AS started, strftime(b, '%Y-%m-%d %H:%M:%S.%f') AS last_seen, CAST(n AS BIGINT) AS n FROM r"
)


def _shown_runs(runs):
    fmt = "yyyy-MM-dd HH:mm:ss.SSSSSS"
    return runs.select("user_id", F.date_format("started", fmt).alias("started"), F.date_format("last_seen", fmt).alias("last_seen"), "n")


@query("heartbeat_sessions", _RUNS)
def heartbeat_sessions(spark, root):
    """Runs of heartbeats of each user with no silence of ten hours between."""
    return _shown_runs(sessions(table(spark, root, "events"), "user_id", "ts", _SILENCE))


@query("stream_sessions", _RUNS + " WHERE b + INTERVAL 10 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE")
def stream_sessions(spark, root):
    """The runs whose silence the watermark has passed."""
    return _shown_runs(run_to_table(sessions(stream(spark, root, "events"), "user_id", "ts", _SILENCE), "sessions"))


# --- tool inputs: framing, reassembly and reversal of one stream ------------------------------------

_REMOTE = "mcp__"
_INPUT_RULES = make_rules(aliases=[("C:\\Users\\jane", "D:\\Home\\person")], remote_prefixes=[_REMOTE])
#: Characters of a chunk; records, JSON strings and labels are cut wherever it falls.
_CHUNK = 61
_BATCHES = 3


def _secret(conv):
    return F.concat(F.lit("user"), conv.cast("string"), F.lit("@corp.example"))


def _event(kind: str, rest) :
    """A server-sent event with a JSON payload."""
    return F.concat(F.lit(f"event: {kind}\ndata: {{\"type\": \"{kind}\", \"index\": "), F.col("turn").cast("string"), rest, F.lit("}\n\n"))


def write_chunks(spark, root):
    """Each conversation as one stream of events, a tool input for each turn, cut into chunks that lie in several micro-batches."""
    conv = table(spark, root, "conversations").where("text <> ''")
    name = F.when(F.col("turn") % 3 == 2, f"{_REMOTE}ask").otherwise("Edit")
    body = F.to_json(F.struct(
        F.concat(F.lit("D:\\Home\\person\\"), F.col("turn").cast("string")).alias("path"),
        F.concat("text", F.lit(" "), label(_secret(F.col("conv_id")), F.lit("email"), test_key())).alias("text"),
    ))
    conv = conv.select("conv_id", "turn", name.alias("name"), body.alias("body"))
    half = F.ceil(F.length("body") / 2).cast("int")
    piece = lambda a, n: F.regexp_extract(F.to_json(F.struct(F.substring(F.col("body"), a, n).alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1)
    delta = lambda a, n: _event("content_block_delta", F.concat(F.lit(', "delta": {"type": "input_json_delta", "partial_json": '), piece(a, n), F.lit("}")))
    start = F.concat(F.lit(', "content_block": {"type": "tool_use", "name": "'), F.col("name"), F.lit('"}'))
    events = F.concat(
        _event("content_block_start", start), delta(F.lit(1), half), delta(half + 1, F.length("body")), _event("content_block_stop", F.lit(""))
    )
    turns = conv.select("conv_id", F.struct("turn", events.alias("events")).alias("t"))
    whole = turns.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("t")), lambda t: t["events"]), "").alias("s"))
    n = F.ceil(F.length("s") / _CHUNK).cast("int")
    chunks = whole.select("conv_id", n.alias("n"), F.posexplode(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring("s", i * _CHUNK + 1, F.lit(_CHUNK)))).alias("seq", "chunk"))
    rows = stored(chunks.select(
        "conv_id", F.col("seq").cast("bigint").alias("seq"), "chunk", (F.col("seq") == F.col("n") - 1).alias("is_last"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("seq")).alias("ts"), F.floor(F.col("seq") * _BATCHES / F.col("n")).cast("int").alias("batch"),
    ), "chunks")
    base = work_dir(spark, "chunk-stream")
    for b in range(_BATCHES):
        rows.where(F.col("batch") == b).drop("batch").coalesce(1).write.parquet(f"{base}/batch-{b}")
        time.sleep(0.01)  # the file source goes by modification time
    reader = spark.readStream.schema(rows.drop("batch").schema).option("recursiveFileLookup", "true")
    return reader.option("maxFilesPerTrigger", 1).parquet(base)


@query(
    "stream_tool_inputs",
    "SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN 'D:\\Home\\person\\' ELSE 'C:\\Users\\jane\\' END || turn AS path, "
    "text || ' ' || CASE WHEN turn % 3 = 2 THEN " + label_sql("('user' || conv_id || '@corp.example')", "'email'")
    + " ELSE 'user' || conv_id || '@corp.example' END AS text FROM conversations WHERE text <> ''",
)
def stream_tool_inputs(spark, root):
    """Chunks become records, records whole inputs, and inputs for local tools get real names and values back.

    The vault is a versioned table that each micro-batch reads as it is then.
    """
    chunks = write_chunks(spark, root)
    base = work_dir(spark, "tool-inputs")
    secrets = table(spark, root, "conversations").select(_secret(F.col("conv_id")).alias("value")).distinct()
    secrets.select(label(F.col("value"), F.lit("email"), test_key()).alias("label"), "value", F.lit("2024-01-01").cast("timestamp").alias("last_seen"),
                   F.lit("email").alias("category")).write.parquet(f"{base}/vault/batch=0")
    events = event_stream(chunks, "conv_id", "seq", "chunk", "ts")

    def write(batch, batch_id):
        inputs = stored(batch.where("kind = 'input'"), "inputs")
        known = current_vault(spark, f"{base}/vault").select("label", "value")
        reverse_batch(inputs, ["stream_id", "n"], _INPUT_RULES, known).write.mode("overwrite").parquet(f"{base}/out/batch={batch_id}")

    with rocksdb(spark):
        run_batches(events, write, f"{base}/checkpoint")
    done = spark.read.parquet(f"{base}/out")
    field = lambda f: F.get_json_object("fragment", f"$.{f}").alias(f)
    return done.select(F.col("stream_id").cast("bigint").alias("conv_id"), F.col("index").cast("bigint").alias("turn"), field("path"), field("text"))


@query("stream_alerts_timed", ORACLES["alert_rate_limit"])
def stream_alerts_timed(spark, root):
    """The alert limit on a stream whose state ends with each key's interval."""
    message = F.concat(F.lit("group "), (F.col("user_id") % 20).cast("string"), F.lit(" at 10.1.2.3"))
    errors = stream(spark, root, "events").where("event_type = 'error'").select(
        L.alert_key(F.lit("warn"), F.lit("bad"), message).alias("key"), "ts"
    )
    with rocksdb(spark):
        sent = run_to_table(limited_stream(errors, "key", "ts", 6 * 3600), "alerts")
    return sent.select("key", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"))
