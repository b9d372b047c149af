"""Keyed state: fragment reassembly, alert rate limits, latches and liveness.

The per-key functions are small; Spark shuffles, stores and expires the state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import catalog
from ..operators.aliases import to_real
from ..operators.nested import text_or_json
from ..operators.resolve import is_remote, resolve_from_vault
from ..operators.ruleset import RuleSet

FRAGMENTS = "stream_id string, index int, seq bigint, type string, name string, fragment string"


def _ordered(parts: Iterator[pd.DataFrame], by: str) -> pd.DataFrame:
    """The rows of one key in this micro-batch (bounded by the batch, not the stream)."""
    return pd.concat(list(parts), ignore_index=True).sort_values(by, kind="stable")


def reassemble_stream(events: DataFrame) -> DataFrame:
    """Hold the deltas of an open block and emit them as one fragment when it stops.

    ``events`` follow ``FRAGMENTS``.  Events outside an open block, and all other
    types, pass unchanged; interleaved blocks have their own state.
    """

    def step(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        open_, name, held = state.get if state.exists else (False, None, "")
        out, pieces = [], [held]
        columns = ["stream_id", "index", "seq", "type", "name", "fragment"]
        for row in _ordered(parts, "seq")[columns].itertuples(index=False):
            if row.type == "start":
                open_, name, pieces = True, row.name, [""]
                out.append(row)
            elif row.type == "delta" and open_:
                pieces.append(row.fragment or "")
            elif row.type == "stop" and open_:
                out.append(row._replace(type="delta", name=name, fragment="".join(pieces)))
                out.append(row._replace(name=name))
                open_, pieces = False, [""]
            else:
                out.append(row)
        if open_:
            state.update((True, name, "".join(pieces)))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=columns).astype({"index": "int32", "seq": "int64"})

    return events.groupBy("stream_id", "index").applyInPandasWithState(
        step, FRAGMENTS, "open boolean, name string, held string", "append", GroupStateTimeout.NoTimeout
    )


def frames(chunks: DataFrame, key: str, seq: str, chunk: str) -> DataFrame:
    """Split arbitrary chunks into records that end with a blank line.

    The unfinished rest is kept as state and put before the next chunk; the last
    row of a stream (``is_last``) flushes it.
    """

    def step(k, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rest, n = state.get if state.exists else ("", 0)
        rows, last = _ordered(parts, seq), False
        rest += "".join(rows[chunk].fillna(""))
        last = bool(rows["is_last"].any())
        *done, rest = rest.split("\n\n")
        records = [d + "\n\n" for d in done] + ([rest] if last and rest else [])
        state.update(("" if last else rest, n + len(records)))
        yield pd.DataFrame({key: [k[0]] * len(records), "record_no": pd.Series(range(n, n + len(records)), dtype="int64"), "record": records})

    return chunks.groupBy(key).applyInPandasWithState(
        step, f"{key} string, record_no bigint, record string", "rest string, n bigint", "append", GroupStateTimeout.NoTimeout
    )


def reversed_fragment(fragment: Column, name: Column, rules: RuleSet) -> Column:
    """Un-alias the strings of a reassembled JSON fragment, unless its kind is remote.

    An incomplete or non-JSON accumulation is forwarded as it is.
    """
    parses = F.try_parse_json(fragment).isNotNull()
    real = text_or_json(fragment, F.lit(True), lambda t: to_real(t, rules).text)
    return F.when(~is_remote(name, rules.remote_prefixes) & F.coalesce(parses, F.lit(False)), real).otherwise(fragment)


def reverse_batch(batch: DataFrame, keys: list[str], rules: RuleSet, known: DataFrame, bounded: bool = False) -> DataFrame:
    """For ``foreachBatch`` after reassembly: un-alias, then resolve labels, by policy."""
    real = batch.withColumn("fragment", reversed_fragment(F.col("fragment"), F.col("name"), rules))
    local = ~is_remote(F.col("name"), rules.remote_prefixes)
    resolved = resolve_from_vault(real.where(local), keys, "fragment", known, bounded)
    return resolved.unionByName(real.where(~local))


def alert_stream(alerts: DataFrame, key: str, ts: str, seconds: int = catalog.ALERT_INTERVAL_SECONDS) -> DataFrame:
    """Alerts that go out: suppressed within the interval since the last one sent."""
    micros = seconds * 1_000_000
    rows = alerts.select(F.col(key).alias("key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at"))

    def step(k, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        sent = []
        for at in _ordered(parts, "at")["at"]:
            if last is None or at - last >= micros:
                last = int(at)
                sent.append(last)
        state.update((last,))
        yield pd.DataFrame({"key": [k[0]] * len(sent), "at": pd.Series(sent, dtype="int64")})

    out = rows.groupBy("key").applyInPandasWithState(
        step, "key string, at bigint", "last bigint", "append", GroupStateTimeout.NoTimeout
    )
    return out.select(F.col("key").alias(key), F.timestamp_micros("at").alias(ts))


def latch_stream(states: DataFrame, key: str, ts: str, bad: Column) -> DataFrame:
    """One alert per change from good to bad; good again re-arms it."""
    rows = states.select(
        F.col(key).cast("string").alias("key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at"), bad.alias("bad")
    )

    def step(k, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        armed = state.get[0] if state.exists else False
        fired = []
        rows_ = pd.concat(list(parts), ignore_index=True).sort_values(["at", "bad"], kind="stable")
        for at, is_bad in zip(rows_["at"], rows_["bad"]):
            if is_bad and armed:
                fired.append(int(at))
            armed = not is_bad
        state.update((armed,))
        yield pd.DataFrame({"key": [k[0]] * len(fired), "at": pd.Series(fired, dtype="int64")})

    out = rows.groupBy("key").applyInPandasWithState(
        step, "key string, at bigint", "armed boolean", "append", GroupStateTimeout.NoTimeout
    )
    return out.select(F.col("key").alias(key), F.timestamp_micros("at").alias(ts))


def liveness_stream(beats: DataFrame, key: str, ts: str, seconds: int = catalog.STALE_SECONDS, lateness: str = "10 minutes") -> DataFrame:
    """Emits ``down`` when a key was silent for ``seconds`` of event time, ``up`` on its return."""
    rows = beats.select(F.col(key).cast("string").alias("key"), F.col(ts).cast("timestamp").alias("at")).withWatermark("at", lateness)

    def step(k, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, down = state.get if state.exists else (None, False)
        out = []
        if state.hasTimedOut:
            out.append((k[0], last, "down"))
            state.update((last, True))
        else:
            seen = pd.concat(list(parts), ignore_index=True)["at"].max()
            newest = int(seen.value // 1000)
            if down:
                out.append((k[0], newest, "up"))
            last = newest if last is None else max(last, newest)
            state.update((last, False))
            deadline = last // 1000 + seconds * 1000
            state.setTimeoutTimestamp(max(deadline, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["key", "at", "state"]).astype({"at": "int64"})

    out = rows.groupBy("key").applyInPandasWithState(
        step, "key string, at bigint, state string", "last bigint, down boolean", "append", GroupStateTimeout.EventTimeTimeout
    )
    return out.select(F.col("key").alias(key), F.timestamp_micros("at").alias(ts), "state")
