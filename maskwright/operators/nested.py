"""Transforms over nested columns, JSON text, maps and repeated blocks."""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import catalog
from ..functions.keys import LabelKey, hmac_hex
from ..functions.let import let
from ..functions.regexes import FIELD_MARK, MATCH_MARK
from .spans import working_copy

StringFn = Callable[[Column], Column]


def deep_transform(value: Column, dtype: T.DataType, fn: StringFn, opaque: bool = True) -> Column:
    """Apply ``fn`` to every string of a typed nested value; keys stay as they are.

    Structs whose ``type`` names an opaque block travel untouched.
    """
    if isinstance(dtype, T.StringType):
        return fn(value)
    if isinstance(dtype, T.ArrayType) and _has_string(dtype.elementType):
        return F.transform(value, lambda x: deep_transform(x, dtype.elementType, fn, opaque))
    if isinstance(dtype, T.MapType) and _has_string(dtype.valueType):
        return F.transform_values(value, lambda _, v: deep_transform(v, dtype.valueType, fn, opaque))
    if isinstance(dtype, T.StructType) and _has_string(dtype):
        rebuilt = F.struct(
            *[deep_transform(value[f.name], f.dataType, fn, opaque).alias(f.name) for f in dtype.fields]
        )
        kept = value.isNull()
        if opaque and any(f.name == "type" and isinstance(f.dataType, T.StringType) for f in dtype.fields):
            kept = kept | F.coalesce(value["type"].isin(catalog.OPAQUE_BLOCK_TYPES), F.lit(False))
        return F.when(kept, value).otherwise(rebuilt)
    return value


def _has_string(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.StringType):
        return True
    if isinstance(dtype, T.ArrayType):
        return _has_string(dtype.elementType)
    if isinstance(dtype, T.MapType):
        return _has_string(dtype.valueType)
    return isinstance(dtype, T.StructType) and any(_has_string(f.dataType) for f in dtype.fields)


def transform_columns(df: DataFrame, columns: list[str], fn: StringFn) -> DataFrame:
    """Only the named columns change; everything else passes through."""
    return df.withColumns({c: deep_transform(F.col(c), df.schema[c].dataType, fn) for c in columns})


def skip_opaque(kind: Column, text: Column, fn: StringFn) -> Column:
    return F.when(kind.isin(catalog.OPAQUE_BLOCK_TYPES), text).otherwise(fn(text))


# --- JSON text ---------------------------------------------------------------------

# A string token, and the colon that makes it a key.  Possessive, so that long
# strings neither backtrack nor recurse.
JSON_STRING = r'("[^"\\]*+(?:\\.[^"\\]*+)*+")(\s*+:)?+'


def _json_pieces(work: Column) -> Column:
    """Alternating text and string tokens; a token carries its colon if it is a key."""
    marked = F.regexp_replace(work, JSON_STRING, f"{MATCH_MARK}$1{FIELD_MARK}$2{MATCH_MARK}")
    return F.split(marked, MATCH_MARK, -1)


def text_or_json(raw: Column, as_json: Column, fn: StringFn) -> Column:
    """Apply ``fn`` to every string value of a JSON text, or to the whole text.

    Works on the tokens of the text itself: numbers, key order, white space and
    every string that does not change keep their exact bytes.
    """

    def pieces(work):
        return F.when(as_json, _json_pieces(work)).otherwise(F.array(F.lit(""), work))

    def piece(p, i):
        fields = F.split(p, FIELD_MARK, -1)
        token, colon = F.get(fields, F.lit(0)), F.coalesce(F.get(fields, F.lit(1)), F.lit(""))
        value = F.when(as_json, _decode(token)).otherwise(p)
        rewritten = let(
            value,
            lambda v: let(fn(v), lambda out: F.when(as_json, _encode(token, v, out)).otherwise(out)),
        )
        return F.when(i % 2 == 0, p).when(colon != "", F.concat(token, colon)).otherwise(rewritten)

    return let(working_copy(raw), lambda w: F.array_join(F.transform(pieces(w), piece), ""))


def json_transform(raw: Column, fn: StringFn) -> Column:
    """Every string value of a JSON text; one that does not parse is returned as found."""
    return F.when(F.try_parse_json(raw).isNotNull(), text_or_json(raw, F.lit(True), fn)).otherwise(raw)


def _decode(token: Column) -> Column:
    inner = F.substring(token, F.lit(2), F.length(token) - 2)
    read = F.get_json_object(F.concat(F.lit('{"v":'), token, F.lit("}")), "$.v")
    return F.when(F.contains(token, F.lit("\\")), read).otherwise(inner)


def _encode(token: Column, before: Column, after: Column) -> Column:
    made = F.to_json(F.struct(after.alias("v")))
    return F.when(after == before, token).otherwise(F.substring(made, F.lit(6), F.length(made) - 6))


def json_skeleton(raw: Column) -> Column:
    """Shape and types without string contents; null when the text does not parse.

    Going through a variant sorts object keys; string values become ``"s"``.
    """
    canonical = working_copy(F.to_json(F.try_parse_json(raw)))
    shape = F.transform(
        _json_pieces(canonical),
        lambda p, i: F.when(i % 2 == 0, p)
        .when(F.endswith(p, F.lit(FIELD_MARK)), F.lit('"s"'))
        .otherwise(F.replace(p, F.lit(FIELD_MARK), F.lit(""))),
    )
    return F.array_join(shape, "")


def pseudonymize_field(
    raw: Column, field: str, mode: str, key: LabelKey, session_value: Column | None = None
) -> Column:
    """Replace one string field of a JSON text by a keyed or per-run pseudonym.

    ``stable`` is consistent for ever, ``session`` one value per run.  A text
    that does not parse, or without that field as a string, is left alone.
    """
    if mode == "off":
        return raw
    if mode not in ("stable", "session"):
        raise ValueError(f"unknown mode {mode!r}")
    parsed = F.try_parse_json(raw)
    is_string = F.schema_of_variant(F.try_variant_get(parsed, f"$.{field}", "variant")) == "STRING"
    value = F.get_json_object(raw, f"$.{field}")
    made = hmac_hex(value, key) if mode == "stable" else session_value
    pattern = f'("{field}"\\s*+:\\s*+)"[^"\\\\]*+(?:\\\\.[^"\\\\]*+)*+"'
    return F.when(
        F.coalesce(is_string, F.lit(False)),
        F.regexp_replace(raw, F.lit(pattern), F.concat(F.lit('$1"'), made, F.lit('"'))),
    ).otherwise(raw)


def session_value() -> Column:
    """One random pseudonym for a whole run."""
    return F.lit(secrets.token_hex(32))


# --- maps ----------------------------------------------------------------------------


def map_policy(
    values: Column, keep: list[str] = (), extra: dict[str, str | None] | None = None, mode: str = "on"
) -> Column:
    """Listed names get a generic value or are dropped; all others pass."""
    if mode == "off":
        return values
    rules = _policy(keep, extra)
    drop = [n for n, v in rules.items() if v is None]
    put = {n: v for n, v in rules.items() if v is not None}
    kept = F.map_filter(values, lambda k, _: ~F.lower(k).isin(drop)) if drop else values
    table = F.create_map(*[F.lit(x) for pair in put.items() for x in pair])
    return F.transform_values(kept, lambda k, v: F.coalesce(F.try_element_at(table, F.lower(k)), v))


def map_policy_hits(values: Column, keep: list[str] = (), extra=None) -> Column:
    """The listed names a map holds, lower-cased."""
    rules = _policy(keep, extra)
    return F.filter(F.transform(F.map_keys(values), F.lower), lambda k: k.isin(list(rules)))


def _policy(keep, extra) -> dict[str, str | None]:
    rules = {**catalog.HEADER_POLICY, **(extra or {})}
    for name in keep:
        rules.pop(name.lower(), None)
    return rules


# --- repeated blocks -------------------------------------------------------------------


def distinct_first(df: DataFrame, text: str, out: str, fn: StringFn) -> DataFrame:
    """Transform every distinct text once and join the result back.

    Pays off only where blocks repeat.  The wide side of the join carries a
    digest, not the text; a digest shared by many rows is split by AQE's skew
    join, and the transformed side has one row per digest.
    """
    digest = F.sha2(F.col(text), 256)
    done = (
        df.select(text).where(F.col(text).isNotNull()).distinct()
        .select(digest.alias("_digest"), fn(F.col(text)).alias(out))
    )
    return df.withColumn("_digest", digest).join(done, "_digest", "left").drop("_digest")


def run_statistics(df: DataFrame, text: str, rendered: Callable[[Column], Column]) -> DataFrame:
    """Walked characters, memo hits and misses, and rendering counts.

    A repeated block counts as a memo hit and is not walked again.
    """
    per_text = df.groupBy(text).agg(F.count(F.lit(1)).alias("_copies"))
    r = per_text.select(
        "_copies", F.length(text).alias("_chars"), rendered(F.col(text)).alias("_r")
    )
    flat = r.select(
        "_copies", "_chars",
        F.inline(F.array(F.struct(
            F.size("_r.redact_spans").alias("_spans"),
            F.col("_r.aliased").alias("_aliased"),
            F.col("_r.normalized").alias("_normalized"),
        ))),
    )
    return flat.agg(
        F.sum(F.col("_copies") - 1).cast("bigint").alias("memo_hit"),
        F.count(F.lit(1)).alias("memo_miss"),
        F.sum("_chars").cast("bigint").alias("walked_chars"),
        F.sum("_spans").cast("bigint").alias("redacted"),
        F.sum("_aliased").cast("bigint").alias("aliased"),
        F.sum("_normalized").cast("bigint").alias("normalized"),
    )
