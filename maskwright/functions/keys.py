"""Keyed labels: HMAC-SHA256 composed from ``sha2`` so it stays in the JVM."""

from __future__ import annotations

import hashlib
import hmac
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 64
MAC_CHARS = 16
# "[PII:" + ":" + 16 hex + "]"
LABEL_OVERHEAD = 23

# What counts as a label when protecting existing ones, and the
# stricter form that is eligible for resolution.
LABEL_GUARD = r"\[PII:[A-Za-z0-9_-]+:[0-9a-f]{8,}\]"
LABEL_RESOLVE = r"(?i)\[PII:[a-z0-9_-]+:[0-9a-f]{16}\]"

IPAD_COLUMN = "_mw_ipad"
OPAD_COLUMN = "_mw_opad"


def subkey(master: bytes, purpose: str, length: int = 32) -> bytes:
    """HKDF-SHA256 (RFC 5869) with an empty salt; purposes: label, memo, device, cache."""
    prk = hmac.new(b"\0" * 32, master, hashlib.sha256).digest()
    out, block, i = b"", b"", 1
    while len(out) < length:
        block = hmac.new(prk, block + purpose.encode() + bytes([i]), hashlib.sha256).digest()
        out += block
        i += 1
    return out[:length]


def pads(key: bytes) -> tuple[bytes, bytes]:
    """The inner and outer HMAC pads of a key."""
    if len(key) > BLOCK:
        key = hashlib.sha256(key).digest()
    key = key.ljust(BLOCK, b"\0")
    return bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)


@dataclass(frozen=True)
class LabelKey:
    """The two HMAC pads as columns."""

    ipad: Column
    opad: Column

    @staticmethod
    def public(key: bytes) -> "LabelKey":
        """Pads as literals.  They show up in query plans: test keys only."""
        inner, outer = pads(key)
        return LabelKey(F.lit(inner), F.lit(outer))

    @staticmethod
    def attached() -> "LabelKey":
        """Pads from the columns added by :func:`attach_key`."""
        return LabelKey(F.col(IPAD_COLUMN), F.col(OPAD_COLUMN))


def key_frame(spark, key: bytes) -> DataFrame:
    """One-row table holding the pads, to be written to restricted storage."""
    return spark.createDataFrame([pads(key)], "ipad binary, opad binary")


def attach_key(df: DataFrame, keys: DataFrame) -> DataFrame:
    """Add the pads of a stored one-row key table as columns.

    Scalar subqueries keep key material out of the plan text and event log,
    need no join, and fail if the key table has more than one row.
    """
    return df.withColumns(
        {IPAD_COLUMN: keys.select("ipad").scalar(), OPAD_COLUMN: keys.select("opad").scalar()}
    )


def detach_key(df: DataFrame) -> DataFrame:
    return df.drop(IPAD_COLUMN, OPAD_COLUMN)


def hmac_hex(value: Column, key: LabelKey) -> Column:
    inner = F.unhex(F.sha2(F.concat(key.ipad, F.encode(value, "UTF-8")), 256))
    return F.sha2(F.concat(key.opad, inner), 256)


def label(value: Column, category: Column, key: LabelKey) -> Column:
    """``[PII:<category>:<16 hex of HMAC>]``; case-sensitive on the value."""
    mac = F.substring(hmac_hex(value, key), 1, MAC_CHARS)
    return F.concat(F.lit("[PII:"), category, F.lit(":"), mac, F.lit("]"))


def labels_in(text: Column) -> Column:
    """Every resolvable label in a text, in order."""
    return F.regexp_extract_all(text, F.lit(LABEL_RESOLVE), F.lit(0))
