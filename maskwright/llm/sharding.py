"""Operator 2: sharding by histogram sort, with DataFrame operations only.

Rows are ordered by an integer key and dealt into shards of near equal bytes.  Splitters come from
exact histograms: each round counts bytes and rows below equally spaced probes inside the intervals
that still hold a splitter, until a splitter's interval holds one position or at most ``tolerance``
bytes.  Then the rows, texts and all, are exchanged once.

Positions are ``key * 2**48`` plus 48 bits of the text's hash, so a key that very many rows share is
split like any other range; only rows equal in key and text stay side by side in one shard.
The last histogram also cuts shards into buckets of bounded rows with exact counts.  A bucket is what
one task sorts, so ``slot`` (gapless in the shard) needs no pass over a whole shard.  The driver holds
at most ``PROBES`` counts a round, and two numbers for each bucket.

With ``tolerance`` 0 the law is: a row's shard is ``floor(bytes of all rows before * shards / bytes of all rows)``.

Defined cases: a null key sorts first; a null text has no bytes, hash and CRC of the empty text; rows
equal in key and text have neighbouring slots; extra columns pass through; an empty table gives no row.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

SHARDS = 24
PROBES = 4096
_WIDE = "decimal(38,0)"


@dataclass(frozen=True)
class Bin:
    """Rows at positions ``low`` to ``high``, both of which occur."""

    low: int
    high: int
    size: int
    rows: int


def position(key: str, text: str) -> Column:
    whole = F.coalesce(F.col(key).cast("long"), F.lit(-(2**63))).cast("decimal(20,0)") * F.lit(Decimal(2**48)).cast("decimal(15,0)")
    hashed = F.xxhash64(F.coalesce(F.col(text), F.lit(""))).bitwiseAND(F.lit(2**48 - 1))
    return (whole + hashed.cast("decimal(15,0)")).cast(_WIDE)


def byte_size(text: str) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long")


def _literal(values: list[int], kind: str) -> Column:
    """One folded literal, however long."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def _below(ordered: Column, n: int, x: Column) -> Column:
    """How many of ``n`` ascending values are less than ``x``, by binary search."""
    strides = F.array(*[F.lit(1 << k) for k in reversed(range(max(1, n.bit_length())))])
    return F.aggregate(strides, F.lit(0), lambda at, s: F.when(F.get(ordered, at + s - 1) < x, at + s).otherwise(at))


def _refined(sized: DataFrame, bins: list[Bin], probes: int) -> list[Bin]:
    """Exact histogram of each bin at equally spaced probes; one pass over keys and sizes."""
    k = max(2, probes // len(bins))
    lows, highs = _literal([b.low - 1 for b in bins], _WIDE), _literal([b.high for b in bins], _WIDE)
    widths = _literal([-(-(b.high - b.low + 1) // k) for b in bins], _WIDE)
    rows = (
        sized.withColumn("j", _below(lows, len(bins), F.col("pos")) - 1)
        .where((F.col("j") >= 0) & (F.col("pos") <= F.get(highs, "j")))
        .withColumns({"over": F.col("pos") - F.get(lows, "j") - 1, "width": F.get(widths, "j")})
        .groupBy("j", F.expr("over div width").alias("b"))
        .agg(F.min("pos").alias("low"), F.max("pos").alias("high"), F.sum("size").alias("size"), F.count("*").alias("n"))
        .collect()
    )
    return sorted((Bin(int(r.low), int(r.high), r["size"], r.n) for r in rows), key=lambda b: b.low)


def histogram(sized: DataFrame, shards: int, buckets: int, tolerance: int = 0, probes: int = PROBES) -> list[Bin]:
    """Ascending bins that cover all rows: every splitter falls on a bin's end, and no bin of many positions is large."""
    head = sized.agg(F.min("pos").alias("low"), F.max("pos").alias("high"), F.sum("size").alias("size"), F.count("*").alias("n")).first()
    if not head.n:
        return []
    total, bins = head["size"], [Bin(int(head.low), int(head.high), head["size"], head.n)]
    most_rows = max(1, head.n // buckets)
    while True:
        open_bins, before = [], 0
        for b in bins:
            # a splitter lies strictly inside when a multiple of total / shards does
            inside = (before + b.size) * shards // total > before * shards // total and (before + b.size) * shards % total != 0
            inside = inside or (before + b.size) * shards // total > before * shards // total + 1
            if b.low < b.high and (inside and b.size > tolerance or b.rows > most_rows):
                open_bins.append(b)
            before += b.size
        if not open_bins:
            return bins
        open_bins = open_bins[: probes // 2]
        gone = set(open_bins)
        bins = sorted([b for b in bins if b not in gone] + _refined(sized, open_bins, probes), key=lambda b: b.low)


def shard(docs: DataFrame, shards: int = SHARDS, key: str = "doc_id", text: str = "text", tolerance: int = 0, buckets: int | None = None) -> DataFrame:
    """``docs`` with ``size``, ``shard`` and ``slot``, after one exchange of the rows."""
    n = common.parts(docs)
    docs = docs.drop("size", "shard", "slot")
    names = docs.columns
    sized = common.stored(docs.select(position(key, text).alias("pos"), byte_size(text).alias("size")), "shard-sizes")
    bins = histogram(sized, shards, buckets or 4 * max(n, shards), tolerance)
    if not bins:
        return docs.select("*", byte_size(text).alias("size"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    total, most = sum(b.size for b in bins), max(1, sum(b.rows for b in bins) // (buckets or 4 * max(n, shards)))
    ends, owner, first_slot = [], [], []
    before, slot, held, last = 0, 0, 0, -1
    for b in bins:
        own = min(shards - 1, before * shards // total)
        if own != last:
            slot = held = 0
        if own != last or held + b.rows > most:
            ends.append(b.high)
            owner.append(own)
            first_slot.append(slot)
            held = 0
        ends[-1] = b.high
        held, slot, before, last = held + b.rows, slot + b.rows, before + b.size, own
    bucket = _below(_literal(ends, _WIDE), len(ends), F.col("_pos"))
    placed = docs.select("*", byte_size(text).alias("size"), position(key, text).alias("_pos")).withColumn("_bucket", bucket).repartition(n, "_bucket")
    order = Window.partitionBy("_bucket").orderBy("_pos")
    return placed.select(
        *names, "size", F.get(_literal(owner, "int"), "_bucket").alias("shard"),
        (F.get(_literal(first_slot, "long"), "_bucket") + F.row_number().over(order) - 1).alias("slot"),
    )


def op2_histogram_sort(spark: SparkSession, root: str) -> DataFrame:
    """All documents in 24 shards of near equal bytes, in doc_id order."""
    return shard(common.table(spark, root, "documents").select("doc_id", "text")).select(
        "doc_id", "size", F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), F.lit("bytes").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
