"""Operator 6: benchmark decontamination by template canonicalisation.

Texts are cut into runs of letters and digits.  Typed placeholders replace numbers (a run that
begins with a digit), names (a capitalised run that does not begin a sentence) and units (a unit
word after a number); neighbours of one type are one placeholder.  Windows of ``WINDOW`` template
tokens are joined by hash with those of the benchmark, and the placeholders' values of aligned
windows are compared.  Windows of one document and item at the same distance are one alignment: a
document re-uses an item when in some alignment the values correspond one to one, the same value
standing for the same value throughout, or a window has equal values.  So neither other places of
the item nor variants of it hide a copy.  ``windows`` counts the document's windows in all such
alignments; the other columns describe the one of most windows, then of fewest changed values.

A window counts only with ``PLAIN`` different plain words, so that templates of placeholders match
nothing.  Items shorter than a window are one window of their own length, if it has so many.

Benchmark windows are sent to the tasks while there are at most ``SENT`` of them (8 bytes each);
beyond, all document windows are shuffled and joined.  Either way gives the same rows.

Defined cases: null or empty texts have no window; rows without doc_id or item_id name nothing and
are left out; repeated rows count once; empty tables give no row; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOW = 12
PLAIN = 6
SENT = 4_000_000

# Unit words.
UNITS = [
    "mm", "cm", "m", "km", "in", "inch", "inches", "ft", "foot", "feet", "yd", "yards", "mi", "mile", "miles",
    "metre", "metres", "meter", "meters", "mg", "g", "kg", "t", "gram", "grams", "oz", "lb", "lbs", "pound", "pounds",
    "ml", "cl", "l", "litre", "litres", "liter", "liters", "gallon", "gallons", "ms", "s", "sec", "second", "seconds",
    "min", "minute", "minutes", "h", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years",
    "percent", "usd", "eur", "gbp", "dollar", "dollars", "euro", "euros", "cent", "cents", "w", "kw", "v", "a", "hz",
    "b", "kb", "mb", "gb", "tb", "degrees",
]

_OUTSIDE = np.ones(256, bool)
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _OUTSIDE[_a:_b] = False
_STOPS = np.zeros(256, bool)
_STOPS[[10, 13, 33, 46, 58, 63]] = True
_NUMBER, _NAME, _UNIT = (np.uint64(x) for x in (0x4E554D42, 0x4E414D45, 0x554E4954))


def _hash_words(names: list[str]) -> np.ndarray:
    raw, at = common.bytes_of(pa.array(names))
    return np.sort(common.words(raw, at, _OUTSIDE)[0])


_UNIT_HASHES = _hash_words(UNITS)


def member(x: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(x), bool)
    i = np.minimum(np.searchsorted(ordered, x), len(ordered) - 1)
    return ordered[i] == x


def templates(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Template token hashes, first token of each text, is-placeholder, and the hash of each placeholder's value."""
    # A-Z are folded by the word hash; of the other capitals those of Latin-1 (two bytes, the first 0xC3) are folded here
    wide = np.concatenate([[False], raw[:-1] == 0xC3]) & (raw >= 0x80) & (raw <= 0x9E) & (raw != 0x97)
    hashed, first, start, end = common.words(raw + 32 * wide.astype(np.uint8), offsets, _OUTSIDE)
    n = len(hashed)
    if not n:
        return hashed, first, np.zeros(0, bool), hashed
    lead = raw[start]
    number = (lead >= 48) & (lead < 58)
    second = raw[np.minimum(start + 1, len(raw) - 1)]
    lower = (second >= 97) & (second < 123) | (second >= 128)
    capital = (lead >= 65) & (lead < 91) & (end - start > 1) & lower
    stops = np.concatenate([[0], np.cumsum(_STOPS[raw])])
    begins = np.zeros(n, bool)
    begins[first[:-1][first[:-1] < n]] = True
    begins[1:] |= stops[start[1:]] > stops[end[:-1]]
    name = capital & ~begins
    heads = np.zeros(n, bool)
    heads[first[:-1][first[:-1] < n]] = True
    after_number = np.concatenate([[False], number[:-1]]) & ~heads
    unit = after_number & ~number & member(hashed, _UNIT_HASHES)
    name &= ~unit
    kind = np.where(number, 1, np.where(name, 2, np.where(unit, 3, 0)))
    keep = np.ones(n, bool)
    keep[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 0) | heads[1:]
    at = np.flatnonzero(keep)
    # value of a run: an order-dependent sum over its words
    rank = np.arange(n) - at[np.cumsum(keep) - 1]
    value = np.add.reduceat(common.mix(hashed + rank.astype(np.uint64)), at)
    slot = kind[at] > 0
    token = np.select([kind[at] == 1, kind[at] == 2, kind[at] == 3], [_NUMBER, _NAME, _UNIT], hashed[at])
    return token.astype(np.uint64), np.searchsorted(at, first), slot, value


def windows(table: DataFrame, key: str, lengths: list[int], whole: bool, keep: np.ndarray | None = None) -> DataFrame:
    """Template windows ``h, id, pos, values``; ``values`` are the placeholders' value hashes in order.

    ``lengths`` are the window lengths to take; with ``whole`` a text shorter than the longest is one
    window of its own length.  ``keep`` holds the sorted hashes to which the result is restricted.
    """
    sent = None if keep is None else table.sparkSession.sparkContext.broadcast(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = common.bytes_of(batch.column(1))
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for i, j in common.steps(at):
                token, first, slot, value = templates(raw[at[i] : at[j]], at[i : j + 1] - at[i])
                doc = np.repeat(np.arange(j - i), np.diff(first))
                size = np.diff(first)
                for k in sorted({*lengths, *(size[size < max(lengths)].tolist() if whole else ())}):
                    if k < PLAIN:
                        continue
                    g, p = common.grams(token, first, int(k))
                    if whole and k < max(lengths):
                        own = size[doc[p]] == k
                        g, p = g[own], p[own]
                    if sent is not None:
                        hit = member(g, sent.value)
                        g, p = g[hit], p[hit]
                    rows = []
                    for h, q in zip(g.view(np.int64).tolist(), p.tolist()):
                        s = slot[q : q + k]
                        if len(np.unique(token[q : q + k][~s])) >= PLAIN:
                            rows.append((h, int(ids[i + doc[q]]), q - int(first[doc[q]]), value[q : q + k][s].view(np.int64).tolist()))
                    if rows:
                        h, d, q, v = zip(*rows)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(h, pa.int64()), pa.array(d, pa.int64()), pa.array(q, pa.int32()), pa.array(v, pa.list_(pa.int64()))],
                            names=["h", "id", "pos", "values"],
                        )

    rows = table.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), "text")
    return rows.mapInArrow(run, "h long, id long, pos int, values array<long>")


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, sent: int = SENT) -> DataFrame:
    """``doc_id, item_id, windows, slots, changed, kind`` for every item that a document re-uses."""
    items = common.stored(windows(benchmark, "item_id", [window], True).withColumn("k", F.lit(0)), "benchmark-windows")
    short = short_lengths(benchmark, window)
    lengths = [*short, window]
    count = items.count()
    keep = None
    if count <= sent:
        keep = np.unique(np.array([r.h for r in items.select("h").distinct().collect()], np.int64).view(np.uint64))
    found = windows(docs, "doc_id", lengths, False, keep)
    left = items.select("h", F.col("id").alias("item_id"), F.col("pos").alias("item_pos"), F.col("values").alias("item_values"))
    right = found.select("h", F.col("id").alias("doc_id"), F.col("pos").alias("doc_pos"), F.col("values").alias("doc_values"))
    shift, same = F.col("doc_pos") - F.col("item_pos"), F.col("item_values") == F.col("doc_values")
    met = common.stored(right.join(left, "h").withColumn("shift", shift).withColumn("same", same.cast("int")), "benchmark-hits")
    pair = ["doc_id", "item_id"]
    each = [*pair, "shift"]
    hits = met.groupBy(*each).agg(F.countDistinct("doc_pos").alias("n"), F.countDistinct(F.when(F.col("same") == 1, F.col("doc_pos"))).alias("n_same"))
    slots = met.select(*each, "same", F.explode(F.arrays_zip("item_values", "doc_values")).alias("z")).groupBy(
        *each, F.col("z.item_values").alias("was"), F.col("z.doc_values").alias("now")
    ).agg(F.max("same").alias("same"))
    judged = slots.groupBy(*each).agg(
        F.count("*").alias("slots"), F.countDistinct("was").alias("n_was"), F.countDistinct("now").alias("n_now"),
        F.sum((F.col("was") != F.col("now")).cast("long")).alias("changed"), F.sum("same").alias("same_slots"),
    )
    # an alignment that no one-to-one reading explains keeps its verbatim windows only
    whole = F.col("slots").isNull() | ((F.col("n_was") == F.col("slots")) & (F.col("n_now") == F.col("slots"))) | (F.col("changed") == 0)
    read = hits.join(judged, each, "left").withColumn("whole", whole).where("whole or n_same > 0").select(
        *each, "whole", F.struct(
            F.when(F.col("whole"), F.col("n")).otherwise(F.col("n_same")).alias("n"),
            (-F.when(F.col("whole"), F.coalesce("changed", F.lit(0))).otherwise(0)).cast("long").alias("less"),
            (-F.col("shift")).alias("early"),
            F.coalesce(F.when(F.col("whole"), F.col("slots")).otherwise(F.col("same_slots")), F.lit(0)).cast("long").alias("slots"),
        ).alias("best"),
    )
    out = met.join(read, each).where("whole or same = 1").groupBy(*pair).agg(F.countDistinct("doc_pos").alias("windows"), F.max("best").alias("best"))
    return out.select(
        *pair, "windows", "best.slots", (-F.col("best.less")).alias("changed"),
        F.when(F.col("best.less") == 0, "verbatim").otherwise("reparameterised").alias("kind"),
    )


def short_lengths(benchmark: DataFrame, window: int) -> list[int]:
    """Template lengths below ``window`` among the items; at most ``window - PLAIN`` values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = common.bytes_of(batch.column(0))
            n = np.diff(templates(raw, at)[1])
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(n[(n >= PLAIN) & (n < window)]).astype(np.int32))], names=["n"])

    return sorted(r.n for r in benchmark.select("text").mapInArrow(run, "n int").distinct().collect())


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that re-use no item."""
    # stored first, so that the planner knows its size before any text moves
    leaked = common.stored(leaks(docs, benchmark).select("doc_id").distinct(), "benchmark-leaks")
    return docs.join(leaked, "doc_id", "left_anti").select(*docs.columns)


def op6_templates(spark: SparkSession, root: str) -> DataFrame:
    """Benchmark items that documents re-use, verbatim or with other values."""
    return leaks(common.table(spark, root, "documents"), common.table(spark, root, "benchmark"))
