"""Literals from a table of any size, matched by a join of word runs.

A literal that begins and ends with a word character and is guarded on both sides can only match
where a run of words begins and ends.  One pass over the texts cuts them into words; of every run of as
many words as some literal has, a hash of its folded characters is looked up in a filter of one size for
any table.  What passes is sent once for each run of a step, with its places, and looked up by equality.
The plan does not depend on the number of literals.  Literals of other shapes stay in the rule set, where
each is a regex.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import stored
from .joins import lookup
from .places import FILTER_BITS, folded, gram_filter, mix, steps, word_table

WORD = r"[\p{L}\p{N}_]"


def joinable(value: Column, boundary: Column) -> Column:
    """Literals that this module matches: guarded, with a word character at either edge."""
    return boundary & F.rlike(value, F.lit(f"(?s)^{WORD}(?:.*{WORD})?$"))


def word_count(value: Column) -> Column:
    return F.regexp_count(value, F.lit(f"{WORD}+"))


_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
#: The one character whose lower case is two.
_DOTTED, _TWO = 0x130, (0x69, 0x307)
#: Words up to twice this length are searched together for copies of a shorter one.
SHORT = 32


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Spans:
    """Hashes of any spans of folded characters, by prefix sums; what is equal in lower case hashes alike."""

    def __init__(self, points: np.ndarray):
        dotted = points == _DOTTED
        self.at = np.concatenate([[0], np.cumsum(1 + dotted)])
        if dotted.any():
            points = np.repeat(points, 1 + dotted)
            i = self.at[:-1][dotted]
            points[i], points[i + 1] = _TWO
        n = len(points)
        self.inverse = _powers(_INVERSE, n + 1)
        self.total = np.zeros(n + 1, np.uint64)
        np.cumsum(mix(points.astype(np.uint64) + _BASE) * _powers(_BASE, n), out=self.total[1:])

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.total[end] - self.total[start]) * self.inverse[start] + (end - start).astype(np.uint64)).view(np.int64)

    def copies(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Which spans are copies of a shorter one, side by side."""
        out, length = np.zeros(len(start), bool), end - start
        for size in range(1, SHORT + 1):
            k = np.flatnonzero((length % size == 0) & (length >= 2 * size) & ~out)
            out[k] = self.hashes(start[k], end[k] - size) == self.hashes(start[k] + size, end[k])
        for k in np.flatnonzero((length > 2 * SHORT) & ~out).tolist():
            size = np.arange(SHORT + 1, length[k] // 2 + 1)
            size = size[length[k] % size == 0]
            out[k] = (self.hashes(np.repeat(start[k], len(size)), end[k] - size) == self.hashes(start[k] + size, np.repeat(end[k], len(size)))).any()
        return out


def with_grams(known: DataFrame) -> DataFrame:
    """``known`` with ``gram``, the hash of ``run``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points, _, first = folded(batch.column(0).to_pylist())
            spans = Spans(points)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(spans.hashes(spans.at[first[:-1]], spans.at[first[1:]]))], names=[*batch.schema.names, "gram"])

    return known.select("run", "size", "value").mapInArrow(run, "run string, size int, value string, gram long")


def word_runs(units: DataFrame, keys: list[str], text: str, bits: np.ndarray, counts: list[int]) -> DataFrame:
    """``found, places``: runs of words that may be literals, or copies of one, each once for a step's texts.

    A place has the unit's ``keys`` and ``start``.
    """
    kinds = ", ".join(f"{k}: {units.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(len(keys)).to_pylist()]
            for i, j in steps(texts):
                points, _, first = folded(texts[i:j])
                inside, edge = word_table()[points], np.zeros(len(points) + 1, bool)
                edge[first] = True
                start = np.flatnonzero(inside & (edge[:-1] | ~np.concatenate([[False], inside[:-1]])))
                end = np.flatnonzero(inside & (edge[1:] | ~np.concatenate([inside[1:], [False]]))) + 1
                of = np.searchsorted(first, start, side="right") - 1
                spans = Spans(points)
                starts, ends, rows = [], [], []
                for n in counts:
                    m = max(0, len(start) - n + 1)
                    s, e = spans.at[start[:m]], spans.at[end[len(end) - m :]]
                    low = spans.hashes(s, e) & (FILTER_BITS - 1)
                    may = bits[low >> 3] >> (low & 7).astype(np.uint8) & 1 > 0
                    if n == 1:
                        may |= spans.copies(s, e)
                    k = np.flatnonzero(may & (of[:m] == of[len(of) - m :]))
                    starts.append(start[k])
                    ends.append(end[k + n - 1])
                    rows.append(of[k])
                start, end, of = np.concatenate(starts), np.concatenate(ends), np.concatenate(rows)
                whole = "".join(texts[i:j])
                found = pa.array([whole[a:b] for a, b in zip(start.tolist(), end.tolist())], pa.string()).dictionary_encode()
                index = found.indices.to_numpy()
                order = np.argsort(index, kind="stable")
                cuts = np.searchsorted(index[order], np.arange(len(found.dictionary) + 1)).astype(np.int32)
                of, start = of[order], start[order]
                took = [c.take(pa.array(of + i)) for c in batch.columns[:-1]]
                places = pa.StructArray.from_arrays([*took, pa.array((start - first[of]).astype(np.int32))], names=[*keys, "start"])
                yield pa.RecordBatch.from_arrays([found.dictionary, pa.ListArray.from_arrays(pa.array(cuts), places)], names=["found", "places"])

    return units.select(*keys, text).mapInArrow(run, f"found string, places array<struct<{kinds}, start: int>>")


def literal_hits(units: DataFrame, keys: list[str], text: str, literals: DataFrame) -> DataFrame:
    """``keys, start, end, value`` for every place where a joinable literal occurs, any case.

    ``literals`` has ``value, boundary``.  A word that repeats a literal without a gap counts as that
    many occurrences, as the guard allows a copy of the value as neighbour.
    """
    known = literals.where(joinable(F.col("value"), F.col("boundary"))).select(
        F.lower("value").alias("run"), word_count(F.col("value")).cast("int").alias("size"), "value"
    ).dropDuplicates(["run"])
    known = stored(with_grams(known), "dictionary")
    bits, counts = gram_filter(known)
    if not counts:
        return units.select(*keys, F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit("").alias("value")).limit(0)
    unit = F.regexp_extract(F.lower("found"), rf"^({WORD}+?)\1+$", 1)
    as_whole, as_copies = F.struct(F.lower("found").alias("run"), F.lit(True).alias("whole")), F.struct(unit.alias("run"), F.lit(False).alias("whole"))
    runs = word_runs(units, keys, text, bits, counts).select(
        "places", F.length("found").alias("length"), F.inline(F.filter(F.array(as_whole, as_copies), lambda x: x["run"] != ""))
    )
    found = lookup(runs, known.select("run", "value"), "run", bounded=True).where("value IS NOT NULL")
    at = F.col("place.start")
    starts = F.when(F.col("whole"), F.array(at)).otherwise(F.sequence(at, at + F.col("length") - F.length("run"), F.length("run")))
    size = F.when(F.col("whole"), F.col("length")).otherwise(F.length("run"))
    each = found.select("value", "whole", "length", "run", F.explode("places").alias("place"))
    return each.select(*[F.col(f"place.{k}").alias(k) for k in keys], F.explode(starts).alias("start"), size.alias("n"), "value").select(
        *keys, F.col("start").cast("int").alias("start"), (F.col("start") + F.col("n")).cast("int").alias("end"), "value"
    )
