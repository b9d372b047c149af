"""Operator 12: importance resampling towards target texts, by bit-sliced aggregation.

A text's features are its runs of one and of two consecutive words, hashed into ``BUCKETS`` buckets.
How much more often a bucket occurs in the target than in the corpus is its gain, a whole number.

1. One pass over the corpus and one over the target count the features of each bucket; a task sends
   one row for each bucket at most.
2. The gains, ``BUCKETS`` whole numbers whatever the corpus holds, are cut into bit planes of their
   magnitudes, one set for gains above zero and one for gains below.
3. A second pass counts each document's buckets again and cuts the counts into planes, too: bit ``b``
   of plane ``j`` is bit ``j`` of the count of bucket ``b``.  Every count plane is combined with every
   gain plane by AND, and the population counts times powers of two add up to the exact sum of gains.
4. A Gumbel variable drawn from a hash of the id is added to the floored mean; the highest sums are a
   draw without replacement.  They are ranked by a range partition and its partitions' sizes.

Defined cases: a null or wordless text has no feature and weight 0; a null id has no score, no rank
and is not among the documents to draw from; repeated rows are rows of their own, ties go to the
smaller id; a text longer than a step is counted in pieces that overlap by one word; extra columns
are ignored; an empty target gives gains against no counts; an empty corpus gives no row.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

BUCKETS = 10_000
SEED = 7
LEAST_WORDS = 20
PERCENT = 25
#: Words up to this many bytes are hashed side by side, longer ones one by one.
SHORT = 48

_SEPARATES = np.ones(256, bool)
_SEPARATES[48:58] = _SEPARATES[97:123] = _SEPARATES[128:] = False


# ---------------------------------------------------------------- CRC-32 of many words


def _byte_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


_TABLE = _byte_table()


def _zero_tables() -> np.ndarray:
    """``[n, k, b]``: what byte ``b`` at place ``k`` of a register becomes after ``n`` zero bytes."""
    out = np.zeros((SHORT + 1, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32)[:, None])
    for n in range(SHORT):
        out[n + 1] = _TABLE[out[n] & 255] ^ (out[n] >> 8)
    return out


_ZEROS = _zero_tables()


def _crc_words(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 of each word."""
    order = np.argsort(-size, kind="stable")
    n_long = int((size > SHORT).sum())
    order = order[n_long:]
    at, left = start[order], size[order]
    state = np.full(len(order), 0xFFFFFFFF, np.uint32)
    for i in range(int(left[0]) if len(left) else 0):
        m = int(np.searchsorted(-left, -i))  # words of more than i bytes
        s = state[:m]
        state[:m] = _TABLE[(s ^ raw[at[:m] + i]) & 255] ^ (s >> 8)
    out = np.empty(len(start), np.uint32)
    out[order] = ~state
    for w in np.flatnonzero(size > SHORT):
        out[w] = zlib.crc32(raw[start[w] : start[w] + size[w]].tobytes())
    return out


def _crc_pairs(raw: np.ndarray, start: np.ndarray, size: np.ndarray, crc: np.ndarray, first: np.ndarray) -> np.ndarray:
    """CRC-32 of the words ``first`` and ``first + 1`` with one space between."""
    left = ~crc[first]
    left = ~(_TABLE[(left ^ np.uint32(32)) & 255] ^ (left >> 8))
    second = first + 1
    n = np.minimum(size[second], SHORT)
    out = crc[second].copy()
    for k in range(4):
        out ^= _ZEROS[n, k, (left >> np.uint32(8 * k)) & 255]
    for p in np.flatnonzero(size[second] > SHORT):
        w = second[p]
        out[p] = zlib.crc32(raw[start[w] : start[w] + size[w]].tobytes(), int(left[p]))
    return out


# ---------------------------------------------------------------- features


def _features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and bucket of every feature of a run of texts, and each row's words."""
    raw = common._LOWER[raw]
    inside = ~_SEPARATES[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    start = np.flatnonzero(inside & (~np.concatenate([[False], inside[:-1]]) | edge[:-1]))
    size = np.flatnonzero(inside & (~np.concatenate([inside[1:], [False]]) | edge[1:])) + 1 - start
    row = np.searchsorted(offsets, start, side="right") - 1
    crc = _crc_words(raw, start, size)
    first = np.flatnonzero(row[1:] == row[:-1])
    pairs = _crc_pairs(raw, start, size, crc, first)
    bucket = np.concatenate([crc, pairs]) % np.uint32(BUCKETS)
    return np.concatenate([row, row[first]]), bucket.astype(np.int64), np.bincount(row, minlength=len(offsets) - 1)


def _pieces(raw: np.ndarray, limit: int) -> Iterator[tuple[int, int, int]]:
    """Ranges of one text, cut at ends of words: first byte, end, and the bytes it shares with the last."""
    inside = ~_SEPARATES[common._LOWER[raw]]
    start, shared = 0, 0
    while start < len(raw):
        end = min(len(raw), start + shared + limit)
        while end < len(raw) and inside[end - 1] and inside[end]:  # a word is never cut
            rest = np.flatnonzero(~inside[end : end + limit])
            end = min(len(raw), end + (int(rest[0]) if len(rest) else limit))
        yield start, end, shared
        if end == len(raw):
            return
        last = end
        while last > start and not inside[last - 1]:
            last -= 1
        begin = last
        while begin > start and inside[begin - 1]:
            begin -= 1
        start, shared = (end, 0) if begin == last else (begin, end - begin)


def counts(raw: np.ndarray, offsets: np.ndarray, step: int = common.STEP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For runs of rows: first row, end, bucket counts ``[row, bucket]``, and each row's words."""
    for i, j in common.steps(offsets, step):
        if j - i == 1 and offsets[j] - offsets[i] > step:  # a long text, in pieces
            text, total, n_words = raw[offsets[i] : offsets[j]], np.zeros(BUCKETS, np.int64), 0
            for a, b, shared in _pieces(text, step):
                _, bucket, n = _features(text[a:b], np.array([0, b - a]))
                total += np.bincount(bucket, minlength=BUCKETS)
                n_words += int(n[0])
                if shared:  # the word before was counted with the last piece
                    total[int(_features(text[a : a + shared], np.array([0, shared]))[1][0])] -= 1
                    n_words -= 1
            yield i, j, total[None, :], np.array([n_words])
            continue
        for a in range(i, j, 256):  # dense counts of few rows at a time
            b = min(j, a + 256)
            row, bucket, n = _features(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            yield a, b, np.bincount(row * BUCKETS + bucket, minlength=(b - a) * BUCKETS).reshape(b - a, BUCKETS), n


def bucket_counts(texts: DataFrame) -> DataFrame:
    """``bucket, n`` over all rows of the one column ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            raw, at = common.bytes_of(batch.column(0))
            for *_, c, _ in counts(raw, at):
                total += c.sum(axis=0)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    return texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: dict[int, int], target: dict[int, int]) -> np.ndarray:
    """Each bucket's gain in thousandths of a natural logarithm, rounded down."""
    size, aim = float(sum(corpus.values()) + BUCKETS), float(sum(target.values()) + BUCKETS)
    s, t = ([float(c.get(b, 0) + 1) for b in range(BUCKETS)] for c in (corpus, target))
    return np.array([math.floor(1000 * math.log(t[b] * size / (s[b] * aim))) for b in range(BUCKETS)], np.int64)


# ---------------------------------------------------------------- planes


def planes(values: np.ndarray) -> np.ndarray:
    """Bit planes of whole numbers >= 0: ``[plane, row, word]`` for ``values[row, bucket]``."""
    n = max(1, int(values.max(initial=0)).bit_length())
    values = values.astype(np.min_scalar_type(1 << n))
    width = -(-values.shape[1] // 64) * 8
    out = np.zeros((n, len(values), width), np.uint8)
    for j in range(n):
        bits = np.packbits((values & values.dtype.type(1 << j)) != 0, axis=1, bitorder="little")
        out[j, :, : bits.shape[1]] = bits
    return out.view(np.uint64)


def sums(count_planes: np.ndarray, plus: np.ndarray, minus: np.ndarray) -> np.ndarray:
    """Sum of count times gain for each row, from planes only."""
    total = np.zeros(count_planes.shape[1], np.int64)
    for sign, side in ((1, plus), (-1, minus)):
        for j, c in enumerate(count_planes):
            for k, g in enumerate(side):
                total += sign * (np.bitwise_count(c & g).sum(axis=1, dtype=np.int64) << (j + k))
    return total


def weights(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """``doc_id, n_words, n_features, weight`` of every row of ``docs(doc_id, text)``."""
    plus, minus = (planes(np.maximum(side, 0)[None, :]) for side in (gain, -gain))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            raw, at = common.bytes_of(batch.column(1))
            n_words, total = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for i, j, c, n in counts(raw, at):
                n_words[i:j], total[i:j] = n, sums(planes(c), plus, minus)
            n_features = n_words + np.maximum(n_words - 1, 0)
            mean = total // np.maximum(n_features, 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words), pa.array(n_features), pa.array(mean)], names=["doc_id", "n_words", "n_features", "weight"]
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


# ---------------------------------------------------------------- the draw


def noise(key, seed: int = SEED):
    """A standard Gumbel variable in thousandths, rounded down, from the first 32 bits of a SHA-256."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256)
    unit = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.log(-F.log(unit))).cast("long")


def ranked(rows: DataFrame, *order) -> DataFrame:
    """All rows with their ``rank`` in ``order``; no task holds more than a range."""
    placed = common.stored(rows.repartitionByRange(common.parts(rows), *order).withColumn("part", F.spark_partition_id()), "ranges")
    sizes = placed.groupBy("part").agg(F.count("*").alias("n"))  # a row for each partition
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    within = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    starts = sizes.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    numbered = placed.withColumn("within", within).join(starts, "part")
    return numbered.withColumn("rank", F.col("before") + F.col("within")).drop("part", "within", "before")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, rank``: every document, the drawn ones with a rank."""
    corpus, aim = ({r.bucket: r.n for r in bucket_counts(x).collect()} for x in (docs, target))  # BUCKETS rows at most
    scored = common.stored(
        weights(docs, gains(corpus, aim)).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "resampling-scores"
    )
    may = (F.col("n_words") >= least_words) & F.col("doc_id").isNotNull()
    draw = scored.where(may).count() * percent // 100
    placed = ranked(scored.where(may), F.desc("score"), F.col("doc_id"), F.col("n_features"), F.col("weight"))
    drawn = placed.withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank")))
    return drawn.unionByName(scored.where(~may).withColumn("rank", F.lit(None).cast("long")))


def op12_bit_sliced(spark: SparkSession, root: str) -> DataFrame:
    """All documents weighed against the benchmark's texts, a quarter of the longer ones drawn."""
    out = resample(common.table(spark, root, "documents"), common.table(spark, root, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


#: DuckDB: the same weights and draw, with a CRC-32 of its own.
SQL = """
WITH crc AS (
  SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b)) AS t),
texts AS (SELECT true AS doc, doc_id AS id, text FROM documents UNION ALL SELECT false, item_id, text FROM benchmark),
w AS MATERIALIZED (
  SELECT doc, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM texts),
f AS MATERIALIZED (
  SELECT doc, id, feature, count(*) AS n FROM (
    SELECT doc, id, unnest(w) AS feature FROM w
    UNION ALL
    SELECT doc, id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w)
  GROUP BY ALL),
h AS MATERIALIZED (
  SELECT feature, CAST(xor(list_reduce(list_transform(range(len(x) // 2), lambda i: CAST('0x' || x[2 * i + 1 : 2 * i + 2] AS BIGINT)),
    lambda c, y: xor(t[(xor(c, y) & 255) + 1], c >> 8), 4294967295), 4294967295) % 10000 AS BIGINT) AS bucket
  FROM (SELECT DISTINCT feature, hex(encode(feature)) AS x FROM f), crc),
c AS MATERIALIZED (SELECT doc, id, bucket, n FROM f JOIN h USING (feature)),
b AS (
  SELECT bucket, sum(n) FILTER (doc) AS s, sum(n) FILTER (NOT doc) AS t FROM c GROUP BY bucket),
z AS (SELECT CAST(coalesce(sum(n) FILTER (doc), 0) AS DOUBLE) AS s, CAST(coalesce(sum(n) FILTER (NOT doc), 0) AS DOUBLE) AS t FROM c),
g AS MATERIALIZED (
  SELECT bucket, CAST(floor(1000 * ln((coalesce(b.t, 0)::DOUBLE + 1) * (z.s + 10000) / ((coalesce(b.s, 0)::DOUBLE + 1) * (z.t + 10000)))) AS BIGINT) AS gain FROM b, z),
d AS (SELECT id, sum(n) AS n, sum(n * gain) AS total FROM c JOIN g USING (bucket) WHERE doc GROUP BY id),
e AS (
  SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_features,
    CAST(CASE WHEN n IS NULL THEN 0 WHEN total >= 0 THEN total // n ELSE -((n - 1 - total) // n) END AS BIGINT) AS weight,
    CAST('0x' || left(sha256('7:' || doc_id), 8) AS BIGINT) AS h
  FROM documents LEFT JOIN d ON id = doc_id),
s AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM e),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM s WHERE n_features >= 39)
SELECT s.*, CASE WHEN rank <= 25 * n // 100 THEN rank END AS rank FROM s LEFT JOIN r USING (doc_id)
"""
