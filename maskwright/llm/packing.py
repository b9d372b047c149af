"""Operator 10: packing by concatenation and cutting.

Pass 1 encodes each partition once and writes ids with the running count in the partition;
the totals (one row for each partition) are summed in partition order into global offsets.
Pass 2 cuts the endless sequence into windows of ``width`` ids.  A document that crosses a
window's edge gives several pieces; the pieces are the boundary records.  Texts and ids are
never shuffled, and only the last sequence is shorter than ``width``.

Defined cases: null or empty text gives one piece of one end id; null doc_id is kept; repeated
rows give pieces of their own; an empty table gives no piece; extra columns are dropped.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, tokens

WIDTH = 1024


def token_table(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, part, before, n, ids``: ids as unsigned 16-bit integers where they fit, else 32-bit (``wide``)."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            for sub in _slices(batch):
                ids = [np.frombuffer(b, "<u4") for b in tokens.encoded(sub.column(1).to_pylist(), tokenizer)]
                wide = any(int(x.max()) >= 1 << 16 for x in ids)
                n = np.array([len(x) for x in ids], np.int64)
                before = total + np.cumsum(n) - n
                total += int(n.sum())
                yield pa.RecordBatch.from_arrays(
                    [
                        sub.column(0), pa.array(np.full(len(n), part, np.int32)), pa.array(before), pa.array(n),
                        pa.array(np.full(len(n), wide)), common.blobs([x.astype("<u4" if wide else "<u2").tobytes() for x in ids]),
                    ],
                    names=["doc_id", "part", "before", "n", "wide", "ids"],
                )

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        encode, "doc_id long, part int, before long, n long, wide boolean, ids binary"
    )


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    _, at = common.bytes_of(batch.column(1))
    for i, j in common.steps(at):
        yield batch.slice(i, j - i)


def pack(docs: DataFrame, tokenizer: str, width: int = WIDTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces ``doc_id, start, length, ids, doc_tokens, sequence_id, offset``; ``ids`` is little-endian unsigned 32-bit."""
    held = common.stored(token_table(docs, tokenizer, key, text), "packing")
    totals = held.groupBy("part").agg(F.sum("n").alias("t"))
    before = F.coalesce(F.sum("t").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # one row of 12 bytes for each input split, so its size is bounded by the number of tasks
    offsets = F.broadcast(totals.select("part", before.cast("long").alias("first")))
    placed = held.join(offsets, "part").select(
        "doc_id", "n", "wide", "ids", (F.col("first") + F.col("before")).alias("g")
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for k, n, wide, ids, g in zip(*(c.to_pylist() for c in batch.columns)):
                body = memoryview(np.frombuffer(ids, "<u4" if wide else "<u2").astype("<u4").tobytes())
                a = 0
                while a < n:
                    sequence, offset = divmod(g + a, width)
                    m = min(n - a, width - offset)
                    rows.append((k, a, m, bytes(body[4 * a : 4 * (a + m)]), n, sequence, offset))
                    a += m
                if len(rows) >= 5_000:
                    yield _pieces(rows)
                    rows = []
            if rows:
                yield _pieces(rows)

    return placed.mapInArrow(cut, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, pa.binary() if name == "ids" else pa.int64()) for c, name in zip(zip(*rows), names)], names=names
    )


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op10_concatenate_and_cut(spark: SparkSession, root: str) -> DataFrame:
    """All documents as sequences of 1024 ids; one row for each piece."""
    import public_tokenizers

    return digest(pack(common.table(spark, root, "documents"), public_tokenizers.path("byte_bpe_50k.json")))
