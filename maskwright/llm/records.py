"""Operator 3: token ids as length-delimited binary records with a separate offset index.

A file is a run of records; a record is

    length   8 bytes, little-endian: bytes of the payload
    check    4 bytes: masked CRC-32 of those 8 bytes
    payload  1 byte of flags (1: the document has an id, 2: wide), 8 bytes signed id, then each
             token id in 2 bytes, or in 4 where a document has an id of 65,536 or more (wide)
    check    4 bytes: masked CRC-32 of the payload

The mask turns a CRC right by 15 bits and adds a constant, so that the check of data that
hold checks is still a check.  The index (Parquet: ``file, at, size, doc_id, n_tokens``)
allows reads in any order.

Each task writes one file below a temporary name and renames it when it is complete, so a
repeated task replaces its own file by an equal one.

Defined cases: null text is empty (one end id); null doc_id comes first and is kept; repeated
rows give repeated records, ordered by text hash; an empty table gives an empty index and no file;
extra columns are not written.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, tokens

_DELTA = 0xA282EAD8


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + _DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return b"".join((size, struct.pack("<I", masked(size)), payload, struct.pack("<I", masked(payload))))


def unframed(stream) -> Iterator[tuple[int, bytes]]:
    """Records of an open file with their offsets; damage raises ``ValueError``."""
    at = 0
    while head := stream.read(12):
        if len(head) < 12 or struct.unpack("<I", head[8:])[0] != masked(head[:8]):
            raise ValueError(f"damaged length at {at}")
        (size,) = struct.unpack("<Q", head[:8])
        body = stream.read(size + 4)
        if len(body) < size + 4 or struct.unpack("<I", body[size:])[0] != masked(body[:size]):
            raise ValueError(f"damaged record at {at}")
        yield at, body[:size]
        at += size + 16


def record_at(uri: str, at: int) -> bytes:
    """One record, by its offset from the index."""
    fs, path = pafs.FileSystem.from_uri(uri)
    with fs.open_input_file(path) as f:
        f.seek(at)
        return next(unframed(f))[1]


def write_records(docs: DataFrame, folder: str, tokenizer: str, key: str = "doc_id", text: str = "text", files: int | None = None) -> DataFrame:
    """Encode every text and write record files below ``folder`` (a URI) in ascending key order; returns the index."""
    spark = docs.sparkSession

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        fs, root = pafs.FileSystem.from_uri(folder)
        name = f"part-{task.partitionId():07d}.rec"
        fs.create_dir(f"{root}/_writing", recursive=True)
        draft = f"{root}/_writing/{name}-{task.taskAttemptId()}"
        out, at = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            out = out or fs.open_output_stream(draft)
            rows = []
            ids = batch.column(0).to_pylist()
            for k, body in zip(ids, tokens.encoded(batch.column(1).to_pylist(), tokenizer)):
                record = frame(payload(k, body))
                out.write(record)
                rows.append((name, at, len(record), k, len(body) // 4))
                at += len(record)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()))],
                names=["file", "at", "size", "doc_id", "n_tokens"],
            )
        if out:
            out.close()
            fs.move(draft, f"{root}/{name}")

    n = files or common.parts(docs)
    ordered = (
        docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
        .withColumn("tie", F.xxhash64("text"))
        .repartitionByRange(n, F.asc_nulls_first("doc_id"), "tie")
        .sortWithinPartitions(F.asc_nulls_first("doc_id"), "tie")
        .select("doc_id", "text")
    )
    index = ordered.mapInArrow(write, "file string, at long, size long, doc_id long, n_tokens long")
    index.write.parquet(f"{folder}/_index")
    return spark.read.schema(index.schema).parquet(f"{folder}/_index")


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """Read the files back, checking every record: ``doc_id, start, n_tokens, ids_crc32, file, at``.

    ``start`` counts the ids of all documents before; file totals come from the index, one row
    for each file, and are summed in file order.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = []
                with fs.open_input_stream(f"{root}/{name}", buffer_size=1 << 20) as f:
                    for at, body in unframed(f):
                        k, ids = parsed(body)
                        rows.append((k, start, len(ids), zlib.crc32(ids.tobytes()), name, at))
                        start += len(ids)
                        if len(rows) == 10_000:
                            yield _rows(rows)
                            rows = []
                if rows:
                    yield _rows(rows)

    files = index.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return (
        files.select("file", before.cast("long").alias("start"))
        .repartition(common.parts(index), "file")
        .mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, file string, at long")
    )


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["doc_id", "start", "n_tokens", "ids_crc32", "file", "at"]
    )


def payload(key: int | None, ids: bytes) -> bytes:
    """A document's payload; ``ids`` are little-endian unsigned 32-bit integers."""
    array = np.frombuffer(ids, "<u4")
    wide = len(array) > 0 and int(array.max()) >= 1 << 16
    return struct.pack("<Bq", (key is not None) + 2 * wide, key or 0) + (ids if wide else array.astype("<u2").tobytes())


def parsed(body: bytes) -> tuple[int | None, np.ndarray]:
    """Key and token ids (unsigned 32-bit) of a payload."""
    flags, key = struct.unpack_from("<Bq", body)
    return key if flags & 1 else None, np.frombuffer(body, "<u4" if flags & 2 else "<u2", offset=9).astype("<u4")


def op3_token_records(spark: SparkSession, root: str) -> DataFrame:
    """All documents as record files in the shared store, read back from there."""
    import public_tokenizers

    folder = common.shared_path(spark, "token-records")
    if "://" not in folder and not folder.startswith("file:"):
        folder = f"file://{folder}"
    index = write_records(common.table(spark, root, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return read_records(index, folder).select("doc_id", "start", "n_tokens", "ids_crc32")
