"""What the operators share: storage, word hashes over Arrow buffers, grouped streams, components."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import tables
from ..sources.tables import forgotten  # noqa: F401

#: Bytes of text that one vectorized step handles; whole documents, so a longer one is a step of its own.
STEP_BYTES = 1 << 20


# ---------------------------------------------------------------- storage

_LOCAL: dict[str, str] = {}


def shared_path(spark: SparkSession, purpose: str) -> str:
    """A fresh folder in the store that driver and executors share (``spark.checkpoint.dir``)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:  # a local session without one, as in tests
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = _LOCAL.setdefault("base", tempfile.mkdtemp(prefix="llm-"))
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


#: Bytes of an Arrow batch.  Spark's 64 MB are held twice by the JVM, while its buffers double, and once more by the worker.
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def light_batches(spark: SparkSession) -> None:
    """Rows go to Python in batches of ``BATCH`` bytes, unless the session has a size of its own."""
    if spark.conf.get(BATCH[0], None) is None:
        spark.conf.set(*BATCH)


def stored(df: DataFrame, purpose: str, rows: int | None = None, free: bool = False) -> DataFrame:
    """Write once, read back: cuts lineage, and a lost executor costs a re-read only.

    With ``rows``, about how many light rows there are, the last stage has only as many tasks as these need.
    With ``free`` the shuffle files of this query go at its end.
    """
    light_batches(df.sparkSession)
    path = shared_path(df.sparkSession, purpose)
    if rows is not None:
        df = df.coalesce(tasks_for(rows, df))
    with tables.freed(df.sparkSession) if free else contextlib.nullcontext():
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, n: int, purpose: str) -> DataFrame:
    """``stored`` in ``n`` Spark buckets by ``key``, see ``sources.tables``."""
    light_batches(df.sparkSession)
    return tables.bucketed(df, key, n, purpose)


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root.rstrip('/')}/{name}.parquet")


def parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


# ---------------------------------------------------------------- Arrow columns


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string or binary column and the offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    if column.null_count:
        column = column.fill_null(b"" if kind == pa.large_binary() else "")
    column = column.cast(kind)
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def steps(offsets: np.ndarray, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes each; rows are never cut."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def blobs(arrays: list[bytes]) -> pa.Array:
    return pa.array(arrays, pa.binary())


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[object, pa.Table]]:
    """Runs of equal ``key`` in batches that arrive sorted by it; a run may span batches."""
    held: list[pa.Table] = []
    held_key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        keys = rows[key].to_numpy()
        cut = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
        for a, b in zip(cut[:-1], cut[1:]):
            if held and keys[a] != held_key:
                yield held_key, pa.concat_tables(held)
                held = []
            held_key = keys[a]
            held.append(rows.slice(a, b - a))
    if held:
        yield held_key, pa.concat_tables(held)


# ---------------------------------------------------------------- words

_SEED = np.random.default_rng(20240601)
_BYTE = _SEED.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(int(_P), -1, 2**64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS: dict[str, np.ndarray] = {"p": np.ones(1, np.uint64), "i": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["p"]) < n:
        m = max(n, STEP_BYTES + 1)
        for k, base in (("p", _P), ("i", _P_INV)):
            a = np.full(m, base, np.uint64)
            a[0] = 1
            _POWERS[k] = np.multiply.accumulate(a)
    return _POWERS["p"][:n], _POWERS["i"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def words(raw: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a run of texts; ``space`` marks other separating bytes.

    Returns the 64-bit hash of each word (A-Z lower-cased), the first word of each text (n + 1
    entries), and each word's first and end byte.
    """
    n = len(raw)
    docs = len(offsets) - 1
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(docs + 1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~space[raw]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True  # a text's end ends its last word
    before = np.concatenate([[False], inside[:-1]])
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.concatenate([inside[1:], [False]])
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    p, inv = _powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[_LOWER[raw]] * p[:n], out=total[1:])
    hashed = mix((total[end] - total[start]) * inv[start] + (end - start).astype(np.uint64))
    return hashed, np.searchsorted(start, offsets), start, end


_SHIFT = (_SEED.integers(1, 2**63, 64, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def grams(hashed: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each window of ``k`` words that lies within one text, and the window's first word."""
    n = len(hashed)
    if n < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    m = n - k + 1
    ok = np.ones(m, bool)
    for back in range(1, k):  # windows that begin less than k words before a text's end
        at = first[1:] - back
        ok[at[(at >= 0) & (at < m)]] = False
    if k <= 8:
        out = np.zeros(m, np.uint64)
        for j in range(k):
            out += hashed[j : j + m] * _SHIFT[j]
    else:  # rolling by prefix sums, so the cost does not grow with k
        p, inv = _powers(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(hashed * p[:n], out=total[1:])
        out = (total[k:] - total[:m]) * inv[:m]
    at = np.flatnonzero(ok)
    return mix(out[at] + np.uint64(k)), at


# ---------------------------------------------------------------- joins

#: Ways that the rows of one key are dealt to before a join with one row for each key.
SALTS = 32


def salted_join(rows: DataFrame, one: DataFrame, key: str, by) -> DataFrame:
    """``rows`` with the columns of ``one``, which has one row for each ``key``; null joins null.

    Each row of ``one`` is repeated ``SALTS`` times and ``by`` deals the rows, so that no task has a hot key's rows alone.
    """
    deals = one.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnRenamed(key, "salted_key")
    dealt = rows.withColumn("salt", F.pmod(by, F.lit(SALTS)).cast("int"))
    on = dealt[key].eqNullSafe(deals["salted_key"]) & (dealt["salt"] == deals["salt"])
    return dealt.join(deals, on).drop(deals["salt"]).drop("salt", "salted_key")


# ---------------------------------------------------------------- components


def tasks_for(rows: int, df: DataFrame, each: int = 50_000) -> int:
    """Tasks for light rows: one for each ``each`` of them, at most the session's shuffle partitions."""
    return max(1, min(parts(df), -(-rows // each)))


def components(edges: DataFrame, purpose: str = "components", rows: int | None = None, rounds: int = 64) -> DataFrame:
    """Connected components of ``edges(a, b)``: ``(id, component)``, the component being its smallest id.

    Alternates large-star and small-star steps; each round is written to the shared store.
    Both steps aggregate with a partial minimum, so a hub with very many links is no hot task.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both if large else both.where("b < a")
        least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        joined = near.join(least, "a")
        if large:
            out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    def state(e: DataFrame):
        """Edges, and nodes that are not yet simply a component's root or a child of it."""
        ends = e.select(F.col("a").alias("v"), F.lit(1).alias("child"), F.lit(0).alias("root")).union(
            e.select("b", F.lit(0), F.lit(1))
        )
        nodes = ends.groupBy("v").agg(F.sum("child").alias("child"), F.sum("root").alias("root"))
        open_node = (F.col("child") > 1) | ((F.col("child") > 0) & (F.col("root") > 0))
        return nodes.agg(F.coalesce(F.sum("child"), F.lit(0)).alias("edges"), F.count_if(open_node).alias("open")).first()

    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), purpose, rows)
    for _ in range(rounds):
        at = state(now)
        if not at.open:
            break
        now = stored(star(star(now, True), False), purpose, at.edges)
    else:
        raise RuntimeError(f"components are unfinished after {rounds} rounds")
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(
        now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    )


# ---------------------------------------------------------------- SQL

#: DuckDB: the words of every document, as ``words`` has them.
WORDS_SQL = (
    "w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    "'[^\\x20\\x09-\\x0D]+') AS ws FROM documents)"
)
