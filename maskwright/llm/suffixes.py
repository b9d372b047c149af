"""Operator 1: repeated passages by a sparse suffix array.

A passage of ``MIN_WORDS`` words or more that occurs at two places is repeated (words as in
``common.words``, A-Z lower-cased).  Every window of ``MIN_WORDS`` words selects a minimiser: the
``SEED``-word run of least hash in it, the leftmost on a tie.  The choice depends on the window's
words only, so equal windows select the same run at the same place.

1. One scan keeps the suffixes at minimisers, about one for each twenty words.  A suffix carries the
   hash of its first ``SEED`` words and of its stretch: all words of the windows that selected it.
2. The suffixes are sorted over range partitions (ties by document and place, so a suffix that occurs
   very often fills many partitions) and compared with their neighbours; those alone are dropped.
   At a partition's edge a suffix is kept, because its neighbour is not in sight.
3. Equal stretches are one class, extended as a whole.  Where a suffix has several different
   stretches, one representative of each is extended left and right to the last common window, by
   hashes of its windows; this needs the text of those documents only.

The result is exact up to collisions of 64-bit hashes.  The first occurrence (least doc_id, then
place) of a passage stays; all other occurrences are ``first = false`` and may be cut.

Defined cases: texts with fewer words, null and empty texts have no passage; rows without doc_id are
left out; a row that is repeated with its doc_id counts as the same occurrence, so it is reported as a
first one; extra columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MIN_WORDS = 50
SEED = 11
_POSITION = np.uint64((1 << 24) - 1)
BLOCK = 1 << 22


def _rolling(hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums by which any run of words has a hash at once."""
    p, inv = common._powers(len(hashed) + 1)
    total = np.zeros(len(hashed) + 1, np.uint64)
    np.cumsum(hashed * p[: len(hashed)], out=total[1:])
    return total, inv


def run_hash(rolling: tuple[np.ndarray, np.ndarray], start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
    total, inv = rolling
    return common.mix((total[start + length] - total[start]) * inv[start] + np.uint64(7) * np.asarray(length).astype(np.uint64))


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values."""
    m = len(x) - width + 1
    if m <= 0:
        return x[:0]
    blocks = -(-len(x) // width)
    full = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    full[: len(x)] = x
    full = full.reshape(blocks, width)
    head = np.minimum.accumulate(full, axis=1).ravel()
    tail = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(tail[:m], head[width - 1 : width - 1 + m])


def minimisers(grams: np.ndarray, width: int, block: int = BLOCK) -> np.ndarray:
    """Leftmost position of the least value of each run of ``width``.

    Values carry their position in the low bits; blocks of runs number their own positions, so that
    texts of any length fit.
    """
    found = [np.zeros(0, np.int64)]
    for at in range(0, len(grams) - width + 1, block):
        part = grams[at : at + block + width - 1]
        tagged = (part & ~_POSITION) | np.arange(len(part), dtype=np.uint64)
        found.append((sliding_minimum(tagged, width) & _POSITION).astype(np.int64) + at)
    return np.concatenate(found)


def stretches(hashed: np.ndarray, first: np.ndarray, min_words: int = MIN_WORDS, seed: int = SEED):
    """Suffixes at minimisers: hash of the seed, hash of the stretch, text, first window (in its text), windows."""
    none = np.zeros(0, np.int64)
    empty = (none.view(np.uint64), none.view(np.uint64), none, none, none)
    n = len(hashed)
    if n < min_words:
        return empty
    rolling = _rolling(hashed)
    at = np.arange(n - seed + 1)
    grams = run_hash(rolling, at, seed)
    chosen = minimisers(grams, min_words - seed + 1)
    p = np.arange(len(chosen))
    doc = np.searchsorted(first, p, side="right") - 1
    inside = p + min_words <= first[doc + 1]
    p, doc, chosen = p[inside], doc[inside], chosen[inside]
    if not len(p):
        return empty
    new = np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (doc[1:] != doc[:-1])])
    head = np.flatnonzero(new)
    count = np.diff(np.append(head, len(p)))
    start = p[head]
    return grams[chosen[head]], run_hash(rolling, start, count + min_words - 1), doc[head], start - first[doc[head]], count


def suffix_table(docs: DataFrame, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """``key, stretch, doc_id, start, windows``; ``start`` is a word's position in its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = common.bytes_of(batch.column(1))
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for i, j in common.steps(at):
                hashed, first, _, _ = common.words(raw[at[i] : at[j]], at[i : j + 1] - at[i])
                key, stretch, doc, start, count = stretches(hashed, first, min_words, seed)
                if len(key):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(key.view(np.int64)), pa.array(stretch.view(np.int64)), pa.array(ids[i + doc].astype(np.int64)),
                            pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32)),
                        ],
                        names=["key", "stretch", "doc_id", "start", "windows"],
                    )

    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "key long, stretch long, doc_id long, start int, windows int")


def _with_neighbour(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a sorted partition whose key is a neighbour's key; its first and last rows always."""
    held: pa.Table | None = None
    alike = True  # the held row's link to the row before it
    for batch in batches:
        if not batch.num_rows:
            continue
        now = pa.Table.from_batches([batch])
        rows = now if held is None else pa.concat_tables([held, now])
        key = rows["key"].to_numpy()
        same = key[1:] == key[:-1]
        before = np.concatenate([[alike], same])
        keep = before[:-1] | same
        yield from rows.slice(0, len(key) - 1).filter(pa.array(keep)).combine_chunks().to_batches()
        held, alike = rows.slice(len(key) - 1), bool(before[-1])
    if held is not None:
        yield from held.combine_chunks().to_batches()


def window_hashes(docs: DataFrame, places: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``h, doc_id, start, several`` of each window at ``places(doc_id, start, windows, several)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = common.bytes_of(batch.column(1))
            ids = batch.column(0).to_numpy()
            for i, j in common.steps(at):
                hashed, first, _, _ = common.words(raw[at[i] : at[j]], at[i : j + 1] - at[i])
                rolling = _rolling(hashed)
                starts, counts, flags = (batch.column(c).slice(i, j - i) for c in (2, 3, 4))
                doc = np.repeat(np.arange(j - i), np.diff(starts.offsets.to_numpy()))
                a, m = (c.flatten().to_numpy().astype(np.int64) for c in (starts, counts))
                f = flags.flatten().to_numpy(zero_copy_only=False).astype(bool)
                inner = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                p, d = np.repeat(a, m) + inner, np.repeat(doc, m)
                if len(p):
                    h = run_hash(rolling, first[d] + p, min_words)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(h.view(np.int64)), pa.array(ids[i + d]), pa.array(p.astype(np.int32)), pa.array(np.repeat(f, m))],
                        names=["h", "doc_id", "start", "several"],
                    )

    listed = places.groupBy("doc_id").agg(F.collect_list(F.struct("start", "windows", "several")).alias("p")).select(
        "doc_id", *[F.col(f"p.{c}").alias(c) for c in ("start", "windows", "several")]
    )
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(listed.hint("merge"), "doc_id")
    return texts.select("doc_id", "text", "start", "windows", "several").mapInArrow(run, "h long, doc_id long, start int, several boolean")


def repeats(docs: DataFrame, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """Repeated passages ``doc_id, start_word, end_word, first``: merged spans of words, the end exclusive."""
    n = common.parts(docs)
    suffixes = common.stored(suffix_table(docs, min_words, seed), "suffixes")
    order = ["key", "stretch", "doc_id", "start"]
    near = common.stored(
        suffixes.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(_with_neighbour, suffixes.schema), "suffix-neighbours"
    )
    here = F.struct("doc_id", "start")
    classes = common.stored(
        near.groupBy("key", "stretch").agg(F.count("*").alias("n"), F.min(here).alias("f"), F.max("windows").alias("windows")), "suffix-classes"
    )
    split = classes.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key", F.lit(True).alias("split"))
    judged = common.stored(classes.join(split, "key", "left").where("n > 1 or split"), "suffix-judged")
    # stretches that occur again: later occurrences as a whole, and the first one where its suffix has no other stretch
    whole = near.join(judged.where("n > 1").select("key", "stretch", "f", "split"), ["key", "stretch"]).where((here != F.col("f")) | F.col("split").isNull()).select(
        "doc_id", "start", (F.col("start") + F.col("windows") - 1 + min_words).alias("end"), (here == F.col("f")).alias("first")
    )
    places = judged.where("split").select(F.col("f.doc_id").alias("doc_id"), F.col("f.start").alias("start"), "windows", (F.col("n") > 1).alias("several"))
    windows = common.stored(window_hashes(docs, places, min_words), "suffix-windows")
    again = windows.groupBy("h").agg(F.count("*").alias("n"), F.min(here).alias("f")).where("n > 1").select("h", "f")
    single = windows.join(again, "h", "left").where("f is not null or several").select(
        "doc_id", "start", (F.col("start") + min_words).alias("end"), F.coalesce(here == F.col("f"), F.lit(True)).alias("first")
    )
    spans = whole.union(single).groupBy("doc_id", "first").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("s"))
    return spans.select("doc_id", "first", F.explode(_merged("s")).alias("s")).select(
        "doc_id", F.col("s.start").alias("start_word"), F.col("s.end").alias("end_word"), "first"
    )


def _merged(column: str):
    """Sorted spans with touching or overlapping ones joined."""
    none = F.array().cast("array<struct<start:int,end:int>>")
    state = F.struct(none.alias("done"), F.lit(None).cast("struct<start:int,end:int>").alias("open"))

    def step(s, x):
        apart = s["open"].isNotNull() & (x["start"] > s["open"]["end"])
        done = F.when(apart, F.concat(s["done"], F.array(s["open"]))).otherwise(s["done"])
        joined = F.struct(s["open"]["start"].alias("start"), F.greatest(s["open"]["end"], x["end"]).alias("end"))
        fresh = F.struct(x["start"].alias("start"), x["end"].alias("end"))
        return F.struct(done.alias("done"), F.when(s["open"].isNull() | apart, fresh).otherwise(joined).alias("open"))

    return F.aggregate(column, state, step, lambda s: F.concat(s["done"], F.array(s["open"])))


def without_repeats(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``docs`` with all but the first occurrences cut from the texts; ``n_chars`` follows, if there is one.

    A cut reaches from the passage's first word to the next word that stays.  A document that loses
    its last word goes; rows without doc_id stay as they are.
    """
    names = docs.columns
    key, text = names.index("doc_id"), names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = common.bytes_of(batch.column(text))
            cuts = batch.column(len(names)).to_pylist()
            texts, alive = [], []
            for i, j in common.steps(at):
                part = raw[at[i] : at[j]]
                _, first, start, _ = common.words(part, at[i : j + 1] - at[i])
                data, ends = part.tobytes(), at[i : j + 1] - at[i]
                for d in range(j - i):
                    spans, a, b = cuts[i + d], int(ends[d]), int(ends[d + 1])
                    if not spans:
                        texts.append(None)
                        alive.append(True)
                        continue
                    w, out, left = int(first[d]), [], int(first[d + 1] - first[d])
                    for s in sorted(spans, key=lambda s: s["start_word"]):
                        out.append(data[a : start[w + s["start_word"]]])
                        stop = w + s["end_word"]
                        a = int(start[stop]) if stop < first[d + 1] else b
                        left -= s["end_word"] - s["start_word"]
                    out.append(data[a:b])
                    texts.append(b"".join(out).decode("utf-8"))
                    alive.append(left > 0)
            changed = pa.array([t is not None for t in texts])
            new = pc.if_else(changed, pa.array(texts, pa.string()), batch.column(text).cast(pa.string()))
            columns = [new if k == text else batch.column(k) for k in range(len(names))]
            if "n_chars" in names:
                k = names.index("n_chars")
                columns[k] = pc.if_else(changed, pc.utf8_length(new).cast(columns[k].type), columns[k])
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(alive))

    listed = spans.where("not first").groupBy("doc_id").agg(F.collect_list(F.struct("start_word", "end_word")).alias("_cuts"))
    return docs.join(listed.withColumnRenamed("doc_id", "_cut_id").hint("merge"), docs["doc_id"] == F.col("_cut_id"), "left").select(*names, "_cuts").mapInArrow(run, docs.schema)


def op1_sparse_suffixes(spark: SparkSession, root: str) -> DataFrame:
    """Passages of fifty words or more that occur again in the documents."""
    return repeats(common.table(spark, root, "documents"))


SQL = (
    f"WITH {common.WORDS_SQL}, "
    f"p AS (SELECT doc_id, ws, unnest(range(1, len(ws) - {MIN_WORDS - 2})) AS p FROM w), "
    f"v AS (SELECT doc_id, p, hash(array_to_string(ws[p:p + {MIN_WORDS - 1}], ' ')) AS h FROM p), "
    "again AS (SELECT h, min((doc_id, p)) AS f FROM v GROUP BY h HAVING count(*) > 1), "
    "hits AS (SELECT doc_id, p, (doc_id, p) = f AS first FROM v JOIN again USING (h)), "
    f"steps AS (SELECT *, CASE WHEN p - lag(p) OVER o <= {MIN_WORDS} THEN 0 ELSE 1 END AS new FROM hits WINDOW o AS (PARTITION BY doc_id, first ORDER BY p)), "
    "runs AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, first ORDER BY p) AS run FROM steps) "
    f"SELECT doc_id, CAST(min(p) - 1 AS INTEGER) AS start_word, CAST(max(p) - 1 + {MIN_WORDS} AS INTEGER) AS end_word, first FROM runs GROUP BY doc_id, first, run"
)
