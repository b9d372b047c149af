"""Operator 13: vector codes by parts, from k-means over anchors-hierarchy metric trees.

Components become whole numbers, vectors are cut into ``PARTS`` parts, and each part position has a
codebook of ``ENTRIES`` entries.  All arithmetic that decides anything is exact.

1. Each task builds, once, a metric tree over the parts of each position of a block of ``BLOCK``
   vectors, middle out: anchors are picked one after the other, each the point farthest from the
   anchor with the largest radius, and take over the points that are nearer to them; an anchor's
   points are sorted by distance, so those within half the distance between two anchors are never
   looked at.  The anchors are merged pair by pair into a tree, and each anchor's points become a tree
   of their own in the same way.  A ball caches the sum and the count of its points.
2. A round sends the codebooks to the blocks.  From the root down a ball inherits the entries that may
   own some of its points, and strikes out those that its nearest entry beats everywhere in the ball:
   ``|p-c|^2 - |p-b|^2 > 2 r |c-b|`` for pivot ``p``, radius ``r``, nearest ``b``.  A ball with one entry
   left adds its cached sum and count at once; leaves compare what is left, point by point.
3. The sums of a task, one row for each entry and position at most, are added up in Spark, and each
   entry becomes the rounded-down mean.  After ``ROUNDS`` rounds a last descent gives the codes.

The trees are stored below ``spark.checkpoint.dir`` and read in each round; no round shuffles vectors.

Defined cases: rows whose vector is null, empty, or holds null or non-finite components are dropped,
and so are vectors of another length than most (of equally frequent lengths the shorter stays);
a length that the parts do not divide is an error, and so are components so large that a squared
distance could leave 63 bits; fewer vectors than entries give as many entries; repeated rows are rows
of their own, but an id seeds one entry, by its least vector; a null id seeds none; ties go to the
lower index; extra columns are ignored; an empty table, and one without any id, gives no row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
#: Vectors of one block of trees, and points that a ball must have to be cut.
BLOCK = 2048
LEAF = 24


# ---------------------------------------------------------------- whole numbers


def whole(table: DataFrame, key: str = "vec_id", column: str = "embedding", label: str = "label", scale: int = SCALE) -> tuple[DataFrame, int]:
    """``vec_id, label, x``: the components as rounded-down multiples of ``1 / scale``; and how many."""
    rows = table.select(F.col(key).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(column).cast("array<double>").alias("v"))
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = rows.where(F.col("v").isNotNull() & (F.size("v") > 0) & fine)
    sizes = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows"), F.max(F.array_max(F.transform("v", F.abs))).alias("most"))
    most = sizes.orderBy(F.desc("rows"), "n").first()
    if most is None:
        return rows.select("vec_id", "label", F.col("v").cast("array<long>").alias("x")), 0
    if most.n * (2 * (most.most * scale + 1)) ** 2 >= 2.0**62:
        raise ValueError(f"components up to {most.most} are too large for exact distances in 63 bits")
    return rows.where(F.size("v") == most.n).select("vec_id", "label", F.transform("v", lambda c: F.floor(c * scale)).alias("x")), most.n


def first_entries(rows: DataFrame, dim: int, parts: int = PARTS, entries: int = ENTRIES) -> np.ndarray:
    """``[part, entry, component]``: the parts of the vectors of the least ids."""
    ids = [r.vec_id for r in rows.where(F.col("vec_id").isNotNull()).select("vec_id").distinct().orderBy("vec_id").limit(entries).collect()]
    least = rows.where(F.col("vec_id").isin(ids)).groupBy("vec_id").agg(F.min("x").alias("x")).orderBy("vec_id").collect()
    flat = np.array([r.x for r in least], np.int64).reshape(len(least), parts, dim // parts)
    return np.ascontiguousarray(flat.transpose(1, 0, 2))


# ---------------------------------------------------------------- anchors hierarchy


def _far(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    d = x - p
    return (d * d).sum(axis=1)


class Tree:
    """Balls over points: ``pivot, radius, total, count, first, end`` (places in ``order``) and children.

    Every ball's points are a run of ``order``; ``left`` is -1 at a leaf.
    """

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points, self.leaf = points, leaf
        self.pivot: list[np.ndarray] = []
        self.radius: list[float] = []
        self.total: list[np.ndarray] = []
        self.count: list[int] = []
        self.children: list[tuple[int, int]] = []
        self.members: list[np.ndarray | None] = []
        self.root = self._build(np.arange(len(points)))

    def _ball(self, ids: np.ndarray | None, total: np.ndarray, count: int, children: tuple[int, int]) -> int:
        """A ball around the rounded mean; its radius reaches all points, exactly or by its children's balls."""
        pivot = total // count
        if ids is not None:
            radius = float(np.sqrt(_far(self.points[ids], pivot).max()))
        else:
            radius = max(float(np.sqrt(((self.pivot[c] - pivot) ** 2).sum())) + self.radius[c] for c in children)
        self.pivot.append(pivot)
        self.radius.append(radius * (1 + 1e-12) + 1e-9)
        self.total.append(total)
        self.count.append(count)
        self.children.append(children)
        self.members.append(ids)
        return len(self.pivot) - 1

    def anchors(self, ids: np.ndarray, k: int) -> list[np.ndarray]:
        """The points of up to ``k`` anchors, each with its nearest one."""
        x = self.points[ids]
        d = _far(x, x[0])
        order = np.argsort(-d, kind="stable")
        owned, far, centre = [order], [d[order]], [0]  # by anchor: its points, farthest first
        while len(owned) < k:
            widest = max(range(len(owned)), key=lambda a: far[a][0])
            if far[widest][0] == 0:
                break
            new = int(owned[widest][0])
            gain, gain_d = [], []
            for a in range(len(owned)):
                apart = int(((x[centre[a]] - x[new]) ** 2).sum())
                if not apart:
                    continue
                # nearer to its anchor than half the way to the new one: cannot change hands
                n = int(np.searchsorted(-4 * far[a], -apart, side="left"))
                if not n:
                    continue
                d_new = _far(x[owned[a][:n]], x[new])
                moves = d_new < far[a][:n]
                gain.append(owned[a][:n][moves])
                gain_d.append(d_new[moves])
                stay = np.concatenate([~moves, np.ones(len(owned[a]) - n, bool)])
                owned[a], far[a] = owned[a][stay], far[a][stay]
            points, dist = np.concatenate(gain), np.concatenate(gain_d)
            order = np.argsort(-dist, kind="stable")
            owned.append(points[order])
            far.append(dist[order])
            centre.append(new)
        return [ids[o] for o in owned]

    def _build(self, ids: np.ndarray) -> int:
        if len(ids) > self.leaf:
            found = self.anchors(ids, max(2, int(np.sqrt(len(ids)))))
            if len(found) > 1:
                return self._merge([self._build(f) for f in found])
        return self._ball(ids, self.points[ids].sum(axis=0), len(ids), (-1, -1))

    def _merge(self, nodes: list[int]) -> int:
        """Joins the two balls that fit into the smallest ball, until one is left."""
        nodes = list(nodes)
        pivot = np.array([self.pivot[n] for n in nodes], np.float64)
        radius = np.array([self.radius[n] for n in nodes])

        def widths(i: int) -> np.ndarray:
            apart = np.sqrt(((pivot - pivot[i]) ** 2).sum(axis=1))
            out = np.maximum((apart + radius + radius[i]) / 2, np.maximum(radius, radius[i]))
            out[i] = np.inf
            return out

        width = np.array([widths(i) for i in range(len(nodes))])
        for _ in range(len(nodes) - 1):
            i, j = divmod(int(width.argmin()), len(nodes))
            a, b = nodes[i], nodes[j]
            nodes[i] = self._ball(None, self.total[a] + self.total[b], self.count[a] + self.count[b], (a, b))
            pivot[i], radius[i] = self.pivot[nodes[i]], self.radius[nodes[i]]
            width[j, :] = width[:, j] = np.inf
            alive = np.isfinite(width[i])
            w = np.where(alive, widths(i), np.inf)
            width[i, :] = width[:, i] = w
        return nodes[i] if len(nodes) > 1 else nodes[0]

    def laid_out(self) -> dict[str, np.ndarray]:
        """Arrays in depth-first order: a ball's points are a run of ``order``, its left child follows it."""
        n, d = len(self.pivot), self.points.shape[1]
        out = {
            "pivot": np.empty((n, d), np.int64), "radius": np.empty(n), "total": np.empty((n, d), np.int64), "count": np.empty(n, np.int64),
            "first": np.empty(n, np.int64), "right": np.full(n, -1, np.int64),
        }
        order, stack, at, place = [], [(self.root, -1)], 0, 0
        while stack:
            node, parent = stack.pop()
            if parent >= 0:
                out["right"][parent] = at
            out["pivot"][at], out["radius"][at], out["total"][at] = self.pivot[node], self.radius[node], self.total[node]
            out["count"][at], out["first"][at] = self.count[node], place
            if self.members[node] is not None:
                order.append(self.members[node])
                place += len(self.members[node])
            else:
                left, right = self.children[node]
                stack += [(right, at), (left, -1)]
            at += 1
        return out | {"order": np.concatenate(order)}


def descend(tree: dict[str, np.ndarray], points: np.ndarray, entries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Whole balls with their one entry, and single points: ``(kind, index, entry)`` batches.

    ``kind`` is "ball" (index: balls) or "point" (index: rows of ``points``).
    """
    balls, open_ = np.zeros(1, np.int64), np.ones((1, len(entries)), bool)
    span = np.sqrt(((entries[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2).astype(np.float64))
    while len(balls):
        gap = tree["pivot"][balls][:, None, :] - entries[None, :, :]
        d = np.where(open_, (gap * gap).sum(axis=2), np.iinfo(np.int64).max)
        best = d.argmin(axis=1)
        lead = (d - d[np.arange(len(balls)), best][:, None]).astype(np.float64)
        # struck out only if beaten at every point of the ball, with room for rounding
        open_ &= ~(lead > 2 * tree["radius"][balls][:, None] * span[best] * (1 + 1e-9) + 1e-6)
        one = open_.sum(axis=1) == 1
        if one.any():
            yield "ball", balls[one], open_[one].argmax(axis=1)
        balls, open_ = balls[~one], open_[~one]
        leaf = tree["right"][balls] < 0
        if leaf.any():
            at, left = balls[leaf], open_[leaf]
            size = tree["count"][at]
            of = np.repeat(np.arange(len(at)), size)
            place = np.repeat(tree["first"][at] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
            rows = tree["order"][place]
            step = max(1, (1 << 20) // len(entries))
            for a in range(0, len(rows), step):
                row, entry = np.nonzero(left[of[a : a + step]])
                dist = _far(points[rows[a : a + step][row]], entries[entry])
                head = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
                least = np.minimum.reduceat(dist, head)
                hit = np.flatnonzero(dist == np.repeat(least, np.diff(np.append(head, len(row)))))
                hit = hit[np.concatenate([[True], row[hit][1:] != row[hit][:-1]])]  # ties: the lower index
                yield "point", rows[a : a + step][row[hit]], entry[hit]
        inner, open_ = balls[~leaf], open_[~leaf]
        balls = np.concatenate([inner + 1, tree["right"][inner]])
        open_ = np.concatenate([open_, open_])


# ---------------------------------------------------------------- blocks in Spark

_FIELDS = (("points", "<i4"), ("pivot", "<i8"), ("radius", "<f8"), ("total", "<i8"), ("count", "<i4"), ("first", "<i4"), ("right", "<i4"), ("order", "<i4"))


def blocks(rows: DataFrame, dim: int, parts: int = PARTS, size: int = BLOCK) -> DataFrame:
    """One row for each block of ``rows(vec_id, label, x)``: ids, labels, and by part position the points and their tree."""
    width = dim // parts
    label = rows.schema["label"].dataType.simpleString()

    def emit(rows: pa.Table) -> pa.RecordBatch:
        x = rows["x"].combine_chunks().flatten().to_numpy().reshape(rows.num_rows, dim)
        trees = []
        for p in range(parts):
            points = np.ascontiguousarray(x[:, p * width : (p + 1) * width])
            trees.append(Tree(points).laid_out() | {"points": points})
        return pa.RecordBatch.from_arrays(
            [
                *[pa.ListArray.from_arrays(pa.array([0, rows.num_rows], pa.int32()), rows[c].combine_chunks()) for c in ("vec_id", "label")],
                *[pa.array([[t[f].astype(kind).tobytes() for t in trees]], pa.list_(pa.binary())) for f, kind in _FIELDS],
            ],
            names=["vec_ids", "labels", *[f for f, _ in _FIELDS]],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
            while held.num_rows >= size:
                yield emit(held.slice(0, size))
                held = held.slice(size)
        if held is not None and held.num_rows:
            yield emit(held)

    schema = f"vec_ids array<long>, labels array<{label}>, " + ", ".join(f"{f} array<binary>" for f, _ in _FIELDS)
    return rows.select("vec_id", "label", "x").mapInArrow(run, schema)


def _trees(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, int, np.ndarray, dict[str, np.ndarray]]]:
    """Row of the batch, part position, points and tree."""
    for r in range(batch.num_rows):
        cells = {f: batch.column(f)[r].values for f, _ in _FIELDS}
        for part in range(len(cells["points"])):
            tree = {f: np.frombuffer(cells[f][part].as_buffer(), kind) for f, kind in _FIELDS}
            tree = {f: a if f == "radius" else a.astype(np.int64) for f, a in tree.items()}
            tree |= {f: tree[f].reshape(-1, width) for f in ("points", "pivot", "total")}
            yield r, part, tree.pop("points"), tree


def round_sums(trees: DataFrame, books: np.ndarray) -> DataFrame:
    """``part, entry, n, s0, s1, ...``: count and component sums of what each entry owns."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)

        def sums() -> pa.RecordBatch:
            part, entry = np.nonzero(n)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(n[part, entry]),
                    pa.array(total[part, entry].tolist(), pa.list_(pa.int64())),
                ],
                names=["part", "entry", "n", "total"],
            )

        held = 0
        for batch in batches:
            for row, part, points, tree in _trees(batch, width):
                for kind, index, entry in descend(tree, points, books[part]):
                    np.add.at(n[part], entry, tree["count"][index] if kind == "ball" else 1)
                    np.add.at(total[part], entry, tree["total"][index] if kind == "ball" else points[index])
                held += len(points)
            if held >= 1 << 31:  # components are below 2**30, so a sum stays within 63 bits
                yield sums()
                n[:], total[:], held = 0, 0, 0
        yield sums()

    some = trees.mapInArrow(run, "part int, entry int, n long, total array<long>")
    exact = [F.sum(F.col("total")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(width)]
    return some.groupBy("part", "entry").agg(F.sum("n").alias("n"), *exact)


def moved(trees: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round; what comes back is one row for each entry and position at most."""
    out = books.copy()
    for r in round_sums(trees, books).collect():
        out[r.part, r.entry] = [int(r[f"s{i}"]) // r.n for i in range(books.shape[2])]
    return out


def coded(trees: DataFrame, books: np.ndarray) -> DataFrame:
    """``vec_id, label, code, error`` of every vector, from one more descent."""
    width = books.shape[2]
    label = trees.schema["labels"].dataType.elementType.simpleString()
    digits = np.frombuffer("".join(f"{e:02x}" for e in range(256)).encode(), "S2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                ids, labels = (batch.column(c)[r].values for c in ("vec_ids", "labels"))
                codes, error = np.empty((len(ids), len(books)), np.int64), np.zeros(len(ids), np.int64)
                for _, part, points, tree in _trees(batch.slice(r, 1), width):
                    for kind, index, entry in descend(tree, points, books[part]):
                        if kind == "point":
                            codes[index, part] = entry
                            continue
                        size = tree["count"][index]
                        place = np.repeat(tree["first"][index] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
                        codes[tree["order"][place], part] = np.repeat(entry, size)
                    error += _far(points, books[part][codes[:, part]])
                text = np.ascontiguousarray(digits[codes]).view(f"S{2 * len(books)}").ravel()
                yield pa.RecordBatch.from_arrays(
                    [ids, labels, pa.array(text.astype(str)), pa.array(error)], names=["vec_id", "label", "code", "error"]
                )

    return trees.mapInArrow(run, f"vec_id long, label {label}, code string, error long")


def codebooks_sha256(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(table: DataFrame, key: str = "vec_id", column: str = "embedding", label: str = "label") -> tuple[DataFrame, np.ndarray]:
    """``vec_id, label, code, error`` of every kept row, and the codebooks ``[part, entry, component]``."""
    rows, dim = whole(table, key, column, label)
    if dim % PARTS:
        raise ValueError(f"{PARTS} equal parts cannot be cut from {dim} components")
    books = first_entries(rows, dim) if dim else np.zeros((PARTS, 0, 0), np.int64)
    if not books.size:  # nothing to seed with
        none = rows.where(F.lit(False)).select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
        return none, books
    trees = common.stored(blocks(rows, dim), "part-trees")
    for _ in range(ROUNDS):
        books = moved(trees, books)
    return coded(trees, books), books


def op13_anchors_codes(spark: SparkSession, root: str) -> DataFrame:
    """Codes of all embeddings, their errors, the errors summed by label, and the codebooks' digest."""
    codes, books = compress(common.table(spark, root, "embeddings"))
    codes = common.stored(codes, "part-codes")
    sums = codes.groupBy("label").agg(F.sum("error").alias("label_error"))
    out = common.salted_join(codes, sums, "label", F.xxhash64("vec_id", "code"))
    return out.select("vec_id", "code", "error", "label_error", F.lit(codebooks_sha256(books)).alias("codebooks_sha256"))


_SQL_HEAD = """WITH k AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (
  SELECT vec_id, label, part, list_slice(x, part * len(x) // 16 + 1, (part + 1) * len(x) // 16) AS y FROM k, (SELECT unnest(range(16)) AS part)),
b0 AS MATERIALIZED (
  SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, y FROM p
  WHERE vec_id IN (SELECT vec_id FROM k ORDER BY vec_id LIMIT 64))"""
_SQL_ASSIGN = """,
a{t} AS MATERIALIZED (
  SELECT vec_id, p.label, p.part, min(64 * list_sum(list_transform(range(1, len(p.y) + 1), lambda i: (p.y[i] - b.y[i]) * (p.y[i] - b.y[i]))) + entry) AS best
  FROM p JOIN b{t} b ON b.part = p.part GROUP BY vec_id, p.label, p.part)"""
_SQL_MOVE = """,
s{t} AS (
  SELECT part, entry, i, sum(y[i]) AS s, count(*) AS n
  FROM (SELECT a.part, best % 64 AS entry, y, unnest(range(1, len(y) + 1)) AS i FROM a{t} a JOIN p ON p.vec_id = a.vec_id AND p.part = a.part)
  GROUP BY part, entry, i),
m{t} AS (SELECT part, entry, list(CASE WHEN s >= 0 THEN s // n ELSE -((n - 1 - s) // n) END ORDER BY i) AS y FROM s{t} GROUP BY part, entry),
b{u} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.y, b.y) AS y FROM b{t} b LEFT JOIN m{t} m ON m.part = b.part AND m.entry = b.entry)"""
_SQL_TAIL = """,
c AS (
  SELECT vec_id, label, string_agg(printf('%02x', CAST(best % 64 AS INTEGER)), '' ORDER BY part) AS code, CAST(sum(best // 64) AS BIGINT) AS error
  FROM a2 GROUP BY vec_id, label)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY part, entry, i))
   FROM (SELECT part, entry, unnest(y) AS v, unnest(range(len(y))) AS i FROM b2)) AS codebooks_sha256
FROM c
"""

#: DuckDB: the same rounds, with every distance computed.
SQL = _SQL_HEAD + "".join(_SQL_ASSIGN.format(t=t) + (_SQL_MOVE.format(t=t, u=t + 1) if t < ROUNDS else "") for t in range(ROUNDS + 1)) + _SQL_TAIL
