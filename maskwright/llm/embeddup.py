"""Operator 11: near duplicates of embeddings, by int8 tile products with error bounds.

Vectors are compared only with vectors of the same label, by cosine.

1. Equal vectors of a label are one node with its number of copies; copies link with each other and
   share all other links, so none of their pairs is ever formed.
2. A node's direction ``u`` is stored as int8 components ``q`` and one step ``s``, with the length
   ``e`` of the error ``u - s q`` and the length ``m`` of ``s q``.  For two nodes
   ``|cos - s s' (q . q')| <= m e' + e m' + e e'``, whatever the vectors are.
3. Nodes are dealt to blocks of about ``BLOCK`` rows, within a label by the nearest of a few pivots.  A
   block keeps the range of its angles to every pivot: two blocks whose ranges are farther apart than
   the threshold's angle can hold no link, and their rows never meet.
4. Blocks that may hold links are multiplied tile by tile.  The bound decides most pairs; only those
   that it leaves open are computed again, in double precision on the original vectors.
5. Links are counted where they are found, weighted with copies: a pair of blocks sends one row for
   each node that has a link, with the count and the node that stands for its part of the links.
   The rows are added up, and classes are the connected components of those stand-in edges.

Every pair that the threshold admits is linked.  The work grows with the square of the different
vectors of a label, less what step 3 rules out; rows of a block travel once for each other block.

Defined cases: a null label, a null id, and vectors that are null, empty, zero, or hold null or
non-finite components link with nothing: no links, a class of their own (of a null id: no class),
kept (of a null id: null).  Vectors of different lengths are not compared.  Repeated rows are copies,
repeated ids with different vectors are vectors of their own.  Norms neither overflow nor vanish, as
the largest component is divided out first.  Extra columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

COSINE = 0.93
BLOCK = 2048
#: Rows of a tile, pivots, and pairs that one exact step computes.
TILE = 512
PIVOTS = 32
EXACT = 1 << 14
#: Room for rounding in bounds and angles; far above that of double precision.
ROUNDING = 1e-9


# ---------------------------------------------------------------- int8 codes


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Directions, int8 codes, steps, code lengths and error lengths of the rows of ``x``."""
    u = x / np.abs(x).max(axis=1, keepdims=True)
    u /= np.sqrt((u * u).sum(axis=1, keepdims=True))
    step = np.abs(u).max(axis=1) / 127
    code = np.rint(u / step[:, None])
    near = code * step[:, None]
    return u, code.astype(np.int8), step, np.sqrt((near**2).sum(axis=1)), np.sqrt(((u - near) ** 2).sum(axis=1))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of int8 rows: single precision holds sums of up to 1,024 of them."""
    out = np.zeros((len(a), len(b)))
    for k in range(0, a.shape[1], 1024):
        out += a[:, k : k + 1024].astype(np.float32) @ b[:, k : k + 1024].astype(np.float32).T
    return out


def components_of(vec: pa.Array, kind: str) -> np.ndarray:
    """Rows of one length in double precision."""
    raw, at = common.bytes_of(vec)
    return np.frombuffer(raw.tobytes(), kind).reshape(len(at) - 1, -1).astype(np.float64)


class Side:
    """The rows of a block."""

    def __init__(self, rows: pa.Table, kind: str):
        self.node = rows["node"].to_numpy()
        self.copies = rows["copies"].to_numpy()
        x = components_of(rows["vec"], kind)
        self.u, self.code, self.step, self.length, self.error = quantised(x)

    def cosines(self, i: np.ndarray, other: Side, j: np.ndarray) -> np.ndarray:
        return np.concatenate([(self.u[i[k : k + EXACT]] * other.u[j[k : k + EXACT]]).sum(axis=1) for k in range(0, len(i), EXACT)] or [np.zeros(0)])


def links(a: Side, b: Side, least: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows ``i`` of ``a`` and ``j`` of ``b`` with a cosine of ``least`` or more; within a block each pair both ways."""
    found_i, found_j = [], []
    for p in range(0, len(a.node), TILE):
        for q in range(0, len(b.node), TILE):
            r, s = slice(p, p + TILE), slice(q, q + TILE)
            about = products(a.code[r], b.code[s]) * (a.step[r, None] * b.step[None, s])
            room = a.length[r, None] * b.error[None, s] + a.error[r, None] * (b.length[None, s] + b.error[None, s]) + ROUNDING
            maybe = about + room >= least
            if same:
                maybe &= np.arange(p, p + maybe.shape[0])[:, None] != np.arange(q, q + maybe.shape[1])[None, :]
            i, j = np.nonzero(maybe)
            open_ = np.flatnonzero(about[i, j] - room[i, j] < least)
            keep = np.ones(len(i), bool)
            keep[open_] = a.cosines(i[open_] + p, b, j[open_] + q) >= least
            found_i.append(i[keep] + p)
            found_j.append(j[keep] + q)
    return np.concatenate(found_i), np.concatenate(found_j)


def stand_ins(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """For nodes 0 to n - 1 with links ``i - j``: the least node that each one reaches."""
    lead = np.arange(n)
    while True:
        before = lead.copy()
        low = np.minimum(lead[i], lead[j])
        np.minimum.at(lead, i, low)
        np.minimum.at(lead, j, low)
        lead = lead[lead]
        if (lead == before).all():
            return lead


# ---------------------------------------------------------------- blocks in Spark


def prepared(table: DataFrame, key: str, column: str, label: str) -> tuple[DataFrame, str]:
    """``vec_id, label, vec`` of every row, ``vec`` null if it takes no part; and the components' binary kind."""
    kind = "<f4" if table.schema[column].dataType.elementType.simpleString() == "float" else "<f8"
    v = F.col(column).cast(f"array<{'float' if kind == '<f4' else 'double'}>")
    rows = table.select(F.col(key).cast("long").alias("vec_id"), F.col(label).alias("label"), v.alias("v"))
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    part = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & fine & F.exists("v", lambda c: c != 0)
    label_type = rows.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(2)
            flat = v.flatten().to_numpy(zero_copy_only=False).astype(kind) + np.zeros(1, kind)  # -0.0 equals 0.0
            at = np.concatenate([[0], np.cumsum(v.value_lengths().fill_null(0).to_numpy())])
            vec = [flat[a:b].tobytes() if ok else None for a, b, ok in zip(at[:-1], at[1:], v.is_valid().to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(vec, pa.binary())], names=["vec_id", "label", "vec"])

    return rows.withColumn("v", F.when(part, F.col("v"))).mapInArrow(run, f"vec_id long, label {label_type}, vec binary"), kind


def pivots_of(nodes: DataFrame, kind: str) -> dict[int, np.ndarray]:
    """Directions of ``PIVOTS`` nodes for each size of a vector, those of least hash.

    They decide only where rows lie, not what is compared; the ``PIVOTS`` most frequent sizes are served.
    """
    sizes = [r.n for r in nodes.groupBy(F.length("vec").alias("n")).count().orderBy(F.desc("count"), "n").limit(PIVOTS).collect()]
    out = {}
    for n in sizes:
        some = nodes.where(F.length("vec") == n).select(F.xxhash64("vec").alias("h"), "vec").orderBy("h").limit(PIVOTS).collect()
        out[n] = quantised(np.array([np.frombuffer(r.vec, kind) for r in some], np.float64))[0]
    return out


def _angles(vec: pa.Array, pivots: dict[int, np.ndarray], kind: str) -> np.ndarray:
    """Angles to the pivots; rows of a size without pivots have zeros."""
    out = np.zeros((len(vec), PIVOTS))
    size = pc.binary_length(vec).to_numpy()
    for n, p in pivots.items():
        at = np.flatnonzero(size == n)
        if len(at):
            u = quantised(components_of(vec.take(pa.array(at)), kind))[0]
            out[at, : len(p)] = np.arccos(np.clip(u @ p.T, -1, 1))
    return out


def blocked(nodes: DataFrame, pivots: dict[int, np.ndarray], kind: str, block: int) -> DataFrame:
    """``group, cell, deal`` of each node beside its columns, and its ``angles``.

    A label has about as many cells as it fills blocks, at most one for each pivot; a cell's rows are dealt by hash.
    """

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            angles = _angles(batch.column(batch.schema.get_field_index("vec")), pivots, kind)
            cells = np.minimum.accumulate(angles, axis=1)  # the least angle among the first k pivots
            nearest = np.where(angles == cells, np.arange(PIVOTS), 0)
            nearest = np.maximum.accumulate(nearest, axis=1).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(list(angles), pa.list_(pa.float64())), pa.array(list(nearest), pa.list_(pa.int32()))],
                names=[*batch.schema.names, "angles", "nearest"],
            )

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in nodes.schema)
    measured = nodes.mapInArrow(measure, f"{kinds}, angles array<double>, nearest array<int>")
    group = F.struct("label", F.length("vec").alias("size")).alias("group")
    sizes = nodes.groupBy(group).agg(F.count("*").alias("n")).select("group", F.least(F.lit(PIVOTS), F.ceil(F.col("n") / block)).cast("int").alias("cells"))
    placed = common.salted_join(measured.withColumn("group", group), sizes, "group", F.xxhash64("node")).withColumn("cell", F.element_at("nearest", F.col("cells")))
    placed = placed.select("group", "cell", *nodes.columns, "angles")
    cells = placed.groupBy(F.struct("group", "cell").alias("place")).agg(F.ceil(F.count("*") / block).cast("int").alias("deals"))
    dealt = common.salted_join(placed.withColumn("place", F.struct("group", "cell")), cells, "place", F.xxhash64("node"))
    return dealt.select("group", "cell", F.pmod(F.xxhash64("node", F.lit(1)), F.col("deals")).cast("int").alias("deal"), *nodes.columns, "angles")


def block_pairs(rows: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """Rows with their block's number within the group, and pairs of blocks ``i <= j`` that may hold links."""
    reach = math.acos(max(-1.0, min(1.0, least))) + 1e-6
    ends = [f(F.col("angles")[p]).alias(f"{n}{p}") for p in range(PIVOTS) for n, f in (("low", F.min), ("high", F.max))]
    metas = rows.groupBy("group", "cell", "deal").agg(*ends)
    number = F.row_number().over(Window.partitionBy("group").orderBy("cell", "deal"))  # a row for each block
    low, high = (F.array(*[F.col(f"{n}{p}") for p in range(PIVOTS)]).alias(n) for n in ("low", "high"))
    metas = common.stored(metas.select("group", "cell", "deal", (number - 1).alias("no"), low, high), "embedding-blocks")
    last = metas.groupBy("group").agg(F.max("no").alias("last"))
    firsts = metas.join(last, "group").select("group", F.col("no").alias("i"), F.col("low").alias("l"), F.col("high").alias("h"), F.explode(F.sequence("no", "last")).alias("no"))
    apart = F.array_max(F.zip_with(F.zip_with("l", "high", lambda x, y: x - y), F.zip_with("low", "h", lambda x, y: x - y), lambda x, y: F.greatest(x, y)))
    pairs = firsts.join(metas, ["group", "no"]).where(apart <= reach).select("group", "i", F.col("no").alias("j"))
    numbered = rows.join(metas.select("group", "cell", "deal", "no"), ["group", "cell", "deal"]).select("group", "no", "node", "copies", "vec")
    return numbered, pairs


def found_links(rows: DataFrame, pairs: DataFrame, kind: str, least: float) -> DataFrame:
    """``node, lead, links``: from each pair of blocks one row for each node that has a link there.

    ``links`` counts the rows linked, copies included; ``lead`` is one node of its part of the pair's links.
    """
    ways = pairs.select("group", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("no"))
    pair = F.xxhash64("group", "i", "j")
    met = ways.join(rows, ["group", "no"]).select(pair.alias("deal"), F.to_json(F.struct("group", "i", "j")).alias("pair"), (F.col("no") != F.col("i")).cast("int").alias("side"), "node", "copies", "vec")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in common.groups(batches, "pair"):
            side = rows["side"].to_numpy()
            cut = int(np.searchsorted(side, 1))
            a = Side(rows.slice(0, cut), kind)
            b = Side(rows.slice(cut), kind) if cut < len(side) else a
            i, j = links(a, b, least, a is b)
            if not len(i):
                continue
            n = len(a.node)
            if a is b:
                node, count = a.node, np.bincount(i, a.copies[j], n)
            else:
                node = np.concatenate([a.node, b.node])
                count = np.concatenate([np.bincount(i, b.copies[j], n), np.bincount(j, a.copies[i], len(b.node))])
                j = j + n
            lead = stand_ins(i, j, len(node))
            some = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays(
                [pa.array(node[some]), pa.array(node[lead[some]]), pa.array(count[some].astype(np.int64))], names=["node", "lead", "links"]
            )

    dealt = met.repartition(common.parts(rows), "deal").sortWithinPartitions("pair", "side")
    return dealt.select("pair", "side", "node", "copies", "vec").mapInArrow(run, "node long, lead long, links long")


def near_duplicates(table: DataFrame, least: float = COSINE, key: str = "vec_id", column: str = "embedding", label: str = "label", block: int = BLOCK) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of ``table``."""
    rows, kind = prepared(table, key, column, label)
    rows = common.stored(rows, "embedding-rows")
    part = rows.where(F.col("vec").isNotNull())
    alike = part.groupBy("label", "vec").agg(F.min("vec_id").alias("least_id"), F.count("*").alias("copies"))
    nodes = common.stored(alike.withColumn("node", F.monotonically_increasing_id()), "embedding-nodes")
    dealt = common.stored(blocked(nodes, pivots_of(nodes, kind), kind, block), "embedding-dealt")
    numbered, pairs = block_pairs(dealt, least)
    found = common.stored(found_links(numbered, pairs, kind, least), "embedding-links")
    edges = found.where("node <> lead").select(F.col("node").alias("a"), F.col("lead").alias("b"))
    member = common.components(edges, "embedding-components").withColumnRenamed("id", "node")
    ids = member.join(nodes.select("node", "least_id"), "node").groupBy("component").agg(F.min("least_id").alias("component_id"))
    member = common.salted_join(member, ids, "component", F.xxhash64("node")).select("node", "component_id")
    counted = found.groupBy("node").agg(F.sum("links").alias("links"))
    classes = nodes.join(counted, "node", "left").join(member, "node", "left").select(
        "label", "vec", F.coalesce("component_id", "least_id").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    linked = part.join(classes, ["label", "vec"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(F.col("vec").isNull()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op11_int8_tiles(spark: SparkSession, root: str) -> DataFrame:
    """All embeddings of equal label whose cosine is at least 0.93."""
    return near_duplicates(common.table(spark, root, "embeddings"))


#: DuckDB: the same links by comparing all pairs of a label.
SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93),
r(id, root) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, r.root FROM r JOIN l ON r.id = l.a),
c AS (SELECT id, min(root) AS component_id FROM r GROUP BY id),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings LEFT JOIN n ON a = vec_id LEFT JOIN c ON id = vec_id
"""
