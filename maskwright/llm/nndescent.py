"""Operator 9: approximate nearest neighbours by NN-descent and greedy graph search.

Nearness is the largest inner product.  Vectors are kept apart in bands, inside which norms differ by
a factor of two at most, so that single long vectors do not blur the others.  Each band has a graph of
its own, built on vectors that are scaled to norm one at most and lengthened by one component that makes
all norms of the band equal: the nearest by angle are then the nearest by inner product for any query.
Every query searches every band, and the exact scores of all that it found are ranked together; its
work grows with the number of bands that hold vectors.

1. Equal vectors are one node: its least id, and the ``k + 1`` least of its ids (no answer needs more).
2. Random sign codes deal the nodes into groups of at most ``GROUP``; inside a group all pairs are
   compared.  The best ``DEGREE`` of ``TABLES`` deals are the first graph.
3. Each round joins every node with a sample of its neighbours and of the nodes it is a neighbour of,
   compares those among each other, and keeps what improves a list.  Rounds end when fewer than
   ``SETTLED`` of all edges change, at most after ``ROUNDS``.
4. A query starts at its own node, in its own band, and at fixed ones of each band, by norm and by hash:
   ``ENTRIES`` of them, or ``SPREAD`` for each node on the square root of the band's size if that is more.
   All are scored for every query, so that groups which no edge connects are entered, too.  Each hop expands its ``BEAM`` best nodes that were not expanded yet, along edges
   of either direction, and keeps the best ``k + KEEP``; hops go on until the best nodes of all queries
   are expanded.  What is kept is scored exactly at the end.

Every row is indexed; the samples in step 3 only decide which pairs are tried.  The recall against
brute force is measured by the tests.

Defined cases: vectors that are null, zero, of another length than most, or hold null or non-finite
components take no part, neither as query nor as candidate; a repeated vec_id with one vector is one
candidate; of different vectors with one vec_id, the one whose bytes come first stands for it; ties go
to the smaller vec_id; extra columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

K = 20
DEGREE = 20
TABLES = 4
GROUP = 128
SAMPLE = 14
ROUNDS = 5
SETTLED = 0.01
ENTRIES = 32
SPREAD = 16
BEAM = 8
KEEP = 44


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    raw, at = common.bytes_of(column)
    return np.frombuffer(raw.tobytes(), kind).reshape(len(at) - 1, -1) if len(at) > 1 else np.zeros((0, 1), kind)


def vectors(table: DataFrame, key: str = "vec_id", column: str = "embedding") -> tuple[DataFrame, str]:
    """``vec_id, vec, norm`` of the rows that take part, and the components' binary kind."""
    rows = table.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("vec_id"), F.col(column).alias("v"))
    double = rows.schema["v"].dataType.elementType.simpleString() != "float"
    kind = "<f8" if double else "<f4"
    sizes = rows.groupBy(F.size("v").alias("n")).count().where("n > 0").orderBy(F.desc("count"), "n").first()
    rows = rows.where(F.size("v") == (sizes.n if sizes else -1)).select("vec_id", F.col("v").cast(f"array<{'double' if double else 'float'}>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = batch.column(1).flatten()
            x = flat.to_numpy(zero_copy_only=False).astype(kind).reshape(batch.num_rows, -1)  # null is NaN
            most = np.abs(x).max(axis=1).astype(np.float64)
            ok = np.isfinite(most) & (most > 0)
            norm = np.zeros(len(x))
            norm[ok] = most[ok] * np.sqrt(((x[ok] / most[ok, None]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(pa.array(ok)), common.blobs([r.tobytes() for r in x[ok]]), pa.array(norm[ok])], names=["vec_id", "vec", "norm"]
            )

    some = rows.mapInArrow(run, "vec_id long, vec binary, norm double")
    one = some.groupBy("vec_id").agg(F.min(F.struct("vec", "norm")).alias("v"))
    return one.select("vec_id", "v.vec", "v.norm"), kind


def nodes_of(rows: DataFrame, keep: int) -> DataFrame:
    """Distinct vectors ``id, vec, norm, band, ids``; only the ``keep`` least ids of a vector travel."""
    rank = F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))
    least = rows.withColumn("rank", rank).where(F.col("rank") <= keep)
    nodes = least.groupBy("vec").agg(F.min("vec_id").alias("id"), F.first("norm").alias("norm"), F.sort_array(F.collect_list("vec_id")).alias("ids"))
    return nodes.select("id", "vec", "norm", F.floor(F.log2("norm") + 0.5).cast("int").alias("band"), "ids")


def _scaled(nodes: DataFrame, most: dict[int, float], kind: str) -> DataFrame:
    """``id, band, x``: the lengthened vectors in half precision, for building the graph only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                limit = np.array([most[b] for b in batch.column(2).to_numpy().tolist()])
                v = _matrix(batch.column(1), kind).astype(np.float64) / limit[:, None]
                rest = np.sqrt(np.maximum(0, 1 - (v**2).sum(axis=1)))
                x = np.concatenate([v, rest[:, None]], axis=1).astype("<f2")
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(2), common.blobs([r.tobytes() for r in x])], names=["id", "band", "x"]
                )

    return nodes.select("id", "vec", "band").mapInArrow(run, "id long, band int, x binary")


def _first_edges(scaled: DataFrame, n: int, counts: dict[int, int]) -> DataFrame:
    """``a, b, sim`` inside the groups of each deal; a group lies in one band."""
    bits = {band: max(0, int(np.ceil(np.log2(max(1, count / (GROUP / 2)))))) for band, count in counts.items()}
    width = max(1, *bits.values(), 1)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(2), "<f2").astype(np.float32)
            used = np.arange(width) < np.array([bits[b] for b in batch.column(1).to_numpy().tolist()])[:, None]
            for t in range(TABLES):
                planes = np.random.default_rng(900 + t).standard_normal((x.shape[1], width)).astype(np.float32)
                codes = ((x @ planes > 0) & used) @ (1 << np.arange(width, dtype=np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(codes * TABLES + t), *batch.columns], names=["code", "id", "band", "x"])

    coded = common.stored(scaled.mapInArrow(code, "code long, id long, band int, x binary"), "graph-codes", sum(counts.values()))
    sizes = coded.groupBy("band", "code").agg(F.count("*").alias("size"))
    salt = F.pmod(F.xxhash64("id"), F.ceil(F.col("size") / GROUP))
    dealt = coded.join(sizes, ["band", "code"]).select(F.xxhash64("band", "code", salt).alias("code"), "id", "band", "x")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in common.groups(batches, "code"):
            for part in _by_band(rows):
                if part.num_rows > 1:
                    yield from _best(part["id"].to_numpy(), _matrix(part["x"], "<f2").astype(np.float32), None)

    return dealt.repartition(n, "code").sortWithinPartitions("code").mapInArrow(compare, "a long, b long, sim float")


def _by_band(rows: pa.Table) -> Iterator[pa.Table]:
    band = rows["band"].to_numpy()
    for b in np.unique(band):
        yield rows.filter(pa.array(band == b))


def _best(ids: np.ndarray, x: np.ndarray, bound: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """The best ``DEGREE`` others of each row, above the row's bound if it has one."""
    sim = x @ x.T
    sim[ids[:, None] == ids[None, :]] = -np.inf
    k = min(DEGREE, len(ids) - 1)
    top = np.argpartition(-sim, k - 1, axis=1)[:, :k] if k < len(ids) else np.argsort(-sim, axis=1)[:, :k]
    row = np.repeat(np.arange(len(ids)), k)
    col = top.ravel()
    s = sim[row, col]
    ok = s > (-np.inf if bound is None else bound[row])
    if ok.any():
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[row[ok]]), pa.array(ids[col[ok]]), pa.array(s[ok].astype(np.float32))], names=["a", "b", "sim"]
        )


def _lists(edges: DataFrame, n: int) -> DataFrame:
    """The best ``DEGREE`` different neighbours of each node; ``fresh`` are those that ``edges`` marks new."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole(batches):
            a, b, s, new = (batch[c].to_numpy() for c in ("a", "b", "sim", "fresh"))
            order = np.lexsort((new, -s, b, a))  # an old edge before its new copy
            a, b, s, new = a[order], b[order], s[order], new[order]
            once = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
            head = np.flatnonzero(once)
            new = np.minimum.reduceat(new, head)
            a, b, s = a[once], b[once], s[once]
            order = np.lexsort((b, -s, a))
            a, b, s, new = a[order], b[order], s[order], new[order]
            start = np.concatenate([[True], a[1:] != a[:-1]])
            rank = np.arange(len(a)) - np.flatnonzero(start)[np.cumsum(start) - 1]
            ok = rank < DEGREE
            yield pa.RecordBatch.from_arrays(
                [pa.array(a[ok]), pa.array(b[ok]), pa.array(s[ok]), pa.array(rank[ok].astype(np.int32)), pa.array(new[ok])],
                names=["a", "b", "sim", "rank", "fresh"],
            )

    return edges.repartition(n, "a").sortWithinPartitions("a").mapInArrow(run, "a long, b long, sim float, rank int, fresh int")


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches sorted by ``a``, cut so that no list is split."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        rows = rows if held is None else pa.concat_tables([held, rows])
        a = rows["a"].to_numpy()
        cut = int(np.searchsorted(a, a[-1]))
        if cut:
            yield rows.slice(0, cut)
        held = rows.slice(cut)
    if held is not None and held.num_rows:
        yield held


def build_graph(scaled: DataFrame, counts: dict[int, int]) -> DataFrame:
    """``a, b, sim, rank``: up to ``DEGREE`` neighbours of each node in its band, best first."""
    n, count = common.parts(scaled), sum(counts.values())
    fresh = F.lit(1).cast("int").alias("fresh")
    graph = common.stored(_lists(_first_edges(scaled, n, counts).select("a", "b", "sim", fresh), n), "graph", count * DEGREE)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in common.groups(batches, "v"):
            if rows.num_rows > 1:
                yield from _best(rows["m"].to_numpy(), _matrix(rows["x"], "<f2").astype(np.float32), rows["bound"].to_numpy())

    for turn in range(ROUNDS):
        last = graph.where(F.col("rank") == DEGREE - 1).select(F.col("a").alias("id"), F.col("sim").alias("bound"))
        known = scaled.drop("band").join(last, "id", "left").select(F.col("id").alias("m"), "x", F.coalesce("bound", F.lit(-2.0).cast("float")).alias("bound"))
        pick = F.xxhash64("a", "b", F.lit(turn))
        some = [
            graph.select(F.col(p).alias("v"), F.col(q).alias("m"), F.row_number().over(Window.partitionBy(p).orderBy(F.desc("fresh"), pick)).alias("r"))
            .where(F.col("r") <= SAMPLE).select("v", "m")
            for p, q in (("a", "b"), ("b", "a"))
        ]
        near = some[0].union(some[1]).distinct().join(known, "m").select("v", "m", "x", "bound")
        found = near.repartition(n, "v").sortWithinPartitions("v").mapInArrow(meet, "a long, b long, sim float")
        old = graph.select("a", "b", "sim", F.lit(0).cast("int").alias("fresh"))
        graph = common.stored(_lists(old.union(found.select("a", "b", "sim", fresh)), n), "graph", count * DEGREE)
        counts = graph.agg(F.sum("fresh").alias("new"), F.count("*").alias("all")).first()
        if (counts.new or 0) < SETTLED * (counts.all or 1):
            break
    return graph.select("a", "b", "sim", "rank")


def slots(counts: dict[int, int]) -> dict[int, int]:
    """Slots of each band from which two entries are taken, one by norm and one by hash."""
    return {band: max(ENTRIES // 2, int(np.ceil(SPREAD / 2 * np.sqrt(count)))) for band, count in counts.items()}


def search(queries: DataFrame, scaled: DataFrame, graph: DataFrame, entries: dict[int, list[tuple[int, bytes]]], kind: str, keep: int) -> DataFrame:
    """Greedy search in every band: ``query_id, band, vec, ids``, the best ``keep`` nodes found there.

    ``queries`` has ``query_id, node, home, vec``, the query's own node and its band; ``entries`` are
    further start nodes of each band with their vectors.
    """
    n = common.parts(scaled)
    back = graph.select(F.col("b").alias("node"), F.col("a").alias("b"), F.row_number().over(Window.partitionBy("b").orderBy(F.desc("sim"), "a")).alias("r"))
    count = graph.count()
    edges = common.stored(
        graph.select(F.col("a").alias("node"), "b").union(back.where(F.col("r") <= DEGREE).select("node", "b")).distinct(), "graph-edges", count
    )
    flat = scaled.select(F.col("id").alias("b"), "x")
    schema = "query_id long, band int, vec binary, ids array<long>, scores array<double>, done array<boolean>, next array<long>"
    none = {"ids": "array<long>", "scores": "array<double>", "done": "array<boolean>"}
    everywhere = queries.withColumn("band", F.explode(F.array(*[F.lit(b) for b in sorted(entries)]).cast("array<int>")))
    start = F.when(F.col("band") == F.col("home"), F.array("node")).otherwise(F.array().cast("array<long>"))
    state = everywhere.select("query_id", "band", "vec", *[F.array().cast(t).alias(c) for c, t in none.items()], start.alias("next"))
    sent = queries.sparkSession.sparkContext.broadcast(
        {band: (np.array([i for i, _ in some], np.int64), np.array([np.frombuffer(x, "<f2") for _, x in some])) for band, some in entries.items()}
    )

    def hop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for rows in (part for _, rows in common.groups(batches, "query_id") for part in _by_band(rows)):
            held = rows["vec"].is_valid().to_numpy()
            at = int(np.argmax(held))
            one = {c: rows[c][at].as_py() for c in ("query_id", "band", "vec", "ids", "scores", "done")}
            q = np.frombuffer(one["vec"], kind).astype(np.float64)
            q = q / np.abs(q).max()
            q = np.append(q / np.sqrt((q**2).sum()), 0)
            ids, scores, done = (np.array(one[c], t) for c, t in (("ids", np.int64), ("scores", np.float64), ("done", bool)))
            new = rows.filter(pa.array(~held))
            b = new["b"].to_numpy()
            x = _matrix(new["x"], "<f2").astype(np.float64) if len(b) else np.zeros((0, len(q)))
            if not len(ids):
                if one["band"] not in starts:
                    entry_ids, entry_x = sent.value[one["band"]]
                    starts[one["band"]] = entry_ids, entry_x.astype(np.float64)
                entry_ids, entry_x = starts[one["band"]]
                b, x = np.concatenate([b, entry_ids]), np.concatenate([x, entry_x])
            b, first = np.unique(b, return_index=True)
            fresh = ~np.isin(b, ids)
            ids, scores = np.concatenate([ids, b[fresh]]), np.concatenate([scores, x[first[fresh]] @ q])
            done = np.concatenate([done, np.zeros(int(fresh.sum()), bool)])
            order = np.lexsort((ids, -scores))[:keep]
            ids, scores, done = ids[order], scores[order], done[order]
            following = np.flatnonzero(~done)[:BEAM]
            done[following] = True
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([one["query_id"]], pa.int64()), pa.array([one["band"]], pa.int32()), common.blobs([one["vec"]]), pa.array([ids.tolist()], pa.list_(pa.int64())),
                    pa.array([scores.tolist()], pa.list_(pa.float64())), pa.array([done.tolist()], pa.list_(pa.bool_())),
                    pa.array([ids[following].tolist()], pa.list_(pa.int64())),
                ],
                names=["query_id", "band", "vec", "ids", "scores", "done", "next"],
            )

    finished: DataFrame | None = None
    first = True
    while True:  # ends: what falls out of a list never comes back, and no node is expanded twice
        front = state.select("query_id", "band", F.explode("next").alias("node"))
        reached = front.join(edges, "node").select("query_id", "band", "b")
        if first:  # the first hop scores the node itself, too
            reached = reached.union(front.select("query_id", "band", F.col("node").alias("b")))
        scored = reached.distinct().join(flat, "b").select("query_id", "band", "b", "x")
        rows = state.drop("next").withColumns({"b": F.lit(None).cast("long"), "x": F.lit(None).cast("binary")}).unionByName(scored, allowMissingColumns=True)
        moved = common.stored(rows.repartition(n, "query_id").sortWithinPartitions("query_id").mapInArrow(hop, schema), "graph-search", count // DEGREE)
        over = moved.where(F.size("next") == 0)
        finished = over if finished is None else finished.union(over)
        state = moved.where(F.size("next") > 0)
        first = False
        if state.isEmpty():
            return finished.select("query_id", "band", "vec", "ids")


def exact_scores(found: DataFrame, nodes: DataFrame, kind: str) -> DataFrame:
    """``query_id, id, score`` in double precision on the original vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                q, y = (_matrix(batch.column(c), kind).astype(np.float64) for c in (1, 3))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array((q * y).sum(axis=1))], names=["query_id", "id", "score"])

    pairs = found.select("query_id", "vec", F.explode("ids").alias("id")).join(nodes.select("id", F.col("vec").alias("y")), "id")
    return pairs.select("query_id", "vec", "id", "y").mapInArrow(run, "query_id long, id long, score double")


def nearest(table: DataFrame, is_query, k: int = K, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score`` for the rows where ``is_query`` holds, against every other row."""
    rows, kind = vectors(table, key, column)
    rows = common.stored(rows, "vectors")
    nodes = common.stored(nodes_of(rows, k + 1), "nodes", rows.count())
    # one row for each binary order of magnitude of the norms
    bands = {r.band: r for r in nodes.groupBy("band").agg(F.max("norm").alias("most"), F.count("*").alias("count")).collect()}
    scaled = common.stored(_scaled(nodes, {b: r.most for b, r in bands.items()}, kind), "graph-vectors")
    graph = build_graph(scaled, {b: r["count"] for b, r in bands.items()})
    in_band = F.create_map(*[F.lit(v) for pair in slots({b: r["count"] for b, r in bands.items()}).items() for v in pair])
    slot = F.pmod(F.xxhash64("id"), in_band[F.col("band")] if bands else F.lit(1)).alias("slot")
    picked = nodes.select("band", "id", "norm", slot, F.xxhash64("id", F.lit(1)).alias("h")).groupBy("band", "slot").agg(
        F.max(F.struct("norm", (-F.col("id")).alias("minus"))).alias("long"), F.min(F.struct("h", "id")).alias("any")
    )
    starts = picked.select(F.explode(F.array(-F.col("long.minus"), F.col("any.id"))).alias("id")).distinct()
    entries: dict[int, list[tuple[int, bytes]]] = {b: [] for b in bands}
    for r in scaled.join(starts, "id").orderBy("id").collect():
        entries[r.band].append((r.id, bytes(r.x)))
    asked = rows.where(is_query).join(nodes.select("vec", F.col("id").alias("node"), F.col("band").alias("home")), "vec").select(
        F.col("vec_id").alias("query_id"), "node", "home", "vec"
    )
    found = exact_scores(search(asked, scaled, graph, entries, kind, k + KEEP), nodes, kind)
    # a node stands for all ids of its vector; no more than k + 1 of them can be answers
    spread = found.join(nodes.select("id", "ids"), "id").select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return spread.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def op9_nn_descent(spark: SparkSession, root: str) -> DataFrame:
    """The 20 nearest found for every twentieth vector, against all others."""
    return nearest(common.table(spark, root, "embeddings"), F.col("vec_id") % 20 == 0)
