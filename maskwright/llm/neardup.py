"""Operator 4: near duplicates by a chosen-path set similarity join.

A document's set holds its distinct 5-word shingles (A-Z lower-cased; with fewer words the whole
sequence is the one shingle; without words the set is empty and linked with nothing).  Documents
are linked when 100 * intersection >= percent * union; classes are the connected components.

1. One scan gives each set's size, a 128-bit digest and a signature of minwise tokens.  Equal
   sets become one representative, its smallest doc_id, so exact copies never meet again.
2. Each tree starts with one minwise token.  A node of more than ``LEAF`` documents branches: it
   selects ``BRANCH`` further coordinates by its path, and each document goes to the child of its
   own minwise token there.  Independent trees are repeated to the target recall.
3. Small nodes are compared exhaustively on signatures and give a spanning forest of the pairs that
   may be linked.  A node of which one child would hold ``DENSE`` of the documents, or that has come
   through ``DEPTH`` branchings, holds documents that are alike almost throughout; it does not branch,
   but is tied together as a whole.
4. Forests join into clusters.  Texts of clustered documents are stored apart, once.  In a cluster full
   sets are compared exactly, block by block, all pairs inside a task; a task returns a spanning forest
   of its links, never all pairs.
5. In clusters of several blocks what is open is compared exactly too: each small node that still has
   several classes as a whole, and in dense nodes every document outside the main class against all.
   Pairs inside one class need no comparison, because a further link would not change the class, and
   neither do documents whose shingles are shared too rarely in the cluster to reach the threshold
   with any other one.

Defined cases: null doc_id gives component_id null and kept true; a null or empty text is its own
class; repeated rows are copies of one another; extra columns are ignored; an empty table gives an
empty result.  A doc_id stands for one text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SHINGLE = 5
PERCENT = 85
COORDINATES = 64
#: A pair at the threshold stays together in a tree with probability 0.78 at least (0.85 at the root, 0.98 at
#: each of DEPTH branchings), so seven trees miss one in 30,000.
TREES = 7
BRANCH = 2
DEPTH = 4
LEAF = 64
DENSE = 0.7
#: Signature similarity of a candidate: 0.85 less four standard deviations at 64 coordinates.
NEAR = 0.66
BLOCK = 256
#: Bytes of text whose shingles are counted at once.
OWN_BYTES = 4 << 20

_RANDOM = np.random.default_rng(85)
_TIMES = _RANDOM.integers(1, 2**63, COORDINATES, dtype=np.uint64) | np.uint64(1)
_D1, _D2 = (np.uint64(x) for x in _RANDOM.integers(1, 2**63, 2, dtype=np.uint64))


def shingle_sets(raw: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    hashed, first, _, _ = common.words(raw, offsets)
    g, at = common.grams(hashed, first, SHINGLE)
    bounds = np.searchsorted(at, first)
    out = []
    for d in range(len(offsets) - 1):
        if first[d + 1] - first[d] >= SHINGLE:
            out.append(np.unique(g[bounds[d] : bounds[d + 1]]))
        elif first[d + 1] > first[d]:
            w = hashed[first[d] : first[d + 1]]
            out.append(common.grams(w, np.array([0, len(w)]), len(w))[0])
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def sketches(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, d1, d2, sig``; one row for each input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = common.bytes_of(batch.column(1))
            for i, j in common.steps(at):
                sets = shingle_sets(raw[at[i] : at[j]], at[i : j + 1] - at[i])
                n = np.array([len(s) for s in sets], np.int64)
                d1, d2 = np.zeros(j - i, np.uint64), np.zeros(j - i, np.uint64)
                sig = np.zeros((j - i, COORDINATES), np.uint32)
                if n.sum():
                    flat, full = np.concatenate(sets), np.flatnonzero(n)
                    starts = (np.cumsum(n) - n)[full]
                    d1[full] = np.add.reduceat(common.mix(flat ^ _D1), starts)
                    d2[full] = np.add.reduceat(common.mix(flat ^ _D2), starts)
                    for c in range(COORDINATES):
                        sig[full, c] = np.minimum.reduceat((flat * _TIMES[c]) >> np.uint64(32), starts).astype(np.uint32)
                flat_sig = pa.array(sig.view(np.int32).ravel())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i), pa.array(n), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)),
                        pa.ListArray.from_arrays(np.arange(j - i + 1, dtype=np.int32) * COORDINATES, flat_sig),
                    ],
                    names=["doc_id", "n_shingles", "d1", "d2", "sig"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_shingles long, d1 long, d2 long, sig array<int>"
    )


# ---------------------------------------------------------------- trees


def tree_nodes(reps: DataFrame, count: int) -> tuple[DataFrame, DataFrame | None]:
    """Small nodes and dense large ones, both ``path, rep, sig``; documents alone in a node are gone.

    Signatures are joined to the documents that have company only.
    """
    roots = reps.select("rep", F.posexplode(F.slice("sig", 1, TREES)).alias("tree", "value")).select("rep", F.xxhash64("tree", "value").alias("path"))
    sizes = roots.groupBy("path").agg(F.count("*").alias("size")).where("size > 1")
    level = roots.join(sizes, "path").join(reps.hint("merge"), "rep").select("path", "rep", "sig", "size")
    leaves: DataFrame | None = None
    dense: DataFrame | None = None
    rows = count * TREES
    for depth in range(DEPTH + 1):
        sized = common.stored(level, "near-nodes", rows)
        small = sized.where(F.col("size") <= LEAF).select("path", "rep", "sig")
        leaves = small if leaves is None else leaves.union(small)
        large = sized.where(F.col("size") > LEAF)
        rows = large.count()
        if not rows:
            break
        judged = large.select("path", "rep", "sig", F.lit(True).alias("alike"))
        if depth < DEPTH:
            judged = common.stored(large.join(_alike_nodes(large), "path").select("path", "rep", "sig", "alike"), "near-large", rows)
        full = judged.where("alike").select("path", "rep", "sig")
        dense = full if dense is None else dense.union(full)
        if depth == DEPTH:
            break
        rows = judged.where("not alike").count()
        if not rows:
            break
        rows *= BRANCH
        children = judged.where("not alike").select(
            "rep", "sig", F.explode(F.array_distinct(F.array(*[F.xxhash64("path", _spot(b), _token(b)) for b in range(BRANCH)]))).alias("path")
        )
        sizes = children.groupBy("path").agg(F.count("*").alias("size")).where("size > 1")
        level = children.join(sizes, "path").select("path", "rep", "sig", "size")
    return leaves, dense


def _spot(b: int) -> Column:
    """The ``b``-th coordinate by which a node branches."""
    return F.pmod(F.xxhash64("path", F.lit(b)), F.lit(COORDINATES)).cast("int")


def _token(b: int) -> Column:
    return F.element_at("sig", _spot(b) + 1)


def _alike_nodes(large: DataFrame) -> DataFrame:
    """``path, alike``: does one child of a node hold ``DENSE`` of its documents?  Counted before any document is sent to children."""
    most = None
    for b in range(BRANCH):
        one = large.groupBy("path", "size", _token(b).alias("token")).agg(F.count("*").alias("n"))
        one = one.groupBy("path", "size").agg(F.max("n").alias("n"))
        most = one if most is None else most.union(one)
    return most.groupBy("path").agg((F.max("n") >= DENSE * F.max("size")).alias("alike"))


def forest(size: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least row that each of ``size`` rows reaches over the pairs ``a, b``."""
    label = np.arange(size)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _alike(nodes: DataFrame, n: int) -> DataFrame:
    """Edges ``a, b`` that tie together what is alike by signature and at most ``LEAF`` apart in a node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = pa.Table.from_batches([batch])
            rows = now if held is None else pa.concat_tables([held, now])
            fresh = 0 if held is None else held.num_rows
            path, rep = rows["path"].to_numpy(), rows["rep"].to_numpy()
            sig = rows["sig"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, COORDINATES)
            out = []
            for lag in range(1, LEAF):
                i = np.arange(max(0, fresh - lag), len(path) - lag)
                i = i[path[i] == path[i + lag]]
                if not len(i):
                    break
                i = i[(sig[i] == sig[i + lag]).sum(axis=1) >= NEAR * COORDINATES]
                out.append(np.stack([i, i + lag]))
            if out:
                root = forest(len(path), *np.concatenate(out, axis=1))
                tied = rep[root] != rep
                pairs = np.unique(np.stack([rep[root][tied], rep[tied]], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])
            held = rows.slice(max(len(path) - LEAF, int(np.argmax(path == path[-1]))))

    return nodes.repartition(n, "path").sortWithinPartitions("path", "sig").mapInArrow(run, "a long, b long")


def _stars(dense: DataFrame) -> DataFrame:
    """Every document of a dense node tied to the node's least one."""
    pivots = dense.groupBy("path").agg(F.min("rep").alias("a"))
    return dense.select("path", F.col("rep").alias("b")).join(pivots, "path").where("a <> b").select("a", "b")


# ---------------------------------------------------------------- exact comparison


def exact_links(ids: np.ndarray, sets: list[np.ndarray], percent: int = PERCENT) -> list[tuple[int, int]]:
    """A spanning forest of the links among a few hundred sets."""
    size = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), size)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.concatenate([[True], flat[1:] != flat[:-1]]) if len(flat) else np.zeros(0, bool)
    feature = np.cumsum(new) - 1
    shared = np.bincount(feature, minlength=1)[feature] > 1 if len(flat) else np.zeros(0, bool)
    feature, owner = feature[shared], owner[shared]
    common_size = np.zeros((len(sets), len(sets)), np.float32)
    if len(feature):
        feature = np.cumsum(np.concatenate([[0], (feature[1:] != feature[:-1]).astype(np.int64)]))
        width = 4096
        cuts = np.searchsorted(feature, np.arange(0, feature[-1] + width + 1, width))
        for a, b in zip(cuts[:-1], cuts[1:]):
            if b > a:
                x = np.zeros((len(sets), width), np.float32)
                x[owner[a:b], feature[a:b] % width] = 1
                common_size += x @ x.T
    inter = np.rint(common_size).astype(np.int64)
    union = size[:, None] + size[None, :] - inter
    yes = np.triu((100 * inter >= percent * union) & (union > 0), 1)
    parent = list(range(len(sets)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for i, j in zip(*np.nonzero(yes)):
        a, b = root(int(i)), root(int(j))
        if a != b:
            parent[a] = b
            out.append((int(ids[i]), int(ids[j])))
    return out


def clustered_texts(docs: DataFrame, blocks: DataFrame) -> DataFrame:
    """``rep, text`` of the documents in a cluster, stored: all texts move for them once, however often they are compared."""
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text")
    return common.stored(texts.join(blocks.select("rep").hint("merge"), "rep", "left_semi"), "near-texts")


def compare(texts: DataFrame, tasks: DataFrame) -> DataFrame:
    """Exact links inside each task; ``tasks`` has ``task, rep``, at most two blocks of reps for a task; ``texts`` has ``rep, text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in common.groups(batches, "task"):
            raw, at = common.bytes_of(rows["text"])
            sets = [s for i, j in common.steps(at) for s in shingle_sets(raw[at[i] : at[j]], at[i : j + 1] - at[i])]
            links = [x for x in exact_links(rows["rep"].to_numpy(), sets) if x[0] != x[1]]
            if links:
                a, b = zip(*links)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    dealt = texts.join(tasks.hint("merge"), "rep").select("task", "rep", "text")
    return dealt.repartition(common.parts(texts), "task").sortWithinPartitions("task").mapInArrow(run, "a long, b long")


def near_links(docs: DataFrame, reps: DataFrame, count: int) -> DataFrame:
    """Links ``a, b`` between the ``count`` representatives that span every class."""
    leaves, dense = tree_nodes(reps, count)
    pairs = _alike(leaves, common.parts(docs))
    clusters = common.components(pairs if dense is None else pairs.union(_stars(dense)), "near-clusters", count)
    sizes = clusters.groupBy("component").agg(F.count("*").alias("size"))
    blocks = common.stored(
        clusters.join(sizes, "component").select(
            F.col("id").alias("rep"), "component", F.ceil(F.col("size") / BLOCK).cast("int").alias("n_blocks"),
            F.pmod(F.xxhash64("id"), F.ceil(F.col("size") / BLOCK)).cast("int").alias("block"),
        ),
        "near-blocks", count,
    )
    texts = clustered_texts(docs, blocks)
    # every block with itself and with block 0 of its cluster
    with_zero = F.when((F.col("block") == 0) & (F.col("n_blocks") > 1), F.sequence(F.lit(1), F.col("n_blocks") - 1)).otherwise(F.array("block"))
    first = common.stored(
        compare(texts, blocks.select("rep", F.explode(with_zero).alias("i"), "component").select(F.xxhash64("component", "i").alias("task"), "rep")),
        "near-links",
    )
    many = blocks.where("n_blocks > 1").select("rep", "component")
    if many.isEmpty():
        return first
    inside = first.join(many.select(F.col("rep").alias("a")), "a", "left_semi")
    classes = common.components(inside, "near-classes", count).select(F.col("id").alias("rep"), F.col("component").alias("class"))
    state = common.stored(many.join(classes, "rep", "left").select("rep", "component", F.coalesce("class", "rep").alias("class")), "near-state", count)
    state = linkable(texts, state, count)
    again = _leaf_tasks(leaves, state)
    if dense is not None:
        again = again.union(_minor_tasks(dense, state))
    again = common.stored(again.distinct(), "near-open", count)
    if again.isEmpty():
        return first
    return first.union(common.stored(compare(texts, again), "near-links"))


def linkable(texts: DataFrame, state: DataFrame, count: int, percent: int = PERCENT) -> DataFrame:
    """``state`` (``rep, component, class``) without the documents that can be linked with no other of their cluster.

    Of a document's ``n`` shingles ``s`` occur in another document of the cluster, too, whose documents have ``least`` shingles
    or more.  No intersection is larger than ``s`` then, and no similarity than ``s / (n + max(s, least) - s)``.  What goes
    makes shingles of others rarer, so the step is repeated while it drops a tenth of the documents.
    """

    rows = texts.join(state.select("rep", "component").hint("merge"), "rep").select("component", "rep", "text")
    total, left = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0], state.count()
    each = total // max(1, left) + 1
    while left:
        rows = texts.join(state.select("rep", "component").hint("merge"), "rep").select("component", "rep", "text")
        sums = common.stored(_own_shingles(rows, each * left // OWN_BYTES + 1), "near-own")
        least = sums.where("rep is null").groupBy("component").agg(F.min("n").alias("least"))
        own = sums.where("rep is not null").groupBy("component", "rep").agg(F.sum("own").alias("own"), F.max("n").alias("n"))
        s = F.col("n") - F.col("own")
        none = own.join(least, "component").where(100 * s < percent * (F.col("n") + F.greatest(s, "least") - s)).select("rep")
        state = common.stored(state.join(none, "rep", "left_anti").select("rep", "component", "class"), "near-state", count)
        before, left = left, state.count()
        if 10 * left > 9 * before:
            break
    return state


def _own_shingles(rows: DataFrame, n: int) -> DataFrame:
    """``component, rep, n, own``: a document's shingles that no other text of its cluster has, in parts to be summed.

    A row without rep has the least ``n`` of some of the cluster's documents.  Shingles move in ``n`` buckets by hash, one
    row for each step of texts and bucket.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            component, rep = (batch.column(k).to_numpy() for k in range(2))
            raw, at = common.bytes_of(batch.column(2))
            for i, j in common.steps(at):
                sets = shingle_sets(raw[at[i] : at[j]], at[i : j + 1] - at[i])
                size = np.array([len(x) for x in sets], np.int64)
                of = np.repeat(np.arange(j - i), size)
                # of a cluster's own; two shingles of one hash would only count as shared
                key = common.mix(np.concatenate(sets) + common.mix(component[i:j].astype(np.uint64))[of])
                bucket = (key % np.uint64(n)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                cuts = np.searchsorted(bucket[order], np.arange(n + 1))
                out = []
                for b in np.flatnonzero(np.diff(cuts)):
                    take = order[cuts[b] : cuts[b + 1]]
                    docs, runs = np.unique(of[take], return_counts=True)
                    out.append((b, key[take].view(np.int64), component[i:j][docs], rep[i:j][docs], size[docs], runs))
                if out:
                    kinds = [pa.int64(), *[pa.list_(pa.int64())] * 5]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["bucket", "key", "component", "rep", "n", "runs"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, part in common.groups(batches, "bucket"):
            key, component, rep, size, runs = (part[c].combine_chunks().flatten().to_numpy() for c in ("key", "component", "rep", "n", "runs"))
            of = np.repeat(np.arange(len(rep)), runs)
            order = np.argsort(key)
            key, of = key[order], of[order]
            new = np.concatenate([[True], key[1:] != key[:-1], [True]])
            own = np.bincount(of[new[1:] & new[:-1]], minlength=len(rep))
            some = np.flatnonzero(own)
            clusters, at = np.unique(component, return_inverse=True)
            least = np.full(len(clusters), np.iinfo(np.int64).max)
            np.minimum.at(least, at, size)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([clusters, component[some]])), pa.array([*[None] * len(clusters), *rep[some].tolist()], pa.int64()),
                    pa.array(np.concatenate([least, size[some]])), pa.array(np.concatenate([np.zeros(len(clusters), np.int64), own[some]])),
                ],
                names=["component", "rep", "n", "own"],
            )

    dealt = rows.mapInArrow(deal, "bucket long, " + ", ".join(f"{c} array<long>" for c in ("key", "component", "rep", "n", "runs")))
    return dealt.repartition(common.parts(rows), "bucket").sortWithinPartitions("bucket").mapInArrow(count, "component long, rep long, n long, own long")


def _leaf_tasks(leaves: DataFrame, state: DataFrame) -> DataFrame:
    """Small nodes whose documents of one cluster still have several classes; equal nodes of several trees once."""
    rows = leaves.select("path", "rep").join(state, "rep").select(F.xxhash64("path", "component").alias("node"), "rep", "class")
    nodes = rows.groupBy("node").agg(
        F.min("class").alias("least"), F.max("class").alias("most"), F.count("*").alias("n"), F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("sign")
    ).where("least < most")
    once = nodes.groupBy("n", "sign").agg(F.min("node").alias("node")).select("node")
    return rows.join(once, "node").select(F.col("node").alias("task"), "rep")


def _minor_tasks(large: DataFrame, state: DataFrame) -> DataFrame:
    """For dense nodes: the documents outside the node's main class, in blocks, against all of it."""
    rows = large.select("path", "rep").join(state, "rep").select(F.xxhash64("path", "component").alias("path"), "rep", "class")
    rows = common.stored(rows, "near-rows")
    counts = rows.groupBy("path", "class").agg(F.count("*").alias("n"))
    main = counts.groupBy("path").agg(F.max(F.struct("n", F.col("class"))).alias("m"), F.sum("n").alias("size"))
    main = main.select("path", F.col("m.class").alias("main"), "size", (F.col("size") - F.col("m.n")).alias("minor")).where("minor > 0")
    rows = rows.join(main, "path").withColumns({
        "k_minor": F.ceil(F.col("minor") / BLOCK).cast("int"), "k_all": F.ceil(F.col("size") / BLOCK).cast("int"),
        "h": F.xxhash64("rep", F.lit(3)),
    })
    minor = rows.where("class <> main").select("rep", "path", F.pmod("h", "k_minor").alias("i"), F.explode(F.sequence(F.lit(0), F.col("k_all") - 1)).alias("j"))
    every = rows.select("rep", "path", F.explode(F.sequence(F.lit(0), F.col("k_minor") - 1)).alias("i"), F.pmod("h", "k_all").alias("j"))
    return minor.select(F.xxhash64("path", F.col("i").cast("int"), F.col("j").cast("int")).alias("task"), "rep").union(
        every.select(F.xxhash64("path", F.col("i").cast("int"), F.col("j").cast("int")).alias("task"), "rep")
    )


def near_classes(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each input row."""
    rows = common.stored(sketches(docs), "near-sketches")
    full = rows.where("n_shingles > 0 and doc_id is not null")
    groups = common.stored(
        full.groupBy("n_shingles", "d1", "d2").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig")), "near-groups", rows.count()
    )
    count = groups.count()
    links = near_links(docs, groups.select("rep", "sig"), count)
    classes = common.components(links, "near-components", count).select(F.col("id").alias("rep"), "component")
    known = groups.join(classes, "rep", "left").select("n_shingles", "d1", "d2", F.coalesce("component", "rep").alias("component"))
    return rows.drop("sig").join(known, ["n_shingles", "d1", "d2"], "left").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("c")
    ).select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("c")).alias("component_id"),
        F.coalesce(F.col("doc_id") == F.col("c"), F.lit(True)).alias("kept"),
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each class; of rows that repeat a doc_id one stays, rows without doc_id all stay."""
    rows = common.stored(near_classes(docs), "near-kept")
    # stored first, so that the planner knows its size before any text moves
    gone = common.stored(rows.where("not kept").select("doc_id").distinct(), "near-gone", rows.count())
    out = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    twice = rows.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").select("doc_id")
    if twice.isEmpty():
        return out
    return out.join(twice, "doc_id", "left_anti").select(*docs.columns).union(
        out.join(twice, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id"])
    )


def op4_chosen_path(spark: SparkSession, root: str) -> DataFrame:
    """Near-duplicate classes of all documents at 85 % of five-word shingles."""
    return near_classes(common.table(spark, root, "documents"))


SQL = (
    f"WITH RECURSIVE {common.WORDS_SQL}, "
    "g AS (SELECT doc_id, CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: hash(array_to_string(ws[i:i + 4], ' '))) "
    "WHEN len(ws) > 0 THEN [hash(array_to_string(ws, ' '))] ELSE [] END AS gs FROM w), "
    "s AS (SELECT DISTINCT doc_id, unnest(gs) AS h FROM g), "
    "n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1), "
    "shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2), "
    f"links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= {PERCENT} * (x.n + y.n - k)), "
    "pairs AS (SELECT a, b FROM links UNION SELECT b, a FROM links), "
    "reach AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT r.doc_id, b.b FROM reach r JOIN pairs b ON b.a = r.c) "
    "SELECT doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(c) AS component_id, doc_id = min(c) AS kept "
    "FROM reach LEFT JOIN n USING (doc_id) GROUP BY doc_id"
)
