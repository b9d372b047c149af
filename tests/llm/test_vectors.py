"""Operators 11, 12 and 13: SQL, brute force, bounds, trees, and odd inputs."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest

from maskwright.llm import common, embeddup, partcodes, resampling
from tests.compare import compare
from tests.llm import plain

SCHEMA = "vec_id long, embedding array<float>, label int, code string, node long, group int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, l, "x", 1, 2) for i, v, l in rows], SCHEMA)


def cluster(rng, n, dim, spread, copies=0):
    """Vectors around a few centres, some of them repeated."""
    centres = rng.standard_normal((5, dim))
    x = centres[rng.integers(0, 5, n)] + spread * rng.standard_normal((n, dim))
    x *= 10.0 ** rng.integers(-3, 4, n)[:, None]
    return np.concatenate([x, x[:copies]]).astype(np.float32)


def linked(rows, least):
    union, n_links = plain.Union([i for i, *_ in rows]), collections.Counter()
    by = collections.defaultdict(list)
    for i, v, l in rows:
        by[l].append((i, np.array(v, np.float64)))
    for some in by.values():
        for k, (i, x) in enumerate(some):
            for j, y in some[:k]:
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= least:
                    n_links[i] += 1
                    n_links[j] += 1
                    union.join(i, j)
    return {i: (n_links[i], union.root(i), union.root(i) == i) for i, *_ in rows}


@pytest.mark.parametrize("name, module, query", [
    ("op11", embeddup, "op11_int8_tiles"), ("op12", resampling, "op12_bit_sliced"), ("op13", partcodes, "op13_anchors_codes"),
])
def test_against_sql(spark, name, module, query):
    assert compare(spark, "/root/testdata/sf0.01", getattr(module, query), module.SQL).startswith("ok")


# ---------------------------------------------------------------- op11


def test_links_between_many_blocks(spark):
    rng = np.random.default_rng(5)
    x = cluster(rng, 260, 24, 0.25, copies=60)
    rows = [(int(i), v.tolist(), int(i) % 3 % 2) for i, v in zip(rng.permutation(len(x)), x)]
    want = linked(rows, 0.93)
    assert 100 < sum(w[0] for w in want.values()) and any(not w[2] for w in want.values())
    for block in (16, 2048):
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddup.near_duplicates(table(spark, rows), block=block).collect()}
        assert got == want


def test_bound_holds_and_codes_decide_most_pairs():
    rng = np.random.default_rng(6)
    x = cluster(rng, 400, 64, 0.3).astype(np.float64)
    u, q, step, length, error = embeddup.quantised(x)
    about = embeddup.products(q, q) * np.outer(step, step)
    room = np.outer(length, error) + np.outer(error, length) + np.outer(error, error) + embeddup.ROUNDING
    assert (np.abs(u @ u.T - about) <= room).all()
    assert (np.abs(about - 0.93) <= room).mean() < 0.2


def test_embeddings_with_odd_values(spark):
    nan, inf = float("nan"), float("inf")
    a, b = [1.0, 0.0], [0.0, 1.0]
    rows = [(1, a, 1), (2, a, 1), (2, a, 1), (3, None, 1), (4, [], 1), (5, [0.0, 0.0], 1), (6, [nan, 1.0], 1), (7, [inf, 1.0], 1), (8, [None, 1.0], 1),
            (9, a, None), (10, a, 2), (None, a, 1), (11, [1.0, 0.0, 0.0], 1), (12, [2e30, -0.0], 1), (13, b, 1), (2, b, 1), (14, [1e-30, 0.0], 1)]
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddup.near_duplicates(table(spark, rows)).collect()), key=repr)
    group = [(1, 4, 1, True), (2, 4, 1, False), (2, 4, 1, False), (12, 4, 1, False), (14, 4, 1, False)]
    alone = [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10, 11)]
    want = group + alone + [(13, 1, 2, False), (2, 1, 2, True), (None, 0, None, None)]
    assert got == sorted(want, key=repr)
    assert embeddup.near_duplicates(table(spark, [])).count() == 0


def test_very_long_vectors(spark):
    rng = np.random.default_rng(7)
    base = rng.standard_normal(3000).astype(np.float32)
    rows = [(0, base.tolist(), 0), (1, (base + 0.1 * rng.standard_normal(3000)).tolist(), 0), (2, rng.standard_normal(3000).tolist(), 0)]
    rows = [(i, np.array(v, np.float32).tolist(), l) for i, v, l in rows]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddup.near_duplicates(table(spark, rows)).collect()}
    assert got == linked(rows, 0.93) and got[1] == (1, 0, False)


# ---------------------------------------------------------------- op12


def features(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(plain.LOWER))
    return w + [f"{a} {b}" for a, b in zip(w, w[1:])], len(w)


def buckets(text):
    return collections.Counter(zlib.crc32(f.encode()) % resampling.BUCKETS for f in features(text)[0])


@pytest.mark.parametrize("text", ["ab cd Ef  gh, " * 50, "x" * 3000 + " y " + "z" * 1000, "日本語テキスト、長い" * 80 + " ab 日本", "", "   ", "a", "-- a --", "É1 a9 " * 99 + "b" * 60])
def test_pieces_of_long_texts(text):
    raw = np.frombuffer(text.encode(), np.uint8)
    for step in (1, 2, 3, 7, 50, 100_000):
        parts = list(resampling.counts(raw, np.array([0, len(raw)]), step))
        total = sum(c.sum(axis=0) for *_, c, _ in parts)
        assert {int(b): int(total[b]) for b in np.flatnonzero(total)} == buckets(text)
        assert sum(int(n.sum()) for *_, n in parts) == features(text)[1]


def test_planes_give_exact_sums():
    rng = np.random.default_rng(8)
    counts = rng.integers(0, 40_000, (20, 10_000)) * (rng.random((20, 10_000)) < 0.1)
    gain = rng.integers(-9000, 9000, 10_000)
    plus, minus = (resampling.planes(np.maximum(g, 0)[None, :]) for g in (gain, -gain))
    assert (resampling.sums(resampling.planes(counts), plus, minus) == counts @ gain).all()
    zero = np.zeros((2, 10_000), np.int64)
    assert (resampling.sums(resampling.planes(zero), plus, minus) == 0).all()


def test_resampling_edge_cases(spark, edges, nothing):
    target = spark.createDataFrame([(1, "word word a b c d"), (2, None)], "item_id int, text string")
    rows = resampling.resample(edges, target, percent=100, least_words=4).collect()
    assert len(rows) == edges.count()
    by = {r.doc_id: r for r in rows}
    assert all(by[i].n_features == 0 and by[i].weight == 0 and by[i]["rank"] is None and by[i].score is not None for i in (0, 1, 2))
    assert by[None].score is None and by[None]["rank"] is None and by[None].n_features == 5
    ranked = sorted((r for r in rows if r["rank"]), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == [1, 2, 3, 4] and [(-r.score, r.doc_id) for r in ranked] == sorted((-r.score, r.doc_id) for r in ranked)
    assert by[6].n_features == 59_999
    assert resampling.resample(nothing, target).count() == 0
    assert {r.weight for r in resampling.resample(edges, nothing.select("doc_id", "text")).collect() if not r.n_features} == {0}


# ---------------------------------------------------------------- op13


def coded(rows, rounds=partcodes.ROUNDS):
    """Plain k-means by parts: codes, errors, digest."""
    x = np.floor(np.array([v for _, v, _ in rows], np.float64) * partcodes.SCALE).astype(np.int64)
    seeds = [k for _, k in sorted((i, k) for k, (i, *_) in enumerate(rows) if i is not None)][: partcodes.ENTRIES]
    width, codes, error, books = x.shape[1] // partcodes.PARTS, [], np.zeros(len(x), np.int64), []
    for p in range(partcodes.PARTS):
        y = x[:, p * width : (p + 1) * width]
        book = y[seeds].copy()
        for turn in range(rounds + 1):
            d = ((y[:, None] - book[None]) ** 2).sum(axis=2)
            c = d.argmin(axis=1)
            for e in range(len(book) if turn < rounds else 0):
                if (c == e).any():
                    book[e] = y[c == e].sum(axis=0) // (c == e).sum()
        codes.append(c)
        error += d.min(axis=1)
        books += book.ravel().tolist()
    text = ["".join(f"{e:02x}" for e in row) for row in np.array(codes).T]
    return list(zip(text, error.tolist())), hashlib.sha256(",".join(map(str, books)).encode()).hexdigest()


@pytest.mark.parametrize("n, dim, seed", [(300, 32, 1), (50, 16, 2), (700, 64, 3)])
def test_codes_against_plain_rounds(spark, n, dim, seed):
    rng = np.random.default_rng(seed)
    x = np.round(rng.standard_normal((n, dim)) * (1 if seed < 3 else 0.01), 2).astype(np.float32)  # small numbers give many ties
    x[: n // 3] = x[0]  # copies
    rows = [(int(i), v.tolist(), int(i) % 4 or None) for i, v in zip(rng.permutation(n), x)]
    want, digest = coded(rows)
    codes, books = partcodes.compress(table(spark, rows))
    assert partcodes.codebooks_sha256(books) == digest
    assert {r.vec_id: (r.code, r.error) for r in codes.collect()} == {i: w for (i, *_), w in zip(rows, want)}


def test_trees_hold_every_point_once():
    rng = np.random.default_rng(9)
    for n, d in ((1, 3), (30, 1), (500, 4), (900, 2)):
        x = rng.integers(-40, 40, (n, d))
        t = partcodes.Tree(x).laid_out()
        assert sorted(t["order"]) == list(range(n))
        for b in range(len(t["count"])):
            own = x[t["order"][t["first"][b] : t["first"][b] + t["count"][b]]]
            assert (own.sum(axis=0) == t["total"][b]).all() and t["count"][b] == len(own)
            assert np.sqrt(((own - t["pivot"][b]) ** 2).sum(axis=1)).max() <= t["radius"][b]


def test_whole_balls_are_owned():
    rng = np.random.default_rng(10)
    centres = rng.integers(-10_000, 10_000, (20, 4))
    x = (centres[rng.integers(0, 20, 2000)] + rng.integers(-50, 50, (2000, 4))).astype(np.int64)
    t = partcodes.Tree(x).laid_out()
    kinds = collections.Counter()
    for kind, index, _ in partcodes.descend(t, x, centres):
        kinds[kind] += int(t["count"][index].sum()) if kind == "ball" else len(index)
    assert kinds["ball"] > 1900 and sum(kinds.values()) == 2000


def test_codes_of_odd_vectors(spark):
    nan = float("nan")
    a, b = [float(k) for k in range(16)], [-0.001] * 16
    rows = [(3, a, 1), (1, b, None), (1, b, None), (1, a, 2), (None, a, None), (4, None, 1), (5, [], 1), (6, [nan] * 16, 1), (7, [None] * 16, 1), (8, [1.0] * 32, 1)]
    codes, books = partcodes.compress(table(spark, rows))
    out = sorted(((r.vec_id, r.label, r.code, r.error) for r in codes.collect()), key=repr)
    assert len(out) == 5 and books.shape == (16, 2, 1)
    assert {r[3] for r in out} == {0} and {r[0] for r in out} == {1, 3, None}
    assert books[0].ravel().tolist() == [-1, 0]
    assert partcodes.compress(table(spark, []))[0].count() == 0
    assert partcodes.compress(table(spark, [(None, a, 1)]))[0].count() == 0
    with pytest.raises(ValueError):
        partcodes.compress(table(spark, [(1, [1.0] * 17, 1)]))
    with pytest.raises(ValueError):
        partcodes.compress(table(spark, [(1, [1e30] * 16, 1)]))


def test_rows_of_a_hot_key_are_dealt(spark):
    rows = spark.range(1000).selectExpr("id", "if(id < 900, null, id % 7) as k")
    one = rows.groupBy("k").count()
    out = common.salted_join(rows, one, "k", rows["id"])
    assert out.count() == 1000 and out.columns == ["id", "k", "count"]
    assert out.where("k is null and count = 900").count() == 900
