"""Operators 5, 7, 8 and 9: held-out accuracy, SQL and brute force."""

import collections
import math
import os
import random
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from maskwright.llm import common, langid, nndescent, pitmanyor, urlrank
from tests.compare import TABLES, compare
from tests.llm import plain


def fold(i):
    return zlib.crc32(str(i).encode()) % 5


def test_held_out_languages(spark):
    docs = common.table(spark, "/root/testdata/sf0.01", "documents")
    said = {r.doc_id: r for r in langid.op5_cross_parsing(spark, "/root/testdata/sf0.01").collect()}
    held = [r for r in docs.select("doc_id", "lang").collect() if fold(r.doc_id) == 0]
    assert all(said[r.doc_id].held_out for r in held) and sum(r.held_out for r in said.values()) == len(held)
    assert sum(said[r.doc_id].lang_pred == r.lang for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in said.values())


def test_phrases_are_longest_matches():
    sample = {"x": ["abcabd abc"], "y": ["zzzz"]}
    model = langid.Model(sample)

    def slow(text, y):
        n = i = 0
        while i < len(text):
            j = i + 1
            while j <= len(text) and text[i:j] in y:
                j += 1
            i = max(i + 1, j - 1)
            n += 1
        return n

    rnd = random.Random(4)
    for _ in range(200):
        text = "".join(rnd.choice("abcdz ") for _ in range(rnd.randrange(1, 40)))
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        got = model.phrases(points, np.array([0, len(text)]))[0].tolist()
        known = "".join(c if model.symbol[ord(c)] else "?" for c in text)
        assert got == [slow(known, "abcabd abc"), slow(known, "zzzz")]


def test_language_edge_cases(spark, edges, nothing):
    rows = langid.identify(edges.withColumn("lang", F.lit("en")), langid.fold() != 0).collect()
    by_id = {r.doc_id: r for r in rows}
    assert len(rows) == edges.count() and all(by_id[i].lang_pred == "und" and by_id[i].score == 0 for i in (0, 1, 2))
    unlabelled = langid.identify(edges.withColumn("lang", F.lit(None).cast("string")), F.lit(True)).collect()
    assert {r.lang_pred for r in unlabelled} == {"und"}
    assert langid.identify(nothing, F.lit(True)).count() == 0
    assert langid.accepted(edges.withColumn("lang", F.lit("en"))).columns == [*edges.columns, "lang"]


def test_languages_of_many_characters(spark):
    """Two languages of Han characters, one each of Latin, Cyrillic and Greek; one has long texts only."""
    rnd = random.Random(6)

    def words(low, letters, n, longest):
        return ["".join(chr(low + rnd.randrange(letters)) for _ in range(rnd.randrange(1, longest))) for _ in range(n)]

    kinds = {"h1": words(0x4E00, 900, 700, 4), "h2": words(0x5200, 900, 700, 4), "la": words(97, 26, 300, 9), "cy": words(0x430, 32, 300, 9), "el": words(0x3B1, 17, 300, 9)}

    def text(k, n):
        return ("" if k[0] == "h" else " ").join(rnd.choice(kinds[k]) for _ in range(n))

    rows = [(100 * j + i, text(k, 9000 if k in ("h2", "el") else 250), k) for j, k in enumerate(kinds) for i in range(40 if k == "h1" else 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    new = [(10_000 + 100 * j + i, text(k, 300), k) for j, k in enumerate(kinds) for i in range(5)]
    noise = [(20_000 + i, "".join(chr(0x7000 + rnd.randrange(3000)) for _ in range(400)), None) for i in range(3)]
    both = docs.union(spark.createDataFrame([(i, t, None) for i, t, _ in new] + noise, docs.schema)).coalesce(4)
    said = {r.doc_id: r.lang_pred for r in langid.identify(both, F.lit(True)).collect()}
    assert all(said[i] == k for i, _, k in rows + new)
    assert {r.doc_id for r in langid.accepted(both).select("doc_id").collect()} == {i for i, _, _ in rows + new}


def test_links_move_trust(spark, tmp_path):
    rnd = random.Random(2)
    hosts = [f"h{k}.{t}" for k in range(30) for t in ("com", "org", "net", "example.org")]
    rows = [
        (k, rnd.choice(["http://", "HTTPS://", "x"]) + rnd.choice(hosts).upper() + rnd.choice(["/de/x", "/fr/", "/es/1", "/en/12?q", "#a", ""]),
         " ".join(f'<a href="//{rnd.choice(hosts)}/x">' for _ in range(rnd.randrange(4))))
        for k in range(500)
    ] + [(9000, None, None), (9001, "", ""), (9002, "http://", None), (9002, "http://", None)]
    for t in TABLES:
        if t != "pages":
            os.symlink(f"/root/testdata/sf0.001/{t}.parquet", tmp_path / f"{t}.parquet")
    pd.DataFrame(rows, columns=["page_id", "url", "html"]).to_parquet(tmp_path / "pages.parquet")
    assert compare(spark, str(tmp_path), urlrank.op7_link_graph, urlrank.SQL).startswith("ok (504 rows)")
    assert compare(spark, "/root/testdata/sf0.001", urlrank.op7_link_graph, urlrank.SQL).startswith("ok")
    linked = spark.createDataFrame(
        [(1, "http://bad.com/de/1", None), (2, "http://bad.com/de/2", None), (3, "http://friend.net/x", '<a href="http://bad.com/">'), (4, "http://far.net/x", "")],
        "page_id long, url string, html string",
    )
    assert {r.page_id: r.verdict for r in urlrank.judge(linked).collect()} == {1: "block", 2: "block", 3: "block", 4: "allow"}
    assert urlrank.judge(linked.where("page_id < 0")).count() == 0


def test_masses_reach_the_fixed_point_on_a_cycle(spark):
    ring = [f"h{k}.net" for k in range(30)]  # longer than any fixed small number of rounds
    links = [(a, b, 1 + k % 3) for k, (a, b) in enumerate(zip(ring, ring[1:] + ring[:1]))] + [("h3.net", "h20.net", 2), ("h20.net", "bad.net", 1)]
    hosts = {h: (2, int(h == "h0.net"), 0) for h in ring} | {"bad.net": (3, 0, 3)}
    html = {a: " ".join(f'<a href="https://{t}/">' * w for f, t, w in links if f == a) for a in hosts}
    pages = spark.createDataFrame([(h, html[h]) for h in hosts], "host string, html string")
    got = urlrank.propagate(
        spark.createDataFrame([(h, *n) for h, n in hosts.items()], "host string, pages long, allowed long, blocked long"), urlrank.host_edges(pages)
    )
    seed = {h: (150_000 * n[1], 150_000 * n[2]) for h, n in hosts.items()}
    out, into, now, before = collections.Counter(), collections.Counter(), dict(seed), None
    for a, b, w in links:
        out[a] += w
        into[b] += w
    while now != before:
        flow, before = {h: [0, 0] for h in hosts}, now
        for a, b, w in links:
            flow[b][0] += now[a][0] * w // out[a]
            flow[a][1] += now[b][1] * w // into[b]
        now = {h: (seed[h][0] + flow[h][0] * 85 // 100, seed[h][1] + flow[h][1] * 85 // 100) for h in hosts}
    assert {r.host: (r.trust, r.distrust) for r in got.collect()} == now
    assert all(t > 0 for h, (t, _) in now.items() if h in ring)
    with pytest.raises(RuntimeError):
        urlrank.propagate(got.selectExpr("host", "pages", "1L allowed", "0L blocked"), urlrank.host_edges(pages), 2)


def test_base_scores_and_counts(spark, edges, nothing):
    for df in (common.table(spark, "/root/testdata/sf0.001", "documents"), edges):
        rows = pitmanyor.score(df, F.crc32(F.col("doc_id").cast("string")) % 5 != 1).collect()
        data = [(r.doc_id, [*plain.words(r.text), None]) for r in df.collect()]
        counts = collections.Counter(w for i, t in data if i is not None and fold(i) != 1 for w in t)
        n, v = sum(counts.values()), len(counts)
        want = sorted((str(i), len(t), sum(counts[w] > 0 for w in t), n, round(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), 5)) for i, t in data)
        assert sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in rows) == want
        assert all(math.isfinite(r.score) and r.score <= 0 for r in rows)
    assert pitmanyor.score(nothing, F.lit(True)).count() == 0


def test_the_model_beats_the_base_on_held_out_texts(spark):
    rows = [r for r in pitmanyor.op8_pitman_yor(spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows) + 0.3 * sum(r.n_tokens for r in rows)


def test_scores_no_longer_depend_on_the_number_of_sweeps(spark):
    docs = common.table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 1

    def mean(*sweeps):
        r = pitmanyor.score(docs, ~held, *sweeps).where(held).agg(F.sum("score").alias("s"), F.sum("n_tokens").alias("n")).first()
        return r.s / r.n

    assert abs(mean() - mean(8, 4)) < 0.005


@pytest.mark.parametrize("weight", [0.5, 30.0, 2000.0])
def test_tables_of_frequent_words_are_drawn(monkeypatch, weight):
    monkeypatch.setattr(pitmanyor, "DRAWS", 1000, raising=False)  # lots are cut into blocks
    n, count, d = 400, 1500, 0.8
    rnd, want = np.random.default_rng(7), np.ones(n)
    for seated in range(1, count):
        want += rnd.random(n) < weight / (weight + seated - d * want)
    got = pitmanyor.seat(np.full(n, count), np.full(n, weight), d, np.arange(n, dtype=np.uint64), np.zeros(n, np.int64), 1)
    assert abs(got.mean() - want.mean()) < 5 * want.std() * (2 / n) ** 0.5
    assert 0.7 < got.var() / want.var() < 1.4
    alone = pitmanyor.seat(np.full(1, count), np.full(1, weight), d, np.full(1, 5, np.uint64), np.zeros(1, np.int64), 1)
    assert alone[0] == got[5]  # copies of a word seat alike


def test_probabilities_sum_to_one(monkeypatch):
    """All words of a context, with the one unknown word, in every sweep."""
    rnd = np.random.default_rng(1)
    word = np.repeat(np.arange(1, 41, dtype=np.uint64), 12)
    context = np.tile(np.concatenate([np.arange(8), pitmanyor.CONTEXTS + np.arange(4)]), 40)
    count = rnd.integers(0, 90, len(word))
    parent = np.concatenate([np.arange(pitmanyor.CONTEXTS) % 4, np.arange(pitmanyor.ENDINGS)])
    runs = np.full(40, 12)
    x = pitmanyor.Words([{"w": pitmanyor.pack(np.unique(word)), "runs": pitmanyor.pack(runs), "u": pitmanyor.pack(context), "m": pitmanyor.pack(count), "f": pitmanyor.pack(np.ones(40, np.int64))}])
    history = []
    for s in range(3):
        for state in pitmanyor.sweeps(x, parent, history, 40):
            t1, c2, t2, c0, t0 = state
        own = x.context < pitmanyor.CONTEXTS
        now = np.zeros((2, pitmanyor.CONTEXTS + pitmanyor.ENDINGS + 1))
        np.add.at(now[0], x.context[own], x.count[own])
        np.add.at(now[1], x.context[own], t1[own])
        np.add.at(now[0], pitmanyor.CONTEXTS + x.end_class, c2)
        np.add.at(now[1], pitmanyor.CONTEXTS + x.end_class, t2)
        now[:, -1] = c0.sum(), t0.sum()
        history.append(now)
        base = 1 / 41
        p0, p2, p1 = pitmanyor.predictive(x, state, now, base)
        d, th = pitmanyor.DISCOUNT, pitmanyor.STRENGTH
        rest0 = (th[0] + d[0] * now[1, -1]) / (th[0] + now[0, -1]) * base
        assert p0.sum() + rest0 == pytest.approx(1)
        for room in range(8):
            k = parent[room]
            r2 = (th[1] + d[1] * now[1, pitmanyor.CONTEXTS + k]) / (th[1] + now[0, pitmanyor.CONTEXTS + k]) * rest0
            r1 = (th[2] + d[2] * now[1, room]) / (th[2] + now[0, room]) * r2
            assert p1[x.context == room].sum() + r1 == pytest.approx(1)
        assert (t1 <= x.count).all() and (t2 <= c2).all() and (t0 <= c0).all()


def recall(df):
    rows = nndescent.nearest(df, F.col("vec_id") % 20 == 0).collect()
    data = [(r.vec_id, r.embedding) for r in df.dropDuplicates(["vec_id"]).collect()]
    size = collections.Counter(len(e) for _, e in data if e).most_common(1)[0][0]
    data = [(i, e) for i, e in data if e and len(e) == size and all(v is not None and math.isfinite(v) for v in e) and any(e)]
    ids, x = np.array([i for i, _ in data]), np.array([e for _, e in data], np.float64)
    place, got, hits, total = {i: k for k, i in enumerate(ids.tolist())}, collections.defaultdict(list), 0, 0
    for r in rows:
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    for q in ids[ids % 20 == 0].tolist():
        sims = x @ x[place[q]]
        best = [int(ids[j]) for j in np.lexsort((ids, -np.round(sims, 12))) if ids[j] != q][:20]
        mine = sorted(got[q])
        assert [r for r, _, _ in mine] == list(range(1, len(best) + 1))
        assert all(abs(s - sims[place[v]]) < 1e-9 * max(1, abs(s)) for _, v, s in mine)
        assert [(-round(s, 12), v) for _, v, s in mine] == sorted((-round(s, 12), v) for _, v, s in mine)
        hits, total = hits + len({v for _, v, _ in mine} & set(best)), total + len(best)
    return hits / total


def test_recall_on_the_embeddings(spark):
    assert recall(common.table(spark, "/root/testdata/sf0.1", "embeddings")) >= 0.9


def test_recall_with_norms_ties_and_odd_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(v) for v in rng.standard_normal(8) * rng.uniform(0.2, 3)]) for i in range(400)]
    rows += [(1000 + i, [1.0] * 8) for i in range(100)]  # more equal vectors than answers
    rows += [(2000, None), (2020, [0.0] * 8), (2040, [math.nan] + [1.0] * 7), (2060, [None] + [1.0] * 7), (2080, [1.0]), (2100, [0.5] * 8), (2100, [0.5] * 8)]
    assert recall(spark.createDataFrame([(i, e, "x") for i, e in rows], "vec_id long, embedding array<float>, score string")) >= 0.9
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in nndescent.nearest(few, F.col("vec_id") % 20 == 0).collect()] == [(0, 1, 1, 4.0)]
    assert nndescent.nearest(few.where("vec_id < 0"), F.col("vec_id") % 20 == 0).count() == 0


def test_recall_when_single_vectors_are_much_longer(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((2000, 32))
    x /= np.sqrt((x**2).sum(axis=1))[:, None]
    x = np.concatenate([x, 10_000 * x[:1], 1e7 * x[1:3], 1e-3 * x[3:43]])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    assert recall(spark.createDataFrame(rows, "vec_id long, embedding array<double>")) >= 0.9


def test_a_vec_id_with_several_vectors_has_one(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (0, [0.0, 1.0]), (1, [3.0, 5.0]), (2, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert [tuple(r) for r in nndescent.nearest(df, F.col("vec_id") == 0).orderBy("rank").collect()] == [(0, 1, 1, 5.0), (0, 2, 2, 0.0)]


def test_many_small_groups_far_from_each_other_are_all_entered(spark):
    """Short queries, whose nearest are a group of long vectors that no edge leads to from other groups."""
    rng = np.random.default_rng(12)
    centres = rng.standard_normal((60, 24))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    long = np.repeat(centres, 22, axis=0) + 0.01 * rng.standard_normal((60 * 22, 24))
    x = np.concatenate([0.01 * centres, long]).astype(np.float32)
    ids = np.concatenate([20 * np.arange(60), [i for i in range(2000) if i % 20][: len(long)]])
    rows = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<float>")
    got = {}
    for r in nndescent.nearest(rows, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    score = x[:60].astype(np.float64) @ x.astype(np.float64).T
    score[np.arange(60), np.arange(60)] = -np.inf
    best = np.argsort(-score, axis=1)[:, :20]
    assert np.mean([len(got[20 * q] & set(ids[best[q]].tolist())) / 20 for q in range(60)]) > 0.95


def test_automata_have_no_columns_that_no_language_uses():
    model = langid.Model({"aa": ["abc abd"], "bb": ["xyz"]})
    states = len(model.table) // model.dense
    assert model.dense == 6 and len(model.table) == states * 6


def test_scores_do_not_depend_on_the_number_of_buckets(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"alpha beta w{k % 7} gamma {k} alpha") for k in range(200)], "doc_id long, text string")
    got = []
    for buckets in (1, 5):
        monkeypatch.setattr(pitmanyor, "BUCKETS", buckets)
        got.append({r.doc_id: (r.n_tokens, r.n_known, round(r.score, 9)) for r in pitmanyor.score(docs, F.col("doc_id") % 5 != 1).collect()})
    assert got[0] == got[1] and len(got[0]) == 200


def test_python_workers_get_light_batches(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    spark.conf.unset(common.BATCH[0])
    texts = spark.range(0, 40, 1, 1).select(F.repeat(F.lit("x"), 1 << 20).alias("text"))
    assert common.stored(texts.mapInArrow(sizes, "n long"), "sizes").agg(F.max("n")).first()[0] < 10 << 20
    spark.conf.set(common.BATCH[0], "4m")  # a session's own size stays
    common.light_batches(spark)
    assert spark.conf.get(common.BATCH[0]) == "4m"
    spark.conf.unset(common.BATCH[0])


def test_one_bucket_of_words_is_held_at_a_time(monkeypatch):
    import weakref

    held, most, real = weakref.WeakSet(), [], pitmanyor.Words.__init__

    def init(self, rows):
        held.add(self)
        most.append(len(held))
        real(self, rows)

    monkeypatch.setattr(pitmanyor.Words, "__init__", init)
    monkeypatch.setattr(pitmanyor, "CONTEXTS", 2)
    word, one = np.array([7, 9], np.uint64), np.ones(2, np.int64)
    row = {"w": pitmanyor.pack(word), "runs": pitmanyor.pack(one), "u": pitmanyor.pack(one), "m": pitmanyor.pack(one * 3), "f": pitmanyor.pack(one), "block": 1, "z": pitmanyor.pack(one), "d": pitmanyor.pack(one - 1)}
    parent = np.array([0, 0, *range(pitmanyor.ENDINGS)], np.int64)
    totals = [np.ones((2, 2 + pitmanyor.ENDINGS + 1)) for _ in range(3)]
    for _ in range(3):
        assert pitmanyor.bucket_totals([row], parent, totals[:-1], 2)["c"].to_pylist()
        (got,) = pitmanyor.bucket_scores([row], parent, totals, 2, 6, 1)
        assert got["block"].to_pylist() == [1]
    assert max(most) == 1


def test_a_sweep_seats_only_pairs_of_several_customers(monkeypatch):
    monkeypatch.setattr(pitmanyor, "CONTEXTS", 4)
    count, context = np.array([1, 3, 0, 1, 2, 5]), np.array([0, 1, 2, 3, 1, 5])  # room 5 is an ending's
    pairs = {"w": pitmanyor.pack(np.array([7, 9])), "runs": pitmanyor.pack(np.array([4, 2])), "u": pitmanyor.pack(context), "m": pitmanyor.pack(count), "f": pitmanyor.pack(np.ones(2, np.int64))}
    parent = np.array([0, 1, 0, 1, *range(pitmanyor.ENDINGS)], np.int64)
    seen, real = [], pitmanyor.seat
    monkeypatch.setattr(pitmanyor, "seat", lambda c, *args: (seen.append(c.tolist()), real(c, *args))[1])
    totals = [np.ones((2, 4 + pitmanyor.ENDINGS + 1)) for _ in range(2)]
    states = list(pitmanyor.sweeps(pitmanyor.Words([pairs]), parent, totals, 2))
    assert len(states) == 3 and seen[0] == seen[3] == [3, 2]
    for t1, c2, t2, c0, t0 in states:  # word 7: ending 0 has rooms 0 and 2, ending 1 rooms 1, 3 and 5; word 9: ending 1 only
        assert t1[[0, 2, 3]].tolist() == [1, 0, 1] and c2.tolist() == [1, t1[1] + 1, t1[4] + 5]
        assert c0.sum() == t2.sum() and (t0 <= c0).all()


def test_every_context_has_a_restaurant_of_its_own(spark):
    """Words beyond the most frequent ones, of one ending, tell their followers apart."""
    fill = [(10 + k, " ".join(f"f{(k * 97 + j) % 9000}" for j in range(100))) for k in range(360)]
    docs = spark.createDataFrame([(0, "aaxq red"), (1, "aaxq blue"), (2, "aaxq red"), (3, "bbxq blue"), *fill], "doc_id long, text string")
    got = {r.doc_id: r.score for r in pitmanyor.score(docs, F.col("doc_id") > 1).where("doc_id < 2").collect()}
    assert 0.3 < got[0] - got[1] < 0.4  # red: a customer of the room (0.15 / 2) and 1.85 / 2 of the ending's 0.07; blue: the latter


def test_arrays_of_any_width_are_packed():
    rnd = np.random.default_rng(3)
    for bits in range(1, 63):
        for n in (0, 1, 9, 1001):
            x = rnd.integers(0, 1 << bits, n)
            assert (pitmanyor.unpack(pitmanyor.pack(x)).astype(np.int64) == x).all()
