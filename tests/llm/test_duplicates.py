"""Operators 1, 4 and 6 against plain versions."""

import collections
import random
import re

import numpy as np
import pytest

from maskwright.llm import common, decontaminate, neardup, suffixes
from tests.llm import plain


def near(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_classes(df).collect()}


def test_near_classes_of_the_documents(spark, small):
    docs = common.table(spark, small, "documents")
    assert near(docs) == plain.near_classes([(r.doc_id, r.text) for r in docs.collect()])


def test_minimisers_of_very_long_texts():
    grams = np.random.default_rng(8).integers(0, 40, 5000).astype(np.uint64) << np.uint64(50)  # many ties
    want = [p + int(np.argmin(grams[p : p + 40])) for p in range(5000 - 39)]
    for block in (1, 7, 40, 1000, 1 << 22):
        assert suffixes.minimisers(grams, 40, block).tolist() == want
    assert not len(suffixes.minimisers(grams[:39], 40))
    hashed = np.random.default_rng(9).integers(1, 2**63, (1 << 24) + 1000, dtype=np.uint64)
    hashed[-400:-200] = hashed[3000:3200]  # the same 200 words on either side of 2^24
    key, _, _, start, count = suffixes.stretches(hashed, np.array([0, len(hashed)]))
    inside = [(start >= a) & (start + count + 49 <= a + 200) for a in (3000, len(hashed) - 400)]
    assert len(set(key[inside[0]]) & set(key[inside[1]])) >= 3


def test_near_classes_of_a_dense_group(spark):
    rnd = random.Random(3)
    base = [f"w{rnd.randrange(500)}" for _ in range(150)]
    rows = []
    for k in range(700):  # more than a block, with links on either side of the threshold
        w = list(base)
        for _ in range(rnd.randrange(6)):
            w[rnd.randrange(len(w))] = f"x{rnd.randrange(10**6)}"
        rows.append((k, " ".join(w)))
    rows += [(5000 + k, " ".join(base[:60] + [f"y{rnd.randrange(10**6)}" for _ in range(60)])) for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert near(df) == plain.near_classes(rows)


def test_a_group_that_is_alike_is_tied_without_branching(spark):
    rnd = np.random.default_rng(5)
    base = rnd.integers(0, 2**31 - 1, neardup.COORDINATES)
    sigs = np.where(rnd.random((300, len(base))) < 0.95, base, rnd.integers(0, 2**31 - 1, (300, len(base))))
    reps = spark.createDataFrame([(k, s.tolist()) for k, s in enumerate(sigs)], "rep long, sig array<int>")
    _, dense = neardup.tree_nodes(reps, 300)
    roots = {t: sum(s[t] == base[t] for s in sigs) for t in range(neardup.TREES)}
    assert dense.count() == sum(roots.values())  # each tree's root once, not its two children


def test_only_texts_of_clustered_documents_are_compared(spark, monkeypatch):
    rnd = random.Random(6)
    base = [f"w{k}" for k in range(100)]
    rows = [(k, " ".join(base[:-1] + [f"x{k}"])) for k in range(20)]
    rows += [(100 + k, " ".join(f"y{rnd.randrange(10**6)}" for _ in range(60))) for k in range(80)]
    seen, real = [], neardup.compare
    monkeypatch.setattr(neardup, "compare", lambda texts, tasks: (seen.append(texts.count()), real(texts, tasks))[1])
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert near(df) == plain.near_classes(rows) and seen and max(seen) == 20


def test_documents_that_share_too_little_are_not_dealt_out_again(spark, monkeypatch):
    rnd = random.Random(12)
    base = [f"w{k}" for k in range(150)]
    rows = []
    for k in range(600):  # one in ten has copies at the threshold, the others are near but linked with none
        w = list(base)
        for at in rnd.sample(range(150), 1 if k % 10 == 0 else 5):
            w[at] = f"x{rnd.randrange(10**6)}"
        rows.append((k, " ".join(w)))
    dealt, real = [], neardup.compare
    monkeypatch.setattr(neardup, "compare", lambda texts, tasks: (dealt.append(tasks.count()), real(texts, tasks))[1])
    monkeypatch.setattr(neardup, "BLOCK", 32)
    assert near(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == plain.near_classes(rows)
    assert sum(dealt) < 5 * len(rows)


def test_linkable_is_exact_at_the_threshold(spark, monkeypatch):
    words = [f"w{k}" for k in range(30)]
    rows = [(1, words[:21]), (2, words[:24]), (3, words[:20]), (4, words[:23])]  # 17, 20, 16 and 19 shingles
    texts = spark.createDataFrame([(k, " ".join(w)) for k, w in rows], "rep long, text string")

    def left(*clusters):
        state = spark.createDataFrame([(k, c, k) for c, ks in enumerate(clusters) for k in ks], "rep long, component long, class long")
        return sorted(r.rep for r in neardup.linkable(texts, state, 4).collect())

    assert left([1, 2], [3, 4]) == [1, 2]  # 17 of 20 are enough, 16 of 19 are not
    monkeypatch.setattr(neardup, "OWN_BYTES", 100)  # several buckets
    assert left([1, 2], [3, 4]) == [1, 2]
    assert left([1, 2, 3, 4]) == [1, 2, 3, 4] and left([1], [2]) == [] and left() == []


def test_near_edge_cases(edges, nothing):
    rows = neardup.near_classes(edges).collect()
    assert len(rows) == edges.count()
    by_id = {r.doc_id: r for r in rows}
    assert by_id[None].component_id is None and by_id[None].kept
    assert all(by_id[i].n_shingles == 0 and by_id[i].component_id == i and by_id[i].kept for i in (0, 1, 2))
    assert by_id[7].component_id == 5 and not by_id[7].kept
    assert neardup.near_classes(nothing).count() == 0
    kept = neardup.deduplicated(edges)
    assert kept.columns == edges.columns and sorted(-1 if r.doc_id is None else r.doc_id for r in kept.collect()) == [-1, 0, 1, 2, 3, 4, 5, 6]


def test_exact_threshold():
    a = np.arange(17, dtype=np.uint64)
    assert neardup.exact_links(np.array([1, 2]), [a, np.arange(20, dtype=np.uint64)]) == [(1, 2)]  # 17 of 20
    assert neardup.exact_links(np.array([1, 2]), [a[:16], np.arange(19, dtype=np.uint64)]) == []  # 16 of 19


def covered(df, *args):
    out = collections.defaultdict(set)
    for r in suffixes.repeats(df, *args).collect():
        out[r.doc_id, r.first].update(range(r.start_word, r.end_word))
    return dict(out)


def test_repeats_of_the_documents(spark, small):
    docs = common.table(spark, small, "documents")
    assert covered(docs) == plain.repeats([(r.doc_id, r.text) for r in docs.collect()], 50)
    cut = suffixes.without_repeats(docs, suffixes.repeats(docs))
    assert cut.columns == docs.columns
    assert suffixes.repeats(cut).where("not first").count() == 0
    assert cut.where("n_chars <> length(text)").count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_repeats_of_few_words(spark, seed):
    rnd = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(4)]
    passages = [[rnd.choice(vocabulary) for _ in range(60)] for _ in range(5)]
    rows = [(900, None), (901, ""), (902, "a " * 300)]
    for d in range(200):
        w: list[str] = []
        for _ in range(rnd.randrange(4)):
            w += passages[rnd.randrange(5)][rnd.randrange(30) :] if rnd.random() < 0.6 else [rnd.choice(vocabulary) for _ in range(rnd.randrange(40))]
        rows.append((d, " ".join(w)))
    assert covered(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 12, 5) == plain.repeats(rows, 12)


def test_repeats_edge_cases(edges, nothing):
    found = covered(edges)
    assert set(found) == {(6, True), (6, False)}  # one word over and over: the first passage stays
    assert suffixes.without_repeats(edges, suffixes.repeats(edges)).count() == edges.count()
    assert suffixes.repeats(nothing).count() == 0


def test_verbatim_leaks(spark):
    root = "/root/testdata/sf0.01"
    docs, items = common.table(spark, root, "documents"), common.table(spark, root, "benchmark")

    def runs(text):
        w = re.findall(r"[^\W_]+", text.lower())
        return {tuple(w[k : k + 12]) for k in range(len(w) - 11)}

    bench = [(r.item_id, runs(r.text)) for r in items.collect()]
    want = {(d.doc_id, i) for d in docs.collect() for i, g in bench if g & runs(d.text)}
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, items).collect()}
    assert got == want
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, items, sent=0).collect()} == want  # the join without broadcast
    assert {r.doc_id for r in decontaminate.clean(docs, items).select("doc_id").collect()} == {d.doc_id for d in docs.collect()} - {d for d, _ in want}


def test_templates(spark, edges, nothing):
    say = "Yesterday a farmer near {} sold {} kg of fresh apples to his neighbour for {} dollars each day of the {} year."
    items = spark.createDataFrame([(10, say.format("Paris", 45, 12, "same")), (11, None), (12, "tiny"), (None, "x")], "item_id long, text string")
    docs = spark.createDataFrame(
        [(1, "Before. " + say.format("Paris", 45, 12, "same")), (2, say.format("Berlin", 99, 7, "same")), (3, say.format("Rome", 8, 8, "same")), (4, "45 kg for 12 dollars")],
        "doc_id long, text string",
    )
    got = {r.doc_id: r.kind for r in decontaminate.leaks(docs, items).collect()}
    assert got == {1: "verbatim", 2: "reparameterised"}  # in 3 one value stands for two
    assert decontaminate.leaks(edges, items).count() == 0 and decontaminate.clean(edges, items).count() == edges.count()
    assert decontaminate.leaks(nothing, items).count() == 0 and decontaminate.leaks(docs, items.where("item_id < 0")).count() == 0


def test_templates_by_alignment(spark):
    form = "On the farm near {} there were {} red hens and also {} white ducks beside the old wooden barn."
    two = form.format("Paris", 5, 7) + " " + form.format("Rome", 8, 5)  # one form twice, with other values
    say = "Yesterday a farmer near {} sold {} kg of fresh apples to his neighbour for {} dollars each day of the {} year."
    own = say.format("Paris", 45, 12, "same")
    items = spark.createDataFrame([(1, two), (2, own)], "item_id long, text string")
    docs = spark.createDataFrame(
        [
            (1, two), (2, "Before. " + two + " After."),
            (3, own + " " + say.format("Berlin", 45, 7, "same")),  # verbatim, then a variant
            (4, say.format("Rome", 99, 7, "same") + " " + say.format("Oslo", 3, 4, "same")),  # two variants
            (5, say.format("Rome", 8, 8, "same")), (6, say.format("Rome", 8, 8, "same") + " " + say.format("Oslo", 9, 9, "same")),
            (7, form.format("Oslo", 9, 9) + " " + form.format("Oslo", 9, 9)),
        ],
        "doc_id long, text string",
    )
    for sent in (decontaminate.SENT, 0):
        got = {(r.doc_id, r.item_id): (r.kind, r.changed > 0) for r in decontaminate.leaks(docs, items, sent=sent).collect()}
        assert got == {(1, 1): ("verbatim", False), (2, 1): ("verbatim", False), (3, 2): ("verbatim", False), (4, 2): ("reparameterised", True)}
    assert [r.doc_id for r in decontaminate.clean(docs, items).orderBy("doc_id").collect()] == [5, 6, 7]
