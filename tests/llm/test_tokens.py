"""Operators 2, 3 and 10: exact round trips."""

import collections
import io
import random
import zlib

import numpy as np
import pytest

from maskwright.llm import common, packing, records, sharding, tokens


@pytest.fixture(scope="module")
def library(tokenizer):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer)


def ids_of(library, text):
    return np.array(library.encode(text or "", add_special_tokens=False).ids + [0], "<u4")


def test_encoder_equals_the_library(library, tokenizer):
    rnd = random.Random(1)
    marks = [" ", "  ", "\n", "a", "B", ".", ",", "'s", "é", "中", "\t", " ", "1", "!", "²", "\0", "ʰ", "$$$", "|", "<|endoftext|>"]
    texts = ["".join(rnd.choice(marks) for _ in range(30)) for _ in range(1500)] + ["", " x", "x ", "it's, don't. x's", "a b c"]
    got = tokens.Encoder(tokenizer).encode(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_records_round_trip(spark, tmp_path, library, tokenizer, edges, nothing):
    folder = f"file://{tmp_path}/records"
    index = records.write_records(edges, folder, tokenizer, files=3)
    rows = sorted(edges.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    got = sorted(records.read_records(index, folder).collect(), key=lambda r: r.start)
    start = 0
    for r, g in zip(rows, got, strict=True):
        ids = ids_of(library, r.text)
        assert (g.doc_id, g.start, g.n_tokens, g.ids_crc32) == (r.doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
        key, back = records.parsed(records.record_at(f"{folder}/{g.file}", g.at))  # by the index, in any order
        assert key == r.doc_id and (back == ids).all()
    empty = f"file://{tmp_path}/none"
    assert records.read_records(records.write_records(nothing, empty, tokenizer), empty).count() == 0


def test_damage_is_found():
    data = bytearray(records.frame(b"payload") + records.frame(b"next"))
    assert [b for _, b in records.unframed(io.BytesIO(data))] == [b"payload", b"next"]
    data[14] ^= 1
    with pytest.raises(ValueError, match="damaged record at 0"):
        list(records.unframed(io.BytesIO(data)))


def test_packing(spark, library, tokenizer, edges, nothing):
    pieces = packing.digest(packing.pack(edges, tokenizer, width=16)).collect()
    whole = collections.Counter((r.doc_id, len(ids_of(library, r.text))) for r in edges.collect())
    ids = {(r.doc_id, len(ids_of(library, r.text))): ids_of(library, r.text) for r in edges.collect()}
    got, sequences = collections.Counter(), collections.defaultdict(list)
    for p in pieces:
        body = ids[p.doc_id, p.doc_tokens][p.start : p.start + p.length]
        assert zlib.crc32(body.tobytes()) == p.ids_crc32 and p.length == len(body)
        got[p.doc_id, p.doc_tokens] += p.length
        sequences[p.sequence_id].append((p.offset, p.length))
    assert got == {k: k[1] * n for k, n in whole.items()}
    for s, parts in sequences.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 16 or s == max(sequences)
    assert sorted(sequences) == list(range(len(sequences)))
    assert packing.pack(nothing, tokenizer).count() == 0


def test_shards(spark, small, edges, nothing):
    for df in (common.table(spark, small, "documents"), edges, spark.createDataFrame([(5 if k % 3 else k, f"text {k % 977} " * (k % 7)) for k in range(3000)], "doc_id long, text string")):
        rows = sharding.shard(df).collect()
        assert len(rows) == df.count()
        keyed = sorted((-(2**63) if r.doc_id is None else r.doc_id, r.text or "") for r in rows)
        size = {k: len(k[1].encode()) + 8 for k in keyed}
        total, before, want = sum(size[k] for k in keyed), 0, {}
        for k in keyed:
            want.setdefault(k, before * 24 // total)
            before += size[k]
        slots = collections.defaultdict(list)
        for r in rows:
            slots[r.shard].append(r.slot)
        assert all(sorted(v) == list(range(len(v))) for v in slots.values())
        if len({k[0] for k in keyed}) == len(keyed):
            assert {(r.doc_id, r.text or ""): r.shard for r in rows} == want
        else:  # rows of one key are ordered by hash, so only the balance is checked
            bytes_of = collections.Counter()
            for r in rows:
                bytes_of[r.shard] += r.size
            assert max(bytes_of.values()) <= total / 24 + 2 * max(size.values())
    assert sharding.shard(nothing).count() == 0


def test_shards_use_no_python(spark, small):
    plan = sharding.op2_histogram_sort(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Exchange") == 1
