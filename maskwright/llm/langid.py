"""Operator 5: language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text is built.  A text is parsed against each:
a phrase is the longest match from the present character on, and a character that never occurs is
a phrase of its own.  ``phrases * log2(size of the labelled text)`` is the text's cost in bits, and
the language of least cost wins; ties go to the first in alphabetical order.  ``score`` is the
winner's share when every language has weight ``2 ** -bits``.

The labelled text is a bounded sample: for each language up to ``SAMPLE_DOCS`` documents, each cut to
``SAMPLE_CHARS`` / 4 characters, smallest hash of doc_id first, until ``SAMPLE_CHARS`` characters are
reached, where the last is cut; all languages together have at most ``SAMPLE_TOTAL``.  The automata are
sent to the tasks: at most ``2 * SAMPLE_TOTAL`` states of 64 transitions, 134 MB however many languages, and
as many columns fewer as no language has use for,
and at most ``3 * SAMPLE_TOTAL`` sparse ones.

Every text is parsed whole, in blocks of ``BLOCK`` characters side by side; a block's edge ends a
phrase for all languages alike.  Letters are lower-cased and every run of other characters is one
blank.  Every character of the sample has a symbol: each language's 62 most frequent ones have dense
transitions, its others sparse ones.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; so is every text when
nothing is labelled.  A null lang is never learned from; a null doc_id is predicted, but neither
learned from nor held out.  Repeated rows are predicted alike; extra columns pass through.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Labelled characters of one language, and of all together; beyond four languages each gets less.
SAMPLE_CHARS = 1 << 16
SAMPLE_TOTAL = 1 << 18
SAMPLE_DOCS = 64
SYMBOLS = 64
BLOCK = 512
#: Bytes of texts parsed side by side; what a step holds is some forty times that.
STEP_BYTES = 1 << 19
#: Bits for each character from which a text is like none of the languages; in proportion more where the
#: language's characters have an entropy above that of ``ALPHABET`` equally frequent letters, as Han has.
REJECT_BITS = 6.0
ALPHABET = 26


def folded(text: str) -> str:
    return " ".join("".join(c.lower()[:1] if c.isalpha() else " " for c in text).split())


def automaton(symbols: np.ndarray) -> list[dict[int, int]]:
    """Transitions of each state of the suffix automaton of a sequence; state 0 is the root."""
    following: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in symbols.tolist():
        now = len(following)
        following.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in following[p]:
            following[p][c] = now
            p = link[p]
        if p >= 0:
            q = following[p][c]
            if length[p] + 1 == length[q]:
                link[now] = q
            else:
                twin = len(following)
                following.append(dict(following[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and following[p].get(c) == q:
                    following[p][c] = twin
                    p = link[p]
                link[q] = link[now] = twin
        last = now
    return following


class Model:
    """Automata of all languages in one table, the symbol of each code point, and each language's column for a symbol.

    Column 0 matches nothing; column ``SYMBOLS - 1`` is looked up in the sparse transitions.
    """

    def __init__(self, samples: dict[str, list[str]]):
        self.languages = sorted(samples)
        texts = [" ".join(folded(t) for t in samples[k]) for k in self.languages]
        code = {c: i + 1 for i, c in enumerate(sorted(set("".join(texts))))}
        self.letters = np.zeros(0x110000, bool)
        self.symbol = np.zeros(0x110000, np.int32)  # 0: matches nothing
        for cp in range(0x110000):
            if 0xD800 <= cp < 0xE000:
                continue
            c = chr(cp)
            self.letters[cp] = c.isalpha()
            self.symbol[cp] = code.get(c.lower()[:1] if self.letters[cp] else " ", 0)
        tables, base, keys, ends = [], [0], [], []
        self.width = len(code) + 1
        self.column = np.zeros((len(texts), self.width), np.uint8)
        self.excess = np.ones(len(texts))
        self.dense = min(SYMBOLS, 1 + max((len(set(t)) for t in texts), default=0))  # columns in use
        for k, t in enumerate(texts):
            often = sorted(Counter(t).items(), key=lambda x: (-x[1], x[0]))
            for i, (c, _) in enumerate(often):
                self.column[k, code[c]] = min(i + 1, SYMBOLS - 1)
            entropy = -sum(m / len(t) * math.log2(m / len(t)) for _, m in often)
            self.excess[k] = max(1.0, entropy / math.log2(ALPHABET))
            dense = self.column[k].tolist()
            following = automaton(np.array([code[c] for c in t], np.int64))
            table = np.full((len(following), self.dense), -1, np.int32)
            for at, f in enumerate(following):
                for c, to in f.items():
                    if dense[c] < SYMBOLS - 1:
                        table[at, dense[c]] = to + base[-1]
                    else:
                        keys.append((at + base[-1]) * self.width + c)
                        ends.append(to + base[-1])
            tables.append(table)
            base.append(base[-1] + len(following))
        order = np.argsort(np.array(keys, np.int64))
        self.keys, self.ends = np.array(keys, np.int64)[order], np.array(ends, np.int32)[order]
        self.roots = np.array(base[:-1], np.int32)
        self.table = np.concatenate(tables).ravel() if tables else np.zeros(0, np.int32)
        self.bits = np.array([math.log2(max(2, len(t))) for t in texts])

    def follow(self, state: np.ndarray, column: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The states after ``symbol``, whose columns are ``column``; -1 is none."""
        to = self.table[state.astype(np.int64) * self.dense + column]
        if len(self.keys):
            i, j = np.nonzero(column == SYMBOLS - 1)
            if len(i):
                key = state[i, j if state.shape[1] > 1 else 0].astype(np.int64) * self.width + symbol[j]
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                to[i, j] = np.where(self.keys[at] == key, self.ends[at], -1)
        return to

    def phrases(self, points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Phrases of each text (rows) for each language (columns)."""
        n = np.diff(offsets)
        pieces = (n + BLOCK - 1) // BLOCK
        doc = np.repeat(np.arange(len(n)), pieces)
        inner = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = offsets[doc] + inner * BLOCK
        length = np.minimum(BLOCK, offsets[doc + 1] - start)
        order = np.argsort(-length, kind="stable")
        doc, start, length = doc[order], start[order], length[order]
        symbols = self.symbol[points]
        active = np.searchsorted(-length, -np.arange(BLOCK), side="left")  # blocks longer than each position
        roots = self.roots[:, None]
        state = np.repeat(roots, len(doc), axis=1)
        count = np.zeros((len(self.roots), len(doc)), np.int32)
        for t in range(BLOCK):
            k = int(active[t])
            if not k:
                break
            c = symbols[start[:k] + t]
            s = state[:, :k]
            column = self.column[:, c]
            to = self.follow(s, column, c)
            miss = to < 0
            count[:, :k] += miss | (s == roots)
            again = self.follow(roots, column, c)
            state[:, :k] = np.where(miss, np.where(again < 0, roots, again), to)
        out = np.zeros((len(n), len(self.roots)), np.int64)
        for i in range(len(self.roots)):
            out[:, i] = np.bincount(doc, weights=count[i], minlength=len(n)).astype(np.int64)
        return out

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and bits for each character of every text, over the language's ``excess``."""
        raw, at = common.bytes_of(column)
        names = np.full(len(at) - 1, "und", object)
        score, rate = np.zeros(len(at) - 1), np.zeros(len(at) - 1)
        if not self.languages:
            return names.tolist(), score, rate
        for i, j in common.steps(at, STEP_BYTES):
            part = raw[at[i] : at[j]]
            points = np.frombuffer(part.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
            lead = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])
            offsets = lead[at[i : j + 1] - at[i]]
            letter = self.letters[points]
            letters = np.concatenate([[0], np.cumsum(letter)])
            some = (letters[offsets[1:]] - letters[offsets[:-1]]) > 0
            keep = letter | np.concatenate([[False], letter[:-1]])  # one blank after a word
            points = points[keep]
            offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
            cost = self.phrases(points, offsets) * self.bits
            best = cost.argmin(axis=1)
            least = cost[np.arange(j - i), best]
            share = 1 / np.exp2(-np.minimum(1000, cost - least[:, None])).sum(axis=1)
            names[i:j] = np.where(some, np.array(self.languages, object)[best], "und")
            score[i:j] = np.where(some, share, 0)
            rate[i:j] = np.where(some, least / np.maximum(1, np.diff(offsets)) / self.excess[best], 0)
        return names.tolist(), score, rate


def fold(key: str = "doc_id", folds: int = 5):
    return F.crc32(F.col(key).cast("string")) % folds


def sample(docs: DataFrame, learn) -> dict[str, list[str]]:
    """Bounded labelled text of each language among the rows where ``learn`` holds."""
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")))
    usable = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") > 0))
    rows = usable.select("doc_id", "lang", F.substring("text", 1, SAMPLE_CHARS // 4).alias("text"), rank.alias("rank")).where(F.col("rank") <= SAMPLE_DOCS).orderBy("lang", "rank").collect()
    out: dict[str, list[str]] = {}
    size: Counter = Counter()
    bound = min(SAMPLE_CHARS, SAMPLE_TOTAL // max(1, len({r.lang for r in rows})))
    for r in rows:
        text = r.text[: bound - size[r.lang]]
        if text:
            out.setdefault(r.lang, []).append(text)
            size[r.lang] += len(text)
    return out


def identify(docs: DataFrame, learn) -> DataFrame:
    """``docs`` with ``lang_pred, score, bits_per_char``; learns from the rows where ``learn`` holds."""
    spark = docs.sparkSession
    common.light_batches(spark)
    sent = spark.sparkContext.broadcast(Model(sample(docs, learn)))
    taken = {"lang_pred", "score", "bits_per_char"} & set(docs.columns)
    docs = docs.drop(*taken)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, score, rate = sent.value.predict(batch.column(at))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names, pa.string()), pa.array(score), pa.array(rate)],
                names=[*batch.schema.names, "lang_pred", "score", "bits_per_char"],
            )

    schema = T.StructType([*docs.schema.fields]).add("lang_pred", "string").add("score", "double").add("bits_per_char", "double")
    return docs.mapInArrow(run, schema)


def accepted(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are in some language: not ``und``, and parsed in fewer than ``REJECT_BITS`` bits a character.

    A very short text is not judged by its bits, because one phrase more or less decides there.
    """
    rows = identify(docs, F.lit(True))
    language = (F.col("lang_pred") != "und") & ((F.col("bits_per_char") < REJECT_BITS) | (F.length("text") < 200))
    return rows.where(language).select(*docs.columns)


def op5_cross_parsing(spark: SparkSession, root: str) -> DataFrame:
    """Language of every document, learned from four of five labelled folds."""
    docs = common.table(spark, root, "documents").select("doc_id", "text", "lang")
    return identify(docs, fold() != 0).select(
        "doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "lang_pred", "score"
    )
