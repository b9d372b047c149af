"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import collections
import re

LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def words(text: str | None) -> list[str]:
    return [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(LOWER)) if w]


class Union:
    def __init__(self, ids):
        self.parent = {i: i for i in ids}

    def root(self, x):
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)


def near_classes(rows, percent=85):
    sets = {}
    for i, text in rows:
        w = words(text)
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    holders, union = collections.defaultdict(list), Union(sets)
    for i, s in sets.items():
        shared = collections.Counter()
        for g in s:
            shared.update(holders[g])
            holders[g].append(i)
        for j, k in shared.items():
            if 100 * k >= percent * (len(s) + len(sets[j]) - k):
                union.join(i, j)
    return {i: (len(s), union.root(i)) for i, s in sets.items()}


def repeats(rows, n):
    """Words covered by repeated windows: {(doc, first): positions}."""
    places = collections.defaultdict(list)
    for i, text in rows:
        w = words(text)
        for p in range(len(w) - n + 1):
            places[tuple(w[p : p + n])].append((i, p))
    out = collections.defaultdict(set)
    for at in places.values():
        if len(at) > 1:
            for i, p in at:
                out[i, (i, p) == min(at)].update(range(p, p + n))
    return dict(out)
