"""The frozen rule configuration that batch, stream and verify jobs share.

Rules live in small typed tables (see ``rules.py``); once validated they are
turned into one immutable object from which column expressions are built.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from ..functions import catalog
from ..functions.regexes import count_groups, folded, is_word_token, literal_source, to_java


def row_hash(section: str, *fields) -> bytes:
    """SHA-256 of a section's row: each field as its length in characters, a colon and itself, null as ``n``."""
    parts = []
    for v in (section, *fields):
        text = None if v is None else str(v).lower() if isinstance(v, bool) else str(v)
        parts.append("n" if text is None else f"{len(text)}:{text}")
    return hashlib.sha256("".join(parts).encode()).digest()


def combined_hash(hashes: list[bytes]) -> str:
    """Row hashes added up in four lanes of 32 bits, in any order, with their number."""
    lanes = [str(sum(int.from_bytes(h[4 * i : 4 * i + 4], "big") for h in hashes)) for i in range(4)]
    return hashlib.sha256(":".join([str(len(hashes)), *lanes]).encode()).hexdigest()


# Necessary conditions, any of which may hold: (needed characters, java regex).
Hint = tuple[tuple[str, str], ...]


def join_hints(hints) -> Hint | None:
    hints = list(hints)
    if any(h is None for h in hints):
        return None
    return tuple(dict.fromkeys(test for h in hints for test in h))


@dataclass(frozen=True)
class Pattern:
    name: str
    regex: str
    flags: str = "g"
    category: str | None = None
    # What every matching text must also hold; None = always try.
    hint: Hint | None = None

    @property
    def insensitive(self) -> bool:
        return "i" in (self.flags or "")


@dataclass(frozen=True)
class Literal:
    value: str
    boundary: bool


@dataclass(frozen=True)
class Alias:
    real: str
    alias: str


@dataclass(frozen=True)
class Rewrite:
    name: str
    regex: str
    flags: str = "g"
    replace: str = ""


@dataclass(frozen=True)
class Bucket:
    """Patterns of one case sensitivity, joined so the first alternative wins."""

    regex: str
    names: tuple[str, ...]
    groups: tuple[int, ...]
    hint: Hint | None
    # Each alternative on its own, with a stand-in that keeps the group numbers
    # but never matches: texts that cannot hold a pattern do not pay for it.
    parts: tuple[tuple[str, str, Hint | None], ...] = ()
    insensitive: bool = False


def _bucket(patterns: list[Pattern], insensitive: bool) -> Bucket:
    parts, optional, groups, at, hints = [], [], [], 1, []
    for p in patterns:
        part, inner = f"({to_java(p.regex)})", count_groups(p.regex)
        parts.append(part)
        optional.append((part, "((?!)" + "()" * inner + ")", p.hint))
        groups.append(at)
        at += 1 + inner
        hints.append(p.hint)
    hint = join_hints(hints)
    return Bucket(folded("|".join(parts), insensitive), tuple(p.name for p in patterns),
                  tuple(groups), hint, tuple(optional), insensitive)


def literal_bucket(lit: Literal) -> Bucket:
    """A literal is always a regex of its own, so that crossing literals are both seen."""
    source = literal_source(lit.value, lit.boundary)
    return Bucket(f"({source})", (catalog.LITERAL_CATEGORY,), (1,),
                  (("", literal_source(lit.value, False)),))


@dataclass(frozen=True)
class RuleSet:
    patterns: tuple[Pattern, ...] = ()
    literals: tuple[Literal, ...] = ()
    aliases: tuple[Alias, ...] = ()
    rewrites: tuple[Rewrite, ...] = ()
    timezone: bool = False
    remote_prefixes: tuple[str, ...] = ()
    buckets: tuple[Bucket, ...] = field(init=False, compare=False)

    def __post_init__(self):
        split: dict[bool, list[Pattern]] = {}
        for p in self.patterns:
            split.setdefault(p.insensitive, []).append(p)
        buckets = [_bucket(ps, ci) for ci, ps in split.items()]
        longest_first = sorted(self.literals, key=lambda x: -len(x.value))
        object.__setattr__(self, "literals", tuple(longest_first))
        object.__setattr__(self, "aliases", tuple(sorted(self.aliases, key=lambda a: -len(a.real))))
        object.__setattr__(self, "buckets", tuple(buckets + [literal_bucket(x) for x in longest_first]))

    @property
    def categories(self) -> list[str]:
        return list(dict.fromkeys(n for b in self.buckets for n in b.names))

    @property
    def identity_values(self) -> list[str]:
        """Alias real values: hidden by aliasing outbound, but raw at rest."""
        return [a.real for a in self.aliases if len(a.real) >= catalog.MIN_LITERAL_CHARS]

    @property
    def fingerprint(self) -> str:
        """Covers exactly what decides whether a unit is clean; rows are framed and combined as in ``rules.fingerprint``.

        Pattern order counts (the first alternative wins), the order of the other sections does not.
        """
        rows = [("literals", x.value, x.boundary) for x in self.literals]
        rows += [("patterns", i, p.name, p.regex, p.flags) for i, p in enumerate(self.patterns)]
        rows += [("aliases", a.real, a.alias) for a in self.aliases]
        rows += [("rewrites", r.name, r.regex, r.flags, r.replace) for r in self.rewrites]
        rows += [("settings", self.timezone)]
        return combined_hash([row_hash(*r) for r in rows])


def make_literal(value: str, boundary: bool | None = None) -> Literal | None:
    """Trim, drop what is too short or a template placeholder, decide the guard."""
    v = value.strip()
    if len(v) < catalog.MIN_LITERAL_CHARS or v.lower() in catalog.PLACEHOLDER_LITERALS:
        return None
    return Literal(v, is_word_token(v) if boundary is None else boundary)


def make_rules(
    patterns=(), literals=(), aliases=(), rewrites=(), timezone=False, remote_prefixes=()
) -> RuleSet:
    """Build a rule set from plain tuples, applying the same filters as the rule tables."""
    lits = []
    for entry in literals:
        value, boundary = (entry, None) if isinstance(entry, str) else entry
        made = make_literal(value, boundary)
        if made:
            lits.append(made)
    pairs = [Alias(r, a) for r, a in aliases if len(r.strip()) >= catalog.MIN_LITERAL_CHARS and a.strip()]
    return RuleSet(
        tuple(patterns), tuple(lits), tuple(pairs), tuple(rewrites), timezone, tuple(remote_prefixes)
    )


def shipped_hint(name: str) -> Hint:
    return tuple(catalog.PATTERN_HINTS[name])


def default_patterns() -> list[Pattern]:
    return [Pattern(n, r, f, None, shipped_hint(n)) for n, r, f in catalog.DEFAULT_PATTERNS]


def optional_patterns() -> list[Pattern]:
    return [Pattern(n, r, f, c, shipped_hint(n)) for n, c, r, f in catalog.OPTIONAL_PATTERNS]


def all_patterns() -> list[Pattern]:
    return default_patterns() + optional_patterns()


def pattern_named(name: str) -> Pattern:
    return next(p for p in all_patterns() if p.name == name)


def default_rewrites() -> list[Rewrite]:
    return [Rewrite(*r) for r in catalog.DEFAULT_REWRITES]
