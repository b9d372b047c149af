"""Candidate spans, conflict resolution and keyed redaction as column expressions.

One ``regexp_replace`` per regex wraps every match in marks; splitting on the
marks yields the gaps, the matches and (from the position of the non-empty
field) which alternative matched.  Everything stays inside one projection: no
shuffle, no Python worker.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import catalog
from ..functions.keys import LABEL_GUARD, LABEL_OVERHEAD, LabelKey, label
from ..functions.let import let
from ..functions.regexes import FIELD_MARK, MARK_STAND_IN, MATCH_MARK, escape, escape_class
from ..functions.scan import pieces, scan
from .ruleset import Bucket, Hint, RuleSet, join_hints

# s = start, ne = negated end (so that natural struct order is "earliest first,
# longest first, then rule order"), v = category or replacement text.
CANDIDATE = "struct<s:int,ne:int,o:int,v:string>"
HIT = "struct<real_start:int,real_end:int,red_start:int,red_end:int,category:string>"
SPAN = (
    "struct<real_start:int,real_end:int,red_start:int,red_end:int,"
    "value:string,category:string,label:string>"
)
REDACTED = f"struct<text:string,spans:array<{SPAN}>>"
MAP_SPAN = "struct<src_start:int,src_end:int,out_start:int,out_end:int>"


def _i(n: int) -> Column:
    return F.lit(n).cast("int")


def working_copy(text: Column) -> Column:
    """Same length, free of the two marks."""
    held = F.contains(text, F.lit(MATCH_MARK)) | F.contains(text, F.lit(FIELD_MARK))
    return F.when(held, F.translate(text, MATCH_MARK + FIELD_MARK, MARK_STAND_IN * 2)).otherwise(text)


def marked_matches(
    work: Column, regex: Column | str, fields: str, read, order: int, element: str = CANDIDATE
) -> Column:
    """All non-empty matches of ``regex`` with offsets.

    ``fields`` is the replacement template put between the marks; ``read`` maps
    that piece to ``(match length, v)``.
    """
    marked = F.split(
        F.regexp_replace(work, regex, MATCH_MARK + fields + MATCH_MARK), MATCH_MARK, -1
    )

    def step(at, piece, emit):
        n, v = read(piece.p)

        def hit(size):
            end = at["pos"] + size
            item = F.struct(
                at["pos"].alias("s"), (-end).alias("ne"), _i(order).alias("o"), v.alias("v")
            )
            state = F.struct(end.alias("pos"))
            return F.when(size > 0, emit.one(state, item)).otherwise(emit.nothing(state))

        gap = emit.nothing(F.struct((at["pos"] + F.length(piece.p)).alias("pos")))
        return F.when(piece.i % 2 == 0, gap).otherwise(hit(n))

    numbered = F.transform(marked, lambda p, i: F.struct(p.alias("p"), i.alias("i")))
    return scan(numbered, F.struct(_i(0).alias("pos")), step, element)


def bucket_candidates(work: Column, bucket: Bucket, order: int) -> Column:
    names = bucket.names
    if len(names) == 1:
        # One alternative: the piece is the match.
        return marked_matches(work, bucket.regex, f"${bucket.groups[0]}",
                              lambda p: (F.length(p), F.lit(names[0])), order)
    fields = FIELD_MARK.join(f"${g}" for g in bucket.groups)
    table = const_list(list(names))

    def read(piece):
        parts = F.transform(F.split(piece, FIELD_MARK, -1), lambda x: x != "")
        which = F.array_position(parts, F.lit(True)).cast("int")
        return F.length(piece) - _i(len(names) - 1), F.get(table, which - 1)

    return marked_matches(work, bucket.regex, fields, read, order)


def const_list(values: list[str]) -> Column:
    """A constant array of strings (folded by the optimizer)."""
    return F.split(F.lit(MATCH_MARK.join(values)), MATCH_MARK, -1)


def label_regions(work: Column) -> Column:
    """Where labels already are; nothing touching one may be redacted again."""
    found = marked_matches(work, f"({LABEL_GUARD})", "$1", lambda p: (F.length(p), F.lit("")), 0)
    return F.when(F.contains(work, F.lit("[PII:")), found).otherwise(
        F.array().cast(f"array<{CANDIDATE}>")
    )


def candidates(work: Column, rules: RuleSet, own_literal: Column | None = None, places: Column | None = None) -> Column:
    """Every match of every rule over the original text, in resolution order.

    ``own_literal`` is one more literal whose regex comes from a column, ``places`` are candidates
    that were found elsewhere.
    """
    empty = F.array().cast(f"array<{CANDIDATE}>")
    lists = []
    for order, bucket in enumerate(rules.buckets):
        found = bucket_candidates(work, bucket, order)
        # With a single bucket the whole-text gate has already tested this hint.
        if bucket.hint is not None and len(rules.buckets) > 1:
            found = F.when(may_match(work, bucket.hint), found).otherwise(empty)
        lists.append(found)
    if own_literal is not None:
        category = F.lit(catalog.LITERAL_CATEGORY)
        lists.append(
            marked_matches(work, own_literal, "$0", lambda p: (F.length(p), category), len(rules.buckets))
        )
    if places is not None:
        lists.append(places)
    merged = lists[0] if len(lists) == 1 else F.array_sort(F.concat(*lists))

    def unprotected(regions):
        return F.when(F.size(regions) == 0, merged).otherwise(
            F.filter(
                merged,
                lambda c: ~F.exists(regions, lambda r: (c.s < -r.ne) & (-c.ne > r.s)),
            )
        )

    return let(label_regions(work), unprotected)


def clip_conflicts(found: Column) -> Column:
    """Nested candidates are dropped, crossing ones clipped to their uncovered tail."""
    def step(acc, c, emit):
        end = -c.ne
        begin = F.greatest(c.s, acc["cursor"])
        size = F.length(c.v) + _i(LABEL_OVERHEAD)
        hit = F.struct(
            begin.alias("real_start"),
            end.alias("real_end"),
            (begin + acc["delta"]).alias("red_start"),
            (begin + acc["delta"] + size).alias("red_end"),
            c.v.alias("category"),
        )
        taken = F.struct(end.alias("cursor"), (acc["delta"] + size - (end - begin)).alias("delta"))
        return F.when(end <= acc["cursor"], emit.nothing(acc)).otherwise(emit.one(taken, hit))

    return scan(found, F.struct(_i(0).alias("cursor"), _i(0).alias("delta")), step, HIT)


def may_match(text: Column, hint: Hint | None) -> Column:
    """Cheap test that is true for every text holding a match."""
    if hint is None:
        return F.lit(True)
    by_need: dict[str, list[str]] = {}
    for need, regex in hint:
        by_need.setdefault(need, []).append(regex)
    tests, direct = [], []
    for regex in by_need.pop("", []):
        plain = regex.replace("\\.", ".")
        # A byte search is much cheaper than a regex.
        if escape(plain) == regex:
            tests.append(F.contains(text, F.lit(plain)))
        else:
            direct.append(regex)
    if direct:
        tests.append(F.rlike(text, F.lit("|".join(direct))))
    if by_need:
        members = {n: n if n == "0-9" else escape_class(n) for n in by_need}
        held = [
            F.rlike(text, F.lit(f"[{members[n]}]")) & F.rlike(text, F.lit("|".join(regexes)))
            for n, regexes in by_need.items()
        ]
        # One scan for any needed character guards all of these.
        chars = "".join(members.values())
        tests.append(F.rlike(text, F.lit(f"[{chars}]")) & reduce(or_, held))
    return reduce(or_, tests) if tests else F.lit(False)


def gate(text: Column, rules: RuleSet) -> Column:
    return may_match(text, join_hints(b.hint for b in rules.buckets))


def _hits(text: Column, rules: RuleSet) -> Column:
    return let(working_copy(text), lambda w: clip_conflicts(candidates(w, rules)))


def find_hits(text: Column, rules: RuleSet) -> Column:
    """Accepted spans without values or labels: offsets and category only."""
    empty = F.array().cast(f"array<{HIT}>")
    if not rules.buckets:
        return empty
    return F.when(gate(text, rules), _hits(text, rules)).otherwise(empty)


def cut(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, start + 1, end - start)


def rebuild(text: Column, items: Column, start: str, end: str, value) -> Column:
    """The text with each item replaced, joined in one go."""
    return F.when(F.size(items) == 0, text).otherwise(
        let(pieces(text, items, start, end, bound=True), lambda p: joined(p, items, value))
    )


def joined(p: Column, items: Column, value) -> Column:
    """Gaps and replacements of ``pieces`` in their order, and the rest."""
    return F.concat(
        F.array_join(F.transform(items, lambda x, i: F.concat(F.get(p["parts"], i)["gap"], value(x))), ""), p["rest"]
    )


def redact(
    text: Column, rules: RuleSet, key: LabelKey, own_literal: Column | None = None, places: Column | None = None
) -> Column:
    """``struct(text, spans)`` with every accepted span replaced by its label."""

    def with_values(hits):
        def spanned(p):
            def span(h, i):
                return let(
                    F.get(p["parts"], i)["value"],
                    lambda v: F.struct(
                        h.real_start, h.real_end, h.red_start, h.red_end,
                        v.alias("value"), h.category, label(v, h.category, key).alias("label"),
                    ),
                )

            return let(
                F.transform(hits, span),
                lambda spans: F.struct(joined(p, spans, lambda s: s.label).alias("text"), spans.alias("spans")),
            )

        return let(pieces(text, hits, "real_start", "real_end", bound=True), spanned)

    untouched = F.struct(text.alias("text"), F.array().cast(f"array<{SPAN}>").alias("spans"))
    if own_literal is not None:
        found = let(working_copy(text), lambda w: clip_conflicts(candidates(w, rules, own_literal)))
        return let(found, with_values).cast(REDACTED)
    if places is not None:
        found = let(working_copy(text), lambda w: clip_conflicts(candidates(w, rules, places=places)))
        touched = F.size(places) > 0
        return F.when(touched | gate(text, rules) if rules.buckets else touched, let(found, with_values)).otherwise(untouched).cast(REDACTED)
    if not rules.buckets:
        return untouched.cast(REDACTED)
    full = let(_hits(text, rules), with_values)
    return F.when(gate(text, rules), full).otherwise(untouched).cast(REDACTED)


def category_counts(spans: Column) -> Column:
    """``map<category, n>`` of one unit."""
    cats = F.transform(spans, lambda s: s.category)
    return F.map_from_entries(
        F.transform(
            F.array_sort(F.array_distinct(cats)),
            lambda c: F.struct(c.alias("key"), F.size(F.filter(cats, lambda x: x == c)).alias("value")),
        )
    )


def drop_conflicts(found: Column) -> Column:
    """Earliest wins, then longest; anything overlapping an accepted one is dropped."""
    def step(acc, c, emit):
        return F.when(c.s < acc["cursor"], emit.nothing(acc)).otherwise(emit.one(F.struct((-c.ne).alias("cursor")), c))

    return scan(found, F.struct(_i(0).alias("cursor")), step, CANDIDATE)


def replaced(text: Column, found: Column) -> Column:
    """Apply resolved replacements: ``struct(text, count, spans)``."""

    def build(kept):
        placed = scan(
            kept,
            F.struct(_i(0).alias("delta")),
            lambda acc, c, emit: emit.one(
                F.struct((acc["delta"] + F.length(c.v) - (-c.ne - c.s)).alias("delta")),
                F.struct(
                    c.s.alias("src_start"),
                    (-c.ne).alias("src_end"),
                    (c.s + acc["delta"]).alias("out_start"),
                    (c.s + acc["delta"] + F.length(c.v)).alias("out_end"),
                ),
            ),
            MAP_SPAN,
        )
        ends = F.transform(kept, lambda c: F.struct(c.s.alias("s"), (-c.ne).alias("e"), c.v.alias("v")))
        return F.struct(
            let(ends, lambda e: rebuild(text, e, "s", "e", lambda c: c.v)).alias("text"),
            F.size(kept).alias("count"),
            placed.alias("spans"),
        )

    return let(drop_conflicts(found), build)


REPLACED = f"struct<text:string,count:int,spans:array<{MAP_SPAN}>>"


def untouched(text: Column) -> Column:
    return F.struct(
        text.alias("text"), _i(0).alias("count"), F.array().cast(f"array<{MAP_SPAN}>").alias("spans")
    ).cast(REPLACED)


def apply_rewrites(text: Column, entries: list[tuple[str, str, object]], hint: str | None) -> Column:
    """Replace by several rules in one pass over the original text.

    ``entries`` are ``(java regex, field template, read)``; ``read`` turns the
    template fields into the replacement text.
    """
    if not entries:
        return untouched(text)

    def run(work):
        lists = []
        for order, (regex, fields, value) in enumerate(entries):
            lists.append(
                marked_matches(
                    work, regex, f"$0{FIELD_MARK}{fields}",
                    lambda p, value=value: _match_and_value(p, value), order,
                )
            )
        merged = F.array_sort(F.concat(*lists)) if len(lists) > 1 else lists[0]
        return replaced(text, merged)

    full = let(working_copy(text), run)
    if hint is None:
        return full.cast(REPLACED)
    return F.when(F.rlike(text, F.lit(hint)), full).otherwise(untouched(text)).cast(REPLACED)


def _match_and_value(piece: Column, value) -> tuple[Column, Column]:
    fields = F.split(piece, FIELD_MARK, -1)
    return F.length(F.get(fields, F.lit(0))), value(fields)
