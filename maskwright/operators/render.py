"""The one definition of rendered text: redact, then alias, then normalize."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.keys import LabelKey
from ..functions.let import let
from ..functions.scan import count_up_to
from .aliases import to_alias
from .normalize import normalize
from .ruleset import RuleSet
from .spans import redact


def render(text: Column, rules: RuleSet, key: LabelKey) -> Column:
    """``struct(text, stages, redact_spans, aliased, normalized)``.

    The stage order is contractual: labels are computed on the original text,
    and a timestamp rewritten to UTC must not be scanned as a phone number.
    """

    def after_redact(r):
        def after_alias(a):
            return let(
                normalize(a.text, rules),
                lambda n: F.struct(
                    n.text.alias("text"),
                    F.array(
                        F.transform(
                            r.spans,
                            lambda s: F.struct(
                                s.real_start.alias("src_start"),
                                s.real_end.alias("src_end"),
                                s.red_start.alias("out_start"),
                                s.red_end.alias("out_end"),
                            ),
                        ),
                        a.spans,
                        n.spans,
                    ).alias("stages"),
                    r.spans.alias("redact_spans"),
                    a["count"].alias("aliased"),
                    n["count"].alias("normalized"),
                ),
            )

        return let(to_alias(r.text, rules), after_alias)

    return let(redact(text, rules, key), after_redact)


def rendered_text(text: Column, rules: RuleSet, key: LabelKey) -> Column:
    """Only the text, for callers that need no offset maps."""
    out = redact(text, rules, key).text
    if rules.aliases:
        out = to_alias(out, rules).text if not rules.buckets else let(out, lambda t: to_alias(t, rules).text)
    if rules.rewrites or rules.timezone:
        out = let(out, lambda t: normalize(t, rules).text)
    return out


def span_starts(spans: Column) -> Column:
    return F.transform(spans, lambda s: s.out_start)


def map_back(offset: Column, spans: Column, starts: Column | None = None) -> Column:
    """One stage: output offset to source offset, null strictly inside a replacement.

    Spans ascend and are disjoint, so the last one that begins before the offset decides; it is found
    by binary search.  ``starts`` are the spans' ``out_start``, if they are at hand.
    """

    def mapped(n: Column) -> Column:
        return let(
            F.get(spans, n - 1),
            lambda s: F.when(n == 0, offset).when(offset >= s.out_end, offset - s.out_end + s.src_end),
        )

    return let(count_up_to(span_starts(spans) if starts is None else starts, offset - 1), mapped)


def map_to_source(offset: Column, stages: Column, starts: Column | None = None) -> Column:
    """Rendered offset to original offset through the stages in reverse; ``starts`` are ``span_starts`` of each stage."""
    if starts is None:
        return F.aggregate(F.reverse(stages), offset.cast("int"), lambda o, spans: map_back(o, spans))
    paired = F.reverse(F.arrays_zip(stages.alias("spans"), starts.alias("starts")))
    return F.aggregate(paired, offset.cast("int"), lambda o, p: map_back(o, p["spans"], p["starts"]))
