"""One-way environment normalization: datetime offsets, bare offsets, rewrites."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import catalog
from ..functions.regexes import FIELD_MARK, count_groups, folded, js_template, to_java
from .ruleset import Rewrite, RuleSet
from .spans import apply_rewrites

DATETIME = to_java(catalog.DATETIME_OFFSET)
BARE = to_java(catalog.BARE_OFFSET)
_EPOCH = "1970-01-01"


def utc_text(y, mo, d, h, mi, s, frac, sign, oh, om) -> Column:
    """ISO UTC form of the captured fields, or the same fields with ``+0000``.

    Built from date arithmetic rather than timestamps, so the session time zone
    has no influence.  A day past the end of its month rolls over.
    """
    year, month, day, hour, minute, second, off_h, off_m = (
        x.cast("int") for x in (y, mo, d, h, mi, s, oh, om)
    )
    possible = (
        month.between(1, 12) & day.between(1, 31) & (minute <= 59) & (second <= 59)
        & ((hour <= 23) | ((hour == 24) & (minute == 0) & (second == 0)))
        & (off_h <= 23) & (off_m <= 59)
    )
    first = F.make_date(year, F.when(possible, month).otherwise(F.lit(1)), F.lit(1))
    days = F.datediff(first, F.lit(_EPOCH).cast("date")) + day - 1
    offset = (off_h * 60 + off_m) * F.when(sign == "-", F.lit(-60)).otherwise(F.lit(60))
    seconds = days.cast("bigint") * 86400 + hour * 3600 + minute * 60 + second - offset
    date = F.date_add(F.lit(_EPOCH).cast("date"), F.floor(seconds / 86400).cast("int")).cast("string")
    clock = F.pmod(seconds, F.lit(86400))

    def two(x):
        return F.lpad(x.cast("int").cast("string"), 2, "0")

    time = F.concat_ws(":", two(F.floor(clock / 3600)), two(F.floor(clock % 3600 / 60)), two(clock % 60))
    millis = F.when(frac == "", F.lit("")).otherwise(F.rpad(F.substring(frac, 1, 4), 4, "0"))
    blanked = F.concat(F.concat_ws("-", y, mo, d), F.lit("T"), F.concat_ws(":", h, mi, s), frac, F.lit("+0000"))
    return F.when(possible, F.concat(date, F.lit("T"), time, millis, F.lit("Z"))).otherwise(blanked)


def rewrite_regex(r: Rewrite) -> str:
    flags = r.flags or ""
    source = folded(to_java(r.regex), "i" in flags)
    return "(?m)" + source if "m" in flags else source


def _entries(rewrites: tuple[Rewrite, ...], timezone: bool):
    entries = [
        (rewrite_regex(r), js_template(r.replace, count_groups(r.regex)), lambda f: F.get(f, F.lit(1)))
        for r in rewrites
    ]
    if timezone:
        entries.append(
            (
                DATETIME,
                FIELD_MARK.join(f"${i}" for i in range(1, 11)),
                lambda f: utc_text(*[F.get(f, F.lit(i)) for i in range(1, 11)]),
            )
        )
        entries.append((BARE, "$1\\+0000", lambda f: F.get(f, F.lit(1))))
    return entries


def normalize(text: Column, rules: RuleSet) -> Column:
    """All rewrites found on the original text, earliest and longest first."""
    # A cheap digit-or-slash test covers the timezone part; user rewrites are arbitrary.
    hint = r"[+-]\d\d:?\d\d" if rules.timezone and not rules.rewrites else None
    if hint is None and (rules.rewrites or rules.timezone):
        parts = [rewrite_regex(r) for r in rules.rewrites] + ([r"[+-]\d\d:?\d\d"] if rules.timezone else [])
        hint = "|".join(f"(?:{p})" for p in parts)
    return apply_rewrites(text, _entries(rules.rewrites, rules.timezone), hint)


def dates_to_utc(text: Column) -> Column:
    """``struct(text, count, spans)`` with only the dated offsets rewritten."""
    return apply_rewrites(text, _entries((), True)[:1], r"[+-]\d\d:?\d\d")


def blank_offsets(text: Column) -> Column:
    """An offset on its own loses its value but not its place."""
    return F.regexp_replace(text, BARE, "$1\\+0000")


def normalize_in_turn(text: Column, rules: RuleSet) -> Column:
    """The sequential form: each rewrite sees the output of the one before."""
    out = text
    for r in rules.rewrites:
        out = F.regexp_replace(out, rewrite_regex(r), js_template(r.replace, count_groups(r.regex)))
    if rules.timezone:
        out = dates_to_utc(out).text
        out = blank_offsets(out)
    return out
