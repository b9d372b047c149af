"""Scalar text functions shared by scans, reports and logs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import catalog
from .regexes import escape, to_java
from .scan import count_up_to, scan


def count_substring(text: Column, value: Column) -> Column:
    """Non-overlapping, case-sensitive occurrences of a non-empty string."""
    removed = F.length(F.replace(text, value, F.lit("")))
    return ((F.length(text) - removed) / F.length(value)).cast("int")


def line_of(text: Column, offset: Column) -> Column:
    """1-based line number of a 0-based offset."""
    before = F.substring(text, F.lit(1), offset)
    return (F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1).cast("int")


def line_starts(lines: Column) -> Column:
    """0-based offset at which each line of a split text starts."""
    return scan(
        lines,
        F.struct(F.lit(0).cast("int").alias("pos")),
        lambda at, x, emit: emit.one(F.struct((at["pos"] + F.length(x) + 1).cast("int").alias("pos")), at["pos"]),
        "int",
    )


def line_in(starts: Column, offset: Column) -> Column:
    """1-based line of an offset, given the line starts."""
    return count_up_to(starts, offset)


def line_context(text: Column, line: Column, width: int = 200) -> Column:
    """The given line, trimmed and cut to ``width`` characters."""
    whole = F.get(F.split(text, "\n", -1), line - 1)
    return F.substring(js_trim(whole), 1, width)


def js_trim(text: Column) -> Column:
    return F.regexp_replace(text, to_java(r"^\s+|\s+$"), "")


def title_case(text: Column) -> Column:
    """Lower-case, then raise every letter that follows a non letter or digit.

    Not ``initcap``: ``o'hara-smith`` becomes ``O'Hara-Smith``.
    """
    # A letter needs raising exactly when it starts a run of letters and digits.
    runs = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}]+"), F.lit(0))
    raised = F.transform(
        runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.substring(r, F.lit(2), F.length(r)))
    )
    return F.array_join(raised, "")


def scrub_addresses(text: Column) -> Column:
    """One-way: anything that looks like an IPv4 or IPv6 address is masked."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), to_java(catalog.IPV4_ANY), catalog.ADDRESS_MASK)
    return F.regexp_replace(t, f"(?i){to_java(catalog.IPV6_ANY)}", catalog.ADDRESS_MASK)


def mask_tokens(text: Column) -> Column:
    return F.regexp_replace(text, f"(?i){catalog.LOG_TOKEN}", "$1[redacted]")


def replace_insensitive(text: Column, value: str, replacement: str) -> Column:
    return F.regexp_replace(text, f"(?iu){escape(value)}", replacement)


def clip_words(text: Column, width: int) -> Column:
    """Collapse white space and cut at a word boundary, marking the cut."""
    t = F.trim(F.regexp_replace(text, to_java(r"\s+"), " "))
    cut = F.substring(t, 1, width)
    last_space = F.length(cut) - F.length(F.substring_index(cut, " ", -1)) - 1
    at_word = F.when(last_space > width * 0.6, F.substring(cut, F.lit(1), last_space)).otherwise(cut)
    return F.when(F.length(t) <= width, t).otherwise(
        F.concat(F.regexp_replace(at_word, "[,;:]$", ""), F.lit("…"))
    )
