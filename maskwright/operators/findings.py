"""Findings tables, counts, reports and the publish gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import catalog
from ..functions.keys import LabelKey
from ..functions.regexes import escape, folded, to_java
from ..functions.let import let
from ..functions.scan import pieces, scan
from ..functions.text import count_substring, js_trim, line_in, line_starts
from ..sources.tables import stored
from .ruleset import RuleSet
from .spans import cut, find_hits, may_match, redact


def findings(df: DataFrame, keys: list[str], text: str, rules: RuleSet) -> DataFrame:
    """One row per accepted span: keys, ``start, end, category, value``.

    A narrow transformation: scan, gate, spans and explode run in one stage.
    """
    t = F.col(text)

    # Values are cut before the explode, so that no hit drags the whole text along.
    def valued(hits: Column) -> Column:
        return let(
            pieces(t, hits, "real_start", "real_end", bound=True),
            lambda p: F.transform(
                hits,
                lambda h, i: F.struct(
                    h.real_start.alias("start"), h.real_end.alias("end"), h.category.alias("category"),
                    F.get(p["parts"], i)["value"].alias("value"),
                ),
            ),
        )

    return df.select(*keys, F.inline(let(find_hits(t, rules), lambda hits: F.when(F.size(hits) > 0, valued(hits)))))


def substring_offsets(text: Column, value: str) -> Column:
    """0-based offsets of the non-overlapping occurrences of a string."""
    gaps = F.split(text, escape(value), -1)
    n = F.size(gaps)
    ends = scan(
        F.slice(gaps, F.lit(1), F.greatest(n - 1, F.lit(0))),
        F.struct(F.lit(0).cast("int").alias("pos")),
        lambda at, g, emit: emit.one(
            F.struct((at["pos"] + F.length(g) + len(value)).cast("int").alias("pos")), (at["pos"] + F.length(g)).cast("int")
        ),
        "int",
    )
    return F.when(F.contains(text, F.lit(value)), ends).otherwise(F.array().cast("array<int>"))


def _fixed_hit(value: str, category: str):
    return lambda o: F.struct(
        o.alias("off"), (o + F.lit(len(value))).alias("stop"), F.lit(category).alias("category")
    )


def _located(t: Column, h: Column, line: Column, lines: Column, at: Column) -> Column:
    whole = F.get(lines, line - 1)
    begin, size = h.off - F.get(at.starts, line - 1), h.stop - h.off
    # A line is shorter than the text; only few hits span lines.
    value = F.when(begin + size <= F.length(whole), F.substring(whole, begin + 1, size)).otherwise(cut(t, h.off, h.stop))
    return F.struct(
        h.off.alias("off"), line.alias("line"), h.category.alias("category"), value.alias("value"),
        F.get(at.contexts, line - 1).alias("context"),
    )


def detailed_findings(
    df: DataFrame, keys: list[str], text: str, rules: RuleSet, offset: str | None = None, context: bool = True
) -> DataFrame:
    """Spans, identity values and a time-zone offset with line and context.

    One pass per unit: the hits are merged in an array before the explode.
    Without ``context`` only offset and category are produced.
    """
    t = F.col(text)
    lists = [
        F.transform(
            find_hits(t, rules),
            lambda h: F.struct(h.real_start.alias("off"), h.real_end.alias("stop"), h.category.alias("category")),
        )
    ]
    fixed = [(v, "identity") for v in rules.identity_values]
    if offset:
        fixed.append((offset, "timezone"))
    for value, category in fixed:
        lists.append(F.transform(substring_offsets(t, value), _fixed_hit(value, category)))

    def placed(hits):
        # Lines, their starts and their contexts are worked out once per unit.
        return let(
            F.split(t, "\n", -1),
            lambda lines: let(
                F.struct(
                    line_starts(lines).alias("starts"),
                    F.transform(lines, lambda x: F.substring(js_trim(x), 1, CONTEXT_CHARS)).alias("contexts"),
                ),
                lambda at: F.transform(hits, lambda h: let(line_in(at.starts, h.off), lambda n: _located(t, h, n, lines, at))),
            ),
        )

    if not context:
        flat = F.transform(F.concat(*lists), lambda h: F.struct(h.off.alias("off"), h.category.alias("category")))
        return df.select(*keys, F.inline(flat))
    return df.select(*keys, F.inline(let(F.concat(*lists), lambda hits: F.when(F.size(hits) > 0, placed(hits)))))


CONTEXT_CHARS = 200


def unit_counts(df: DataFrame, keys: list[str], text: str, rules: RuleSet) -> DataFrame:
    """``keys, category, n``: counted inside the row, so nothing is shuffled."""
    cats = F.transform(find_hits(F.col(text), rules), lambda h: h.category)
    return (
        df.select(*keys, F.explode(cats).alias("category"))
        .groupBy(*keys, "category")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _row_counts(df: DataFrame, keep: list[str], text: str, rules: RuleSet, extra_counts=()) -> DataFrame:
    """One row per (unit, category) or one with a null category for a clean unit."""
    hits = find_hits(F.col(text), rules)
    cats = F.transform(hits, lambda h: h.category)
    for category, count in extra_counts:
        cats = F.concat(cats, F.array_repeat(F.lit(category), count))
    return df.select(*keep, F.length(text).alias("_chars"), F.explode_outer(cats).alias("category"))


def scan_totals(df: DataFrame, text: str, rules: RuleSet, group: list[str] | None = None) -> DataFrame:
    """Units scanned, units with hits, characters and hits, per group and overall.

    Aggregated from one number per unit: partial aggregation leaves one row per
    group and task to shuffle, whatever the skew of the groups.
    """
    per_unit = df.select(
        *(group or []), F.length(text).alias("_chars"), F.size(find_hits(F.col(text), rules)).alias("_hits")
    )
    aggs = [
        F.count(F.lit(1)).alias("units"),
        F.count_if(F.col("_hits") > 0).alias("units_with"),
        F.sum(F.col("_chars")).cast("bigint").alias("chars"),
        F.sum(F.col("_hits")).cast("bigint").alias("hits"),
    ]
    return per_unit.rollup(*group).agg(*aggs) if group else per_unit.agg(*aggs)


def grouped_counts(df: DataFrame, group: str, text: str, rules: RuleSet) -> DataFrame:
    """Category counts per group with subtotals and grand total in one pass."""
    return (
        _row_counts(df, [group], text, rules)
        .where(F.col("category").isNotNull())
        .rollup(group, "category")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def category_totals(hits: DataFrame) -> DataFrame:
    """Hits per category, most first, and a TOTAL row."""
    return (
        hits.rollup("category")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.coalesce("category", F.lit("TOTAL")).alias("category"), "n")
        .orderBy(F.desc("n"), "category")
    )


def severity_order(hits: DataFrame, keys: list[str]) -> DataFrame:
    """Units with identity or personal hits first, then by number of hits."""
    severe = F.col("category").isin(catalog.SEVERE_CATEGORIES)
    return (
        hits.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n"), F.max(severe).alias("severe"))
        .orderBy(F.desc("severe"), F.desc("n"), *keys)
    )


def publish_gate(hits: DataFrame, published: DataFrame, keys: list[str], fail_on: list[str]) -> DataFrame:
    """One row per gated category over the publish set, with the verdict."""
    counts = (
        hits.where(F.col("category").isin(fail_on))
        .join(published.select(*keys).distinct(), keys, "left_semi")
        .groupBy("category")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    wanted = hits.sparkSession.createDataFrame([(c,) for c in fail_on], "category string")
    return (
        F.broadcast(wanted)
        .join(counts, "category", "left")
        .select("category", F.coalesce("n", F.lit(0)).alias("n"))
        .withColumn("verdict", F.when(F.col("n") > 0, "FAILED").otherwise("PASSED"))
    )


def published_split(hits: DataFrame, published: DataFrame, keys: list[str]) -> DataFrame:
    """Hits and units that will publish against those that stay local."""
    per_unit = hits.groupBy(*keys).agg(F.count(F.lit(1)).alias("hits"))
    members = published.select(*keys).distinct().withColumn("published", F.lit(True))
    return (
        per_unit.join(members, keys, "left")
        .groupBy(F.coalesce("published", F.lit(False)).alias("published"))
        .agg(F.sum("hits").alias("hits"), F.count(F.lit(1)).alias("units"))
    )


def change_log(df: DataFrame, keys: list[str], text: str, rules: RuleSet, key: LabelKey) -> DataFrame:
    """One record per replaced value with its line: restricted output."""
    t = F.col(text)

    def placed(spans):
        return let(
            line_starts(F.split(t, "\n", -1)),
            lambda starts: F.transform(
                spans,
                lambda s: F.struct(
                    line_in(starts, s.real_start).alias("line"), s.category.alias("category"),
                    s.value.alias("before"), s.label.alias("after"),
                ),
            ),
        )

    rows = let(redact(t, rules, key).spans, lambda spans: F.when(F.size(spans) > 0, placed(spans)))
    return df.select(*keys, F.inline(rows))


def report_lines(hits: DataFrame, key: str) -> DataFrame:
    """The ordered text report, one row per line, ready for ``write.text``.

    ``hits`` is a detailed findings table.  Rank columns give the order, so the
    report can be written in parallel and sorted by them.  The table is stored,
    as it is read three times: for the units, for the lines and for the bounds of the sort.
    """
    hits = stored(hits, "report")
    per_unit = severity_order(hits, [key])
    head = per_unit.select(
        F.col("severe"), F.col("n"), F.col(key), F.lit(0).alias("off"),
        F.concat(
            F.col(key).cast("string"), F.lit("   ("), F.col("n").cast("string"),
            F.when(F.col("n") == 1, " occurrence)").otherwise(" occurrences)"),
            F.when(F.col("severe"), "  [severe]").otherwise(""),
        ).alias("line_text"),
    )
    body = hits.join(per_unit, key).select(
        "severe", "n", key, (F.col("off") + 1).alias("off"),
        F.concat(
            F.lit("  line "), F.lpad(F.col("line").cast("string"), 6, " "),
            F.lit("  ["), F.col("category"), F.lit("]  "), F.col("value"),
            F.when(
                (F.col("context") != "") & (F.col("context") != F.col("value")),
                F.concat(F.lit("\n              | "), F.col("context")),
            ).otherwise(""),
        ).alias("line_text"),
    )
    return head.unionByName(body).orderBy(F.desc("severe"), F.desc("n"), key, "off", "line_text")


def audit_line(counts: Column, chars: Column, aliased: Column) -> Column:
    """Counts only, categories sorted, never a value."""
    pairs = F.transform(
        F.array_sort(F.map_entries(counts)),
        lambda e: F.concat(e.key, F.lit("="), e.value.cast("string")),
    )
    shown = F.when(F.size(pairs) == 0, "redacted=none").otherwise(F.array_join(pairs, " "))
    kb = F.format_number(F.round(chars / 1024, 1), 1)
    return F.concat(
        F.lit("walked="), F.replace(kb, F.lit(","), F.lit("")), F.lit("KB | "), shown,
        F.lit(" aliased="), aliased.cast("string"),
    )


def pattern_profile(df: DataFrame, text: str, patterns) -> DataFrame:
    """Hits and units hit per candidate pattern, from one scan of the corpus."""
    aggs = []
    for i, p in enumerate(patterns):
        counted = F.regexp_count(F.col(text), F.lit(folded(to_java(p.regex), p.insensitive)))
        n = F.when(may_match(F.col(text), p.hint), counted).otherwise(0)
        aggs += [F.sum(n).alias(f"n{i}"), F.count_if(n > 0).alias(f"u{i}")]
    wide = df.agg(*aggs)
    rows = F.array(
        *[
            F.struct(
                F.lit(p.name).alias("name"),
                F.coalesce(F.col(f"n{i}"), F.lit(0)).cast("bigint").alias("hits"),
                F.col(f"u{i}").cast("bigint").alias("units"),
            )
            for i, p in enumerate(patterns)
        ]
    )
    return (
        wide.select(F.inline(rows))
        .withColumn(
            "verdict",
            F.when(F.col("hits") == 0, "nothing matches in this corpus").otherwise("look at the matches first"),
        )
        .orderBy(F.desc("hits"), "name")
    )


def identity_count(text: Column, values: list[str]) -> Column:
    total = F.lit(0)
    for v in values:
        total = total + count_substring(text, F.lit(v))
    return total
