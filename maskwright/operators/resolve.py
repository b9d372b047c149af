"""Turning labels back into values, and edits on rendered text into real edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import catalog
from ..functions.keys import LABEL_RESOLVE, LabelKey, labels_in
from ..functions.let import let
from ..functions.regexes import MATCH_MARK
from .joins import is_small, lookup
from .nested import deep_transform
from .render import map_to_source, render, span_starts
from .ruleset import RuleSet
from .spans import cut, working_copy

NO_VALUES = "map<string,string>"


def has_label(text: Column) -> Column:
    return F.rlike(text, F.lit(LABEL_RESOLVE))


def fill(text: Column, values: Column) -> Column:
    """Replace the labels found in a ``map<label, value>``; others stay."""

    def filled(work):
        pieces = F.split(F.regexp_replace(work, LABEL_RESOLVE, f"{MATCH_MARK}$0{MATCH_MARK}"), MATCH_MARK, -1)
        return F.array_join(
            F.transform(
                pieces,
                lambda p, i: F.when(i % 2 == 0, p).otherwise(F.coalesce(F.try_element_at(values, p), p)),
            ),
            "",
        )

    return F.when(F.contains(text, F.lit("[PII:")), let(working_copy(text), filled)).otherwise(text)


def span_values(spans: Column) -> Column:
    """``map<label, value>`` of a unit's own spans."""
    pairs = F.transform(spans, lambda s: F.struct(s.label.alias("key"), s.value.alias("value")))
    return F.map_from_entries(F.array_distinct(pairs))


def rehydrate(text: Column, spans: Column) -> Column:
    """By the unit's own spans only; null when an unknown label is left."""
    return let(fill(text, span_values(spans)), lambda t: F.when(~has_label(t), t))


def with_values(df: DataFrame, keys: list[str], texts: Column, known: DataFrame, bounded: bool) -> DataFrame:
    """Add ``_values``, a map with the dictionary entries a unit's labels need.

    A bounded dictionary (a capped vault), if its checked size allows, becomes one
    constant map: no join and no second look at ``df``.  Any other is joined; ``df``
    is then used twice and should be a stored table.
    """
    if bounded and is_small(known):
        pairs = known.agg(F.map_from_entries(F.collect_list(F.struct("label", "value"))).alias("m"))
        return df.withColumn("_values", pairs.scalar())
    return df.join(unit_values(df, keys, texts, known), keys, "left")


def unit_values(df: DataFrame, keys: list[str], texts: Column, known: DataFrame) -> DataFrame:
    """``keys, values``: for every unit the dictionary entries its labels need.

    Each unit's map is bounded by the labels in its own text.
    """
    wanted = df.select(*keys, F.explode(F.array_distinct(labels_in(texts))).alias("label"))
    found = lookup(wanted, known.select("label", "value"), "label")
    return (
        found.where(F.col("value").isNotNull())
        .groupBy(*keys)
        .agg(F.map_from_entries(F.collect_list(F.struct("label", "value"))).alias("_values"))
    )


def resolve_from_vault(
    df: DataFrame, keys: list[str], text: str, known: DataFrame, bounded: bool = False, strict: bool = False
) -> DataFrame:
    """Labels replaced from the dictionary; unknown ones stay, or null if ``strict``."""
    full = fill(F.col(text), F.coalesce("_values", F.create_map().cast(NO_VALUES)))
    if strict:
        full = let(full, lambda t: F.when(~has_label(t), t))
    return with_values(df, keys, F.col(text), known, bounded).withColumn(text, full).drop("_values")


def resolve_labels(
    df: DataFrame, keys: list[str], text: str, spans: str, known: DataFrame, bounded: bool = False
) -> DataFrame:
    """Strict: own spans first, then the dictionary; null when anything is left."""
    own = df.withColumn("_values_own", span_values(F.col(spans)))
    own = own.withColumn(text, fill(F.col(text), F.col("_values_own"))).drop("_values_own")
    return resolve_from_vault(own, keys, text, known, bounded, strict=True)


def resolve_deep(df: DataFrame, keys: list[str], column: str, known: DataFrame, bounded: bool = False) -> DataFrame:
    """Every string of a nested column; a string with an unknown label stays as it is."""
    dtype = df.schema[column].dataType
    def one(text):
        return let(
            fill(text, F.coalesce("_values", F.create_map().cast(NO_VALUES))),
            lambda t: F.when(has_label(t), text).otherwise(t),
        )

    return (
        with_values(df, keys, F.to_json(F.struct(column)), known, bounded)
        .withColumn(column, deep_transform(F.col(column), dtype, one, opaque=False))
        .drop("_values")
    )


def label_sources(df: DataFrame, text: str, known: DataFrame, bounded: bool = False) -> DataFrame:
    """Occurrences of labels per lookup outcome: cacheHit, literalDerived, unresolved."""
    used = df.select(F.explode(labels_in(F.col(text))).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    joined = lookup(used, known.select("label", "source"), "label", bounded)
    return joined.groupBy(F.coalesce("source", F.lit("unresolved")).alias("source")).agg(F.sum("n").alias("n"))


# --- policy and path safety --------------------------------------------------------------


def is_remote(name: Column, prefixes: tuple[str, ...]) -> Column:
    """Names with a remote prefix get neither real aliases nor real values."""
    out = F.lit(False)
    for p in prefixes:
        out = out | F.startswith(name, F.lit(p))
    return F.coalesce(out, F.lit(False))


def climbing_segments(path: Column) -> Column:
    return F.size(F.filter(F.split(path, r"[\\/]+", -1), lambda x: x == ".."))


def is_unsafe_path(before: Column, after: Column) -> Column:
    """A resolved value must not add ``..`` segments or a NUL."""
    return F.contains(after, F.lit("\0")) | (climbing_segments(after) > climbing_segments(before))


def path_outcome(before: Column, resolved: Column) -> Column:
    """``resolved`` is the strict result (null when a label is left)."""
    return (
        F.when(~has_label(before), F.lit("noLabel"))
        .when(resolved.isNull(), "pathLabelUnresolved")
        .when(is_unsafe_path(before, resolved), "pathUnsafe")
        .otherwise("pathResolved")
    )


def path_text(before: Column, resolved: Column) -> Column:
    """All or nothing: the original unless the whole path resolved safely."""
    return F.when(path_outcome(before, resolved) == "pathResolved", resolved).otherwise(before)


def field_roles(spark) -> DataFrame:
    """Policy table ``kind, field, role``: which record fields are paths or patterns."""
    rows = [
        (kind, f, role)
        for kind, (paths, patterns) in catalog.RECORD_FIELDS.items()
        for role, fields in (("path", paths), ("pattern", patterns))
        for f in fields
    ]
    return spark.createDataFrame(rows, "kind string, field string, role string")


def resolve_fields(
    records: DataFrame, keys: list[str], known: DataFrame, remote: tuple[str, ...] = (), bounded: bool = False
) -> DataFrame:
    """Field-wise resolution of ``(keys, kind, field, value)`` with one outcome each.

    Paths are all-or-nothing and must not climb, patterns are resolved or kept,
    content keeps unknown labels out (strict), and remote kinds are left alone.
    """
    spark = records.sparkSession
    strict = resolve_from_vault(records.withColumn("_out", F.col("value")), keys, "_out", known, bounded, True)
    roled = strict.join(F.broadcast(field_roles(spark)), ["kind", "field"], "left")
    value, out, role = F.col("value"), F.col("_out"), F.coalesce("role", F.lit("content"))
    outcome = (
        F.when(is_remote(F.col("kind"), remote), "remote")
        .when(role == "path", path_outcome(value, out))
        .when(role == "pattern", F.when(out.isNull(), "patternLabelUnresolved").otherwise("resolved"))
        .otherwise(F.when(out.isNull(), "labelSurvivedWrite").otherwise("resolved"))
    )
    keep = F.col("outcome").isin("remote", "pathUnsafe", "pathLabelUnresolved", "patternLabelUnresolved", "labelSurvivedWrite", "noLabel")
    return (
        roled.withColumn("outcome", outcome)
        .withColumn("value", F.when(keep, value).otherwise(out))
        .drop("_out", "role")
    )


def outcome_counts(df: DataFrame, outcome: str = "outcome") -> DataFrame:
    return df.groupBy(outcome).agg(F.count(F.lit(1)).alias("n"))


# --- edits --------------------------------------------------------------------------------


#: Edits of one unit that one row carries beside the unit's text.
PACK = 256


def packed_edits(edits: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, _pack``: the edits of a unit in lists of about ``PACK``."""
    lots = edits.groupBy(*keys).agg(F.ceil(F.count("*") / PACK).alias("_lots"))
    dealt = edits.join(lots, keys).withColumn("_lot", F.pmod(F.xxhash64("edit_id"), F.col("_lots")))
    return dealt.groupBy(*keys, "_lot").agg(F.collect_list(F.struct("edit_id", "old", "new")).alias("_pack")).drop("_lot")


def translate_edits(
    docs: DataFrame, edits: DataFrame, keys: list[str], text: str, rules: RuleSet, key: LabelKey
) -> DataFrame:
    """Edits ``(keys, edit_id, old, new)`` on rendered text, against the real text.

    Each text with edits is rendered once, and once for each ``PACK`` of its edits the text and its
    maps meet them: no edit carries a text of its own, and ends are mapped back by binary search.
    The old string must occur exactly once and both its ends must map back; otherwise the edit is
    refused with the reason in ``status``.
    """
    touched = docs.join(edits.select(*keys).distinct(), keys, "left_semi")
    rendered = touched.select(*keys, text, F.explode(F.array(render(F.col(text), rules, key))).alias("_r")).select(
        *keys, F.col(text).alias("_real"), F.col("_r.text").alias("_shown"), F.col("_r.stages").alias("_stages"),
        F.transform("_r.stages", span_starts).alias("_starts"), span_values(F.col("_r.redact_spans")).alias("_values"),
    )
    real, shown, stages, starts = (F.col(c) for c in ("_real", "_shown", "_stages", "_starts"))

    def placed(e):
        first = F.position(e["old"], shown)
        known = F.coalesce("_values", F.create_map().cast(NO_VALUES))
        return F.struct(
            e["edit_id"].alias("edit_id"), e["old"].alias("old"), first.alias("at"), F.position(e["old"], shown, first + 1).alias("again"),
            map_to_source(first - 1, stages, starts).alias("from_"), map_to_source(first - 1 + F.length(e["old"]), stages, starts).alias("to_"),
            let(fill(e["new"], known), lambda t: F.when(~has_label(t), t)).alias("real_new"),
        )

    def judged(p):
        status = (
            F.when(shown.isNull(), "no_unit")
            .when(p["old"].isNull() | (p["old"] == ""), "empty")
            .when(p["at"] < 1, "not_found")
            .when(p["again"] > 0, "ambiguous")
            .when(p["from_"].isNull() | p["to_"].isNull(), "inside_span")
            .when(p["real_new"].isNull(), "unknown_label")
            .otherwise("ok")
        )
        return let(
            status,
            lambda s: F.struct(
                p["edit_id"].alias("edit_id"), s.alias("status"), F.when(s == "ok", cut(real, p["from_"], p["to_"])).alias("real_old"),
                F.when(s == "ok", p["real_new"]).alias("real_new"),
            ),
        )

    both = packed_edits(edits, keys).join(rendered, keys, "left")
    return both.select(*keys, F.inline(F.transform("_pack", lambda e: let(placed(e), judged))))


def all_or_nothing(translated: DataFrame, keys: list[str]) -> DataFrame:
    """One failing edit refuses the whole batch of its unit.

    A partial aggregation and a join rather than a window, so that a unit with
    very many edits is never gathered in one task.
    """
    verdict = translated.groupBy(*keys).agg(F.bool_and(F.col("status") == "ok").alias("accepted"))
    return translated.join(verdict, keys)
