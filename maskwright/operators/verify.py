"""Before/after integrity, effect, literal audits and self-tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import catalog
from ..functions.keys import LabelKey
from ..functions.regexes import WORD
from ..functions.text import count_substring
from ..sources.tables import dealt
from .aliases import to_alias
from .joins import lookup
from .nested import json_skeleton
from .render import render, rendered_text
from .rules import alias_risk
from .ruleset import RuleSet
from .spans import find_hits, redact


def line_problems(before: DataFrame, after: DataFrame) -> DataFrame:
    """Classify every line of ``(file, line_no, line)`` before and after a rewrite.

    The full outer join is on file and line, so one huge file is spread over all
    tasks; line counts per file come from partial aggregations of either side, so
    the join itself runs once.
    """
    key = ["file", "line_no"]
    b = before.select(*key, F.col("line").alias("b"))
    a = after.select(*key, F.col("line").alias("a"))
    both = b.join(a, key, "full_outer")
    sizes = [d.groupBy("file").agg(F.count(c).alias(n)) for d, c, n in ((b, "b", "n_before"), (a, "a", "n_after"))]
    counts = sizes[0].join(sizes[1], "file", "full_outer").select("file", *[F.coalesce(n, F.lit(0)).alias(n) for n in ("n_before", "n_after")])
    joined = lookup(both, counts, "file")
    sb, sa = json_skeleton(F.col("b")), json_skeleton(F.col("a"))
    old, new = F.col("b"), F.col("a")
    blank = (F.trim(old) == "") & (F.trim(new) == "")
    lost = (F.col("n_after") > 0) & (F.col("n_after") < F.col("n_before"))
    last = F.col("line_no") == F.col("n_before")
    problem = (
        F.when(F.col("n_after") == 0, "missing")
        .when(lost, "line_count_shrank")
        .when(old.isNull(), "appended")
        .when(blank, "blank")
        .when(sb.isNull(), F.when(old == new, "unparsed_kept").when(last, "partial_last_line").otherwise("unparseable_original_modified"))
        .when(sa.isNull(), "no_longer_parses")
        .when(sb != sa, "structure_changed")
        .when(old != new, "strings_changed")
        .otherwise("identical")
    )
    return joined.select(*key, problem.alias("problem"))


# File-level problems count once per file, line-level ones once per line.
FILE_PROBLEMS = ["missing", "line_count_shrank"]
LINE_PROBLEMS = ["no_longer_parses", "structure_changed", "unparseable_original_modified"]


def problem_counts(classified: DataFrame) -> DataFrame:
    per = classified.groupBy("problem").agg(
        F.count(F.lit(1)).alias("lines"), F.countDistinct("file").alias("files")
    )
    n = F.when(F.col("problem").isin(FILE_PROBLEMS), F.col("files")).otherwise(F.col("lines"))
    return per.select("problem", n.alias("n"))


def first_problems(classified: DataFrame, k: int = 20) -> DataFrame:
    return (
        classified.where(F.col("problem").isin(FILE_PROBLEMS + LINE_PROBLEMS))
        .orderBy("file", "line_no").limit(k)
    )


def hit_count(text: Column, rules: RuleSet) -> Column:
    """Spans plus raw identity values."""
    n = F.size(find_hits(text, rules))
    for value in rules.identity_values:
        n = n + count_substring(text, F.lit(value))
    return n


def effect(pairs: DataFrame, before: str, after: str, rules: RuleSet) -> DataFrame:
    """Personal data before and after, removed share, and identical units.

    A unit that is as it was holds what it held, so it is searched once.
    """
    counted = pairs.select(
        hit_count(F.col(before), rules).alias("_b"), (F.col(before) == F.col(after)).alias("_same"),
        F.when(F.col(before) == F.col(after), F.lit(None).cast("int")).otherwise(hit_count(F.col(after), rules)).alias("_a"),
    )
    sums = counted.agg(
        F.sum("_b").cast("bigint").alias("pii_before"), F.sum(F.coalesce("_a", "_b")).cast("bigint").alias("pii_after"),
        F.count_if("_same").alias("identical"), F.count(F.lit(1)).alias("units"),
    )
    removed = F.col("pii_before") - F.col("pii_after")
    pct = F.when(F.col("pii_before") > 0, F.round(removed * 100.0 / F.col("pii_before"), 1)).otherwise(0.0)
    return sums.withColumns({"removed": removed, "pct": pct})


def verdict(problems: DataFrame, effects: DataFrame) -> DataFrame:
    """CLEAN, STRUCTURALLY CLEAN or the number of integrity problems."""
    bad = problems.where(F.col("problem").isin(FILE_PROBLEMS + LINE_PROBLEMS)).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("bad")
    ).scalar()
    text = (
        F.when((F.col("bad") == 0) & (F.col("pii_after") == 0), "CLEAN")
        .when(F.col("bad") == 0, "STRUCTURALLY CLEAN")
        .otherwise(F.concat(F.col("bad").cast("string"), F.lit(" INTEGRITY PROBLEM(S)")))
    )
    return effects.withColumn("bad", bad).withColumn("verdict", text)


def parse_failures(lines: DataFrame) -> DataFrame:
    """Files in which a rewritten, non-blank line no longer parses."""
    bad = (F.trim("line") != "") & F.try_parse_json("line").isNull()
    return lines.groupBy("file").agg(F.count_if(bad).alias("failures")).where("failures > 0")


# --- literal audits -----------------------------------------------------------------------


def escaped(value: Column) -> Column:
    return F.regexp_replace(value, r"[.*+?^${}()|\[\]\\]", r"\\$0")


def own_literal_regex(value: Column, boundary: Column) -> Column:
    """The guarded regex of a literal held in a column."""
    me = escaped(value)
    word_start = F.rlike(value, F.lit(f"^{WORD}"))
    word_end = F.rlike(value, F.lit(f"{WORD}$"))
    pre = F.when(boundary & word_start, F.concat(F.lit(f"(?:(?<!{WORD})|(?<="), me, F.lit("))"))).otherwise("")
    post = F.when(boundary & word_end, F.concat(F.lit(f"(?:(?!{WORD})|(?="), me, F.lit("))"))).otherwise("")
    return F.concat(F.lit("(?iu)"), pre, me, post)


def _shape(template: str, v: Column) -> Column:
    parts, forms = [], {"{v}": v, "{U}": F.upper(v), "{l}": F.lower(v)}
    rest = template.replace("{{", "\x02").replace("}}", "\x03")
    while rest:
        at = min((rest.find(f) for f in forms if f in rest), default=-1)
        if at < 0:
            parts.append(F.lit(rest.replace("\x02", "{").replace("\x03", "}")))
            break
        if at:
            parts.append(F.lit(rest[:at].replace("\x02", "{").replace("\x03", "}")))
        parts.append(forms[rest[at : at + 3]])
        rest = rest[at + 3 :]
    return F.concat(*parts)


def literal_shapes(literals: DataFrame, templates: list[tuple[str, str]], *more: str) -> DataFrame:
    """Every literal in every adjacency shape: an explode of a fixed list, no join; ``more`` names columns to keep."""
    v = F.col("value")
    shapes = F.array(
        *[
            F.struct(F.lit(i).alias("shape_no"), F.lit(name).alias("shape"), _shape(t, v).alias("text"))
            for i, (name, t) in enumerate(templates)
        ]
    )
    return literals.select("value", "boundary", *more, F.inline(shapes))


def leak_audit(literals: DataFrame, rules: RuleSet, key: LabelKey) -> DataFrame:
    """``value, shape, leak`` for 14 shapes; a leak still shows the literal, any case."""
    known = dealt(literals.select("value", "boundary")).select("value", "boundary", own_literal_regex(F.col("value"), F.col("boundary")).alias("_regex"))
    shaped = literal_shapes(known, catalog.AUDIT_SHAPES, "_regex")
    out = redact(F.col("text"), rules, key, F.col("_regex")).text
    return shaped.select("value", "shape", F.contains(F.lower(out), F.lower("value")).alias("leak"))


def failed_shapes(audit: DataFrame) -> DataFrame:
    """Per literal: number of leaks and the shapes (at most 14) that leaked."""
    failed = F.array_sort(F.collect_list(F.when(F.col("leak"), F.col("shape"))))
    return audit.groupBy("value").agg(
        F.count_if("leak").alias("leaks"), F.array_join(failed, ", ").alias("failed")
    )


def risk_notes(value: Column) -> Column:
    """Over-match risk, judged on shape."""
    n = F.length(value)
    return F.array_join(
        F.array_compact(
            F.array(
                F.when(n <= 3, "three characters at most, so found within other words").when(
                    n <= 5, "five characters at most, may be an everyday word"
                ),
                F.when(F.rlike(value, F.lit("^[0-9]+$")) & (n <= 9), "digits only, like many numbers in logs"),
                F.when(F.rlike(value, F.lit("^[A-Za-z]+$")) & (n <= 6), "one plain word of few letters"),
            )
        ),
        "; ",
    )


def shape_self_test(literals: DataFrame, rules: RuleSet, key: LabelKey) -> DataFrame:
    """20 shapes, case-sensitive: per shape tested, leaked and deliberately embedded."""
    templates = [(str(i), t) for i, t in enumerate(catalog.SELF_TEST_SHAPES)]
    # what depends on the literal alone is worked out before it is put into the shapes; a few bytes are much work, so they are dealt
    known = dealt(literals.select("value", "boundary")).select(
        "value", "boundary", own_literal_regex(F.col("value"), F.col("boundary")).alias("_regex"), F.rlike("value", F.lit(f"^{WORD}+$")).alias("_single")
    )
    shaped = literal_shapes(known, templates, "_regex", "_single")
    out = redact(F.col("text"), rules, key, F.col("_regex")).text
    still, single = F.contains(out, F.col("value")), F.col("_single")
    wrapped = F.col("shape_no").isin(catalog.WORD_WRAPPED_SHAPES)
    return (
        shaped.select("shape_no", still.alias("_still"), (single & wrapped).alias("_expected"))
        .groupBy("shape_no")
        .agg(
            F.count(F.lit(1)).alias("tested"),
            F.count_if(F.col("_still") & ~F.col("_expected")).alias("leaked"),
            F.count_if(F.col("_still") & F.col("_expected")).alias("embedded"),
        )
    )


# --- probes -------------------------------------------------------------------------------


def category_probes(spark: SparkSession, rules: RuleSet, key: LabelKey) -> DataFrame:
    """Each configured category against a representative value; required ones must exist."""
    names = [p.name for p in rules.patterns]
    rows = [(n, catalog.CATEGORY_PROBES.get(n), True) for n in names]
    rows += [(n, None, False) for n in catalog.REQUIRED_CATEGORIES if n not in names]
    df = spark.createDataFrame(rows, "category string, probe string, configured boolean")
    r = df.withColumn("_r", render(F.col("probe"), rules, key))
    fired = (F.size("_r.redact_spans") > 0) & (F.col("_r.text") != F.col("probe"))
    status = (
        F.when(~F.col("configured"), "missing").when(F.col("probe").isNull(), "no probe")
        .when(fired, "ok").otherwise("did not fire")
    )
    return r.select("category", status.alias("status"))


def normalization_probes(spark: SparkSession, rules: RuleSet, key: LabelKey) -> DataFrame:
    df = spark.createDataFrame(catalog.NORMALIZATION_PROBES, "check string, probe string, gone string")
    out = rendered_text(F.col("probe"), rules, key)
    return df.select("check", F.when(F.contains(out, F.col("gone")), "leaks").otherwise("ok").alias("status"))


def alias_checks(spark: SparkSession, rules: RuleSet) -> DataFrame:
    """No risky alias, and no real value surviving ``see X and XX``."""
    rows = [(a.real, a.alias) for a in rules.aliases]
    df = spark.createDataFrame(rows, "real string, alias string")
    text = F.concat(F.lit("see "), "real", F.lit(" and "), "real", "real")
    out = to_alias(text, rules).text
    return df.select(
        "alias", alias_risk(F.col("alias")).alias("risk"), F.contains(out, F.col("real")).alias("survives")
    )


def alias_table_checks(aliases: DataFrame) -> DataFrame:
    """The same for an alias table of any size, each pair against its own rule."""
    seg = F.split("real", r"[\\/]+", -1)
    body = F.array_join(F.transform(seg, escaped), r"[\\/]+")
    guard = F.rlike("real", F.lit(f"^{WORD}+$"))
    pre = F.when(guard, F.concat(F.lit(f"(?:(?<!{WORD})|(?<="), escaped(F.col("real")), F.lit("))"))).otherwise("")
    post = F.when(guard, F.concat(F.lit(f"(?:(?!{WORD})|(?="), escaped(F.col("real")), F.lit("))"))).otherwise("")
    regex = F.concat(F.lit("(?iu)"), pre, body, post)
    target = F.regexp_replace("alias", r"[\\$]", r"\\$0")
    text = F.concat(F.lit("see "), "real", F.lit(" and "), "real", "real")
    out = F.regexp_replace(text, regex, target)
    return aliases.select(
        "real", "alias", alias_risk(F.col("alias")).alias("risk"), F.contains(out, F.col("real")).alias("survives")
    )
