"""Rule tables: normalization, validation, merging and fingerprints."""

from __future__ import annotations

from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import catalog
from ..functions.regexes import to_java
from ..functions.text import js_trim
from .ruleset import Alias, Literal, Pattern, Rewrite, RuleSet, shipped_hint

LITERALS = "value string, boundary boolean"
PATTERNS = "position bigint, name string, category string, regex string, flags string"
ALIASES = "real string, alias string"
REWRITES = "name string, regex string, flags string, replace string"

class DisabledRules(ValueError):
    """Rules that would not be loaded; ``rows`` has ``(section, name, reason)``."""

    def __init__(self, rows: list[tuple[str, str, str]]):
        super().__init__("; ".join(f"{s} {n}: {r}" for s, n, r in rows))
        self.rows = rows


DOCUMENT = (
    "literals array<string>, patterns array<struct<name:string,category:string,regex:string,flags:string>>, "
    "aliases array<struct<real:string,alias:string>>, remoteTools array<string>, "
    "normalize struct<timezone:boolean,rewrites:array<struct<name:string,regex:string,flags:string,replace:string>>>, "
    "retention map<string,string>, residue map<string,string>"
)


def read_rules(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """A JSON rule document as typed tables, one per section.

    A literal is a string or an object ``{value, boundary}``; both are read as
    text first and told apart by their first character.
    """
    doc = spark.read.schema(DOCUMENT).json(path, multiLine=True)
    lit = F.col("l")
    as_object = F.from_json(lit, "value string, boundary boolean")
    is_object = F.startswith(lit, F.lit("{"))
    literals = doc.select(F.explode("literals").alias("l")).select(
        F.when(is_object, as_object["value"]).otherwise(lit).alias("value"),
        F.when(is_object, as_object["boundary"]).alias("boundary"),
    )
    return {
        "literals": literals,
        "patterns": doc.select(F.posexplode("patterns").alias("position", "p")).select("position", "p.*"),
        "aliases": doc.select(F.inline("aliases")),
        "rewrites": doc.select(F.inline("normalize.rewrites")),
        "settings": doc.select(
            F.coalesce("normalize.timezone", F.lit(False)).alias("timezone"),
            F.col("remoteTools").alias("remote_prefixes"), "retention", "residue",
        ),
    }


def disabled_rules(tables: dict[str, DataFrame]) -> list[tuple[str, str, str]]:
    """``(section, name, reason)`` of every pattern and rewrite that cannot be loaded."""
    spark = tables["patterns"].sparkSession
    out = [
        ("patterns", p.name or "pattern", p.verdict or "does not compile")
        for p in tables["patterns"].where("regex IS NOT NULL").withColumn("verdict", pattern_verdict(F.col("regex"))).orderBy("position").collect()
        if p.verdict is not None or not is_compilable(spark, p.regex)
    ]
    return out + [
        ("rewrites", r.name or "rewrite", "does not compile")
        for r in tables["rewrites"].where("regex IS NOT NULL").collect() if not is_compilable(spark, r.regex)
    ]


def rule_set(tables: dict[str, DataFrame], accept_disabled: bool = False) -> RuleSet:
    """Validated rule tables as the frozen object.

    A rule set is configuration and lives on the driver; long lists of literals or aliases belong in a
    table (see ``dictionary``).  Rules that cannot be loaded raise ``DisabledRules`` unless the caller
    accepts to go on without them.
    """
    off = disabled_rules(tables)
    if off and not accept_disabled:
        raise DisabledRules(off)
    spark = tables["patterns"].sparkSession

    def rows(name, df):
        return df.collect()

    lits = rows("literals", literal_rules(tables["literals"]))
    loaded = tables["patterns"].where("regex IS NOT NULL").withColumn("verdict", pattern_verdict(F.col("regex")))
    pats = [p for p in rows("patterns", loaded) if p.verdict is None and is_compilable(spark, p.regex)]
    settings = tables["settings"].first()
    return RuleSet(
        tuple(
            Pattern(p.name or "pattern", p.regex, p.flags or "g", p.category, _known_hint(p.name, p.regex))
            for p in sorted(pats, key=lambda p: p.position)
        ),
        tuple(Literal(x.value, x.boundary) for x in lits),
        tuple(Alias(a.real, a.alias) for a in rows("aliases", alias_rules(tables["aliases"]))),
        tuple(
            Rewrite(r.name or "rewrite", r.regex, r.flags or "g", r.replace or "")
            for r in rows("rewrites", tables["rewrites"].where("regex IS NOT NULL"))
            if is_compilable(spark, r.regex)
        ),
        bool(settings.timezone),
        tuple(settings.remote_prefixes or ()),
    )


def _known_hint(name: str | None, regex: str):
    shipped = dict((n, r) for n, r, _ in catalog.DEFAULT_PATTERNS)
    shipped.update((n, r) for n, _, r, _ in catalog.OPTIONAL_PATTERNS)
    return shipped_hint(name) if shipped.get(name) == regex else None


def is_compilable(spark: SparkSession, regex: str) -> bool:
    """Whether the translated regex compiles: one call to the driver's JVM, no job."""
    try:
        spark.sparkContext._jvm.java.util.regex.Pattern.compile(to_java(regex))
        return True
    except (Py4JJavaError, PySparkException, ValueError):
        return False


# --- literals -----------------------------------------------------------------------------


def literal_rules(raw: DataFrame) -> DataFrame:
    """``value, boundary``: trimmed, long enough, no template placeholder, guard decided."""
    v = js_trim(F.col("value"))
    kept = raw.withColumn("value", v).where(
        (F.length("value") >= catalog.MIN_LITERAL_CHARS)
        & ~F.lower("value").isin(catalog.PLACEHOLDER_LITERALS)
    )
    by_shape = F.rlike("value", F.lit(r"^[\p{L}\p{N}_]+$"))
    return kept.select("value", F.coalesce("boundary", by_shape).alias("boundary"))


def rule_statistics(literals: DataFrame, patterns: DataFrame) -> DataFrame:
    """Literals and patterns that load, and the number of label categories."""
    lits = literal_rules(literals).agg(F.count(F.lit(1)).alias("literals"))
    pats = loadable_patterns(patterns).agg(
        F.count(F.lit(1)).alias("patterns"), F.countDistinct("name").alias("names")
    )
    has_literal = F.when(F.col("literals") > 0, 1).otherwise(0)
    return lits.withColumn("patterns", pats.select("patterns").scalar()).withColumn(
        "categories", pats.select("names").scalar() + has_literal
    )


# --- patterns -----------------------------------------------------------------------------

# A group repeated without bound that itself ends in an unbounded repeat, and a
# pattern that starts with one: exponential and quadratic on adversarial text.
NESTED_REPEAT = r"\([^()]*[^\\()][+*]\)(?:[+*]|\{[0-9]+,\})"
LEADING_REPEAT = r"^(?:\(\?:|\()?(?:\[[^\]]*\]|\\[wdsWDS]|\.)(?:[+*]|\{[0-9]+,\})"


def pattern_verdict(regex: Column) -> Column:
    """Null when safe, else the reason the pattern is not loaded."""
    return (
        F.when(F.rlike(regex, F.lit(NESTED_REPEAT)), "nested unbounded repeat")
        .when(F.rlike(regex, F.lit(LEADING_REPEAT)), "starts with an unbounded repeat")
        .otherwise(F.lit(None).cast("string"))
    )


def linted_patterns(patterns: DataFrame) -> DataFrame:
    return patterns.where("regex IS NOT NULL").withColumn("verdict", pattern_verdict(F.col("regex")))


def loadable_patterns(patterns: DataFrame) -> DataFrame:
    return linted_patterns(patterns).where("verdict IS NULL").drop("verdict")


def disabled_patterns(patterns: DataFrame) -> DataFrame:
    return linted_patterns(patterns).where("verdict IS NOT NULL")


def pattern_audit(patterns: DataFrame) -> DataFrame:
    """Configured and unsafe counts in one row."""
    linted = patterns.withColumn(
        "verdict", F.when(F.col("regex").isNotNull(), pattern_verdict(F.col("regex")))
    )
    return linted.agg(F.count(F.lit(1)).alias("configured"), F.count("verdict").alias("unsafe"))


def adopt_patterns(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Outcome per incoming pattern: ``added``, ``skipped`` or ``rejected`` with the reason."""
    names = existing.select("name").where("name IS NOT NULL").distinct().withColumn("_n", F.lit(True))
    regexes = existing.select("regex").where("regex IS NOT NULL").distinct().withColumn("_r", F.lit(True))
    joined = (
        incoming.where("regex IS NOT NULL").join(names, "name", "left").join(regexes, "regex", "left")
        .withColumn("verdict", pattern_verdict(F.col("regex")))
    )
    outcome = (
        F.when(F.col("_n"), "skipped").when(F.col("_r"), "skipped")
        .when(F.col("verdict").isNotNull(), "rejected").otherwise("added")
    )
    reason = (
        F.when(F.col("_n"), "name already present").when(F.col("_r"), "identical regex already present")
        .otherwise(F.col("verdict"))
    )
    return joined.withColumns({"outcome": outcome, "reason": reason}).drop("_n", "_r", "verdict")


def adopted(existing: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The merged pattern table; only additions change it."""
    return existing.unionByName(outcomes.where("outcome = 'added'").select(*existing.columns))


def adoption_verified(existing: DataFrame, outcomes: DataFrame, written: DataFrame) -> bool:
    """The written table must hold exactly the old patterns and the additions."""
    return written.count() == existing.count() + outcomes.where("outcome = 'added'").count()


# --- aliases ------------------------------------------------------------------------------


def alias_rules(raw: DataFrame) -> DataFrame:
    return raw.where(
        (F.length(js_trim(F.col("real"))) >= catalog.MIN_LITERAL_CHARS) & (F.length(js_trim(F.col("alias"))) >= 1)
    )


def alias_risk(alias: Column) -> Column:
    """Reason why un-aliasing would rewrite innocent text, or null."""
    a = js_trim(alias)
    plain = (F.length(a) < catalog.PLAIN_ALIAS_CHARS) & F.rlike(a, F.lit("^[A-Za-z]+$"))
    return (
        F.when(alias.isNull() | (alias == ""), "empty")
        .when(
            F.lower(a).isin(catalog.RISKY_ALIASES),
            F.concat(F.lit("everyday name: "), a),
        )
        .when(plain, F.concat(F.lit("plain word of "), F.length(a).cast("string"), F.lit(" letters: "), a))
    )


def segment_count(path: Column) -> Column:
    return F.size(F.split(path, r"[\\/]+", -1))


def segment_mismatch(real: Column, alias: Column) -> Column:
    """Different depths: separators of this pair collapse to the configured form."""
    return segment_count(real) != segment_count(alias)


# --- configuration ------------------------------------------------------------------------


def config_findings(patterns: DataFrame, aliases: DataFrame) -> DataFrame:
    """``severity, section, name, message`` for everything that is wrong or doubtful."""
    columns = ["severity", "section", "name", "message"]

    def found(df, severity, section, name, message):
        return df.select(
            F.lit(severity).alias("severity"), F.lit(section).alias("section"),
            name.alias("name"), message.alias("message"),
        )

    unsafe = disabled_patterns(patterns)
    regexes = [r.regex for r in patterns.where("regex IS NOT NULL").select("regex").distinct().collect()]
    broken = [r for r in regexes if not is_compilable(patterns.sparkSession, r)]
    pattern_name = F.coalesce("name", F.lit("?"))
    risk = alias_risk(F.col("alias"))
    parts = [
        found(unsafe, "error", "patterns", pattern_name, F.col("verdict")),
        found(unsafe, "warning", "patterns", pattern_name, F.concat(F.lit("disabled: "), "verdict")),
        found(aliases.where(risk.isNotNull()), "error", "aliases", F.col("alias"), risk),
        found(
            aliases.where(F.col("real") == F.col("alias")), "error", "aliases", F.col("alias"),
            F.lit("real and alias must not be identical"),
        ),
        found(
            alias_rules(aliases).where(segment_mismatch(F.col("real"), F.col("alias"))),
            "warning", "aliases", F.col("alias"), F.lit("different number of path segments"),
        ),
    ]
    if broken:
        parts.append(found(patterns.where(F.col("regex").isin(broken)), "error", "patterns", pattern_name, F.lit("does not compile")))
    return reduce(DataFrame.unionByName, parts).select(*columns)


def masked_literals(literals: DataFrame) -> DataFrame:
    return literals.select(F.lit("***").alias("value"), F.length("value").alias("length"), "boundary")


def masked_aliases(aliases: DataFrame) -> DataFrame:
    return aliases.select(F.lit("***").alias("real"), F.length("real").alias("real_length"), "alias")


def _framed(field: Column) -> Column:
    """A field that no other field can run into: its length, a colon and itself; null is ``n``."""
    return F.coalesce(F.concat(F.length(field).cast("string"), F.lit(":"), field), F.lit("n"))


def fingerprint(sections: dict[str, DataFrame]) -> DataFrame:
    """One SHA-256 over all rule tables, computed without gathering them.

    Every row is hashed with its section and columns; the row hashes are added
    up in four lanes, so partial sums combine in any order.  Tables whose order
    matters carry it in a ``position`` column.
    """
    rows = reduce(
        DataFrame.unionByName,
        [
            df.select(
                F.sha2(F.concat(_framed(F.lit(name)), *[_framed(F.col(c).cast("string")) for c in df.columns]), 256).alias("h")
            )
            for name, df in sections.items()
        ],
    )
    lanes = [
        F.sum(F.conv(F.substring("h", 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)")).cast("string").alias(f"l{i}")
        for i in range(4)
    ]
    return rows.agg(F.count(F.lit(1)).alias("n"), *lanes).select(
        F.sha2(F.concat_ws(":", F.col("n").cast("string"), "l0", "l1", "l2", "l3"), 256).alias("fingerprint")
    )
