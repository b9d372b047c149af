"""The label vault: a table ``label, value, last_seen``, optionally encrypted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import catalog
from ..functions.keys import LabelKey, label
from ..functions.text import title_case
from .ruleset import RuleSet
from .spans import redact


def vault_entries(df: DataFrame, text: str, ts: str, rules: RuleSet, key: LabelKey) -> DataFrame:
    """One row per accepted span: ``label, value, last_seen``."""
    return span_entries(df, redact(F.col(text), rules, key).spans, ts)


def span_entries(df: DataFrame, spans: Column, ts: str) -> DataFrame:
    """The entries of spans that a redaction has found already."""
    return df.select(F.col(ts).alias("last_seen"), F.explode(spans).alias("s")).select(
        F.col("s.label").alias("label"), F.col("s.value").alias("value"), "last_seen"
    )


def build(entries: DataFrame) -> DataFrame:
    """Newest use wins; partial aggregation collapses hot labels before the shuffle."""
    return (
        entries.where(F.col("label").isNotNull() & F.col("value").isNotNull())
        .groupBy("label")
        .agg(F.max_by("value", "last_seen").alias("value"), F.max("last_seen").alias("last_seen"))
    )


def merge(vault: DataFrame, entries: DataFrame) -> DataFrame:
    return build(vault.unionByName(entries))


def unexpired(vault: DataFrame, now: Column, days: int = catalog.VAULT_TTL_DAYS) -> DataFrame:
    return vault.where(F.col("last_seen") > now - F.make_dt_interval(F.lit(days)))


def capped(vault: DataFrame, entries: int) -> DataFrame:
    """The most recently used entries: a distributed top-k, not a global sort.

    What it leaves out can no longer be reversed, so the number has no default; see ``dropped``.
    """
    return vault.orderBy(F.desc("last_seen"), "label").limit(entries)


def dropped(vault: DataFrame, kept: DataFrame) -> DataFrame:
    """The entries that a cap leaves out, to be reported or archived before they go."""
    return vault.join(kept.select("label"), "label", "left_anti")


def touched(vault: DataFrame, used: DataFrame, now: Column) -> DataFrame:
    """A read refreshes the time stamp of the labels it used."""
    reads = used.select("label").distinct().withColumn("_now", now)
    return (
        vault.join(reads, "label", "left")
        .withColumn("last_seen", F.coalesce("_now", "last_seen"))
        .drop("_now")
    )


def encrypted(vault: DataFrame, key: Column) -> DataFrame:
    """AES-GCM per value with a random IV, bound to its label."""
    return vault.withColumn("value", F.aes_encrypt("value", key, F.lit("GCM"), F.lit("DEFAULT"), F.lit(b""), F.col("label")))


def decrypted(vault: DataFrame, key: Column) -> DataFrame:
    """Entries that do not decrypt (other key, tampered) are dropped, never an error."""
    clear = F.try_aes_decrypt("value", key, F.lit("GCM"), F.lit("DEFAULT"), F.col("label")).cast("string")
    return vault.withColumn("value", clear).where(F.col("value").isNotNull())


def derived_labels(literals: DataFrame, value: str, categories: list[str], key: LabelKey) -> DataFrame:
    """``label, value`` recomputed for four spellings of each literal in every category."""
    v = F.col(value)
    spellings = F.array_distinct(F.array(v, F.lower(v), F.upper(v), title_case(v)))
    rows = literals.select(F.explode(spellings).alias("value")).distinct()
    rows = rows.select("value", F.explode(F.array(*[F.lit(c) for c in categories])).alias("category"))
    return rows.select(label(F.col("value"), F.col("category"), key).alias("label"), "value")


def dictionary(vault: DataFrame, derived: DataFrame | None = None) -> DataFrame:
    """``label, value, source``: the vault first, derived labels where it has none."""
    first = vault.select("label", "value", F.lit("cacheHit").alias("source"))
    if derived is None:
        return first
    rest = derived.select("label", "value", F.lit("literalDerived").alias("source"))
    return first.unionByName(rest.join(vault.select("label"), "label", "left_anti"))
