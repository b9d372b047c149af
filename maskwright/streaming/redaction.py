"""Streams through the same render expression as batch jobs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import LabelKey
from ..operators.nested import text_or_json
from ..operators.render import rendered_text
from ..operators.ruleset import RuleSet
from ..operators.vault import build, merge, vault_entries


def render_stream(stream: DataFrame, text: str, rules: RuleSet, key: LabelKey) -> DataFrame:
    """Stateless: every record on its own, no shuffle."""
    return stream.withColumn(text, rendered_text(F.col(text), rules, key))


def fail_closed(body: str, rules: RuleSet, key: LabelKey, out: str, passed: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` writer for JSON bodies.

    Bodies that do not parse go to their own table; everything else is rendered.
    If rendering fails the batch fails and is retried: nothing raw is forwarded.
    Each batch overwrites its own directory, so a retry leaves no duplicates.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        parsed = F.try_parse_json(F.col(body)).isNotNull()
        good = text_or_json(F.col(body), F.lit(True), lambda t: rendered_text(t, rules, key))
        batch.where(parsed).withColumn(body, good).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        batch.where(~parsed).write.mode("overwrite").parquet(f"{passed}/batch={batch_id}")

    return write


def vault_upsert(text: str, ts: str, rules: RuleSet, key: LabelKey, path: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` writer that appends each batch's entries to a vault.

    A batch writes its own folder only, one row for each of its labels, and a retried
    batch overwrites that folder; the vault so far is never read or written again.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        build(vault_entries(batch, text, ts, rules, key)).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def current_vault(spark, path: str, first: DataFrame | None = None) -> DataFrame:
    """The vault as of now: the newest use of each label over all batches and ``first``."""
    entries = spark.read.parquet(path).drop("batch")
    return build(entries) if first is None else merge(first, entries)


def compact_vault(spark, path: str, into: str) -> DataFrame:
    """Write the vault as one table elsewhere, to be the ``first`` of later batches."""
    current_vault(spark, path).write.parquet(into)
    return spark.read.parquet(into)
