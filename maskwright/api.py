"""The public surface in one place."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.keys import LabelKey, attach_key, detach_key, key_frame, label, subkey
from .operators import insights as _insights
from .operators import retention as _retention
from .operators import rules as _rules
from .operators import sweep as _sweep
from .operators import vault, verify
from .operators.aliases import sanitize, to_alias, to_real
from .operators.findings import (
    category_totals, change_log, detailed_findings, findings, grouped_counts, pattern_profile, publish_gate,
    published_split, report_lines, scan_totals, severity_order, unit_counts,
)
from .operators.nested import (
    deep_transform, distinct_first, json_transform, map_policy, pseudonymize_field, session_value, transform_columns,
)
from .operators.normalize import normalize
from .operators.render import map_to_source, render, rendered_text
from .operators.resolve import all_or_nothing, resolve_deep, resolve_fields, resolve_from_vault, resolve_labels
from .operators.resolve import translate_edits
from .operators.ruleset import RuleSet, default_patterns, default_rewrites, make_rules, optional_patterns
from .operators.spans import redact
from .streaming.stateful import reassemble_stream

adopt_patterns = _rules.adopt_patterns
validate_rules = _rules.config_findings
incremental = _sweep.to_examine
sweep = _sweep.sweep
apply_sweep = _sweep.apply_sweep
insights = _insights.all_signals
job_summary = _insights.job_summary
retention_plan = _retention.retention_actions
retention_inventory = _retention.describe


def load_rules(spark: SparkSession, path: str) -> RuleSet:
    """A JSON rule document, validated and frozen."""
    return _rules.rule_set(_rules.read_rules(spark, path))


def render_columns(df: DataFrame, columns: list[str], rules: RuleSet, key: LabelKey) -> DataFrame:
    """Render every string of the named columns; opaque blocks and other columns stay."""
    return transform_columns(df, columns, lambda t: rendered_text(t, rules, key))


def verify_sweep(before: DataFrame, after: DataFrame) -> DataFrame:
    """Integrity problems of a rewrite, counted: ``(file, line_no, line)`` on both sides."""
    return verify.problem_counts(verify.line_problems(before, after))


def self_test(spark: SparkSession, rules: RuleSet, key: LabelKey) -> DataFrame:
    """``section, check, status`` for the whole configuration."""
    parts = []
    if rules.literals:
        lits = spark.createDataFrame([(x.value, x.boundary) for x in rules.literals], "value string, boundary boolean")
        shapes = verify.shape_self_test(lits, rules, key)
        status = F.when(F.col("leaked") > 0, "leaks").otherwise("ok")
        parts.append(shapes.select(F.lit("literals").alias("section"), F.col("shape_no").cast("string").alias("check"), status.alias("status")))
    probes = verify.category_probes(spark, rules, key)
    parts.append(probes.select(F.lit("categories").alias("section"), F.col("category").alias("check"), "status"))
    norms = verify.normalization_probes(spark, rules, key)
    parts.append(norms.select(F.lit("normalization").alias("section"), "check", "status"))
    if rules.aliases:
        checks = verify.alias_checks(spark, rules)
        bad = F.when(F.col("risk").isNotNull(), "risky").when(F.col("survives"), "survives").otherwise("ok")
        parts.append(checks.select(F.lit("aliases").alias("section"), F.col("alias").alias("check"), bad.alias("status")))
    return reduce(DataFrame.unionByName, parts)


__all__ = [
    "LabelKey", "RuleSet", "adopt_patterns", "all_or_nothing", "apply_sweep", "attach_key", "category_totals",
    "change_log", "deep_transform", "default_patterns", "default_rewrites", "detach_key", "detailed_findings",
    "distinct_first", "findings", "grouped_counts", "incremental", "insights", "job_summary", "json_transform",
    "key_frame", "label", "load_rules", "make_rules", "map_policy", "map_to_source", "normalize", "optional_patterns",
    "pattern_profile", "pseudonymize_field", "publish_gate", "published_split", "reassemble_stream", "redact",
    "render", "render_columns", "rendered_text", "report_lines", "resolve_deep", "resolve_fields",
    "resolve_from_vault", "resolve_labels", "retention_inventory", "retention_plan", "sanitize", "scan_totals",
    "self_test", "session_value", "severity_order", "subkey", "sweep", "to_alias", "to_real", "transform_columns",
    "translate_edits", "unit_counts", "validate_rules", "vault", "verify_sweep",
]
