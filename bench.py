"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = [
    "email_by_lang", "scan_totals", "scan_by_source_rollup", "redact_docs", "distinct_first", "findings_table",
    "severity_first", "render_pipeline", "field_selective", "json_deep_transform", "vault_build", "rehydrate_vault",
    "edit_translation", "incremental_skip", "dry_run", "verify_counts", "literal_self_test", "rules_fingerprint",
    "signal_list", "retention_size", "alert_rate_limit", "heartbeat_gaps", "windowed_counts",
]


def main() -> None:
    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    from maskwright.plans.registry import QUERIES
    from maskwright.session import local_session

    spark = local_session("maskwright-bench", int(os.environ.get("BENCH_CPUS", "8")))
    names = [n for n in HEADLINE if not sys.argv[1:] or n in sys.argv[1:]]
    QUERIES[names[0]](spark, root).write.format("noop").mode("overwrite").save()  # warm up the JVM
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, root).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(root.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
