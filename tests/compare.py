"""Run registered queries next to their SQL: ``python -m tests.compare [sf] [name ...]``."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if hasattr(v, "isoformat"):
        return v.isoformat(sep=" ") if hasattr(v, "hour") else v.isoformat()
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    if hasattr(v, "as_tuple"):
        return round(float(v), 6)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def run_sql(root: str, sql: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{root}/{t}.parquet'")
    cur = con.execute(sql)
    return [d[0] for d in cur.description], cur.fetchall(), [str(d[1]) for d in cur.description]


def compare(spark, root: str, fn, sql: str | None) -> str:
    df = fn(spark, root)
    rows = df.collect()
    if sql is None:
        return f"rows only ({len(rows)})"
    cols, want, types = run_sql(root, sql)
    if sorted(cols) != sorted(df.columns):
        return f"COLUMNS {sorted(df.columns)} vs {sorted(cols)}"
    order = sorted(cols)
    at = [cols.index(c) for c in order]
    got = sorted((tuple(plain(r[c]) for c in order) for r in rows), key=repr)
    exp = sorted((tuple(plain(r[i]) for i in at) for r in want), key=repr)
    if got != exp:
        diff = [(a, b) for a, b in zip(got, exp) if a != b][:1]
        return f"VALUES {len(got)} vs {len(exp)} rows; first {str(diff)[:600]}"
    kinds = ", ".join(f"{c}:{df.schema[c].dataType.simpleString()}/{types[cols.index(c)]}" for c in order)
    return f"ok ({len(rows)} rows) {kinds}"


def main() -> int:
    from maskwright.session import local_session
    from maskwright.plans.registry import ORACLES, QUERIES

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    names = sys.argv[2:]
    spark = local_session()
    bad = 0
    for name, fn in QUERIES.items():
        if names and not any(n in name for n in names):
            continue
        t = time.time()
        try:
            verdict = compare(spark, f"/root/testdata/sf{sf}", fn, ORACLES.get(name))
        except Exception as e:  # noqa: BLE001 - report and go on
            verdict = f"ERROR {type(e).__name__}: {str(e)[:700]}"
        bad += not verdict.startswith(("ok", "rows"))
        print(f"{name:32s} {time.time() - t:6.2f}s {verdict}", flush=True)
    print("failed:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
