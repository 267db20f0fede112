"""Run queries beside their SQL twins and report differences.

    python tools/check_queries.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb
import pandas as pd

from faretide.registry import load
from faretide.session import build_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _cell(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, pd.Timestamp):
        return v.isoformat()
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return repr(v + 0.0)
    return v


def rows(df: pd.DataFrame, columns: list[str]) -> list[tuple]:
    cells = [[_cell(v) for v in df[c].tolist()] for c in columns]
    return sorted(zip(*cells), key=repr) if columns else []


def compare(got: pd.DataFrame, want: pd.DataFrame) -> str:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    columns = sorted(got.columns)
    for c in columns:
        kinds = {got[c].dtype.kind, want[c].dtype.kind}
        if kinds in ({"i", "f"}, {"i", "O"}, {"f", "O"}, {"b", "O"}) and len(got) and got[c].notna().all():
            return f"dtype of {c}: {got[c].dtype} != {want[c].dtype}"
    a, b = rows(got, columns), rows(want, columns)
    if a == b:
        return ""
    only_a = [x for x in a if x not in set(b)][:3]
    only_b = [x for x in b if x not in set(a)][:3]
    return f"rows {len(a)} / {len(b)}; {columns}\n      spark {only_a}\n      sql   {only_b}"


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = build_session("check", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("OFF")
    con, failed = connect(sf_dir), 0
    for name, q in load().items():
        if wanted and not any(w in name for w in wanted):
            continue
        started = time.time()
        try:
            got = q.build(spark, sf_dir).toPandas()
            took = time.time() - started
            problem = compare(got, con.execute(q.sql).df()) if q.sql else ""
        except Exception as e:  # noqa: BLE001
            got, took, problem = pd.DataFrame(), time.time() - started, f"{type(e).__name__}: {str(e)[:500]}"
        failed += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {name:34s} {len(got):7d} rows {took:6.2f}s {problem}", flush=True)
    print(f"{failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
