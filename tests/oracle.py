"""Compare registered queries with their SQL. ``python -m tests.oracle [name ...]`` prints one line per query."""

from __future__ import annotations

import glob
import math
import os
import sys
import time
import traceback

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)) or value is pd.NaT or value is pd.NA:
        return None
    if isinstance(value, bytearray):
        return bytes(value)
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return round(value, 9)
    if hasattr(value, "isoformat"):
        return pd.Timestamp(value).isoformat()
    if isinstance(value, (int, str, bytes)):
        return value
    raise TypeError(f"{type(value)} is not a scalar column")


def rows(frame: pd.DataFrame) -> list[tuple]:
    columns = sorted(frame.columns)
    frame = frame[columns]
    return sorted((tuple(_cell(v) for v in r) for r in frame.itertuples(index=False, name=None)), key=repr)


def compare(spark, con, name: str, query, sql: str, sf_dir: str) -> str:
    got = query(spark, sf_dir).toPandas()
    want = con.execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    kinds = []
    for c in sorted(got.columns):
        a, b = got[c].dtype, want[c].dtype
        if a.kind != b.kind and not (got[c].isna().any() or want[c].isna().any()):
            kinds.append(f"{c}: {a} / {b}")
    if kinds:
        return "types " + "; ".join(kinds)
    left, right = rows(got), rows(want)
    if len(left) != len(right):
        return f"rows {len(left)} != {len(right)}"
    for a, b in zip(left, right):
        if a != b:
            return f"first difference {sorted(got.columns)}\n   spark  {a}\n   duckdb {b}"
    return ""


def main(names: list[str]) -> int:
    import __spark_entry__ as contract
    from codevigil.session import build_session

    sf_dir = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")
    spark = build_session(
        "local[8]", "oracle", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g"}
    )
    con = duck(sf_dir)
    con.execute("SET TimeZone='UTC'")
    queries, oracle = contract.queries(), contract.oracle_sql()
    bad = 0
    for name in queries:
        if names and not any(n in name for n in names):
            continue
        start = time.time()
        try:
            if name in oracle:
                problem = compare(spark, con, name, queries[name], oracle[name], sf_dir)
            else:
                frame = queries[name](spark, sf_dir).toPandas()
                rows(frame)
                problem = "" if len(frame) else "no rows"
        except Exception as exc:  # noqa: BLE001
            problem = f"{type(exc).__name__}: {str(exc)[:1500]}"
            if "-v" in sys.argv:
                traceback.print_exc()
        mark = "ok  " if not problem else "FAIL"
        kind = "sql" if name in oracle else "rows"
        print(f"{mark} {name:34s} {kind:4s} {time.time() - start:6.2f}s {problem}", flush=True)
        bad += bool(problem)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main([a for a in sys.argv[1:] if not a.startswith("-")]))
