"""Run registered queries on Spark and DuckDB side by side (also a command)."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        s = df[c]
        if str(s.dtype).startswith("datetime"):
            df[c] = s.astype("datetime64[us]").astype(str)
        elif s.dtype == object:
            df[c] = s.map(lambda v: "<null>" if v is None or v is pd.NaT or (isinstance(v, float) and v != v) else (
                str(list(v)) if isinstance(v, (list, np.ndarray)) else str(v)))
    return df.sort_values(list(df.columns), kind="stable").reset_index(drop=True)


def kinds(df: pd.DataFrame) -> dict[str, str]:
    return {c: str(df[c].dtype).replace('[ns]', '').replace('[us]', '') for c in sorted(df.columns)}


def differences(a: pd.DataFrame, b: pd.DataFrame) -> str:
    """Empty when equal; otherwise the first thing that differs."""
    if sorted(a.columns) != sorted(b.columns):
        return f"columns {sorted(set(a.columns) ^ set(b.columns))}"
    if len(a) != len(b):
        return f"rows {len(a)} vs {len(b)}"
    a, b = _norm(a), _norm(b)
    for c in a.columns:
        x, y = a[c], b[c]
        same = (x == y) | (x.isna() & y.isna())
        if not bool(same.all()):
            i = int(np.flatnonzero(~same.to_numpy())[0])
            return f"{c}: {int((~same).sum())} of {len(a)} differ, first {x[i]!r} vs {y[i]!r} in {a.loc[i].to_dict()} / {b.loc[i].to_dict()}"[:900]
    return ""


def main(sf_dir: str, names: list[str]) -> int:
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as entry
    from panelcast import session

    spark = session.build(master=session.default_master(), partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    qs, oracle, bad = entry.queries(), entry.oracle_sql(), 0
    picked = [q for q in qs if not names or any(q == n or (n.endswith("*") and q.startswith(n[:-1])) for n in names)]
    for q in picked:
        t = time.time()
        try:
            df = qs[q](spark, sf_dir)
            got = df.toPandas()
            took = time.time() - t
            plan = df._jdf.queryExecution().executedPlan().toString()
            marks = [m for m in ("CartesianProduct", "NestedLoopJoin", "SinglePartition") if m in plan]
            if marks:
                print(f"   {q}: {marks}")
            if q not in oracle:
                print(f"{q:32s} rows-only {len(got):8d} {took:6.2f}s")
                continue
            want = con.execute(oracle[q]).df()
            diff = differences(got, want)
            if not diff and kinds(got) != kinds(want):
                d = {c: (kinds(got)[c], kinds(want)[c]) for c in kinds(got) if kinds(got)[c] != kinds(want)[c]}
                diff = f"(types only) {d}"
            bad += bool(diff)
            print(f"{q:32s} {'ok ' if not diff else 'BAD'} {len(got):8d} {took:6.2f}s {diff}", flush=True)
        except Exception as e:  # report and go on with the next query
            bad += 1
            print(f"{q:32s} ERROR {str(e)[:600]}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
