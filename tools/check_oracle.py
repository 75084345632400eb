"""Compare registered queries with their DuckDB SQL on one scale factor.

usage: python tools/check_oracle.py [sf] [query ...]
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
import pandas as pd  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def canonical(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf[sorted(pdf.columns)].copy()
    for c in pdf.columns:
        pdf[c] = pdf[c].map(lambda v: "<null>" if v is None or v != v else repr(v) if isinstance(v, float) else str(v))
    return pdf.sort_values(list(pdf.columns)).reset_index(drop=True)


def compare(got: pd.DataFrame, want: pd.DataFrame) -> str:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns differ: {sorted(set(got.columns) ^ set(want.columns))}"
    if len(got) != len(want):
        return f"rows differ: {len(got)} vs {len(want)}"
    kinds = [
        f"{c}:{got[c].dtype}/{want[c].dtype}"
        for c in got.columns
        if len(got) and got[c].dtype.kind != want[c].dtype.kind and {got[c].dtype.kind, want[c].dtype.kind} & set("ifb")
    ]
    a, b = canonical(got), canonical(want)
    if not a.equals(b):
        bad = [c for c in a.columns if not a[c].equals(b[c])]
        i = next(i for i in range(len(a)) if not a.loc[i].equals(b.loc[i]))
        return f"values differ in {bad}: {a.loc[i, bad].to_dict()} vs {b.loc[i, bad].to_dict()}"
    return f"types differ: {kinds}" if kinds else "ok"


def main():
    from emberwatch.plans.registry import all_oracles, all_queries
    from emberwatch.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    names = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con = local_session(int(os.environ.get("CPUS", "8"))), connect(sf_dir)
    oracles, failed = all_oracles(), []
    for name, fn in all_queries().items():
        if names and name not in names:
            continue
        t = time.time()
        try:
            got = fn(spark, sf_dir).toPandas()
            took = time.time() - t
            if name in oracles:
                verdict = compare(got, con.execute(oracles[name]).df())
            else:
                verdict = "ok (rows only)" if len(got) else "no rows"
        except Exception as exc:  # noqa: BLE001
            took, verdict, got = time.time() - t, f"error: {str(exc)[:1500]}", []
        if not verdict.startswith("ok"):
            failed.append(name)
        print(f"{name:32s} {len(got):7d} rows {took:6.2f}s  {verdict}", flush=True)
    print(f"{len(failed)} failed: {failed}")
    return bool(failed)


if __name__ == "__main__":
    sys.exit(main())
