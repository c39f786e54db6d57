"""Run registered queries in Spark and DuckDB side by side and report differences.

Usage: python tests/check_oracles.py [--sf DIR] [key ...]   (keys may end in *)
"""

from __future__ import annotations

import argparse
import fnmatch
import sys
import time
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype == object or str(df[c].dtype).startswith("datetime"):
            df[c] = df[c].map(lambda v: None if v is None or v is pd.NaT or v != v else str(v)[:19].removesuffix(" 00:00:00"))
        elif str(df[c].dtype) in ("bool", "boolean"):
            df[c] = df[c].map(lambda v: None if v is pd.NA or v is None else str(bool(v)))
        else:
            df[c] = df[c].astype("float64")
    return df.sort_values(list(df.columns), na_position="first").reset_index(drop=True)


def compare(a: pd.DataFrame, b: pd.DataFrame) -> str | None:
    if sorted(a.columns) != sorted(b.columns):
        return f"columns {sorted(a.columns)} vs {sorted(b.columns)}"
    if len(a) != len(b):
        return f"rows {len(a)} vs {len(b)}"
    a, b = canonical(a), canonical(b)
    notes = []
    for c in a.columns:
        x, y = a[c], b[c]
        if x.dtype == float and y.dtype == float:
            bad = ~((x == y) | (x.isna() & y.isna()))
            if bad.any():
                gap = np.nanmax(np.abs(x[bad] - y[bad])) if (x[bad] - y[bad]).notna().any() else float("nan")
                notes.append(f"{c}: {int(bad.sum())} differ, max gap {gap:.3g}")
        else:
            x, y = x.where(x.notna(), None).astype(object), y.where(y.notna(), None).astype(object)
            bad = [p != q for p, q in zip(x, y)]
            if any(bad):
                i = bad.index(True)
                notes.append(f"{c}: {sum(bad)} differ, e.g. {x[i]!r} vs {y[i]!r}")
    return "; ".join(notes) or None


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("keys", nargs="*")
    args = ap.parse_args()
    import __spark_entry__ as entry
    from tidemark.session import build_session

    spark = build_session()
    con = connect(args.sf)
    qs, oracles = entry.queries(), entry.oracle_sql()
    keys = [k for k in qs if not args.keys or any(fnmatch.fnmatch(k, p) for p in args.keys)]
    failed = 0
    for k in keys:
        t0 = time.time()
        try:
            got = qs[k](spark, args.sf).toPandas()
            t1 = time.time()
            if k not in oracles:
                print(f"rows  {k}: {len(got)} rows, no oracle ({t1 - t0:.1f}s)", flush=True)
                continue
            note = compare(got, con.execute(oracles[k]).fetchdf())
            t2 = time.time()
        except Exception as exc:  # report and go on
            failed += 1
            print(f"ERROR {k}: {type(exc).__name__} {str(exc)[:1500]}", flush=True)
            continue
        failed += note is not None
        print(f"{'FAIL ' if note else 'ok   '} {k}: {len(got)} rows {note or ''} ({t1 - t0:.1f}s / {t2 - t1:.1f}s)", flush=True)
    print(f"{len(keys)} keys, {failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(bool(main()))
