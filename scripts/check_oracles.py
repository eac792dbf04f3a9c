"""Run every registered query and its DuckDB oracle; compare rows, columns
and an order-insensitive hash of values.

usage: python scripts/check_oracles.py [sf_dir] [name ...]
"""

from __future__ import annotations

import hashlib
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6) + 0.0
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted(repr(tuple(_norm(r[i]) for i in order)) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()[:16], sorted(cols)


def compare(spark, sf_dir, names=None, verbose=True):
    from lagscope.plans import catalog
    qs, sqls = catalog.queries(), catalog.oracle_sql()
    con = duck(sf_dir)
    results = {}
    for name in (names or list(qs)):
        t = time.time()
        df = qs[name](spark, sf_dir)
        rows = [tuple(r) for r in df.collect()]
        cols = df.columns
        t_spark = time.time() - t
        if name not in sqls:
            results[name] = ("no-oracle", len(rows), t_spark)
            if verbose:
                print(f"{name:38s} rows={len(rows):7d} (no oracle) {t_spark:.1f}s", flush=True)
            continue
        rel = con.sql(sqls[name])
        orows, ocols = rel.fetchall(), rel.columns
        h1, c1 = digest(cols, rows)
        h2, c2 = digest(ocols, orows)
        ok = (len(rows) == len(orows)) and c1 == c2 and h1 == h2
        results[name] = (ok, len(rows), len(orows), t_spark)
        if verbose:
            print(f"{name:38s} {'OK ' if ok else 'BAD'} rows={len(rows)}/{len(orows)} "
                  f"cols={'same' if c1 == c2 else (c1, c2)} {t_spark:.1f}s", flush=True)
    return results


if __name__ == "__main__":
    from lagscope.session import get_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or None
    spark = get_session()
    res = compare(spark, sf, names)
    bad = [k for k, v in res.items() if v[0] is False]
    print("BAD:", bad)
