"""Run registered queries on Spark and their oracle SQL on DuckDB, compare.

Usage: python tools/oracle_check.py [sf_dir] [name-prefix ...]
Compares row count, column names, and an order-insensitive hash of values
(columns sorted by name, doubles rounded to 6 places).
"""

from __future__ import annotations

import hashlib
import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from jobsift.catalog import ORACLE, QUERIES, load_all  # noqa: E402
from jobsift.session import build_session  # noqa: E402
from jobsift.sources.tables import TABLES  # noqa: E402


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6) + 0.0
    if hasattr(v, "item"):
        return _norm(v.item())
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    keys = sorted(repr(tuple(_norm(r[i]) for i in order)) for r in rows)
    return hashlib.md5("\n".join(keys).encode()).hexdigest(), keys


def main() -> int:
    args = sys.argv[1:]
    sf_dir = "/root/testdata/sf0.01"
    if args and args[0].startswith("/"):
        sf_dir, args = args[0], args[1:]
    load_all()
    spark = build_session()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    names = [n for n in QUERIES if not args or any(n.startswith(a) for a in args)]
    bad = 0
    for n in names:
        t0 = time.time()
        try:
            sdf = QUERIES[n](spark, sf_dir)
            scols = sdf.columns
            srows = [tuple(r) for r in sdf.collect()]
        except Exception:
            print(f"FAIL-SPARK {n}\n{traceback.format_exc()[-600:]}")
            bad += 1
            continue
        ts = time.time() - t0
        if n not in ORACLE:
            print(f"ROWS {n}: {len(srows)} rows ({ts:.1f}s)")
            continue
        try:
            cur = con.execute(ORACLE[n])
            dcols = [d[0] for d in cur.description]
            drows = cur.fetchall()
        except Exception:
            print(f"FAIL-DUCK {n}\n{traceback.format_exc()[-600:]}")
            bad += 1
            continue
        hs, ks = _digest(scols, srows)
        hd, kd = _digest(dcols, drows)
        ok = sorted(scols) == sorted(dcols) and len(srows) == len(drows) and hs == hd
        if ok:
            print(f"OK   {n}: {len(srows)} rows ({ts:.1f}s)")
        else:
            bad += 1
            print(f"DIFF {n}: spark {len(srows)} rows {sorted(scols)} / duck {len(drows)} rows {sorted(dcols)}")
            ds, dd = set(ks) - set(kd), set(kd) - set(ks)
            for x in list(ds)[:3]:
                print("   spark-only", x[:300])
            for x in list(dd)[:3]:
                print("   duck-only ", x[:300])
    print(f"{len(names) - bad}/{len(names)} passed")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
