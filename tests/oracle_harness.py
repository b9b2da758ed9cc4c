"""Run registered queries on Spark and their SQL on DuckDB; compare.

Comparison mirrors the driver's gate: same column names (sorted), same row
count, and the same multiset of rows after value normalisation (floats to 6
significant decimals, ints as ints, everything else as text).

Usage: python tests/oracle_harness.py [sf_dir] [name-prefix ...]
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    try:
        import numpy as np
        if isinstance(v, np.generic):
            v = v.item()
    except ImportError:
        pass
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return ("f", round(v, 6))
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, int):
        return ("i", v)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return ("l", tuple(_norm(x) for x in v))
    return ("s", str(v))


def rows_of(pdf):
    cols = sorted(pdf.columns)
    recs = pdf[cols].astype(object).where(pdf[cols].notna(), None).values.tolist()
    return cols, Counter(tuple(_norm(x) for x in r) for r in recs)


def compare(spark, name, entry, sf_dir, con):
    t0 = time.time()
    sdf = entry.build(spark, sf_dir)
    spdf = sdf.toPandas()
    ts = time.time() - t0
    if entry.sql is None:
        return {"name": name, "ok": None, "rows": len(spdf), "spark_s": round(ts, 2)}
    dpdf = con.execute(entry.sql).df()
    c1, r1 = rows_of(spdf)
    c2, r2 = rows_of(dpdf)
    res = {"name": name, "rows": len(spdf), "oracle_rows": len(dpdf), "spark_s": round(ts, 2)}
    if c1 != c2:
        res.update(ok=False, why=f"columns {c1} vs {c2}")
    elif r1 != r2:
        only_s = list((r1 - r2).elements())[:3]
        only_d = list((r2 - r1).elements())[:3]
        res.update(ok=False, why=f"values differ; spark-only {only_s} oracle-only {only_d}")
    else:
        res.update(ok=True)
    return res


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    prefixes = argv[2:]
    from evtrail.plans.registry import load_all
    from evtrail.session import build_session
    spark = build_session()
    con = duck(sf_dir)
    reg = load_all()
    bad = 0
    for name, entry in sorted(reg.items()):
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        try:
            r = compare(spark, name, entry, sf_dir, con)
        except Exception as e:  # noqa: BLE001
            r = {"name": name, "ok": False, "why": f"{type(e).__name__}: {str(e)[:400]}"}
        if r.get("ok") is False:
            bad += 1
        print(r, flush=True)
    print(f"FAILED {bad}")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
