"""Spark-vs-DuckDB check of every registered query (mirrors the driver's compare).

Usage: python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import hashlib
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def fingerprint(columns: list[str], rows: list[tuple]) -> str:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    lines = sorted(repr(tuple(_norm(r[i]) for i in order)) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()[:16]


def compare(spark, name, fn, sql, sf_dir, con):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    s_cols = sdf.columns
    s_rows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    res = con.execute(sql)
    d_cols = [d[0] for d in res.description]
    d_rows = res.fetchall()
    t2 = time.time()
    ok_cols = sorted(s_cols) == sorted(d_cols)
    ok_n = len(s_rows) == len(d_rows)
    ok_hash = ok_cols and fingerprint(s_cols, s_rows) == fingerprint(d_cols, d_rows)
    return {"name": name, "rows": len(s_rows), "oracle_rows": len(d_rows), "cols": ok_cols,
            "count": ok_n, "hash": ok_hash, "spark_s": round(t1 - t0, 2),
            "duck_s": round(t2 - t1, 2), "s_cols": s_cols, "d_cols": d_cols,
            "s_rows": s_rows, "d_rows": d_rows}


def main(argv):
    import __spark_entry__ as entry
    from adfunnel.session import local_session
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    spark = local_session(8)
    con = duck(sf_dir)
    qs, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if names and name not in names:
            continue
        if name not in sqls:
            print(f"{name:32s} (no oracle)")
            continue
        r = compare(spark, name, fn, sqls[name], sf_dir, con)
        status = "OK " if (r["cols"] and r["count"] and r["hash"]) else "BAD"
        bad += status == "BAD"
        print(f"{status} {name:32s} rows={r['rows']:6d} oracle={r['oracle_rows']:6d} "
              f"cols={r['cols']} hash={r['hash']} spark={r['spark_s']}s duck={r['duck_s']}s")
        if not r["cols"]:
            print("   spark:", sorted(r["s_cols"]), "\n   duck: ", sorted(r["d_cols"]))
    print("mismatches:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
