"""Compare a Spark query with its DuckDB oracle the way the driver does:
row count, column names, and an order-insensitive multiset of row values.

Run directly: ``python tests/oracle_compare.py [sf_dir] [name ...]``.
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
EXACT = os.environ.get("ORACLE_EXACT") == "1"  # compare doubles bit for bit
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return ("null",)
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, float):
        if math.isnan(v):
            return ("null",)
        if math.isinf(v):
            return ("f", v)
        return ("f", v if EXACT else float(f"{v:.10g}"))
    if isinstance(v, int):
        return ("f", float(v)) if abs(v) < 2**53 else ("i", v)
    if hasattr(v, "isoformat"):
        return ("t", v.isoformat())
    return ("s", str(v))


def rows_of(cols: list[str], rows) -> list[tuple]:
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in rows)


def compare(spark, name: str, fn, sql: str | None, sf_dir: str, con) -> dict:
    t = time.time()
    sdf = fn(spark, sf_dir)
    s_rows = [tuple(r) for r in sdf.collect()]
    s_cols = sdf.columns
    out = {"name": name, "spark_rows": len(s_rows), "spark_sec": round(time.time() - t, 2)}
    if sql is None:
        out["status"] = "rows-only"
        return out
    rel = con.execute(sql)
    d_cols = [c[0] for c in rel.description]
    d_rows = rel.fetchall()
    out["oracle_rows"] = len(d_rows)
    if sorted(s_cols) != sorted(d_cols):
        out["status"] = f"COLUMNS spark={sorted(s_cols)} oracle={sorted(d_cols)}"
        return out
    a, b = rows_of(s_cols, s_rows), rows_of(d_cols, d_rows)
    if a == b:
        out["status"] = "match"
    else:
        diff = [x for x in a if x not in set(b)][:3]
        diff2 = [x for x in b if x not in set(a)][:3]
        out["status"] = "VALUES differ"
        out["spark_only"] = diff
        out["oracle_only"] = diff2
    return out


def main(argv: list[str]) -> int:
    sys.path.insert(0, ROOT)
    import __spark_entry__ as E
    from statcube.session import local_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:]
    spark = local_session(8)
    con = duck(sf_dir)
    qs, sqls = E.queries(), E.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if names and name not in names:
            continue
        try:
            res = compare(spark, name, fn, sqls.get(name), sf_dir, con)
        except Exception as e:  # report and continue
            res = {"name": name, "status": f"ERROR {type(e).__name__}: {str(e)[:400]}"}
        bad += res["status"] not in ("match", "rows-only")
        print(res, flush=True)
    print("mismatches:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
