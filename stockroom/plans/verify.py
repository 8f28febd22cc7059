"""Side-by-side check of a registered query against its SQL oracle (DuckDB).

Mirrors the driver's gate: row count, column names, and an order-insensitive comparison of
values. Used by the tests and by ``python -m stockroom.plans.verify <sf_dir> [keys...]``.
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def duckdb_conn(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v, digits: int | None):
    if v is None:
        return None
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    if isinstance(v, (float, decimal.Decimal)):
        f = float(v)
        return round(f, digits) if digits is not None else f
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x, digits) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x, digits)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return _norm(v.asDict(recursive=True), digits)
    if isinstance(v, bool):
        return bool(v)
    if isinstance(v, int):
        return int(v)
    return v


def _rows(cols, rows, digits):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i], digits) for i in order) for r in rows]
    return sorted(out, key=repr)


def compare(spark, sf_dir: str, key: str, con=None) -> dict:
    from stockroom.plans.catalog import REGISTRY
    from stockroom.plans.oracle import ORACLE

    con = con or duckdb_conn(sf_dir)
    t0 = time.time()
    sdf = REGISTRY[key](spark, sf_dir)
    srows = [tuple(r) for r in sdf.collect()]
    scols = sdf.columns
    t1 = time.time()
    res = {"key": key, "spark_rows": len(srows), "spark_sec": round(t1 - t0, 2)}
    if key not in ORACLE:
        res["status"] = "no-oracle"
        return res
    cur = con.execute(ORACLE[key])
    ocols = [d[0] for d in cur.description]
    orows = cur.fetchall()
    res["oracle_rows"] = len(orows)
    res["schema_ok"] = sorted(scols) == sorted(ocols)
    if not res["schema_ok"]:
        res["status"] = f"schema spark={sorted(scols)} oracle={sorted(ocols)}"
        return res
    exact = _rows(scols, srows, None) == _rows(ocols, orows, None)
    approx = exact or _rows(scols, srows, 6) == _rows(ocols, orows, 6)
    res["status"] = "exact" if exact else ("approx" if approx else "MISMATCH")
    if not approx:
        a, b = _rows(scols, srows, 6), _rows(ocols, orows, 6)
        res["spark_only"] = [r for r in a if r not in set(b)][:3]
        res["oracle_only"] = [r for r in b if r not in set(a)][:3]
        res["cols"] = sorted(scols)
    return res


def main(argv: list[str]) -> int:
    from stockroom.plans.catalog import REGISTRY
    from stockroom.session import local_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    keys = argv[1:] or list(REGISTRY)
    spark = local_session()
    con = duckdb_conn(sf_dir)
    bad = 0
    for k in keys:
        try:
            r = compare(spark, sf_dir, k, con)
        except Exception as e:  # report and continue with the next key
            r = {"key": k, "status": f"ERROR {type(e).__name__}: {str(e)[:300]}"}
        if r["status"] not in ("exact", "approx", "no-oracle"):
            bad += 1
        print(r, flush=True)
    print(f"{len(keys) - bad}/{len(keys)} ok")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
