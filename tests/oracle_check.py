"""Run registered queries next to their SQL in DuckDB and compare values.

usage: python tests/oracle_check.py [sf_dir] [name ...]
"""

import datetime
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    if v is None:
        return ""
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(norm(x) for x in v.values()) + "}"
    return str(v)


def spark_rows(df):
    cols = sorted(df.columns)
    return cols, sorted(tuple(norm(r[c]) for c in cols) for r in df.select(*[f"`{c}`" for c in cols]).collect())


def sql_rows(con, sql):
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(norm(r[i]) for i in order) for r in cur.fetchall())


def compare(spark, con, fn, sql, sf_dir):
    c1, r1 = spark_rows(fn(spark, sf_dir))
    if sql is None:
        return None, f"rows-only {len(r1)}"
    c2, r2 = sql_rows(con, sql)
    if c1 != c2:
        return False, f"columns {c1} vs {c2}"
    if len(r1) != len(r2):
        return False, f"rows {len(r1)} vs {len(r2)}; e.g. {r1[:1]} vs {r2[:1]}"
    bad = [(a, b) for a, b in zip(r1, r2) if a != b]
    return (not bad), (f"{len(r1)} rows" if not bad else f"{len(bad)}/{len(r1)} differ {c1}: {bad[0]}")


if __name__ == "__main__":
    from panelweave.plans import ORACLES, QUERIES
    from panelweave.session import get_session

    args = sys.argv[1:]
    sf = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in args if not a.startswith("/")] or list(QUERIES)
    spark = get_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    fails = 0
    for n in names:
        for name in [q for q in QUERIES if q == n or (n.endswith("*") and q.startswith(n[:-1]))]:
            t0 = time.time()
            try:
                ok, msg = compare(spark, con, QUERIES[name], ORACLES.get(name), sf)
            except Exception as e:  # noqa: BLE001
                ok, msg = False, f"{type(e).__name__}: {str(e)[:1500]}"
            fails += ok is False
            print(f"{'ok  ' if ok else '--  ' if ok is None else 'FAIL'} {name} {time.time() - t0:.1f}s {msg}", flush=True)
    print("failures:", fails)
