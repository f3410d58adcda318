"""Run one or more registered queries against their SQL twin and report differences."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def oracle(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.10g}")
    if isinstance(value, bool) or value is None:
        return value
    if hasattr(value, "isoformat"):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return str([plain(v) for v in value])
    try:
        return float(f"{float(value):.10g}") if not isinstance(value, str) else value
    except (TypeError, ValueError):
        return str(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(plain(row[i]) for i in order) for row in rows]
    return sorted(out, key=repr)


def compare(spark, con, name, query, sql, sf_dir):
    start = time.time()
    df = query(spark, sf_dir)
    got = df.collect()
    took = time.time() - start
    if sql is None:
        return f"{name}: rows-only {len(got)} ({took:.1f}s)", True
    start = time.time()
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    oracle_took = time.time() - start
    if sorted(names) != sorted(df.columns):
        return f"{name}: COLUMNS {sorted(df.columns)} vs {sorted(names)}", False
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if a == b:
        kind = "" if a else " EMPTY"
        return f"{name}: ok {len(a)}{kind} ({took:.1f}s, oracle {oracle_took:.1f}s)", True
    only_a = [r for r in a if r not in set(b)][:3] if len(a) < 20000 else []
    only_b = [r for r in b if r not in set(a)][:3] if len(b) < 20000 else []
    return f"{name}: DIFFERENT {len(a)} vs {len(b)}\n   {sorted(names)}\n   spark  {only_a}\n   oracle {only_b}", False


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from sweeplog import build_session

    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = build_session("compare", cores=8, **{"spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle(sf)
    queries, sqls = entry.queries(), entry.oracle_sql()
    wanted = sys.argv[1:] or list(queries)
    bad = []
    for name in wanted:
        try:
            line, good = compare(spark, con, name, queries[name], sqls.get(name), sf)
        except Exception as exc:  # noqa: BLE001
            line, good = f"{name}: ERROR {str(exc)[:1500]}", False
        print(line, flush=True)
        if not good:
            bad.append(name)
    print(len(wanted), "queries,", len(bad), "bad:", bad)
