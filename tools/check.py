"""Run registered queries next to their DuckDB text and compare all rows.

usage: python tools/check.py [--sf DIR] [--family NAME ...] [--query NAME ...]
"""

from __future__ import annotations

import argparse
import datetime as dt
import decimal
import math
import sys
import time
import traceback
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb

from factorwise.plans.catalog import FAMILIES, load
from factorwise.session import build_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def canonical(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, bool):
        return v
    if isinstance(v, int):
        return float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return float(f"{v:.10g}") + 0.0
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()[:26]
    if isinstance(v, (list, tuple)):
        return tuple(canonical(x) for x in v)
    if isinstance(v, dict):
        return tuple((k, canonical(x)) for k, x in sorted(v.items()))
    return v


def rows_of(df):
    names = sorted(df.columns)
    return names, Counter(tuple(canonical(r[n]) for n in names) for r in df.collect())


def duck_rows(con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    data = Counter(tuple(canonical(r[i]) for i in order) for r in cur.fetchall())
    return [names[i] for i in order], data


def compare(spark, con, fn, sql, sf):
    names, mine = rows_of(fn(spark, sf))
    if sql is None:
        return "rows", sum(mine.values()), ""
    other_names, other = duck_rows(con, sql)
    if names != other_names:
        return "SCHEMA", sum(mine.values()), f"{names} vs {other_names}"
    if mine != other:
        a, b = list((mine - other).items()), list((other - mine).items())
        return "DIFF", sum(mine.values()), f"only spark {len(a)}: {a[:2]}\n      only duckdb {len(b)}: {b[:2]}"
    return "ok", sum(mine.values()), ""


def main() -> int:
    p = argparse.ArgumentParser()
    p.add_argument("--sf", default="/root/testdata/sf0.01")
    p.add_argument("--family", nargs="*")
    p.add_argument("--query", nargs="*")
    p.add_argument("--trace", action="store_true")
    a = p.parse_args()
    catalog = load(tuple(a.family) if a.family else FAMILIES)
    spark = build_session("check", "local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="16g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(a.sf)
    bad = 0
    for name, fn in catalog.queries.items():
        if a.query and name not in a.query:
            continue
        t = time.time()
        try:
            status, n, note = compare(spark, con, fn, catalog.sql.get(name), a.sf)
        except Exception as e:  # report and go on
            status, n, note = "ERROR", -1, str(e)[:1500]
            if a.trace:
                traceback.print_exc()
        bad += status not in ("ok", "rows")
        print(f"{status:7s} {name:28s} {n:9d} rows {time.time() - t:6.1f}s {note}", flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
