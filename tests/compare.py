"""Run named queries next to their DuckDB oracles: python tests/compare.py [sf] [name-prefix ...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def oracle_connection(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def _plain(v):
    if v is None:
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return 0.0 if v == 0 else v
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    return v


def table_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def compare(spark, con, sf, name, fn, sql):
    start = time.time()
    df = fn(spark, sf)
    got = table_rows(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - start
    if sql is None:
        return took, len(got[1]), "rows-only"
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = table_rows(names, cur.fetchall())
    if got[0] != want[0]:
        return took, len(got[1]), f"COLUMNS {got[0]} != {want[0]}"
    if len(got[1]) != len(want[1]):
        return took, len(got[1]), f"ROWS {len(got[1])} != {len(want[1])}"
    bad = [(a, b) for a, b in zip(got[1], want[1]) if a != b]
    if bad:
        return took, len(got[1]), f"VALUES {len(bad)} differ {got[0]} e.g. {bad[0]}"
    types = {c: t for c, t in df.dtypes}
    sqlt = {d[0]: str(d[1]) for d in cur.description}
    odd = []
    pair = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "int": "INTEGER"}
    for c in types:
        if types[c] in pair and sqlt[c] != pair[types[c]]:
            odd.append((c, types[c], sqlt[c]))
    return took, len(got[1]), "ok" + (f" TYPES {odd}" if odd else "")


if __name__ == "__main__":
    from countloom.plans import load_catalog
    from countloom.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    prefixes = sys.argv[2:]
    path = f"/root/testdata/sf{sf}"
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle_connection(path)
    qs, sqls = load_catalog()
    bad = 0
    for name, fn in sorted(qs.items()):
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        try:
            took, n, res = compare(spark, con, path, name, fn, sqls.get(name))
        except Exception as exc:
            took, n, res = 0.0, 0, "ERROR " + str(exc).replace("\n", " ")[:700]
        bad += not (res.startswith("ok") or res == "rows-only")
        print(f"{name:34s} {took:6.2f}s {n:7d} {res}", flush=True)
    print("bad", bad)
