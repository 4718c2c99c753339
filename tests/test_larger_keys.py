"""Queries whose oracles part from them only where keys are larger than in the small tables."""

import duckdb

from compare import TABLES, compare, oracle_connection
from countloom.plans import load_catalog

SMALL = "/root/testdata/sf0.001"


def moved_order(folder, key):
    """The small tables with the first order of one line renamed to ``key``."""
    con = duckdb.connect()
    old = con.execute(f"SELECT l_orderkey FROM '{SMALL}/lineitem.parquet' GROUP BY 1 HAVING count(*) = 1 ORDER BY 1 LIMIT 1").fetchone()[0]
    for t in TABLES:
        column = {"orders": "o_orderkey", "lineitem": "l_orderkey"}.get(t)
        change = f"* REPLACE (CAST(CASE WHEN {column} = {old} THEN {key} ELSE {column} END AS BIGINT) AS {column})" if column else "*"
        con.execute(f"COPY (SELECT {change} FROM '{SMALL}/{t}.parquet') TO '{folder}/{t}.parquet' (FORMAT parquet)")
    return str(folder)


def test_rebuilt_dispositions_of_a_lost_and_changed_row(spark, tmp_path):
    sf = moved_order(tmp_path, 216_011)  # 11 by 2,000 and 5 by 777
    queries, oracles = load_catalog()
    name = "e08_rebuilt_dispositions"
    assert compare(spark, oracle_connection(sf), sf, name, queries[name], oracles[name])[2] == "ok"
