"""Genes that only one donor holds, or none: folds, and full models, whose effect is exactly zero."""

import duckdb
import pytest

from compare import TABLES, compare, oracle_connection
from countloom.plans import load_catalog

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rare(tmp_path_factory):
    """The small tables with genes 0 and 1 in one order alone, under one of the two conditions, and gene 2 in none."""
    folder = tmp_path_factory.mktemp("rare")
    con = duckdb.connect()
    one = con.execute(f"""SELECT l_orderkey FROM '{SMALL}/lineitem.parquet' JOIN '{SMALL}/orders.parquet' ON l_orderkey = o_orderkey JOIN '{SMALL}/customer.parquet' ON o_custkey = c_custkey
        WHERE c_mktsegment = 'BUILDING' GROUP BY 1 HAVING count(*) > 2 ORDER BY 1 LIMIT 1""").fetchone()[0]
    for t in TABLES:
        line = f"CASE WHEN l_orderkey = {one} THEN l_linenumber % 2 WHEN l_partkey < 3 THEN 100 + l_partkey ELSE l_partkey END"
        change = f"* REPLACE (CAST({line} AS BIGINT) AS l_partkey)" if t == "lineitem" else "*"
        con.execute(f"COPY (SELECT {change} FROM '{SMALL}/{t}.parquet') TO '{folder}/{t}.parquet' (FORMAT parquet)")
    return str(folder)


@pytest.mark.parametrize("name", ["d14_leave_one_out_summary_genes", "d15_donor_influence_genes", "d16_candidates_genes"])
def test_folds_without_an_effect_count_as_in_the_sql(spark, rare, name):
    queries, oracles = load_catalog()
    assert compare(spark, oracle_connection(rare), rare, name, queries[name], oracles[name])[2] == "ok"


def test_the_operator_names_zero_effects(spark, rare):
    from countloom.operators import donor_stats as ds, sensitivity as sens
    from countloom.plans import study_donors as sd, views as v

    found = sens.donor_influence(sd.gene_folds(spark, rare), ds.donor_sides(v.paired_cells(spark, rare), sd.A, sd.B))
    told = {r["gene_id"]: (r["direction_status"], r["zero_effect_donors"]) for r in found.where("gene_id < 3").collect()}
    assert told[0] == told[1] and told[0][0] == "zero_effect_nonstable" and len(told[0][1]) == 1
    assert told[2][0] == "undefined_full_effect" and len(told[2][1]) > 20
