"""Every named query at the smallest scale, next to its oracle where it has one."""

import pytest

from compare import compare, oracle_connection
from countloom.plans import load_catalog

SMALL, MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
# Their oracles state the paired design, and only from this scale on is every nation seen under both conditions.
PAIRED = {"d10_design_contrast", "d11_pseudobulk_de", "d17_fold_integrity", "d20_paired_log_ratios", "d23_activity_contrast"}
QUERIES, ORACLES = load_catalog()


@pytest.fixture(scope="module")
def connections():
    return {sf: oracle_connection(sf) for sf in (SMALL, MEDIUM)}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, connections, name):
    sf = MEDIUM if name in PAIRED else SMALL
    _took, n, result = compare(spark, connections[sf], sf, name, QUERIES[name], ORACLES.get(name))
    assert result in ("ok", "rows-only"), result
