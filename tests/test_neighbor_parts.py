"""Neighbours in many dimensions: parts of a group meet once, instead of every point visiting every block."""

import numpy as np
import pytest

from countloom.operators import neighbors


def brute(x, ids, k):
    d = neighbors.pair_distances(x, x, "l2")
    return {(ids[i], ids[j], r + 1) for i in range(len(x)) for r, j in enumerate([j for j in np.lexsort((ids, d[i])) if j != i][:k])}


@pytest.mark.parametrize("metric", ["l2", "l1"])
def test_parts_find_the_same_neighbours(spark, monkeypatch, metric):
    monkeypatch.setattr(neighbors, "_large_groups", lambda *a: pytest.fail("a point was sent to every block that can hold a neighbour"))
    monkeypatch.setattr(neighbors, "QUERY_ROWS", 150)
    monkeypatch.setattr(neighbors, "POINT_ROWS", 250)
    rng, k = np.random.default_rng(8), 4
    x = rng.normal(size=(600, 16))
    x[:40] = x[40]  # copies of one point
    x[450:] = rng.integers(0, 2, (150, 16))  # ties
    ids = rng.permutation(5000)[:600]
    rows = [(int(i), "ab"[n >= 400], v.tolist()) for n, (i, v) in enumerate(zip(ids, x))]
    df = spark.createDataFrame(rows, "cell_id long, s string, vec array<double>")
    found = {(r["src"], r["dst"], r["rank"]) for r in neighbors.exact_neighbors(df, k, metric, "s", block_rows=100).collect()}
    monkeypatch.setattr(neighbors, "pair_distances", (lambda f: lambda a, b, _: f(a, b, metric))(neighbors.pair_distances))
    assert found == brute(x[:400], ids[:400], k) | brute(x[400:], ids[400:], k)


def test_screened_points_are_those_of_all_distances():
    rng = np.random.default_rng(9)
    some = [rng.normal(size=(5000, 64)), rng.integers(0, 2, (5000, 12)).astype(float), rng.normal(size=(5000, 8)) + 1e7,
            rng.normal(size=(5000, 20)) * 1e-3 + rng.integers(0, 5, (5000, 1)) * 1e4, rng.normal(size=(5000, 6)) * 1e-12, np.ones((5000, 5)), rng.normal(size=(9, 5))]
    for x in some:
        for have, want in zip(neighbors._screened(x[:700], x, 16), neighbors._least(neighbors.pair_distances(x[:700], x, "l2"), 16)):
            assert np.array_equal(have, want)
