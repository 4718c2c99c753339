"""Clusterings of the measured vectors and compositions against NumPy, and keyed shuffles."""

from collections import Counter

import numpy as np
import pytest

from countloom.functions import shuffle
from countloom.plans import load_catalog, study_spatial as st, views as v

SF = "/root/testdata/sf0.001"


def cost(x, labels):
    return sum(((x[labels == c] - x[labels == c].mean(0)) ** 2).sum() for c in np.unique(labels))


def lloyd(x, k, seed, steps=60):
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(steps):
        near = ((x[:, None, :] - centres[None]) ** 2).sum(-1).argmin(1)
        centres = np.array([x[near == c].mean(0) if (near == c).any() else centres[c] for c in range(k)])
    return near


def best_of(x, k, runs=10):
    return min(cost(x, lloyd(x, k, s)) for s in range(runs))


def is_settled(x, labels):
    """Nearly no point is nearer to another cluster's mean: the end of Lloyd steps."""
    names = np.unique(labels)
    means = np.array([x[labels == c].mean(0) for c in names])
    near = names[((x[:, None, :] - means[None]) ** 2).sum(-1).argmin(1)]
    return (near == labels).mean() > 0.98


def vectors(spark):
    rows = sorted(v.vectors(spark, SF).collect(), key=lambda r: r["cell_id"])
    return [r["cell_id"] for r in rows], np.array([r["vec"] for r in rows])


def test_kmeans_of_measured_vectors(spark):
    ids, x = vectors(spark)
    found = {r["cell_id"]: r["cluster"] for r in load_catalog()[0]["m04_embedding_kmeans"](spark, SF).collect()}
    labels = np.array([found[i] for i in ids])
    assert len(found) == len(ids) and is_settled(x, labels)
    assert cost(x, labels) <= 1.1 * best_of(x, 10)


def test_domains_of_measured_vectors(spark):
    ids, x = vectors(spark)
    at = {i: k for k, i in enumerate(ids)}
    near = {}
    for r in st.graph(spark, SF).collect():
        near.setdefault(r["src"], []).append((r["dst"], r["weight"]))
    smooth = x.copy()
    for i, them in near.items():
        w = np.array([b for _, b in them])
        smooth[at[i]] = 0.7 * x[at[i]] + 0.3 * (w / w.sum()) @ x[[at[j] for j, _ in them]]
    found = {r["cell_id"]: r["domain"] for r in load_catalog()[0]["x07_embedding_domains"](spark, SF).collect()}
    labels = np.array([found[i] for i in ids])
    assert is_settled(smooth, labels) and cost(smooth, labels) <= 1.1 * best_of(smooth, 10)


def test_niches_of_measured_neighbourhoods(spark):
    cells = {r["cell_id"]: r["cell_type"] for r in v.places(spark, SF).collect()}
    types = sorted(set(cells.values()))
    near = {c: Counter() for c in cells}
    for r in st.edges(spark, SF).collect():
        near[r["src"]][cells[r["dst"]]] += 1
    x = np.array([[n[t] / max(1, sum(n.values())) for t in types] for _, n in sorted(near.items())])
    from countloom.operators import spatial as sx

    places = v.places(spark, SF)
    found = sx.niches(sx.composition(st.edges(spark, SF), places), places, types, k=5)
    rows = sorted(found.collect(), key=lambda r: r["cell_id"])
    assert np.allclose([r["vec"] for r in rows], x)
    labels = np.array([r["niche"] for r in rows])
    assert is_settled(x, labels)
    summary = {(r["cell_count"], r["dominant_cell_type"], round(r["dominant_cell_type_fraction"], 5)) for r in load_catalog()[0]["x17_neighbourhood_niches"](spark, SF).collect()}
    assert summary == {(int((labels == c).sum()), types[x[labels == c].mean(0).argmax()], round(x[labels == c].mean(0).max(), 5)) for c in np.unique(labels)}


@pytest.mark.parametrize("size", [1, 2, 7, 100])
def test_shuffled_places_are_permutations(size):
    got = shuffle.shuffled_places(np.arange(size), np.full(size, size), 42, np.arange(1, 401))
    assert (np.sort(got, axis=0) == np.arange(size)[:, None]).all()
    if size == 7:  # every place is reached about equally often, and pairs of places move independently
        share = np.array([[(got[i] == j).mean() for j in range(7)] for i in range(7)])
        assert np.abs(share - 1 / 7).max() < 0.08
        pairs = Counter(zip(got[0].tolist(), got[1].tolist()))
        assert len(pairs) == 42 and max(pairs.values()) < 30


def test_five_thousand_states(spark):
    import pandas as pd

    from countloom.operators import signatures as sg

    n, g = 5000, 40
    rng = np.random.default_rng(6)
    x = rng.poisson(0.3, size=(n, g)).astype(float)
    x[3] = 0
    i, j = np.nonzero(x)
    values = spark.createDataFrame(pd.DataFrame({"cell_id": i, "gene_id": j, "value": x[i, j]}))
    states = np.array([f"s{k % 4999}" for k in range(n)])  # one state has two cells
    cells = spark.createDataFrame(pd.DataFrame({"cell_id": np.arange(n), "state": states}))
    names = sorted(set(states))
    centres = np.array([x[states == s].mean(0) for s in names])
    got = {}
    for r in sg.soft_assignment(values, cells).where("cell_id IN (0, 3, 777)").collect():
        got[r["cell_id"], r["to_state"]] = r["sq"]
    assert len(got) == 3 * 4999
    for c in (0, 3, 777):
        assert np.allclose([got[c, s] for s in names], ((centres - x[c]) ** 2).sum(1), atol=1e-9)
    assert sg.soft_assignment(values, cells.where("false")).count() == 0
