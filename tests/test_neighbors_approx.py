"""Approximate neighbours against exact ones, and the number of comparisons."""

import numpy as np
import pandas as pd

from countloom.operators import neighbors_approx as na
from countloom.operators.neighbors import exact_neighbors


def points(spark, x):
    return spark.createDataFrame(pd.DataFrame({"cell_id": np.arange(len(x)), "vec": list(x)}))


def test_recall_in_64_dimensions(spark):
    rng = np.random.default_rng(7)
    n, k = 4000, 10
    x = np.tanh(rng.normal(size=(n, 8)) @ rng.normal(size=(8, 64)) / 3) + 0.02 * rng.normal(size=(n, 64))
    df = points(spark, x)
    leaves = na._forest(df.withColumnRenamed("cell_id", "id"), 6, 32, 5).groupBy("tree", "node", "part").count().toPandas()["count"]
    assert leaves.sum() == 6 * n and leaves.max() <= 64
    counts = []
    found = na.approximate_neighbors(df, k, distances=counts).toPandas()
    assert len(counts) == 3 and sum(counts) < 500 * n, counts
    assert (found.groupby("src").size() == k).all() and (found["src"] != found["dst"]).all()
    assert np.allclose(found["distance"], np.linalg.norm(x[found["src"]] - x[found["dst"]], axis=1))
    d = ((x[:, None, :32] - x[None, :, :32]) ** 2).sum(-1) + ((x[:, None, 32:] - x[None, :, 32:]) ** 2).sum(-1) if n <= 500 else (x**2).sum(1)[:, None] + (x**2).sum(1)[None] - 2 * x @ x.T
    np.fill_diagonal(d, np.inf)
    true = np.argpartition(d, k, axis=1)[:, :k]
    sets = found.groupby("src")["dst"].agg(set)
    share = np.mean([len(sets[i] & set(true[i])) / k for i in range(n)])
    assert share > 0.95, share
    assert abs(na.recall(spark.createDataFrame(found), df, k, sample=300) - share) < 0.05


def test_small_tables_and_copies(spark):
    x = np.vstack([np.zeros((90, 3)), np.random.default_rng(1).normal(size=(60, 3)) + 9])
    df = points(spark, x)
    found = na.approximate_neighbors(df, 3, leaf_rows=20)
    exact = exact_neighbors(df, 3)
    assert found.count() == exact.count() == 450
    assert found.where("src < 90").agg({"distance": "max"}).head()[0] == 0
    assert na.recall(found, df, 3) > 0.9
    assert na.approximate_neighbors(df.where("false"), 3).count() == 0
    assert na.approximate_neighbors(df.where("cell_id = 5"), 3).count() == 0


def test_many_sections_and_a_crowded_spot(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(2)
    sections, crowd = 10_000, 3000
    x = np.vstack([rng.random((sections * 2, 2)) * 50, 7 + 1e-3 * rng.random((crowd, 2)), rng.random((500, 2)) * 100])
    where = np.concatenate([np.repeat(np.arange(sections), 2), np.full(crowd + 500, 3)])
    df = spark.createDataFrame(pd.DataFrame({"cell_id": np.arange(len(x)), "vec": list(x), "section": where.astype(str)}))
    found = exact_neighbors(df, 3, group="section", block_rows=200).toPandas()
    counts = found.groupby("src").size()
    assert len(found[found["src"] < 6]) == 6 and (counts.loc[sections * 2 :] == 3).all()  # section 3 is the crowded one
    here = np.flatnonzero(where == 3)
    d = np.linalg.norm(x[here][:, None] - x[here][None], axis=2)
    np.fill_diagonal(d, np.inf)
    near = np.sort(d, axis=1)[:, :3]
    got = found[found["src"].isin(here)].sort_values(["src", "rank"])["distance"].to_numpy().reshape(-1, 3)
    assert np.allclose(got, near)
