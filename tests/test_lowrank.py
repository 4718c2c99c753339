"""Principal components of large and odd tables against dense decompositions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from countloom.operators import embed, lowrank


def long_table(spark, x):
    i, j = np.nonzero(x)
    import pandas as pd

    return spark.createDataFrame(pd.DataFrame({"cell_id": i, "gene_id": j, "value": x[i, j]})), spark.range(len(x)).select(F.col("id").alias("cell_id"))


def scores_of(df):
    return np.array([r["vec"] for r in df.orderBy("cell_id").collect()])


@pytest.mark.parametrize("centre", [True, False])
def test_thirty_thousand_genes(spark, centre):
    rng = np.random.default_rng(3)
    n, g, programs = 5000, 30_000, 6
    x = np.zeros((n, g), np.float32)
    cells, genes = rng.integers(0, n, 250_000), rng.integers(0, g, 250_000)
    x[cells, genes] = rng.poisson(1.0, 250_000) + 1
    for p in range(programs):  # genes that are high together in some cells
        rows = rng.choice(n, 300 + 60 * p, replace=False)
        x[np.repeat(rows, 40), rng.integers(400 * p, 400 * p + 400, 40 * len(rows))] += 14 + 4 * p
    values, ids = long_table(spark, x)
    values = values.withColumn("value", F.col("value").cast("double"))
    k = 6
    scores, loadings, singular = lowrank.principal_components(values, ids, k, centre)
    dense = x - x.mean(0, dtype=np.float64).astype(np.float32) if centre else x
    gram = (dense @ dense.T).astype(np.float64)
    w, u = np.linalg.eigh(gram)
    w, u = w[::-1][:k], u[:, ::-1][:, :k]
    assert np.allclose(singular, np.sqrt(w), rtol=1e-4)
    got = scores_of(scores)
    assert np.allclose(np.abs((got / singular * u).sum(0)), 1.0, atol=1e-3)
    axes = {r["gene_id"]: r["vec"] for r in loadings.collect()}
    v = np.array(list(axes.values()))
    assert np.allclose(v.T @ v, np.eye(k), atol=1e-8)
    assert (v[np.abs(v).argmax(0), np.arange(k)] > 0).all()


def test_more_components_than_rank_are_zero(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(30, 2)) @ rng.normal(size=(2, 50))
    values, ids = long_table(spark, x)
    scores, loadings, singular = lowrank.principal_components(values, ids, 5, True)
    want = np.linalg.svd(x - x.mean(0), compute_uv=False)[:5]
    assert np.allclose(singular, want, atol=1e-8) and np.allclose(scores_of(scores)[:, 2:], 0, atol=1e-8)


def test_factor_tree_of_many_tasks(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(700, 4))
    rows = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "cell_id long, vec array<double>").repartition(70)
    r = lowrank.tall_factor(rows, 4)
    assert np.allclose(r.T @ r, x.T @ x)
    basis, width = lowrank.orthonormal(rows, 4, twice=True)
    q = scores_of(basis)
    assert width == 4 and np.allclose(q.T @ q, np.eye(4), atol=1e-12)


def test_cells_without_values_and_empty_tables(spark):
    values = spark.createDataFrame([(0, 5, 2.0), (1, 6, 3.0), (1, 5, 1.0)], "cell_id long, gene_id long, value double")
    cells = spark.range(4).select(F.col("id").alias("cell_id"))
    x = np.array([[2.0, 0], [1, 3], [0, 0], [0, 0]])
    got = scores_of(embed.pca_scores(values, cells, 2, True))
    assert np.allclose(got @ got.T, (x - x.mean(0)) @ (x - x.mean(0)).T)
    assert embed.pca_scores(values.where("false"), cells, 2).count() == 4
    assert embed.pca_scores(values, cells.where("false"), 2).count() == 0
