"""Contrasts with absorbed factors against dense designs, and components."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from countloom.operators import contrasts, graph


def tables(spark, meta: pd.DataFrame, y: np.ndarray, stored: np.ndarray):
    i, j = np.nonzero(stored)
    rows = pd.DataFrame({"donor": meta["donor"].to_numpy()[i], "condition": meta["condition"].to_numpy()[i], "gene_id": j, "y": y[i, j]})
    return spark.createDataFrame(meta), spark.createDataFrame(rows), spark.range(y.shape[1]).select(F.col("id").alias("gene_id"))


def dense(x, y):
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    rest = y - x @ beta
    dof = len(y) - np.linalg.matrix_rank(x)
    return beta[0], np.sqrt(rest @ rest / dof * np.linalg.pinv(x.T @ x)[0, 0]), dof


def dummies(values):
    return (np.asarray(values)[:, None] == np.unique(values)[None, :]).astype(float)


def check(found, x, y):
    got = {r["gene_id"]: r for r in found.collect()}
    for j in range(y.shape[1]):
        effect, se, dof = dense(x, y[:, j])
        assert got[j]["residual_df"] == dof
        assert got[j]["effect"] == pytest.approx(effect, abs=1e-7) and got[j]["se"] == pytest.approx(se, abs=1e-6)


@pytest.fixture(scope="module")
def study_table():
    rng = np.random.default_rng(4)
    donors = np.repeat(np.arange(40), 2)
    meta = pd.DataFrame({"donor": [f"d{d}" for d in donors], "condition": ["A", "B"] * 40})
    meta["plate"] = [f"p{x}" for x in rng.integers(0, 25, 80)]
    meta["batch"] = [f"b{x}" for x in rng.integers(0, 3, 80)]
    meta["age"] = rng.normal(50, 10, 80)
    keep = np.ones(80, bool)
    keep[[3, 10, 57]] = False  # some donors are seen on one side only
    meta = meta[keep].reset_index(drop=True)
    y = rng.normal(size=(77, 4)) + 1.0
    stored = rng.random((77, 4)) < 0.7
    stored[:, 3] = False
    return meta, y * stored, stored


def test_donors_are_absorbed(spark, study_table):
    meta, y, stored = study_table
    samples, values, genes = tables(spark, meta, y, stored)
    x = np.column_stack([meta["condition"] == "A", meta["age"], dummies(meta["donor"]), dummies(meta["batch"])[:, 1:]]).astype(float)
    check(contrasts.ols_contrast(samples, values, genes, "A", True, ["age", "batch"]), x, y)


def test_two_factors_by_alternating_projections(spark, study_table):
    meta, y, stored = study_table
    samples, values, genes = tables(spark, meta, y, stored)
    x = np.column_stack([meta["condition"] == "A", meta["age"], dummies(meta["donor"]), dummies(meta["plate"])]).astype(float)
    check(contrasts.ols_contrast(samples, values, genes, "A", True, ["age", "plate"]), x, y)


def test_turns_over_tables_give_the_same_effects(spark):
    rng = np.random.default_rng(3)
    i, j = np.repeat(np.arange(4), 3), np.tile(np.arange(3), 4)
    y = rng.normal(size=12)
    samples = spark.createDataFrame(pd.DataFrame({"_f0": i.astype(str), "_f1": j.astype(str)}))
    values = spark.createDataFrame(pd.DataFrame({"k": 1, "_f0": i.astype(str), "_f1": j.astype(str), "_y": y})[:10])
    fits = []
    for most in (0, 100):
        absorber = contrasts.Absorber(samples, ["k"], local_pairs=most)
        e0, e1 = absorber.effects(values)
        a, b = ({r[f]: r[e] for r in d.collect()} for d, f, e in ((e0, "_f0", "_e0"), (e1, "_f1", "_e1")))
        fits.append(np.array([a[str(p)] + b[str(q)] for p, q in zip(i, j)]))
        assert absorber.rank() == 6
    x = np.column_stack([dummies(i), dummies(j)])
    y[10:] = 0
    assert np.allclose(fits[0], x @ np.linalg.lstsq(x, y, rcond=None)[0]) and np.allclose(fits[0], fits[1])


def test_unpaired_designs(spark, study_table):
    meta, y, stored = study_table
    samples, values, genes = tables(spark, meta, y, stored)
    x = np.column_stack([meta["condition"] == "A", np.ones(77), dummies(meta["batch"])[:, 1:]]).astype(float)
    check(contrasts.ols_contrast(samples, values, genes, "A", False, ["batch"]), x, y)
    x = np.column_stack([meta["condition"] == "A", dummies(meta["plate"])]).astype(float)
    check(contrasts.ols_contrast(samples, values, genes, "A", False, ["plate"]), x, y)


def test_twenty_thousand_paired_donors(spark):
    n = 20_000
    rng = np.random.default_rng(9)
    meta = pd.DataFrame({"donor": np.repeat([f"d{i}" for i in range(n)], 2), "condition": ["A", "B"] * n, "age": rng.normal(size=2 * n)})
    y = np.repeat(rng.normal(size=(n, 3)), 2, axis=0) + rng.normal(size=(2 * n, 3)) + 0.1 * (meta["condition"] == "A").to_numpy()[:, None]
    samples, values, genes = tables(spark, meta, y, np.ones(y.shape, bool))
    got = {r["gene_id"]: r for r in contrasts.ols_contrast(samples, values, genes, "A", True, ["age"]).collect()}
    within = lambda z: z - np.repeat((z[0::2] + z[1::2]) / 2, 2, axis=0)
    x = within(np.column_stack([(meta["condition"] == "A").to_numpy(float), meta["age"]]))
    for j in range(3):
        t = within(y[:, j : j + 1])[:, 0]
        beta, *_ = np.linalg.lstsq(x, t, rcond=None)
        se = np.sqrt(((t - x @ beta) ** 2).sum() / (2 * n - n - 2) * np.linalg.inv(x.T @ x)[0, 0])
        assert got[j]["effect"] == pytest.approx(beta[0], abs=1e-9) and got[j]["se"] == pytest.approx(se, rel=1e-7) and got[j]["residual_df"] == n - 2


def test_bad_designs_raise(spark, study_table):
    meta, y, stored = study_table
    samples, values, genes = tables(spark, meta, y, stored)
    with pytest.raises(ValueError, match="missing values"):
        contrasts.ols_contrast(samples.withColumn("batch", F.when(F.col("donor") != "d1", F.col("batch"))), values, genes, "A", True, ["batch"])
    with pytest.raises(ValueError, match="rank deficient"):
        contrasts.ols_contrast(samples.withColumn("twice", F.when(F.col("condition") == "A", 2.0).otherwise(0.0)), values, genes, "A", True, ["twice"])
    with pytest.raises(ValueError, match="residual degrees"):
        contrasts.ols_contrast(samples.where("donor = 'd0'"), values, genes, "A", True)


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3), (201, 200), (200, 201)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 160)}, 200: 200, 201: 200}
