import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from countloom.functions import ranking, tails


def test_student_tail_closed_forms():
    t = np.array([0.0, 0.3, 1.0, 12.7062, 100.0])
    cauchy = 2 * (0.5 - np.arctan(t) / np.pi)
    assert np.allclose(tails.t_two_sided_np(t, np.ones(5)), cauchy, atol=1e-13)
    two = 1 - t / np.sqrt(2 + t * t)
    assert np.allclose(tails.t_two_sided_np(t, np.full(5, 2.0)), two, atol=1e-13)
    assert tails.t_two_sided_np([2.228138852], [10])[0] == pytest.approx(0.05, abs=1e-9)
    big = tails.t_two_sided_np([1.959963984540054], [1e7])[0]
    assert big == pytest.approx(0.05, abs=1e-6)
    assert math.isnan(tails.t_two_sided_np([np.nan], [3])[0]) and tails.t_two_sided_np([np.inf], [3])[0] == 0


def test_quantiles_and_normal():
    assert tails.t_quantile(0.975, 10) == pytest.approx(2.228138851964939, rel=1e-9)
    assert tails.normal_quantile(0.975) == pytest.approx(1.959963984540054)
    assert tails.normal_two_sided_np([1.959963984540054, -1.959963984540054]) == pytest.approx([0.05, 0.05])


def test_hypergeometric_tail_exact():
    for k, m, s, n in [(1, 20, 5, 4), (3, 50, 10, 12), (0, 9, 3, 2), (5, 9, 4, 6)]:
        exact = sum(math.comb(s, j) * math.comb(m - s, n - j) for j in range(k, min(s, n) + 1)) / math.comb(m, n)
        assert tails.hypergeom_tail_np([k], [m], [s], [n])[0] == pytest.approx(exact, abs=1e-12)


def _bh(p):
    order, out, run, m = np.argsort(p, kind="stable"), np.empty(len(p)), 1.0, len(p)
    for i in range(m - 1, -1, -1):
        run = min(run, p[order[i]] * m / (i + 1))
        out[order[i]] = run
    return out


def test_bh_policies(spark):
    raw = [0.01, 0.04, None, float("nan"), float("inf"), float("-inf"), 1.5, -0.2, 0.04, 0.03]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(raw)], "i int, p double")
    clean = [1.0 if p is None or p != p or p > 1 else max(p, 0.0) for p in raw]
    got = {r["i"]: r["q"] for r in ranking.benjamini_hochberg(df, "p", "q").collect()}
    assert [got[i] for i in range(10)] == pytest.approx(list(_bh(np.array(clean))))
    kept = {r["i"]: r["q"] for r in ranking.benjamini_hochberg(df, "p", "q", missing="keep").collect()}
    finite = [i for i, p in enumerate(raw) if p is not None and math.isfinite(p)]
    want = _bh(np.clip([raw[i] for i in finite], 0, 1))
    assert [kept[i] for i in finite] == pytest.approx(list(want))
    assert all(kept[i] is None for i in range(10) if i not in finite)


def test_bh_computes_p_once(spark):
    @F.pandas_udf("double")
    def noisy(i: pd.Series) -> pd.Series:
        return i / 1000 * (1 + 1e-13 * np.random.default_rng().random(len(i)))

    df = spark.range(1, 801).select("id", noisy.asNondeterministic()("id").alias("p_value"))
    out = ranking.benjamini_hochberg(df).toPandas().sort_values("id")
    assert len(out) == 800 and out["fdr_q_value"].notna().all()
    assert np.allclose(out["fdr_q_value"], 0.8)


def test_bh_empty_and_families(spark):
    empty = spark.createDataFrame([], "f string, p double")
    assert ranking.benjamini_hochberg(empty, "p", "q", ["f"]).count() == 0
    rng = np.random.default_rng(1)
    p = np.concatenate([rng.random(300), np.full(200, 1.0), 10.0 ** -rng.integers(1, 300, 50)])
    data = [(f, i, float(x)) for f in "ab" for i, x in enumerate(p if f == "a" else p[::2])]
    out = ranking.benjamini_hochberg(spark.createDataFrame(data, "f string, i int, p double"), "p", "q", ["f"]).toPandas()
    for f, part in out.groupby("f"):
        part = part.sort_values("i")
        assert np.allclose(part["q"], _bh(part["p"].to_numpy()), rtol=1e-12)


def test_ranks_and_medians(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=401), np.zeros(100), rng.integers(0, 4, 200)])
    df = spark.createDataFrame([("g", float(v)) for v in x], "g string, x double")
    pos = {r["x"]: r["n_below"] for r in ranking.tie_positions(df, ["g"], "x").collect()}
    assert all(pos[float(v)] == int((x < v).sum()) for v in x)
    assert ranking.exact_median(df, ["g"], "x", "m").first()["m"] == np.median(x)
    even = df.where(F.col("x") > 0.5)
    assert ranking.exact_median(even, [], "x", "m").first()["m"] == np.median(x[x > 0.5])


def test_samples_are_exact_and_whole(spark):
    df = spark.range(1000).select(F.col("id").alias("cell_id"), (F.col("id") % 3).alias("g"))
    assert ranking.hash_sample(df, "cell_id", 5, n=123).distinct().count() == 123
    assert ranking.hash_sample(df, "cell_id", 5, n=5000).count() == 1000
    per = {r["g"]: r["count"] for r in ranking.hash_sample(df, "cell_id", 5, fraction=0.8, groups=["g"]).groupBy("g").count().collect()}
    assert per == {0: 267, 1: 266, 2: 266}
    ranks = [r["r"] for r in ranking.hash_shuffle_rank(df, ["g"], "cell_id", 3, "r").where("g = 1").collect()]
    assert sorted(ranks) == list(range(1, 334))
