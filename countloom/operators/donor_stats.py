"""Donor-level statistics: pseudobulk, Welch and paired tests, design-adjusted contrasts, activity scores."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from countloom.functions.moments import mean_with_zeros, sq_dev_with_zeros, welch
from countloom.functions.ranking import benjamini_hochberg
from countloom.functions.special import normal_quantile, t_two_sided
from countloom.operators.contrasts import ols_contrast
from countloom.operators.markers import group_sums
from countloom.operators.normalize import counts_per_million


def pseudobulk(counts: DataFrame, cells: DataFrame, by: list[str] = ("donor", "condition")) -> DataFrame:
    """Integer sums per donor, condition and gene. Long overflow raises under ANSI arithmetic."""
    keys = cells.select("cell_id", *by)
    for c in by:
        keys = keys.where(F.col(c).isNotNull())
    return counts.join(keys, "cell_id").groupBy(*by, "gene_id").agg(F.sum("value").alias("value"))


def covariate_constancy(cells: DataFrame, covariates: list[str], by: list[str] = ("donor", "condition")) -> DataFrame:
    """Per covariate: donor-condition groups in which it varies or is missing."""
    groups = cells.groupBy(*by).agg(
        *[(F.min(c) != F.max(c)).alias(f"_v_{c}") for c in covariates],
        *[F.max(F.col(c).isNull()).alias(f"_m_{c}") for c in covariates],
    )
    one = groups.agg(
        F.count(F.lit(1)).alias("n_groups"),
        *[F.count_if(f"_v_{c}").alias(f"_v_{c}") for c in covariates],
        *[F.count_if(f"_m_{c}").alias(f"_m_{c}") for c in covariates],
    )
    rows = F.array(*[
        F.struct(F.lit(c).alias("covariate"), F.col(f"_v_{c}").alias("n_varying"), F.col(f"_m_{c}").alias("n_missing"))
        for c in covariates
    ])
    return one.select("n_groups", F.inline(rows)).withColumn("constant", (F.col("n_varying") == 0) & (F.col("n_missing") == 0))


def donor_sides(cells: DataFrame, a: str, b: str, donor="donor", condition="condition") -> DataFrame:
    """One row per donor: was it seen under each of the two conditions?"""
    return cells.where(F.col(condition).isin(a, b) & F.col(donor).isNotNull()).groupBy(F.col(donor).alias("donor")).agg(
        F.max(F.col(condition) == a).alias("in_a"), F.max(F.col(condition) == b).alias("in_b")
    )


def sample_qualification(cells: DataFrame, a: str, b: str, min_donors: int = 2, donor="donor", condition="condition") -> DataFrame:
    """Paired designs need identical donor sets, independent ones disjoint sets, both enough donors."""
    one = donor_sides(cells, a, b, donor, condition).agg(
        F.count_if("in_a").alias("n_donors_a"), F.count_if("in_b").alias("n_donors_b"),
        F.count_if(F.col("in_a") & F.col("in_b")).alias("n_donors_both"),
    )
    na, nb, both = F.col("n_donors_a"), F.col("n_donors_b"), F.col("n_donors_both")
    return one.withColumns({
        "paired_ok": (both >= min_donors) & (both == na) & (both == nb),
        "independent_ok": (both == 0) & (na >= min_donors) & (nb >= min_donors),
    })


def _side_moments(value: str, condition: str, a: str, b: str) -> list[Column]:
    out = []
    for side, level in (("a", a), ("b", b)):
        x = F.when(F.col(condition) == level, F.col(value))
        out += [F.count(x).alias(f"k_{side}"), F.avg(x).alias(f"m_{side}"), F.var_pop(x).alias(f"v_{side}")]
    return out


def two_sided_moments(samples: DataFrame, features: DataFrame, na: Column, nb: Column, a: str, b: str, key="gene_id", value="cpm", condition="condition") -> DataFrame:
    """Means and summed squared deviations per feature and condition, zeros merged in, absent features kept."""
    stored = samples.groupBy(key).agg(*_side_moments(value, condition, a, b))
    out = features.select(key).join(stored, key, "left").withColumns({"n_a": na, "n_b": nb})
    for s in "ab":
        k, m, v, n = (F.col(f"{c}_{s}") for c in "kmvn")
        out = out.withColumns({
            f"mean_{s}": mean_with_zeros(k, m, n), f"dev_{s}": sq_dev_with_zeros(k, m, v, n),
            f"stored_{s}": F.coalesce(k, F.lit(0)),
        })
    return out.select(key, "n_a", "n_b", *[f"{c}_{s}" for s in "ab" for c in ("mean", "dev", "stored")])


def side_counts(cells: DataFrame, a: str, b: str, donor: str = "donor", condition: str = "condition") -> tuple[Column, Column]:
    """Donors per condition, as two fields of one scalar subquery."""
    both = donor_sides(cells, a, b, donor, condition).agg(
        F.struct(F.count_if("in_a").cast("double").alias("a"), F.count_if("in_b").cast("double").alias("b")).alias("n")
    ).scalar()
    return both["a"], both["b"]


def donor_cpm(counts: DataFrame, cells: DataFrame, a: str, b: str, donor="donor", condition="condition", log=False) -> DataFrame:
    chosen = cells.where(F.col(condition).isin(a, b)).select(
        "cell_id", F.col(donor).alias("donor"), F.col(condition).alias("condition")
    )
    return counts_per_million(pseudobulk(counts, chosen), ["donor", "condition"], log=log)


def welch_de(counts: DataFrame, cells: DataFrame, genes: DataFrame, a: str, b: str, donor="donor", condition="condition", pseudocount: float = 0.5) -> DataFrame:
    """Welch comparison of donor CPM, one row per gene; an undefined test has p = 1."""
    return welch_cpm(donor_cpm(counts, cells, a, b, donor, condition), genes, *side_counts(cells, a, b, donor, condition), a, b, pseudocount)


def welch_cpm(cpm: DataFrame, genes: DataFrame, na: Column, nb: Column, a: str, b: str, pseudocount: float = 0.5) -> DataFrame:
    """``welch_de`` from CPM by donor, condition and gene, and the donors of each condition."""
    m = two_sided_moments(cpm, genes, na, nb, a, b)
    va, vb = F.col("dev_a") / (F.col("n_a") - 1), F.col("dev_b") / (F.col("n_b") - 1)
    t, df = welch(F.col("mean_a"), va, F.col("n_a"), F.col("mean_b"), vb, F.col("n_b"))
    rows = m.select(
        "gene_id", F.col("n_a").cast("long").alias("n_donors_a"), F.col("n_b").cast("long").alias("n_donors_b"),
        F.col("mean_a").alias("mean_condition_a"), F.col("mean_b").alias("mean_condition_b"),
        F.log2((F.col("mean_a") + pseudocount) / (F.col("mean_b") + pseudocount)).alias("log2_fold_change"),
        t.alias("t_stat"), df.alias("df"),
    ).withColumn("p_value", F.coalesce(t_two_sided("t_stat", "df"), F.lit(1.0)))
    return benjamini_hochberg(rows).withColumn(
        "significant", (F.col("fdr_q_value") < 0.05) & (F.abs("log2_fold_change") > 0.5)
    )


def descriptive_effect(values: DataFrame, cells: DataFrame, genes: DataFrame, a: str, b: str, condition="condition", pseudocount: float = 0.5) -> DataFrame:
    """Cell-level means and log ratio without inference: p and q stay null."""
    sums = group_sums(values, cells.where(F.col(condition).isin(a, b)), condition).groupBy("gene_id").agg(
        F.sum(F.when(F.col("level") == a, F.col("total"))).alias("_a"), F.sum(F.when(F.col("level") == b, F.col("total"))).alias("_b")
    )
    n_a = cells.agg(F.count_if(F.col(condition) == a).alias("n")).scalar()
    n_b = cells.agg(F.count_if(F.col(condition) == b).alias("n")).scalar()
    ma, mb = F.coalesce("_a", F.lit(0.0)) / n_a, F.coalesce("_b", F.lit(0.0)) / n_b
    none = F.lit(None).cast("double")
    return genes.select("gene_id").join(sums, "gene_id", "left").select(
        "gene_id", ma.alias("mean_condition_a"), mb.alias("mean_condition_b"),
        F.log2((ma + pseudocount) / (mb + pseudocount)).alias("log2_fold_change"),
        none.alias("p_value"), none.alias("fdr_q_value"), F.lit("not_estimated").alias("status"),
    )


def differential_abundance(cells: DataFrame, a: str, b: str, state: str, donor="donor", condition="condition") -> DataFrame:
    """Welch comparison of the share of each state among a donor's cells."""
    rows = cells.where(F.col(condition).isNotNull() & F.col(donor).isNotNull() & F.col(state).isNotNull()).select(
        F.col(donor).alias("donor"), F.col(condition).alias("condition"), F.col(state).cast("string").alias("state")
    )
    per_state = rows.groupBy("donor", "condition", "state").agg(F.count(F.lit(1)).alias("value"))
    shares = counts_per_million(per_state, ["donor", "condition"], target_sum=1.0).where(F.col("condition").isin(a, b))
    na, nb = side_counts(cells, a, b, donor, condition)
    m = two_sided_moments(shares, per_state.select("state").distinct(), na, nb, a, b, key="state")
    va, vb = F.col("dev_a") / (F.col("n_a") - 1), F.col("dev_b") / (F.col("n_b") - 1)
    t, df = welch(F.col("mean_a"), va, F.col("n_a"), F.col("mean_b"), vb, F.col("n_b"))
    ratio = F.log2((F.col("mean_a") + 1e-8) / (F.col("mean_b") + 1e-8))
    out = m.select(
        "state", F.col("mean_a").alias("mean_prop_a"), F.col("mean_b").alias("mean_prop_b"), ratio.alias("log2_ratio"),
        t.alias("t_stat"), df.alias("df"), F.when(ratio > 0, F.lit(a)).otherwise(F.lit(b)).alias("enriched_in"),
    ).withColumn("p_value", F.coalesce(t_two_sided("t_stat", "df"), F.lit(1.0)))
    return benjamini_hochberg(out)


def safe_test(rows: DataFrame, keys: list[str], value: str, a: str, b: str, paired: bool, donor="donor", condition="condition") -> DataFrame:
    """Two-sided test per key on one value per donor and condition; null when it cannot be estimated.

    Paired tests use donors seen on both sides; a key without one is returned
    with n = 0. A spread below 1e-12, a side
    with fewer than two values or any infinite value gives null.
    """
    return safe_tests(rows, keys, [value], a, b, paired, donor, condition).select(*keys, f"{value}.*")


def safe_tests(rows: DataFrame, keys: list[str], values: list[str], a: str, b: str, paired: bool, donor="donor", condition="condition") -> DataFrame:
    """``safe_test`` of several values in one pass: the keys, and a struct of results named as each value."""
    def usable(x):
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))

    parts = {value: f"_{i}" for i, value in enumerate(values)}  # prefix of a value's columns
    if paired:
        wide = rows.groupBy(*keys, donor).agg(*[
            F.max(F.when(F.col(condition) == level, F.col(value))).alias(f"{c}_{side}") for value, c in parts.items() for side, level in (("x", a), ("y", b))
        ]).withColumns({f"{c}_d": F.col(f"{c}_x") - F.col(f"{c}_y") for c in parts.values()})
        aggs = []
        for c in parts.values():
            d = F.col(f"{c}_d")
            both = d.isNotNull()
            fine = ~F.isnan(d) & (F.abs(d) != float("inf"))
            aggs += [
                F.count(d).alias(f"{c}_n_a"), F.count_if(both & ~fine).alias(f"{c}_bad"), F.avg(F.when(both, F.col(f"{c}_x"))).alias(f"{c}_mean_a"),
                F.avg(F.when(both, F.col(f"{c}_y"))).alias(f"{c}_mean_b"), F.avg(d).alias(f"{c}_m"), F.var_samp(d).alias(f"{c}_v"), (F.max(d) - F.min(d)).alias(f"{c}_range"),
            ]
        m = wide.groupBy(*keys).agg(*aggs).withColumns({f"{c}_n_b": F.col(f"{c}_n_a") for c in parts.values()})
    else:
        aggs = []
        for value, c in parts.items():
            aggs.append(F.count_if(~usable(F.col(value))).alias(f"{c}_bad"))
            for side, level in (("a", a), ("b", b)):
                y = F.when(F.col(condition) == level, F.col(value))
                aggs += [
                    F.count(y).alias(f"{c}_n_{side}"), F.avg(y).alias(f"{c}_mean_{side}"), F.var_samp(y).alias(f"{c}_v_{side}"),
                    (F.max(y) - F.min(y)).alias(f"{c}_r_{side}"),
                ]
        m = rows.where(F.col(condition).isin(a, b)).groupBy(*keys).agg(*aggs)

    def tested(c):
        x = {name: F.col(f"{c}_{name}") for name in ("n_a", "n_b", "mean_a", "mean_b", "bad")}
        if paired:
            ok = (x["n_a"] >= 2) & (x["bad"] == 0) & (F.col(f"{c}_range") > 1e-12)
            t, df = F.col(f"{c}_m") / F.sqrt(F.col(f"{c}_v") / x["n_a"]), (x["n_a"] - 1).cast("double")
        else:
            ok = (x["n_a"] >= 2) & (x["n_b"] >= 2) & (x["bad"] == 0) & (F.col(f"{c}_r_a") > 1e-12) & (F.col(f"{c}_r_b") > 1e-12)
            t, df = welch(x["mean_a"], F.col(f"{c}_v_a"), x["n_a"], x["mean_b"], F.col(f"{c}_v_b"), x["n_b"])
        return [F.when(ok, t).alias(f"{c}_t_stat"), F.when(ok, df).alias(f"{c}_df")]

    sides = ["n_a", "n_b", "mean_a", "mean_b"]
    out = m.select(*keys, *[F.col(f"{c}_{name}") for c in parts.values() for name in sides], *[x for c in parts.values() for x in tested(c)])
    out = out.withColumns({f"{c}_p_value": t_two_sided(f"{c}_t_stat", f"{c}_df") for c in parts.values()})
    return out.select(*keys, *[
        F.struct(*[F.col(f"{c}_{name}").alias(name) for name in (*sides, "t_stat", "df", "p_value")]).alias(value) for value, c in parts.items()
    ])


def pseudobulk_de(counts: DataFrame, cells: DataFrame, genes: DataFrame, a: str, b: str, paired=False, covariates: list[str] = (), alpha: float = 0.05) -> DataFrame:
    """Design-adjusted log2 effect on log1p CPM, with normal intervals and nullable significance flags."""
    chosen = cells.where(F.col("condition").isin(a, b))
    samples = chosen.groupBy("donor", "condition").agg(
        F.count(F.lit(1)).alias("n_cells"), *[F.min(c).alias(c) for c in covariates]
    )
    logs = donor_cpm(counts, cells, a, b, log=True)
    fit = ols_contrast(samples, logs.withColumnRenamed("cpm", "y"), genes, a, paired, covariates, alpha=alpha)
    base = logs.groupBy("gene_id").agg(F.sum(F.expm1("cpm")).alias("_s"))
    n = samples.agg(F.count(F.lit(1)).alias("n")).scalar()
    z, ln2 = normal_quantile(1 - alpha / 2), math.log(2.0)
    out = fit.join(base, "gene_id", "left").select(
        "gene_id", (F.coalesce("_s", F.lit(0.0)) / n).alias("base_mean"), (F.col("effect") / ln2).alias("log2_fold_change"),
        (F.col("se") / ln2).alias("lfc_se"), "statistic", "p_value", "status",
    ).withColumns({
        "ci_low": F.col("log2_fold_change") - z * F.col("lfc_se"), "ci_high": F.col("log2_fold_change") + z * F.col("lfc_se"),
    })
    return benjamini_hochberg(out, missing="keep").withColumns({
        "significant_at_alpha": F.col("fdr_q_value") < alpha, "significant_fdr05": F.col("fdr_q_value") < 0.05,
    })


def result_status(results: DataFrame, supported: Column, tested: Column | None = None) -> DataFrame:
    """One row: features tested and supported, and the overall status."""
    tested = F.lit(True) if tested is None else tested
    one = results.agg(
        F.count_if(tested).alias("n_features_tested"), F.count_if(tested & F.coalesce(supported, F.lit(False))).alias("n_features_supported")
    )
    return one.withColumn(
        "status",
        F.when(F.col("n_features_supported") > 0, "estimated_supported")
        .when(F.col("n_features_tested") > 0, "estimated_inconclusive").otherwise("not_estimable"),
    )


def check_network(network: DataFrame, species: str | None = None) -> DataFrame:
    """One row: edges, edges without a source or target, weights that are no finite number, edges of another species."""
    empty = lambda c: F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")
    weight = F.try_to_number(F.lit("0"), F.lit("0")).cast("double") if "weight" not in network.columns else F.col("weight").try_cast("double")
    bad = weight.isNull() | F.isnan(weight) | (F.abs(weight) == float("inf"))
    other = F.lit(False)
    if species is not None and "species" in network.columns:
        other = ~F.lower(F.trim(F.coalesce(F.col("species").cast("string"), F.lit("")))).eqNullSafe(species.strip().lower())
    one = network.agg(
        F.count(F.lit(1)).alias("n_edges"), F.count_if(empty("source") | empty("target")).alias("n_missing_ends"),
        F.count_if(bad).alias("n_bad_weights"), F.count_if(other).alias("n_other_species"),
    )
    return one.withColumn("valid", F.col("n_missing_ends") + F.col("n_bad_weights") + F.col("n_other_species") == 0)


def prepare_network(network: DataFrame, genes: DataFrame, tmin: int = 1, key="gene_id", strict: bool = False, species: str | None = None) -> DataFrame:
    """Edges with finite weight (default 1), non-empty ends, measured targets and enough targets per source.

    Other edges are left out; ``check_network`` counts them, and ``strict`` raises when there are any.
    """
    if strict:
        found = check_network(network, species).head()
        if not found["valid"]:
            raise ValueError(f"Network has invalid edges: {found.asDict()}")
    w = F.col("weight").try_cast("double") if "weight" in network.columns else F.lit(1.0)
    source, target = F.trim(F.col("source").cast("string")), F.col("target")
    clean = network.select(source.alias("source"), target.alias("target"), w.alias("weight")).where(
        (F.col("source") != "") & F.col("target").isNotNull() & (F.trim(F.col("target").cast("string")) != "")
        & F.col("weight").isNotNull() & ~F.isnan("weight") & (F.abs("weight") != float("inf"))
    )
    measured = clean.join(genes.select(F.col(key).alias("target")), "target", "left_semi")
    kept = measured.groupBy("source").agg(F.countDistinct("target").alias("_n")).where(F.col("_n") >= tmin)
    return measured.join(kept, "source", "left_semi").select("source", "target", "weight")


def activity_scores(samples: DataFrame, network: DataFrame, genes: DataFrame, by: list[str] = ("donor", "condition"), value="cpm") -> DataFrame:
    """Slope of expression on network weights over all genes, per sample and source.

    Weights are zero outside a source's targets, so the closed form needs only
    sums over stored values and edges.
    """
    n = genes.agg(F.count(F.lit(1)).cast("double").alias("n")).scalar()
    edges = network.groupBy("source", "target").agg(F.sum("weight").alias("weight"))
    sources = edges.groupBy("source").agg(F.sum("weight").alias("sw"), F.sum(F.col("weight") ** 2).alias("sww"))
    listed = sources.agg(F.collect_list(F.struct("source", "sw", "sww")).alias("l")).scalar()
    per_sample = samples.groupBy(*by).agg(F.sum(value).alias("_sy"), F.sum(F.col(value) ** 2).alias("_syy"))
    cross = samples.join(edges, F.col("gene_id") == F.col("target")).groupBy(*by, "source").agg(
        F.sum(F.col("weight") * F.col(value)).alias("_swy")
    )
    grid = per_sample.select(*by, "_sy", "_syy", F.inline(listed)).join(cross, [*by, "source"], "left")
    sxy = F.coalesce("_swy", F.lit(0.0)) - F.col("sw") * F.col("_sy") / n
    sxx, syy = F.col("sww") - F.col("sw") ** 2 / n, F.col("_syy") - F.col("_sy") ** 2 / n
    out = grid.select(
        *by, "source", F.when(sxx > 0, sxy / sxx).alias("slope"),
        F.when((sxx > 0) & (syy > 0), sxy / F.sqrt(sxx * syy)).alias("_r"), (n - 2).alias("df"),
    )
    return out.select(
        *by, "source", "slope", F.when(F.abs("_r") < 1, F.col("_r") * F.sqrt(F.col("df") / (1 - F.col("_r") ** 2))).alias("activity"), "df",
    ).withColumn("p_value", t_two_sided("activity", "df"))
