"""Leave-one-donor-out folds and comparisons of result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from countloom.functions.moments import welch
from countloom.functions.ranking import benjamini_hochberg
from countloom.functions.special import t_two_sided
from countloom.operators import donor_stats as ds

FULL_MODEL = "__full_model__"
MIN_LOO_DONORS = 3


def _drop_one(n: Column, mean: Column, dev: Column, stored: Column, present: Column, x: Column):
    """Mean and squared deviation after removing one unit with value ``x`` (0 when not stored)."""
    value = F.coalesce(x, F.lit(0.0))
    left = n - 1
    emptied = (stored - F.when(x.isNotNull(), 1).otherwise(0)) <= 0
    mean1 = F.when(emptied, F.lit(0.0)).otherwise((n * mean - value) / left)
    dev1 = dev - (value - mean) * (value - mean) * n / left
    tiny = dev1 <= 1e-11 * (dev + n * mean * mean)
    dev1 = F.when(emptied | tiny, F.lit(0.0)).otherwise(dev1)
    return (
        F.when(present, left).otherwise(n), F.when(present, mean1).otherwise(mean), F.when(present, dev1).otherwise(dev)
    )


def leave_one_out(counts: DataFrame, cells: DataFrame, genes: DataFrame, a: str, b: str, pseudocount: float = 0.5, paired: bool = False, adjust: bool = True) -> DataFrame:
    """Full model plus one fold per donor, every gene in every fold.

    The moments of a fold are the full moments with one donor taken out, so
    counts are aggregated once, not once per fold. Paired folds test donor
    differences. Without ``adjust`` the columns p_value and fdr_q_value are left out.
    """
    sides = ds.donor_sides(cells, a, b)
    cpm = ds.donor_cpm(counts, cells, a, b)
    na, nb = ds.side_counts(cells, a, b)
    full = ds.two_sided_moments(cpm, genes, na, nb, a, b)
    per_donor = cpm.groupBy("gene_id", "donor").agg(
        F.max(F.when(F.col("condition") == a, F.col("cpm"))).alias("x_a"),
        F.max(F.when(F.col("condition") == b, F.col("cpm"))).alias("x_b"),
    )
    if paired:
        gap = F.coalesce("x_a", F.lit(0.0)) - F.coalesce("x_b", F.lit(0.0))
        diff = per_donor.withColumn("_gap", gap).groupBy("gene_id").agg(
            F.count(F.lit(1)).alias("_k"), F.avg("_gap").alias("_m"), F.var_pop("_gap").alias("_v")
        )
        full = full.join(diff, "gene_id", "left").select(
            *full.columns, ds.mean_with_zeros(F.col("_k"), F.col("_m"), F.col("n_a")).alias("mean_d"),
            ds.sq_dev_with_zeros(F.col("_k"), F.col("_m"), F.col("_v"), F.col("n_a")).alias("dev_d"),
            F.coalesce("_k", F.lit(0)).alias("stored_d"),
        )
    # The gene table may be a single small file: its rows are dealt out before each becomes one row per fold.
    full = full.repartition(int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")), "gene_id")
    nobody = F.struct(F.lit(FULL_MODEL).alias("donor"), F.lit(False).alias("in_a"), F.lit(False).alias("in_b"))
    donors = sides.agg(F.collect_list(F.struct("donor", "in_a", "in_b")).alias("l")).scalar()
    grid = full.select("*", F.inline(F.concat(F.array(nobody), donors))).join(per_donor, ["gene_id", "donor"], "left")
    n1a, ma, da = _drop_one(*(F.col(f"{c}_a") for c in ("n", "mean", "dev", "stored")), F.col("in_a"), F.col("x_a"))
    n1b, mb, db = _drop_one(*(F.col(f"{c}_b") for c in ("n", "mean", "dev", "stored")), F.col("in_b"), F.col("x_b"))
    fold = grid.withColumns({"fa": n1a, "ga": ma, "ha": da, "fb": n1b, "gb": mb, "hb": db})
    if paired:
        seen = F.when(F.col("x_a").isNotNull() | F.col("x_b").isNotNull(), gap)
        n1, m1, d1 = _drop_one(F.col("n_a"), F.col("mean_d"), F.col("dev_d"), F.col("stored_d"), F.col("in_a"), seen)
        ok = (n1 >= 2) & (d1 > 0)
        t, df = F.when(ok, m1 / F.sqrt(d1 / (n1 - 1) / n1)), F.when(ok, n1 - 1)
    else:
        t, df = welch(
            F.col("ga"), F.col("ha") / (F.col("fa") - 1), F.col("fa"), F.col("gb"), F.col("hb") / (F.col("fb") - 1), F.col("fb")
        )
    fits = (F.col("fa") >= 2) & (F.col("fb") >= 2)
    rows = fold.select(
        "gene_id", F.col("donor").alias("left_out_donor"),
        F.when(fits, F.log2((F.col("ga") + pseudocount) / (F.col("gb") + pseudocount))).alias("log2_fold_change"),
        F.when(fits, t).alias("t_stat"), F.when(fits, df).alias("df"), fits.alias("_fits"),
        (F.col("in_a").cast("int") + F.col("in_b").cast("int")).cast("long").alias("removed_sample_count"),
        (F.col("fa") + F.col("fb")).cast("long").alias("n_pseudobulk_samples"),
        F.when(~fits, F.lit("failed")).when(F.col("donor") == FULL_MODEL, F.lit("full_model")).otherwise(F.lit("estimated")).alias("fit_status"),
    )
    if not adjust:
        return rows.drop("_fits")
    rows = rows.withColumn("p_value", F.when(F.col("_fits"), F.coalesce(t_two_sided("t_stat", "df"), F.lit(1.0)))).drop("_fits")
    return benjamini_hochberg(rows, family=["left_out_donor"], missing="keep")


def leave_one_out_gate(cells: DataFrame, a: str, b: str, min_donors: int = MIN_LOO_DONORS) -> DataFrame:
    """A single ``skipped`` row when a condition has too few donors, else no row."""
    q = ds.sample_qualification(cells, a, b)
    need = max(3, min_donors)
    return q.where(F.least("n_donors_a", "n_donors_b") < need).select(
        F.lit(None).cast("string").alias("left_out_donor"), F.lit("skipped").alias("status"),
        F.format_string(f"needs at least {need} donors per condition; found %d and %d", "n_donors_a", "n_donors_b").alias("skip_reason"),
        F.lit(None).cast("double").alias("p_value"), F.lit(None).cast("double").alias("fdr_q_value"),
    )


def _finite(c: str) -> Column:
    return F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def _with_baseline(folds: DataFrame) -> DataFrame:
    """Fold rows with finite effect and q, next to the full-model values of their gene. One pass over the folds."""
    full = F.col("left_out_donor") == FULL_MODEL
    per_gene = W.partitionBy("gene_id")
    rows = folds.select(
        "gene_id", "left_out_donor", F.when(_finite("log2_fold_change"), F.col("log2_fold_change")).alias("_e"),
        F.when(_finite("fdr_q_value"), F.col("fdr_q_value")).alias("_q"),
    )
    return rows.withColumns({
        "_b": F.max(F.when(full, F.col("_e"))).over(per_gene), "_bq": F.max(F.when(full, F.col("_q"))).over(per_gene),
        "_has": F.max(full).over(per_gene), "_full": full,
    }).where("_has")


def leave_one_out_summary(folds: DataFrame, alpha: float = 0.05, n_requested: Column | None = None) -> DataFrame:
    """Per gene: coverage, direction consistency, range of effects and retention of the decision.

    ``n_requested`` is the number of folds asked for; by default the folds present are counted.
    """
    if n_requested is None:
        n_requested = folds.where(F.col("left_out_donor") != FULL_MODEL).agg(F.countDistinct("left_out_donor").alias("n")).scalar()
    rest = ~F.col("_full")
    e, q = F.when(rest, F.col("_e")), F.when(rest, F.col("_q"))
    out = _with_baseline(folds).groupBy("gene_id", "_b", "_bq").agg(
        F.count(e).alias("n_estimated_loo"), F.count_if(rest & (F.signum("_e") == F.signum("_b"))).alias("_same"), F.count_if(e == 0).alias("n_zero_loo"),
        F.min(e).alias("min_log2_fold_change"), F.max(e).alias("max_log2_fold_change"),
        F.median(e).alias("median_log2_fold_change"), F.count_if(q < alpha).alias("n_significant_loo"),
        F.count(q).alias("_nq"), F.count_if((q < alpha) == (F.col("_bq") < alpha)).alias("_kept"),
    )
    return out.select(
        "gene_id", F.col("_b").alias("baseline_log2_fold_change"), F.col("_bq").alias("baseline_fdr_q_value"),
        (F.col("_bq") < alpha).alias("baseline_significant_at_alpha"),
        "n_estimated_loo", "n_zero_loo", F.when(n_requested > 0, F.col("n_estimated_loo") / n_requested).alias("estimated_coverage"),
        F.when((F.col("n_estimated_loo") > 0) & (F.col("_b") != 0), F.col("_same") / F.col("n_estimated_loo")).alias("direction_consistency"),
        "min_log2_fold_change", "max_log2_fold_change", "median_log2_fold_change", "n_significant_loo",
        F.when((F.col("_nq") > 0) & F.col("_bq").isNotNull(), F.col("_kept") / F.col("_nq")).alias("significance_retention"),
        F.when(F.col("n_estimated_loo") > 0, "estimated").otherwise("not_estimated").alias("summary_status"),
    )


def donor_influence(folds: DataFrame, expected: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Per gene: the donor whose removal moves the effect most, flips, losses and an overall status.

    ``expected`` lists the donors that must have a fold; a fold that is absent
    counts as missing. Lists are as long as the donor list; ``zero_effect_donors``
    is also given where the full effect is zero or missing.
    """
    donors = expected.agg(F.sort_array(F.collect_set("donor")).alias("l")).scalar()
    defined = F.col("_b").isNotNull() & (F.col("_b") != 0)
    sign, base = F.signum("_e"), F.signum("_b")
    donor = F.when(~F.col("_full"), F.col("left_out_donor"))

    def named(cond):
        return F.sort_array(F.collect_list(F.when(cond, donor)))

    rest = ~F.col("_full")
    gap = F.abs(F.col("_e") - F.col("_b"))
    out = _with_baseline(folds).groupBy("gene_id", "_b", "_bq").agg(
        F.count_if(rest & F.col("_e").isNotNull()).alias("n_finite_loo_effects"), F.count_if(rest & defined & (sign == base)).alias("_same"),
        named(defined & (sign == -base)).alias("direction_flip_donors"), named(sign == 0).alias("zero_effect_donors"),
        named(F.col("_e").isNotNull()).alias("_seen"), named((F.col("_q") < alpha) != (F.col("_bq") < alpha)).alias("q_status_changed_donors"),
        F.count_if(rest & (F.col("_q") < alpha)).alias("n_loo_q_below_alpha"),
        F.min(F.when(rest & gap.isNotNull(), F.struct((-gap).alias("d"), F.col("left_out_donor").alias("who")))).alias("_top"),
    ).withColumn("missing_effect_donors", F.array_except(donors, "_seen"))
    flips, missing = F.size("direction_flip_donors") > 0, F.size("missing_effect_donors") > 0
    return out.select(
        "gene_id", F.col("_b").alias("full_log2_fold_change"), F.col("_bq").alias("full_fdr_q_value"),
        F.size(donors).cast("long").alias("expected_donor_folds"), "n_finite_loo_effects",
        F.when(defined, F.col("_same")).alias("n_same_sign_loo_effects"),
        "n_loo_q_below_alpha", "direction_flip_donors", "zero_effect_donors", "missing_effect_donors", "q_status_changed_donors",
        (-F.col("_top.d")).alias("max_abs_delta_lfc"), F.col("_top.who").alias("most_influential_donor"),
        F.when(~defined, "undefined_full_effect").when(flips & missing, "direction_flip_and_incomplete_coverage")
        .when(flips, "direction_flip").when(missing, "incomplete_coverage").when(F.size("zero_effect_donors") > 0, "zero_effect_nonstable")
        .otherwise("direction_stable").alias("direction_status"),
    )


def prioritise_candidates(influence: DataFrame, known: DataFrame, alpha: float = 0.05, min_abs_lfc: float = 1.0) -> DataFrame:
    """Significant, large effects outside a known list, the least stable first. ``known`` has a ``gene_id`` column."""
    hits = influence.where((F.col("full_fdr_q_value") < alpha) & (F.abs("full_log2_fold_change") >= min_abs_lfc)).join(
        known.select(F.upper(F.trim(F.col("gene_id").cast("string"))).alias("_known")),
        F.upper(F.col("gene_id").cast("string")) == F.col("_known"), "left_anti",
    )
    unstable = F.col("direction_status").isin(
        "direction_flip_and_incomplete_coverage", "direction_flip", "incomplete_coverage", "zero_effect_nonstable"
    )
    reason = F.when(unstable, F.col("direction_status")).when(
        F.size("q_status_changed_donors") > 0, "q_status_change"
    ).otherwise("direction_stable_without_q_status_change")
    rank = F.when(F.col("priority_reason").isin("direction_flip_and_incomplete_coverage", "direction_flip"), 0).when(
        F.col("priority_reason") == "incomplete_coverage", 1
    ).when(F.col("priority_reason") == "zero_effect_nonstable", 2).when(F.col("priority_reason") == "q_status_change", 3).otherwise(4)
    ranked = hits.withColumn("priority_reason", reason).withColumn("priority_class", rank.cast("long"))
    return ranked.orderBy("priority_class", F.desc("max_abs_delta_lfc"), "full_fdr_q_value", "gene_id")


def fold_integrity(folds: DataFrame, expected: DataFrame, genes: DataFrame, removed: int) -> DataFrame:
    """Per expected fold: is every gene there once, and was the right number of samples removed?"""
    n_genes = genes.agg(F.count(F.lit(1)).alias("n")).scalar()
    base = folds.where(F.col("left_out_donor") == FULL_MODEL).agg(F.max("n_pseudobulk_samples").alias("n")).scalar()
    known = genes.select("gene_id", F.lit(1).alias("_known"))
    is_full = F.col("left_out_donor") == FULL_MODEL
    want = F.when(is_full, F.lit(0)).otherwise(F.lit(removed))
    per_fold = folds.join(known, "gene_id", "left").groupBy("left_out_donor").agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("gene_id").alias("n_genes"), F.count("_known").alias("_k"),
        F.count_if(F.col("removed_sample_count") != want).alias("n_wrong_removed"),
        F.count_if(F.col("n_pseudobulk_samples") != base - want).alias("n_wrong_samples"),
    )
    listed = expected.select(F.col("donor").alias("left_out_donor")).distinct().unionByName(
        expected.sparkSession.range(1).select(F.lit(FULL_MODEL).alias("left_out_donor"))
    ).withColumn("_expected", F.lit(True))
    rows, distinct = F.coalesce("n_rows", F.lit(0)), F.coalesce("n_genes", F.lit(0))
    return listed.join(per_fold, "left_out_donor", "full_outer").select(
        "left_out_donor", rows.alias("n_rows"), distinct.alias("n_genes"),
        F.coalesce("n_wrong_removed", F.lit(0)).alias("n_wrong_removed"), F.coalesce("n_wrong_samples", F.lit(0)).alias("n_wrong_samples"),
        (F.coalesce("_expected", F.lit(False)) & (rows == distinct) & (F.coalesce("_k", F.lit(0)) == n_genes) & (rows == n_genes)
         & (F.coalesce("n_wrong_removed", F.lit(0)) == 0) & (F.coalesce("n_wrong_samples", F.lit(0)) == 0)).alias("complete"),
    )


def compare_de_tables(primary: DataFrame, branch: DataFrame, keys: list[str] = ("gene_id",), alpha: float = 0.05) -> DataFrame:
    """Full union of keys: direction status and change of the FDR decision; missing rows are kept and named."""
    def side(df, tag):
        return df.select(
            *keys, F.col("log2_fold_change").alias(f"{tag}_log2_fold_change"), F.col("fdr_q_value").alias(f"{tag}_fdr"),
            (F.col("status") if "status" in df.columns else F.lit("estimated")).alias(f"{tag}_row_status"),
        )

    j = side(primary, "primary").join(side(branch, "branch"), list(keys), "full_outer")
    a, b = F.col("primary_log2_fold_change"), F.col("branch_log2_fold_change")
    usable = (
        a.isNotNull() & b.isNotNull() & (F.col("primary_row_status") != "not_estimated") & (F.col("branch_row_status") != "not_estimated")
    )
    status = (
        F.when(F.col("primary_row_status").isNull(), "missing_in_primary").when(F.col("branch_row_status").isNull(), "missing_in_branch")
        .when(~usable, "not_estimable").when((a == 0) | (b == 0), "zero_in_either")
        .when(F.signum(a) == F.signum(b), "same_nonzero_direction").otherwise("opposite_direction")
    )
    hit_a, hit_b = F.col("primary_fdr") < alpha, F.col("branch_fdr") < alpha
    return j.select(
        *keys, status.alias("direction_status"), F.coalesce("primary_row_status", F.lit("missing")).alias("primary_row_status"),
        F.coalesce("branch_row_status", F.lit("missing")).alias("branch_row_status"), "primary_log2_fold_change",
        "branch_log2_fold_change", hit_a.alias("primary_significant"), hit_b.alias("branch_significant"),
        F.coalesce(hit_a != hit_b, F.lit(False)).alias("fdr_status_changed"), (b - a).alias("effect_change"),
    )


def table_equality(left: DataFrame, right: DataFrame, keys: list[str], metrics: list[str], rtol: float = 1e-9, atol: float = 1e-12) -> DataFrame:
    """Per metric: key differences, mask differences (null or NaN, +inf, -inf) and values outside tolerance."""
    def kind(c):
        return (
            F.when(c.isNull() | F.isnan(c), "nan").when(c == float("inf"), "positive_infinity")
            .when(c == float("-inf"), "negative_infinity").otherwise("finite")
        )

    def side(df, tag):
        pack = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias(tag)) for m in metrics])
        return df.select(*keys, F.inline(pack)).withColumn(f"_has_{tag}", F.lit(True))

    j = side(left, "l").join(side(right, "r"), [*keys, "metric"], "full_outer")
    both = F.col("_has_l").isNotNull() & F.col("_has_r").isNotNull()
    same = both & (kind(F.col("l")) == kind(F.col("r")))
    finite = same & (kind(F.col("l")) == "finite")
    gap = F.abs(F.col("l") - F.col("r"))
    close = gap <= F.greatest(rtol * F.greatest(F.abs("l"), F.abs("r")), F.lit(atol))
    out = j.groupBy("metric").agg(
        F.count(F.lit(1)).alias("n_keys"), F.count_if(F.col("_has_r").isNull()).alias("n_missing_right"),
        F.count_if(F.col("_has_l").isNull()).alias("n_missing_left"), F.count_if(both & ~same).alias("n_mask_mismatch"),
        F.count_if(finite).alias("n_finite_compared"), F.count_if(finite & ~close).alias("n_value_mismatch"),
        F.max(F.when(finite, gap)).alias("max_absolute_difference"),
    )
    bad = F.col("n_missing_right") + F.col("n_missing_left") + F.col("n_mask_mismatch") + F.col("n_value_mismatch")
    return out.withColumn("passed", bad == 0)


def paired_log_ratios(counts: DataFrame, cells: DataFrame, genes: DataFrame, a: str, b: str, target_sum: float = 1e4, offset: float = 0.5) -> DataFrame:
    """Mean over donors of log2 CP10K ratios, and the share of donors with a positive one.

    A donor that lacks counts under one condition makes every gene incomplete.
    """
    from countloom.operators.normalize import counts_per_million

    chosen = cells.where(F.col("condition").isin(a, b))
    scaled = counts_per_million(ds.pseudobulk(counts, chosen), ["donor", "condition"], target_sum=target_sum)
    wide = scaled.groupBy("donor", "gene_id").agg(
        F.max(F.when(F.col("condition") == a, F.col("cpm"))).alias("_a"), F.max(F.when(F.col("condition") == b, F.col("cpm"))).alias("_b")
    )
    ratio = F.log2((F.coalesce("_a", F.lit(0.0)) + offset) / (F.coalesce("_b", F.lit(0.0)) + offset))
    sums = wide.groupBy("gene_id").agg(F.sum(ratio).alias("_s"), F.count_if(ratio > 0).alias("_p"))
    seen = scaled.groupBy("donor").agg(F.countDistinct("condition").alias("_c"))
    n = chosen.agg(F.countDistinct("donor").alias("n")).scalar()
    n_complete = seen.agg(F.count_if(F.col("_c") == 2).alias("n")).scalar()
    complete = F.col("n_complete_donors") == F.col("expected_donors")
    return genes.select("gene_id").join(sums, "gene_id", "left").select(
        "gene_id", n.alias("expected_donors"), n_complete.alias("n_complete_donors"), "_s", "_p"
    ).select(
        "gene_id", "expected_donors", "n_complete_donors",
        F.when(complete, F.coalesce("_s", F.lit(0.0)) / F.col("expected_donors")).alias("mean_log_ratio"),
        F.when(complete, F.coalesce("_p", F.lit(0)) / F.col("expected_donors")).alias("positive_donor_fraction"),
    )


def marker_directions(results: DataFrame, markers: DataFrame, gene: str = "gene_name") -> DataFrame:
    """Sign check of prespecified markers, matched without regard to case. ``markers`` has a ``marker`` column."""
    found = results.select(F.upper(F.col(gene)).alias("_m"), F.col("log2_fold_change").alias("_e")).groupBy("_m").agg(
        F.count(F.lit(1)).alias("matches"), F.max("_e").alias("_e")
    )
    effect = F.when((F.col("matches") == 1) & _finite("_e"), F.col("_e"))
    status = (
        F.when(F.col("matches").isNull(), "missing_gene").when(F.col("matches") > 1, "ambiguous_gene_symbol")
        .when(effect.isNull(), "not_estimable").when(effect > 0, "positive_direction").otherwise("direction_not_positive")
    )
    return markers.select("marker", F.upper("marker").alias("_m")).join(found, "_m", "left").select(
        "marker", F.coalesce("matches", F.lit(0)).alias("matches"), status.alias("status"), effect.alias("log2_fold_change")
    )
