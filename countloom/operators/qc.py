"""Quality control and study audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from countloom.functions.ranking import exact_median
from countloom.operators.checks import identity_missing
from countloom.session import cut_lineage

# The four dispositions, in report order.
REASONS = ["retained", "low_gene_count", "high_mito_percentage", "low_gene_count_and_high_mito_percentage"]
# Fixed value: scale of the median absolute deviation under a normal law.
MAD_SCALE = 1.4826
# Labels that mean "not annotated".
UNKNOWN_LABELS = ["", "unknown", "unassigned", "unclassifiable", "undefined", "none", "nan", "na", "n/a"]


def cell_metrics(counts: DataFrame, cells: DataFrame, genes: DataFrame) -> DataFrame:
    """Genes detected, total counts and mitochondrial percentage of every cell, empty cells included.

    The percentage comes from a ``percent_mito`` column of the cells, else from
    a boolean ``mt`` gene column, else from gene names that start with ``mt-``.
    """
    if "percent_mito" in cells.columns:
        is_mt = None
    elif "mt" in genes.columns:
        is_mt = F.col("mt")
    else:
        is_mt = F.lower("gene_name").startswith("mt-")
    stored = counts
    if is_mt is not None:
        stored = counts.join(genes.select("gene_id", is_mt.alias("_mt")), "gene_id", "left")
    else:
        stored = counts.withColumn("_mt", F.lit(False))
    sums = stored.groupBy("cell_id").agg(
        F.count_if(F.col("value") > 0).alias("_n"), F.sum("value").alias("_t"),
        F.sum(F.when(F.col("_mt"), F.col("value")).otherwise(F.lit(0))).alias("_m"),
    )
    total = F.coalesce("_t", F.lit(0))
    joined = cells.join(sums, "cell_id", "left")
    if is_mt is None:
        mito, available = F.col("percent_mito").cast("double"), F.lit(True)
    else:
        has_mt = genes.agg(F.coalesce(F.max(is_mt), F.lit(False)).alias("h")).scalar()
        mito = F.when(has_mt, F.when(total > 0, F.col("_m") * 100.0 / total).otherwise(F.lit(0.0)))
        available = has_mt & (total > 0)
    keep = [c for c in cells.columns if c != "percent_mito"]
    return joined.select(
        *keep, F.coalesce("_n", F.lit(0)).alias("n_genes"), total.alias("total_counts"),
        mito.alias("mito_pct"), available.alias("mito_pct_available"),
    )


def disposition(metrics: DataFrame, min_genes: int | Column, max_mito_pct: float | Column) -> DataFrame:
    """Threshold result of every cell; flags describe the thresholds and are no damage diagnosis."""
    low = F.col("n_genes") < min_genes
    high = F.coalesce(F.col("mito_pct") > max_mito_pct, F.lit(False))
    reason = (
        F.when(low & high, REASONS[3]).when(high, REASONS[2]).when(low, REASONS[1]).otherwise(REASONS[0])
    )
    return metrics.select(
        *[c for c in metrics.columns if c != "mito_pct"],
        F.when(F.col("mito_pct_available"), F.col("mito_pct")).alias("mito_pct"),
        low.alias("low_gene_flag"), high.alias("high_mito_flag"), (~(low | high)).alias("retained"), reason.alias("reason"),
    )


def retention_summary(dispositions: DataFrame) -> DataFrame:
    """Cells per reason, zero counts included, and the share of all cells."""
    one = dispositions.agg(
        F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col("reason") == r).alias(f"_{i}") for i, r in enumerate(REASONS)]
    )
    rows = F.array(*[F.struct(F.lit(r).alias("reason"), F.col(f"_{i}").alias("n_cells")) for i, r in enumerate(REASONS)])
    return one.select("_n", F.inline(rows)).select(
        "reason", "n_cells",
        F.when(F.col("_n") > 0, F.col("n_cells") / F.col("_n")).otherwise(F.lit(0.0)).alias("fraction"),
    )


def review_features(counts: DataFrame, dispositions: DataFrame, genes: DataFrame) -> DataFrame:
    """Per reason and gene: cells, detections, summed counts, detection share and mean."""
    sums = counts.join(dispositions.select("cell_id", "reason"), "cell_id").groupBy("reason", "gene_id").agg(
        F.count_if(F.col("value") > 0).alias("_d"), F.sum("value").alias("_t")
    )
    sizes = retention_summary(dispositions).select("reason", "n_cells")
    grid = genes.select("gene_id", "gene_index", F.explode(F.array(*[F.lit(r) for r in REASONS])).alias("reason"))
    detected, total = F.coalesce("_d", F.lit(0)), F.coalesce("_t", F.lit(0))
    some = F.col("n_cells") > 0
    return grid.join(sizes, "reason").join(sums, ["reason", "gene_id"], "left").select(
        "reason", "gene_id", "gene_index", "n_cells", detected.alias("n_detected"), total.alias("total_counts"),
        F.when(some, detected / F.col("n_cells")).alias("detection_fraction"),
        F.when(some, total / F.col("n_cells")).alias("mean_raw_count"),
        F.when(some, F.lit("described")).otherwise(F.lit("no_cells")).alias("status"),
    )


def dataset_audit(cells: DataFrame, genes: DataFrame, condition="condition", donor="donor", batch="batch") -> DataFrame:
    """One row: size of the study, replication, pairing and batches."""
    per_condition = cells.where(F.col(condition).isNotNull()).groupBy(condition).agg(F.countDistinct(donor).alias("n"))
    per_donor = cells.where(F.col(donor).isNotNull()).groupBy(donor).agg(
        F.coalesce(F.min(condition) != F.max(condition), F.lit(False)).alias("both")
    )
    batches = cells.where(F.col(batch).isNotNull()).select(batch).distinct()
    names = F.concat_ws(", ", F.sort_array(F.collect_list(condition)))
    return cells.agg(
        F.count(F.lit(1)).alias("n_cells"), (F.count_if(identity_missing(F.col(donor))) == 0).alias("donor_metadata_complete"),
    ).select(
        "n_cells",
        genes.agg(F.count(F.lit(1)).alias("n")).scalar().alias("n_genes"),
        per_condition.agg(names.alias("s")).scalar().alias("conditions"),
        F.coalesce(per_condition.agg(F.min("n").alias("n")).scalar(), F.lit(0)).alias("min_replicates_per_condition"),
        per_donor.agg(F.count(F.lit(1)).alias("n")).scalar().alias("total_donors"),
        F.coalesce(per_donor.agg(F.max("both").alias("n")).scalar(), F.lit(False)).alias("paired_donors_observed"),
        batches.agg(F.count(F.lit(1)).alias("n")).scalar().alias("n_batches"),
        "donor_metadata_complete",
    ).withColumns({
        "biological_replication_sufficient": (F.col("min_replicates_per_condition") >= 2) & F.col("donor_metadata_complete"),
        "batch_effect_possible": F.col("n_batches") > 1,
    })


def donors_per_condition(cells: DataFrame, condition="condition", donor="donor") -> DataFrame:
    return cells.where(F.col(condition).isNotNull()).groupBy(condition).agg(
        F.count(F.lit(1)).alias("n_cells"), F.countDistinct(donor).alias("n_donors")
    )


def _centre(metrics: DataFrame, value: Column, name: str) -> tuple[Column, Column]:
    rows = metrics.select(value.cast("double").alias("_v")).where(F.col("_v").isNotNull())
    middle = exact_median(rows, [], "_v", "m").scalar()
    spread = exact_median(rows.select(F.abs(F.col("_v") - middle).alias("_d")), [], "_d", "m").scalar()
    return middle, spread


def mad_thresholds(metrics: DataFrame, multipliers: list[float] = (3,)) -> DataFrame:
    """Thresholds at k scaled median absolute deviations, one row per multiplier.

    Medians are exact. Without a mitochondrial measure the percentage limit is 100.
    The two measured columns are checkpointed, as four medians read them.
    """
    metrics = cut_lineage(metrics.select("n_genes", "mito_pct"))
    g_mid, g_mad = _centre(metrics, F.log1p(F.col("n_genes")), "g")
    m_mid, m_mad = _centre(metrics, F.col("mito_pct"), "m")
    one = metrics.sparkSession.range(1).select(
        g_mid.alias("_gm"), g_mad.alias("_gd"), m_mid.alias("_mm"), m_mad.alias("_md"),
        F.explode(F.array(*[F.lit(float(m)) for m in multipliers])).alias("multiplier"),
    )
    lower = F.col("_gm") - F.col("multiplier") * MAD_SCALE * F.col("_gd")
    upper = F.col("_mm") + F.col("multiplier") * MAD_SCALE * F.col("_md")
    return one.select(
        "multiplier", F.greatest(F.lit(1), F.floor(F.expm1(lower))).cast("long").alias("min_genes"),
        F.when(upper.isNotNull(), F.least(F.lit(100.0), F.greatest(F.lit(5.0), upper))).otherwise(F.lit(100.0)).alias("max_mito_pct"),
    )


def branch_plan(metrics: DataFrame, multipliers: list[float] = (2, 3, 4), primary: float = 3) -> DataFrame:
    """Thresholds, predicted retention and status of each perturbation of the primary rule."""
    metrics = cut_lineage(metrics.select("n_genes", "mito_pct"))
    limits = cut_lineage(mad_thresholds(metrics, list(multipliers)))
    packed = limits.agg(F.collect_list(F.struct("multiplier", "min_genes", "max_mito_pct")).alias("l")).scalar()
    kept = (F.col("n_genes") >= F.col("min_genes")) & F.coalesce(F.col("mito_pct") <= F.col("max_mito_pct"), F.lit(True))
    spread = metrics.select("n_genes", "mito_pct", F.inline(packed))
    counted = spread.groupBy("multiplier", "min_genes", "max_mito_pct").agg(F.count_if(kept).alias("predicted_retained_cells"))
    is_primary = F.col("multiplier") == float(primary)
    main = limits.where(is_primary).select(F.struct("min_genes", "max_mito_pct").alias("s")).scalar()
    return counted.withColumn(
        "status",
        F.when(F.col("predicted_retained_cells") < 3, F.lit("not_estimable"))
        .when(~is_primary & (F.struct("min_genes", "max_mito_pct") == main), F.lit("duplicate_primary"))
        .otherwise(F.lit("planned")),
    )


def batch_confounding(cells: DataFrame, batch="batch", condition="condition") -> DataFrame:
    """Is every batch tied to exactly one condition while several conditions exist?"""
    known = cells.where(F.col(batch).isNotNull() & F.col(condition).isNotNull())
    per_batch = known.groupBy(batch).agg(F.min(condition).alias("lo"), F.max(condition).alias("hi"))
    return per_batch.agg(
        F.count(F.lit(1)).alias("n_batches"), F.count_if(F.col("lo") == F.col("hi")).alias("n_single_condition"),
        F.coalesce(F.min("lo") != F.max("hi"), F.lit(False)).alias("_several"),
    ).select(
        "n_batches", "n_single_condition",
        (F.col("_several") & (F.col("n_batches") > 0) & (F.col("n_batches") == F.col("n_single_condition"))).alias("confounded"),
    )


def population_eligibility(cells: DataFrame, tested: str, reference: str, cell_type="cell_type", donor="donor", condition="condition") -> DataFrame:
    """Which cell types have enough donors per condition, paired or disjoint."""
    rows = cells.where(F.col(cell_type).isNotNull()).select(
        F.col(cell_type).cast("string").alias("cell_type"), F.trim(F.col(donor).cast("string")).alias("_d"),
        F.trim(F.col(condition).cast("string")).alias("_c"),
        (identity_missing(F.col(donor)) | identity_missing(F.col(condition))).alias("_gap"),
    )
    per_donor = rows.groupBy("cell_type", "_d").agg(
        F.count(F.lit(1)).alias("_n"), F.max("_gap").alias("_gap"),
        F.max(F.coalesce(F.col("_c") == tested, F.lit(False))).alias("_a"),
        F.max(F.coalesce(F.col("_c") == reference, F.lit(False))).alias("_b"),
    )
    known = F.col("_d").isNotNull()
    out = per_donor.groupBy("cell_type").agg(
        F.sum("_n").alias("n_cells"), F.count_if(F.col("_a") & known).alias("n_donors_tested"),
        F.count_if(F.col("_b") & known).alias("n_donors_reference"),
        F.count_if(F.col("_a") & F.col("_b") & known).alias("n_donors_both"), (~F.max("_gap")).alias("complete"),
    )
    paired = F.col("n_donors_both") > 0
    same = (F.col("n_donors_both") == F.col("n_donors_tested")) & (F.col("n_donors_both") == F.col("n_donors_reference"))
    eligible = F.col("complete") & (F.least("n_donors_tested", "n_donors_reference") >= 2) & (~paired | same)
    return out.select(
        "cell_type", "n_cells", "n_donors_tested", "n_donors_reference", "n_donors_both", paired.alias("paired"),
        eligible.alias("eligible"),
        F.when(eligible & paired, F.lit("paired_donor_sets")).when(eligible, F.lit("disjoint_donor_sets"))
        .otherwise(F.lit("not_eligible")).alias("reason"),
    )


def compare_branches(primary: DataFrame, branch: DataFrame) -> DataFrame:
    """One row: cells retained by each branch, added, removed and changed."""
    joined = _paired_dispositions(primary, branch)
    a, b = F.col("a_retained"), F.col("b_retained")
    return joined.agg(
        F.count_if(a).alias("primary_retained"), F.count_if(b).alias("branch_retained"),
        F.count_if(~a & b).alias("n_added"), F.count_if(a & ~b).alias("n_removed"), F.count_if(a != b).alias("n_changed"),
    )


def _paired_dispositions(primary: DataFrame, branch: DataFrame) -> DataFrame:
    a = primary.select("cell_id", F.col("retained").alias("a_retained"), F.col("reason").alias("primary_reason"))
    b = branch.select("cell_id", F.col("retained").alias("b_retained"), F.col("reason").alias("branch_reason"))
    return a.join(b, "cell_id")


def reason_transitions(primary: DataFrame, branch: DataFrame) -> DataFrame:
    return _paired_dispositions(primary, branch).groupBy("primary_reason", "branch_reason").agg(F.count(F.lit(1)).alias("n_cells"))


def group_retention(primary: DataFrame, branch: DataFrame, group: str) -> DataFrame:
    """Share of each observed group kept by both branches."""
    named = primary.select("cell_id", F.trim(F.col(group).cast("string")).alias("observed_group"))
    joined = _paired_dispositions(primary, branch).join(named, "cell_id").where(
        F.col("observed_group").isNotNull() & (F.col("observed_group") != "")
    )
    out = joined.groupBy("observed_group").agg(
        F.count(F.lit(1)).alias("original_cells"), F.count_if("a_retained").alias("primary_retained"),
        F.count_if("b_retained").alias("branch_retained"),
    )
    return out.withColumns({
        "primary_retention_fraction": F.col("primary_retained") / F.col("original_cells"),
        "branch_retention_fraction": F.col("branch_retained") / F.col("original_cells"),
    })


def apply_doublet_scores(cells: DataFrame, scores: DataFrame, thresholds: DataFrame, batch="batch", drop: bool = False) -> DataFrame:
    """Flag cells whose external score exceeds the limit of their batch."""
    joined = cells.join(scores.select("cell_id", "doublet_score"), "cell_id", "left").join(
        thresholds.select(batch, "threshold"), batch, "left"
    )
    flag = F.coalesce(F.col("doublet_score") > F.col("threshold"), F.lit(False))
    out = joined.select(*cells.columns, "doublet_score", "threshold", flag.alias("predicted_doublet"))
    return out.withColumn("retained_after_filter", ~F.col("predicted_doublet") if drop else F.lit(True))


def doublet_retention(flagged: DataFrame, batch="batch") -> DataFrame:
    out = flagged.groupBy(batch).agg(
        F.count(F.lit(1)).alias("n_before"), F.count_if("retained_after_filter").alias("n_after"),
        F.count_if("predicted_doublet").alias("n_marked"),
    )
    return out.withColumn("retention_rate", F.col("n_after") / F.col("n_before"))


def label_unknown(label: Column) -> Column:
    return F.coalesce(F.lower(F.trim(label.cast("string"))).isin(UNKNOWN_LABELS), F.lit(True))


def merge_annotation(cells: DataFrame, predicted: DataFrame, existing: str = "cell_type", metadata_conflict: bool = False, replace: bool = True) -> DataFrame:
    """Join predicted labels; unknown, conflicting or metadata-blocked ones never replace an existing label."""
    joined = cells.join(predicted.select("cell_id", "predicted_label"), "cell_id", "left")
    unknown, old_unknown = label_unknown(F.col("predicted_label")), label_unknown(F.col(existing))
    conflict = ~old_unknown & ~unknown & (F.col(existing).cast("string") != F.col("predicted_label").cast("string"))
    take = ~unknown & ~conflict & F.lit(replace and not metadata_conflict)
    return joined.select(
        *[c for c in cells.columns if c != existing], F.col(existing).alias("label_existing"), "predicted_label",
        unknown.alias("label_unknown"), F.coalesce(conflict, F.lit(False)).alias("label_conflict"),
        F.when(take, F.col("predicted_label")).otherwise(F.col(existing)).alias(existing),
    )
