"""Recomputation of external summary tables from their cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def long_masks(cells: DataFrame, masks: list[str], keep: list[str]) -> DataFrame:
    """One row per cell and mask from wide ``mask_<name>_pass`` / ``mask_<name>_metadata_known`` columns."""
    rows = F.array(*[
        F.struct(F.lit(m).alias("mask"), F.col(f"mask_{m}_pass").alias("passed"), F.col(f"mask_{m}_metadata_known").alias("known")) for m in masks
    ])
    return cells.select(*keep, F.inline(rows))


def selection_counts(masked: DataFrame, groups: list[str], samples: DataFrame) -> DataFrame:
    """Per group, mask and sample: input, known, missing and selected cells, library total and status.

    Every sample is listed for every group and mask, with zeros where it has no cell.
    """
    sums = masked.groupBy(*groups, "mask", "sample_id").agg(
        F.count(F.lit(1)).alias("_in"), F.count_if("known").alias("_known"), F.count_if("passed").alias("_sel"),
        F.sum(F.when(F.col("passed"), F.col("total_counts")).otherwise(F.lit(0))).alias("_lib"),
    )
    names = samples.select("sample_id").distinct().agg(F.collect_list("sample_id").alias("l")).scalar()
    grid = sums.select(*groups, "mask").distinct().withColumn("sample_id", F.explode(names))
    out = grid.join(sums, [*groups, "mask", "sample_id"], "left")
    n_in, n_known, n_sel = (F.coalesce(c, F.lit(0)) for c in ("_in", "_known", "_sel"))
    available = (n_in == 0) | (n_known > 0)
    return out.select(
        *groups, "mask", "sample_id", n_in.alias("n_input_cells"), n_known.alias("n_metadata_known"), (n_in - n_known).alias("n_metadata_missing"),
        n_sel.alias("n_cells"), available.alias("mask_available"),
        F.when(~available, "unavailable").when(n_in == 0, "missing_cells").when(n_known < n_in, "available_with_missing_metadata")
        .otherwise("available").alias("mask_status"),
        F.when(available, F.coalesce("_lib", F.lit(0))).alias("total_selected_library"),
    )


def gene_summaries(masked: DataFrame, genes: list[str], groups: list[str], selections: DataFrame) -> DataFrame:
    """Sum, detections, detection share and CPM of each gene column, with the supplied library totals as denominator."""
    rows = F.array(*[F.struct(F.lit(g).alias("gene_symbol"), F.col(f"{g}_raw_UMI").alias("raw")) for g in genes])
    keys = [*groups, "mask", "sample_id"]
    sums = masked.where("passed").select(*keys, F.inline(rows)).groupBy(*keys, "gene_symbol").agg(
        F.sum("raw").alias("_s"), F.count_if(F.col("raw") > 0).alias("_d")
    )
    grid = selections.withColumn("gene_symbol", F.explode(F.array(*[F.lit(g) for g in genes])))
    available, n = F.col("mask_available"), F.col("n_cells")
    total, seen = F.coalesce("_s", F.lit(0)), F.coalesce("_d", F.lit(0))
    return grid.join(sums, [*keys, "gene_symbol"], "left").select(
        *keys, "gene_symbol", "n_cells", "mask_available", "total_selected_library", F.when(available, total).alias("raw_count_sum"),
        F.when(available, seen).alias("detected_cells"), F.when(available & (n > 0), seen / n).alias("detection_fraction"),
        F.when(F.col("total_selected_library") > 0, total / F.col("total_selected_library") * 1e6).alias("pseudobulk_cpm"),
    )


def reconcile(recomputed: DataFrame, supplied: DataFrame, keys: list[str], exact: list[str], close: list[str], rtol: float = 1e-9, atol: float = 1e-10) -> DataFrame:
    """Rows that disagree: a key on one side only, a different integer, or a float outside tolerance."""
    a = recomputed.select(*keys, *[F.col(c).alias(f"_a_{c}") for c in exact + close], F.lit(True).alias("_ha"))
    b = supplied.select(*keys, *[F.col(c).alias(f"_b_{c}") for c in exact + close], F.lit(True).alias("_hb"))
    j = a.join(b, keys, "full_outer")
    problems = [
        F.when(F.col("_hb").isNull(), F.lit("missing_row")), F.when(F.col("_ha").isNull(), F.lit("unexpected_row")),
    ]
    both = F.col("_ha").isNotNull() & F.col("_hb").isNotNull()
    for c in exact:
        problems.append(F.when(both & ~F.col(f"_a_{c}").eqNullSafe(F.col(f"_b_{c}")), F.lit(c)))
    for c in close:
        x, y = F.col(f"_a_{c}"), F.col(f"_b_{c}")
        near = (x.isNull() & y.isNull()) | F.coalesce(F.abs(x - y) <= atol + rtol * F.abs(x), F.lit(False))
        problems.append(F.when(both & ~near, F.lit(c)))
    found = j.withColumn("problem", F.explode(F.array_compact(F.array(*problems))))
    return found.select(*keys, "problem")


def module_status(modules: DataFrame, selections: DataFrame, groups: list[str], reference: str, query: str, min_cells: int) -> DataFrame:
    """Status and median difference of every module row, derived from its cells and score counts.

    ``modules`` has group, mask, module_id, and finite score counts and medians of both sides.
    """
    keys = [*groups, "mask"]

    def side(sample, tag):
        return selections.where(F.col("sample_id") == sample).select(
            *keys, F.col("n_cells").alias(f"n_cells_{tag}"), F.col("mask_available").alias(f"_av_{tag}")
        )

    j = modules.join(side(reference, "reference"), keys, "left").join(side(query, "query"), keys, "left")
    nr, nq = F.coalesce("n_cells_reference", F.lit(0)), F.coalesce("n_cells_query", F.lit(0))
    fr, fq = F.col("n_finite_scores_reference"), F.col("n_finite_scores_query")
    status = (
        F.when(~(F.coalesce("_av_reference", F.lit(True)) & F.coalesce("_av_query", F.lit(True))), "unavailable")
        .when((F.least(nr, nq) == 0) | (F.least(fr, fq) == 0), "missing")
        .when(F.least(nr, nq, fr, fq) < min_cells, "low_cells").otherwise("comparable")
    )
    return j.select(*modules.columns, nr.alias("n_cells_reference"), nq.alias("n_cells_query"), status.alias("comparison_status")).withColumn(
        "median_score_delta", F.when(F.col("comparison_status") == "comparable", F.col("median_score_query") - F.col("median_score_reference"))
    )


def membership(masked: DataFrame, groups: list[str]) -> DataFrame:
    """Order-free digest of the cells each group and mask selects.

    Each cell id gives four 60-bit words of its SHA-256; their sums identify the
    set, so no group's ids are gathered in one place.
    """
    digest = F.sha2(F.col("cell_id").cast("string"), 256)
    words = [F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)") for i in range(4)]
    chosen = [F.coalesce(F.sum(F.when(F.col("passed"), w)), F.lit(0)).cast("string").alias(f"_w{i}") for i, w in enumerate(words)]
    out = masked.groupBy(*groups, "mask").agg(F.count_if("passed").alias("n_cells"), *chosen)
    return out.select(*groups, "mask", "n_cells", F.sha2(F.concat_ws("/", F.col("n_cells").cast("string"), *[f"_w{i}" for i in range(4)]), 256).alias("membership_sha256"))


def equivalent_masks(members: DataFrame, groups: list[str] = ()) -> DataFrame:
    """Masks that select the same cells, under the first of their names. The list holds mask names only."""
    return members.groupBy(*groups, "membership_sha256", "n_cells").agg(
        F.min("mask").alias("canonical_mask"), F.sort_array(F.collect_set("mask")).alias("masks")
    )


def module_sensitivity(status: DataFrame, members: DataFrame, groups: list[str]) -> DataFrame:
    """Range and sign agreement of a module's difference over the distinct comparable cell sets."""
    j = status.join(members.select(*groups, "mask", "membership_sha256"), [*groups, "mask"])
    first = j.groupBy(*groups, "module_id", "membership_sha256").agg(
        F.min_by(F.struct("mask", "comparison_status", "median_score_delta"), "mask").alias("f"),
        F.count_if(F.col("comparison_status") == "comparable").alias("_n"),
        F.max(F.when(F.col("mask") == "all", F.col("median_score_delta"))).alias("_all"),
    )
    delta = F.when(F.col("f.comparison_status") == "comparable", F.col("f.median_score_delta"))
    sign = F.signum(delta)
    out = first.groupBy(*groups, "module_id").agg(
        F.max("_all").alias("all_delta"), F.sum("_n").alias("n_comparable_masks"), F.count(delta).alias("n_distinct_comparable_cell_sets"),
        F.min(delta).alias("delta_min"), F.max(delta).alias("delta_max"), F.min(sign).alias("_lo"), F.max(sign).alias("_hi"),
    )
    return out.select(
        *groups, "module_id", "all_delta", "n_comparable_masks", "n_distinct_comparable_cell_sets", "delta_min", "delta_max",
        F.when(F.col("n_distinct_comparable_cell_sets") < 2, "insufficient_distinct_comparable_cell_sets")
        .when((F.col("_lo") == -1) & (F.col("_hi") == 1), "sign_flip").when(F.col("_lo") != F.col("_hi"), "mixed_zero_and_nonzero")
        .when(F.col("_lo") == 1, "consistent_positive").when(F.col("_lo") == -1, "consistent_negative").otherwise("consistent_zero").alias("sign_status"),
    )


def gene_contrasts(summaries: DataFrame, groups: list[str], reference: str, query: str, min_cells: int) -> DataFrame:
    """Query minus reference per gene where both sides have enough cells."""
    keys = [*groups, "mask", "gene_symbol"]

    def side(sample, column):
        return F.max(F.when(F.col("sample_id") == sample, F.col(column)))

    wide = summaries.groupBy(*keys).agg(
        side(reference, "n_cells").alias("n_cells_reference"), side(query, "n_cells").alias("n_cells_query"),
        F.min(F.when(F.col("sample_id").isin(reference, query), F.col("mask_available"))).alias("_av"),
        *[side(s, c).alias(f"_{t}_{c}") for c in ("detection_fraction", "pseudobulk_cpm") for s, t in ((reference, "r"), (query, "q"))],
    )
    low = F.least("n_cells_reference", "n_cells_query")
    status = F.when(~F.col("_av"), "unavailable").when(low == 0, "missing").when(low < min_cells, "low_cells").otherwise("comparable")
    ok = F.col("comparison_status") == "comparable"
    return wide.withColumn("comparison_status", status).select(
        *keys, "comparison_status", "n_cells_reference", "n_cells_query",
        *[F.when(ok, F.col(f"_q_{c}") - F.col(f"_r_{c}")).alias(f"{c}_delta") for c in ("detection_fraction", "pseudobulk_cpm")],
    )
