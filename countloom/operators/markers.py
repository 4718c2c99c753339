"""Cluster-versus-rest markers and their ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def level_sizes(cells: DataFrame, column: str) -> Column:
    """Sorted array of (level, cells) as a scalar; its length is the number of levels, not of cells."""
    sizes = cells.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("level")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return sizes.agg(F.sort_array(F.collect_list(F.struct("level", "n"))).alias("l")).scalar()


def group_sums(values: DataFrame, cells: DataFrame, column: str) -> DataFrame:
    """Summed value and number of detections per (level, gene)."""
    labels = cells.select("cell_id", F.col(column).cast("string").alias("level")).where(F.col("level").isNotNull())
    return values.join(labels, "cell_id").groupBy("level", "gene_id").agg(
        F.sum("value").cast("double").alias("total"), F.count_if(F.col("value") > 0).alias("detected")
    )


def cluster_markers(values: DataFrame, cells: DataFrame, genes: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Mean and detection inside and outside every cluster, for every gene.

    The rest of a cluster is the gene total minus the inside sum, so count rows
    are read once, and means divide by cells, not by stored rows.
    """
    sums = group_sums(values, cells, cluster)
    totals = sums.groupBy("gene_id").agg(F.sum("total").alias("_all"), F.sum("detected").alias("_seen"))
    sizes = level_sizes(cells, cluster)
    n_all = F.aggregate(F.transform(F.col("_sizes"), lambda s: s["n"]), F.lit(0).cast("long"), lambda a, b: a + b)
    grid = genes.select("gene_id", "gene_index", "gene_name", sizes.alias("_sizes")).select(
        "gene_id", "gene_index", "gene_name", n_all.alias("_n"), F.inline("_sizes")
    )
    joined = grid.join(totals, "gene_id", "left").join(sums, ["level", "gene_id"], "left")
    inside, seen_in = F.coalesce("total", F.lit(0.0)), F.coalesce("detected", F.lit(0))
    seen_out = F.coalesce("_seen", F.lit(0)) - seen_in
    outside = F.when(seen_out > 0, F.col("_all") - inside).otherwise(F.lit(0.0))
    n_rest = F.col("_n") - F.col("n")
    return joined.where(n_rest > 0).select(
        F.col("level").alias("cluster"), "gene_id", "gene_index", "gene_name",
        (inside / F.col("n")).alias("mean_in"), (outside / n_rest).alias("mean_rest"),
        (seen_in / F.col("n")).alias("detection_in"), (seen_out / n_rest).alias("detection_rest"),
        F.col("n").alias("n_in"), n_rest.alias("n_rest"),
    ).withColumns({
        "mean_log1p_difference": F.col("mean_in") - F.col("mean_rest"),
        "detection_difference": F.col("detection_in") - F.col("detection_rest"),
    })


def rank_markers(markers: DataFrame, top_n: int | None = None) -> DataFrame:
    """Order genes inside each cluster by effect, detection, name and index; ties are decided at 12 digits."""
    if top_n is not None and top_n < 20:
        raise ValueError("top_n must be at least 20, or None for all genes")
    order = W.partitionBy("cluster").orderBy(
        F.desc(F.round("mean_log1p_difference", 12)), F.desc(F.round("detection_difference", 12)), "gene_name", "gene_index"
    )
    ranked = markers.withColumn("rank", F.row_number().over(order).cast("long"))
    return ranked if top_n is None else ranked.where(F.col("rank") <= top_n)
