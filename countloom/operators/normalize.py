"""Library-size normalisation and feature selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from countloom.functions.moments import sq_dev_with_zeros


def log_normalize(counts: DataFrame, target_sum: float = 1e4, by: list[str] | None = None) -> DataFrame:
    """log1p(value / total x target); zeros stay unstored.

    One shuffle, by cell: a cell holds at most one row per gene.
    """
    by = by or ["cell_id"]
    total = F.sum("value").over(W.partitionBy(*by))
    scaled = F.col("value") / F.when(total > 0, total).otherwise(F.lit(1.0)) * F.lit(float(target_sum))
    return counts.withColumn("value", F.log1p(scaled))


def counts_per_million(samples: DataFrame, by: list[str], log: bool = False, target_sum: float = 1e6) -> DataFrame:
    """Share of the sample total, times a million; optionally log1p.

    Samples can be few and large, so totals are aggregated and joined back; no
    task holds a whole sample.
    """
    totals = samples.groupBy(*by).agg(F.sum("value").alias("_total"))
    total = F.when(F.col("_total") > 0, F.col("_total")).otherwise(F.lit(1.0))
    cpm = F.col("value") / total * F.lit(float(target_sum))
    return samples.join(totals, list(by)).select(*samples.columns, (F.log1p(cpm) if log else cpm).alias("cpm"))


def gene_variance(values: DataFrame, cells: DataFrame, genes: DataFrame) -> DataFrame:
    """Population variance per gene over all cells, unstored zeros included."""
    n = cells.agg(F.count(F.lit(1)).cast("double").alias("n")).scalar()
    stored = values.groupBy("gene_id").agg(
        F.count(F.lit(1)).alias("_k"), F.avg("value").alias("_mean"), F.var_pop("value").alias("_var")
    )
    dev = sq_dev_with_zeros(F.col("_k"), F.col("_mean"), F.col("_var"), n)
    return genes.join(stored, "gene_id", "left").select(*genes.columns, (dev / n).alias("variance"))


def top_variable_genes(values: DataFrame, cells: DataFrame, genes: DataFrame, n_top: int = 300) -> DataFrame:
    """The ``n_top`` most variable genes; ties go to the lower gene index."""
    ranked = gene_variance(values, cells, genes)
    return ranked.orderBy(F.desc("variance"), "gene_index").limit(n_top)
