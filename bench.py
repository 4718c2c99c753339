"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import functions as F

from countloom.operators import donor_stats
from countloom.plans import load_catalog
from countloom.session import local_session

HEADLINE = [
    "d01_pseudobulk", "d04_welch_de", "d06_differential_abundance", "d07_benjamini_hochberg", "d10_design_contrast", "d12_leave_one_out",
    "d14_leave_one_out_summary", "d23_activity_scores", "q01_cell_metrics", "q04_review_features", "q06_mad_thresholds", "n01_log_normalize",
    "n02_variable_genes", "k02_marker_ranks", "m01_pca_scores", "m03_batch_mixing", "m09_knn_graph", "t03_order_association",
    "x03_section_neighbors", "x08_morans_i", "x12_pair_scores", "x13_label_permutation", "g01_over_representation", "g06_ranked_records",
    "l05_group_pair_scores", "p06_correlation_network", "r01_r02_agreement", "b02_gene_summaries", "e01_provenance", "e13_matrix_fingerprint", "e08_recomputed_adjustment",
    "d17_fold_integrity",
]
WARM_UP = ["d01_pseudobulk", "q01_cell_metrics"]


def bulk_probe(spark) -> float:
    """Seconds for a pseudobulk of 200,000 cells x 30,000 genes with 200,000 stored counts into six samples."""
    cells = spark.range(200_000).select(F.col("id").alias("cell_id"), (F.col("id") % 3).cast("string").alias("donor"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("condition"))
    counts = spark.range(200_000).select(F.col("id").alias("cell_id"), F.pmod(F.xxhash64("id"), F.lit(30_000)).alias("gene_id"), (F.col("id") % 9 + 1).alias("value"))
    start = time.time()
    donor_stats.pseudobulk(counts, cells).write.format("noop").mode("overwrite").save()
    return round(time.time() - start, 3)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    queries = load_catalog()[0]
    names = sys.argv[1:] or HEADLINE
    spark.read.parquet(f"{sf}/lineitem.parquet").selectExpr("sum(l_quantity)").collect()
    for name in WARM_UP:  # untimed: class loading and code generation
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
    took: dict[str, float] = {"d01_probe_200k_x_30k": bulk_probe(spark)}
    for name in names:
        start = time.time()
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - start, 3)
        print(name, took[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))


if __name__ == "__main__":
    main()
