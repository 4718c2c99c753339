"""Comparison of partitions: agreement, matching, retention and annotation scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from countloom.functions.ranking import hash_sample
from countloom.operators.matching import best_matching, pair_up


def contingency(first: DataFrame, second: DataFrame, key: str = "cell_id") -> DataFrame:
    """Cells per pair of labels, over the cells both partitions hold. Inputs have ``label`` columns."""
    a = first.select(key, F.col("label").cast("string").alias("a"))
    b = second.select(key, F.col("label").cast("string").alias("b"))
    return a.join(b, key).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def agreement(table: DataFrame) -> DataFrame:
    """Adjusted Rand index and normalised mutual information of a contingency table.

    The table has one row per pair of labels; all its sums are taken in one pass
    per margin.
    """
    def pairs(c):
        x = F.col(c).cast("double")
        return x * (x - 1) / 2

    rows = table.groupBy("a").agg(F.sum("n").alias("n"))
    cols = table.groupBy("b").agg(F.sum("n").alias("n"))

    def margin(df, tag):
        x = F.col("n").cast("double")
        return df.agg(
            F.struct(F.sum(pairs("n")).alias("p"), F.sum(x * F.log(x)).alias("e"), F.count(F.lit(1)).alias("k")).alias(tag)
        ).scalar()

    x = F.col("n").cast("double")
    one = table.agg(F.sum("n").alias("n"), F.sum(pairs("n")).alias("_t"), F.sum(x * F.log(x)).alias("_e")).withColumns(
        {"_r": margin(rows, "r"), "_c": margin(cols, "c")}
    )
    n = F.col("n").cast("double")
    expected = F.col("_r.p") * F.col("_c.p") / (n * (n - 1) / 2)
    maximum = (F.col("_r.p") + F.col("_c.p")) / 2
    h_rows, h_cols = F.log(n) - F.col("_r.e") / n, F.log(n) - F.col("_c.e") / n
    joint = F.log(n) - F.col("_e") / n
    half = (h_rows + h_cols) / 2
    single = (F.col("_r.k") == 1) & (F.col("_c.k") == 1)
    enough = F.col("n") >= 2
    return one.select(
        F.coalesce("n", F.lit(0)).alias("n_shared_cells"), F.col("_r.k").alias("n_first_labels"), F.col("_c.k").alias("n_second_labels"),
        F.when(enough, F.when(maximum == expected, 1.0).otherwise((F.col("_t") - expected) / (maximum - expected))).alias("ari"),
        F.when(enough, F.when(single, 1.0).otherwise((h_rows + h_cols - joint) / half)).alias("nmi"),
        F.when(enough, "computed").otherwise("not_estimable").alias("status"),
    )


def match_clusters(first: DataFrame, second: DataFrame, minimum: int = 10) -> DataFrame:
    """One-to-one matching of labels by Jaccard on shared cells; unmatched and small labels stay in the table.

    Branch labels without a partner follow as rows without a primary label, with their shared cells.

    The assignment of greatest total Jaccard is found per component of overlapping labels; labels left on both sides,
    which overlap nothing that is free, are paired in order.
    """
    table = contingency(first, second)
    size_a, size_b = table.groupBy("a").agg(F.sum("n").alias("na")), table.groupBy("b").agg(F.sum("n").alias("nb"))
    scored = table.join(size_a, "a").join(size_b, "b").withColumn("jaccard", F.col("n") / (F.col("na") + F.col("nb") - F.col("n")))
    matched = best_matching(scored.select("a", "b", F.col("jaccard").alias("weight")))
    left_a, left_b = size_a.join(matched, "a", "left_anti").select("a"), size_b.join(matched, "b", "left_anti").select("b")
    if not left_a.isEmpty() and not left_b.isEmpty():
        matched = matched.unionByName(pair_up(left_a, left_b))
    totals = first.groupBy(F.col("label").cast("string").alias("a")).agg(F.count(F.lit(1)).alias("primary_total_cells"))
    both = totals.join(size_a, "a", "left").join(matched, "a", "left").join(size_b, "b", "left").join(table, ["a", "b"], "left")
    common, inter = F.coalesce("na", F.lit(0)), F.coalesce("n", F.lit(0))
    shared = common > 0
    union = common + F.coalesce("nb", F.lit(0)) - inter
    described = both.select(
        F.col("a").alias("primary_cluster"), "primary_total_cells", common.alias("shared_cells"), (common / F.col("primary_total_cells")).alias("shared_coverage"),
        (F.col("primary_total_cells") < minimum).alias("small_primary_support"),
        F.when(~shared, "not_evaluable").when(common < minimum, "small_support").otherwise("described").alias("support_status"),
        F.col("b").alias("matched_branch_cluster"),
        F.when(~shared, "no_shared_cells").when(F.col("b").isNotNull(), "matched").otherwise("unmatched").alias("matching_status"),
        F.when(shared, inter).alias("intersection_cells"), F.when(shared, union).alias("union_cells"),
        F.when(shared, inter / union).alias("shared_jaccard"), F.when(shared, inter / common).alias("shared_recall"),
        F.when(shared, F.when(F.col("b").isNotNull(), inter / F.col("nb")).otherwise(F.lit(0.0))).alias("shared_precision"),
    )
    branch = second.select(F.col("label").cast("string").alias("b")).distinct().join(size_b, "b", "left").join(matched, "b", "left").where(F.col("a").isNull())
    alone = branch.select(F.col("b").alias("matched_branch_cluster"), F.coalesce("nb", F.lit(0)).alias("shared_cells"), F.lit("branch_unmatched").alias("matching_status"))
    return described.unionByName(alone, allowMissingColumns=True)


def class_retention(truth: DataFrame, retained: DataFrame, key: str = "cell_id") -> DataFrame:
    """Cells kept per reference class, and overall under the class ``__all__``."""
    kept = retained.select(key).distinct().withColumn("_kept", F.lit(1))
    rows = truth.select(key, F.col("label").cast("string").alias("label")).join(kept, key, "left").withColumn(
        "class", F.explode(F.array(F.lit("__all__"), "label"))
    )
    out = rows.groupBy("class").agg(F.count(F.lit(1)).alias("source_cells"), F.count("_kept").alias("retained_cells"))
    return out.withColumns({
        "excluded_cells": F.col("source_cells") - F.col("retained_cells"), "retention": F.col("retained_cells") / F.col("source_cells"),
    })


def marker_recovery(truth: DataFrame, clusters: DataFrame, markers: DataFrame, expected: DataFrame, max_rank: int = 50, min_purity: float = 0.5) -> DataFrame:
    """Per class: its dominant cluster, that cluster's purity and the expected markers ranked near its top.

    ``expected`` has (label, gene_name); ``markers`` has cluster, gene_name, rank and mean_log1p_difference.
    """
    table = contingency(truth, clusters)
    sizes = table.groupBy("b").agg(F.sum("n").alias("nb"))
    top = table.groupBy("a").agg(F.min(F.struct((-F.col("n")).alias("m"), "b")).alias("t")).select("a", F.col("t.b").alias("b"), (-F.col("t.m")).alias("n"))
    dominant = top.join(sizes, "b").select("a", F.col("b").alias("dominant_cluster"), (F.col("n") / F.col("nb")).alias("purity"))
    good = markers.where((F.col("rank") <= max_rank) & (F.col("mean_log1p_difference") > 0)).select(
        F.col("cluster").alias("dominant_cluster"), "gene_name", F.lit(1).alias("_hit")
    )
    want = expected.select(F.col("label").alias("a"), "gene_name").distinct()
    hits = want.join(dominant, "a", "left").join(good, ["dominant_cluster", "gene_name"], "left")
    return hits.groupBy(F.col("a").alias("class"), "dominant_cluster", "purity").agg(
        F.count(F.lit(1)).alias("n_expected"), F.count("_hit").alias("n_recovered")
    ).withColumn("supported", (F.col("n_recovered") > 0) & F.coalesce(F.col("purity") >= min_purity, F.lit(False)))


def score_annotation(predicted: DataFrame, reference: DataFrame, aliases: DataFrame, key: str = "cell_id") -> DataFrame:
    """Accuracy and macro F1 over reference labels the alias table maps; unmapped predictions count as errors."""
    def text(c):
        return F.lower(F.trim(F.col(c).cast("string")))

    names = aliases.select(text("alias").alias("_al"), "canonical").distinct()
    p = predicted.select(key, text("label").alias("_p"))
    r = reference.select(key, text("label").alias("_r"))
    pairs = p.join(r, key).groupBy("_p", "_r").agg(F.count(F.lit(1)).alias("n"))
    mapped = pairs.join(names.select(F.col("_al").alias("_p"), F.col("canonical").alias("cp")), "_p", "left").join(
        names.select(F.col("_al").alias("_r"), F.col("canonical").alias("cr")), "_r", "left"
    )
    scored = F.col("cr").isNotNull()
    right = scored & (F.col("cp") == F.col("cr"))
    truth_n = mapped.where(scored).groupBy(F.col("cr").alias("c")).agg(
        F.sum("n").alias("fn_tp"), F.sum(F.when(F.col("cp") == F.col("cr"), F.col("n")).otherwise(F.lit(0))).alias("tp")
    )
    pred_n = mapped.where(scored & F.col("cp").isNotNull()).groupBy(F.col("cp").alias("c")).agg(F.sum("n").alias("fp_tp"))
    f1 = truth_n.join(pred_n, "c", "left").agg(
        F.avg(2.0 * F.col("tp") / (F.col("fn_tp") + F.coalesce("fp_tp", F.lit(0)))).alias("f")
    ).scalar()

    def cells(cond):
        return F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))

    return mapped.agg(
        F.sum("n").alias("n_shared_cells"), cells(scored).alias("n_cells_scored"), cells(F.col("cr").isNull() & F.col("_r").isNotNull()).alias("n_reference_unmapped"),
        cells(F.col("cp").isNull() & F.col("_p").isNotNull()).alias("n_prediction_unmapped"), cells(right).alias("_ok"),
    ).select(
        "n_shared_cells", "n_cells_scored", "n_reference_unmapped", "n_prediction_unmapped",
        F.when(F.col("n_cells_scored") > 0, F.col("_ok") / F.col("n_cells_scored")).alias("accuracy"), f1.alias("macro_f1"),
    )


def fold_status(cells: DataFrame, donor: str = "donor", most: int | None = None) -> DataFrame:
    """One row: the number of donors, and whether leaving each out is possible (two at least, ``most`` at most) or why not."""
    n = F.countDistinct(F.trim(F.col(donor).cast("string")))
    few, many = n < 2, F.lit(False) if most is None else n > most
    reason = F.when(few, "fewer than two donors").when(many, f"more than {most} donors")
    return cells.agg(n.alias("n_donors"), F.when(few | many, "not_eligible").otherwise("planned").alias("status"), reason.alias("reason"))


def perturbed_sets(cells: DataFrame, seed: int = 20261003, fraction: float = 0.8, donor: str | None = "donor", most: int | None = None) -> DataFrame:
    """(branch, cell_id): all cells, an exact 80% sample, and each donor left out.

    There is no donor fold below two donors, nor above ``most`` where it is given; ``fold_status`` says so.
    """
    ids = cells.select("cell_id", *([donor] if donor else []))
    out = ids.select(F.lit("primary").alias("branch"), "cell_id").unionByName(
        hash_sample(ids, "cell_id", seed, fraction=fraction).select(F.lit("uniform_sample_80pct").alias("branch"), "cell_id")
    )
    if donor is None:
        return out
    own = F.trim(F.col(donor).cast("string"))
    names = ids.where(own.isNotNull()).select(own.alias("_n")).distinct().agg(F.sort_array(F.collect_set("_n")).alias("l")).scalar()
    eligible = (F.size(names) >= 2) & (F.lit(True) if most is None else F.size(names) <= most)
    folds = ids.withColumn("_left", F.explode(F.when(eligible, names))).where(own != F.col("_left"))
    return out.unionByName(folds.select(F.concat(F.lit("leave_out_"), "_left").alias("branch"), "cell_id"))
