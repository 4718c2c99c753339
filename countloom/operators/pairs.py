"""Ligand-receptor resources: cleaning, coverage, scores and donor-level comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from countloom.functions.ranking import benjamini_hochberg, tie_positions
from countloom.operators.donor_stats import safe_tests
from countloom.session import cut_lineage

PAIR = ["ligand", "receptor"]


def clean_pairs(resource: DataFrame, order: str) -> DataFrame:
    """Trimmed, non-empty, distinct pairs; of duplicates the first in ``order`` is kept. Headers match in any case."""
    names = {c.strip().lower(): c for c in resource.columns}
    if not {"ligand", "receptor"} <= set(names):
        raise ValueError("A pair resource needs ligand and receptor columns")
    rest = [c for c in resource.columns if c not in (names["ligand"], names["receptor"])]
    rows = resource.select(
        F.trim(F.col(names["ligand"]).cast("string")).alias("ligand"), F.trim(F.col(names["receptor"]).cast("string")).alias("receptor"), *rest
    ).where((F.col("ligand") != "") & (F.col("receptor") != ""))
    first = rows.groupBy(*PAIR).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_first"))
    return first.select(*PAIR, *[F.col(f"_first.{c}").alias(c) for c in rest])


def evaluable_pairs(pairs: DataFrame, genes: DataFrame) -> DataFrame:
    """Is every part of both members measured? Complexes are split on ``_ + : |``; missing genes are listed."""
    part = F.array_distinct(F.filter(
        F.concat(F.split("ligand", r"[_+:|]"), F.split("receptor", r"[_+:|]")), lambda x: F.trim(x) != ""
    ))
    parts = pairs.select(*PAIR, F.explode(part).alias("gene"))
    known = genes.select("gene", F.lit(True).alias("_known")).distinct()
    return parts.join(known, "gene", "left").groupBy(*PAIR).agg(
        F.sort_array(F.collect_set(F.when(F.col("_known").isNull(), F.col("gene")))).alias("missing_genes"),
    ).withColumn("evaluable", F.size("missing_genes") == 0)


def coverage_gaps(rows: DataFrame, groups: DataFrame, expected: DataFrame, types: DataFrame | None = None, group: str = "group_id") -> DataFrame:
    """Pairs missing from a group, pairs nobody expected and unknown cell types.

    A pair present in every group is found by counting; only incomplete pairs
    are spread over the groups to name the gaps.
    """
    seen = rows.select(group, *PAIR).distinct()
    names = groups.select(group).distinct()
    every = names.agg(F.sort_array(F.collect_list(group)).alias("l")).scalar()
    known = seen.withColumn("_every", every).where(F.array_contains("_every", F.col(group))).drop("_every")
    per_pair = expected.select(*PAIR).distinct().join(
        known.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("_n")), PAIR, "left"
    ).where(F.coalesce("_n", F.lit(0)) < F.size(every))
    missing = per_pair.select(*PAIR, F.explode(every).alias(group)).join(known, [group, *PAIR], "left_anti").select(
        group, *PAIR, F.lit("missing_pair").alias("problem")
    )
    extra = seen.join(expected.select(*PAIR), PAIR, "left_anti").select(group, *PAIR, F.lit("unexpected_pair").alias("problem"))
    out = missing.unionByName(extra)
    if types is not None:
        used = rows.select(group, F.explode(F.array("source", "target")).alias("cell_type")).distinct()
        stray = used.join(types.select(group, "cell_type"), [group, "cell_type"], "left_anti")
        none = F.lit(None).cast("string")
        out = out.unionByName(stray.select(group, F.col("cell_type").alias("ligand"), none.alias("receptor"), F.lit("unexpected_type").alias("problem")))
    return out


def compare_pair_scores(rows: DataFrame, a: str, b: str, paired: bool, min_donors: int = 2) -> DataFrame:
    """Donor-level test of both rank scores per interaction, each with its own FDR family over estimated tests.

    Rows of one donor and condition are averaged first. Rows are shuffled once, by interaction, and both scores are
    tested in the same pass.
    """
    keys = ["source", "target", *PAIR]
    donors = rows.repartition(*keys).groupBy(*keys, "donor", "condition").agg(
        F.avg("magnitude_rank").alias("magnitude"), F.avg("specificity_rank").alias("specificity")
    )
    out = safe_tests(donors, keys, ["magnitude", "specificity"], a, b, paired).select(*keys, *[
        F.col(f"{score}.{name}").alias(to) for score in ("magnitude", "specificity") for name, to in (
            ("n_a", f"n_a_{score}"), ("n_b", f"n_b_{score}"), ("mean_a", f"mean_{score}_rank_a"), ("mean_b", f"mean_{score}_rank_b"), ("p_value", f"p_{score}")
        )
    ])
    out = out.withColumnsRenamed({"n_a_magnitude": "n_donors_a", "n_b_magnitude": "n_donors_b"}).drop("n_a_specificity", "n_b_specificity")
    enough = F.least("n_donors_a", "n_donors_b") >= min_donors
    out = out.withColumns({c: F.when(enough, F.col(c)) for c in ("p_magnitude", "p_specificity")}).withColumn(
        "status",
        F.when(~enough, "insufficient_donors").when(F.col("p_magnitude").isNull() | F.col("p_specificity").isNull(), "not_estimated").otherwise("tested"),
    )
    for score in ("magnitude", "specificity"):
        out = benjamini_hochberg(out, f"p_{score}", f"fdr_{score}", missing="keep")
    return out


def group_pair_scores(values: DataFrame, cells: DataFrame, pairs: DataFrame, by: list[str] = ("donor", "condition"), cell_type: str = "cell_type", digits: int = 12) -> DataFrame:
    """Magnitude and specificity of every pair between cell types, ranked inside each donor and condition.

    Magnitude is the root of the two mean expressions, specificity the product
    of their shares over cell types. Ranks are percent ranks, 0 the highest,
    over all sender, receiver and pair combinations of the group. Combinations
    without expression on both sides score zero and are counted in the
    denominator but not stored. Scores are rounded to ``digits`` so that equal
    ones tie whatever the order of summation.
    """
    by = list(by)
    labels = cells.select("cell_id", *by, F.col(cell_type).alias("cell_type"))
    sizes = labels.groupBy(*by, "cell_type").agg(F.count(F.lit(1)).alias("n"))
    used = pairs.select(F.explode(F.array(*PAIR)).alias("gene_id")).distinct()
    sums = values.join(used, "gene_id", "left_semi").join(labels, "cell_id").groupBy(*by, "cell_type", "gene_id").agg(F.sum("value").alias("s"))
    means = sums.join(sizes, [*by, "cell_type"]).select(*by, "cell_type", "gene_id", (F.col("s") / F.col("n")).alias("m"))
    whole = means.groupBy(*by, "gene_id").agg(F.sum("m").alias("t"))
    means = means.join(whole, [*by, "gene_id"]).select(*by, "cell_type", "gene_id", "m", (F.col("m") / F.col("t")).alias("share"))
    lig = means.select(*by, F.col("cell_type").alias("source"), F.col("gene_id").alias("ligand"), F.col("m").alias("lm"), F.col("share").alias("ls"))
    rec = means.select(*by, F.col("cell_type").alias("target"), F.col("gene_id").alias("receptor"), F.col("m").alias("rm"), F.col("share").alias("rs"))
    scored = pairs.select(*PAIR).distinct().join(lig, "ligand").join(rec, [*by, "receptor"]).select(
        *by, "source", "target", *PAIR, F.round(F.sqrt(F.col("lm") * F.col("rm")), digits).alias("magnitude"), F.round(F.col("ls") * F.col("rs"), digits).alias("specificity")
    )
    n_pairs = pairs.select(*PAIR).distinct().agg(F.count(F.lit(1)).alias("n")).scalar()
    grid = sizes.groupBy(*by).agg((F.count(F.lit(1)) * F.count(F.lit(1))).alias("_tt")).withColumn("_grid", F.col("_tt") * n_pairs).drop("_tt")
    out = cut_lineage(scored.join(grid, by))
    for score in ("magnitude", "specificity"):
        flipped = out.withColumn("_neg", -F.col(score))
        pos = tie_positions(flipped.select(*by, "_neg"), by, "_neg").select(*by, "_neg", F.col("n_below").alias("_above"))
        out = flipped.join(pos, [*by, "_neg"]).withColumn(
            f"{score}_rank", F.when(F.col("_grid") > 1, F.col("_above") / (F.col("_grid") - 1)).otherwise(F.lit(0.0))
        ).drop("_neg", "_above")
    return out.drop("_grid")
