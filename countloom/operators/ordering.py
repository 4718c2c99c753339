"""Pseudotime, its stability, gene trends, absorption in terminal states and flow between groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from countloom.functions.ranking import benjamini_hochberg, hash_sample, tie_positions
from countloom.functions.special import t_two_sided
from countloom.operators.embed import squared_distance
from countloom.session import cut_lineage


def root_by_gene(values: DataFrame, cells: DataFrame, gene_id) -> DataFrame:
    """The cell with the lowest value of a gene, unstored zeros included; ties by id."""
    one = values.where(F.col("gene_id") == gene_id).groupBy("cell_id").agg(F.sum("value").alias("v"))
    return cells.select("cell_id").join(one, "cell_id", "left").agg(
        F.min(F.struct(F.coalesce("v", F.lit(0)).alias("v"), "cell_id")).alias("m")
    ).select(F.col("m.cell_id").alias("cell_id"))


def pseudotime(vectors: DataFrame, root: DataFrame) -> DataFrame:
    """Distance from the root cell scaled to 0..1; no spread gives 0."""
    origin = vectors.join(root.select("cell_id"), "cell_id", "left_semi").agg(F.min_by("vec", "cell_id").alias("v")).scalar()
    dist = vectors.withColumn("_o", origin).select("cell_id", F.sqrt(squared_distance("vec", "_o")).alias("distance"))
    ends = dist.agg(F.struct(F.min("distance").alias("lo"), F.max("distance").alias("hi")).alias("e")).scalar()
    span = F.col("_e.hi") - F.col("_e.lo")
    return dist.withColumn("_e", ends).select(
        "cell_id", "distance", F.when(span > 1e-12, (F.col("distance") - F.col("_e.lo")) / span).otherwise(F.lit(0.0)).alias("pseudotime")
    )


def _average_rank(df: DataFrame, groups: list[str], value: str, out: str) -> DataFrame:
    pos = tie_positions(df.select(*groups, value), groups, value)
    return df.join(pos.select(*groups, value, (F.col("n_below") + (F.col("n_tie") + 1) / 2).alias(out)), [*groups, value])


def stability(vectors: DataFrame, times: DataFrame, root: DataFrame, repeats: int = 5, fraction: float = 0.8, seed: int = 42) -> DataFrame:
    """Spearman correlation of pseudotime with its recomputation on repeated subsets, one row per repeat.

    Undefined correlations are null. All repeats run in one job.
    """
    base = vectors.select("cell_id", "vec").join(times.select("cell_id", "pseudotime"), "cell_id")
    origin = vectors.join(root.select("cell_id"), "cell_id", "left_semi").agg(F.min_by("vec", "cell_id").alias("v")).scalar()
    each = base.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats)))).withColumn("_o", origin)
    size = F.least(F.col("n_total"), F.greatest(F.lit(2), F.floor(F.lit(fraction) * F.col("n_total") + 0.5)))
    key = F.concat_ws("/", F.lit(str(seed)), F.col("repeat").cast("string"))
    rows = cut_lineage(hash_sample(each, "cell_id", key, size=size, groups=["repeat"]))
    starts = rows.groupBy("repeat").agg(F.min_by("vec", F.struct(squared_distance("vec", "_o").alias("d"), "cell_id")).alias("_s"))
    apart = rows.join(starts, "repeat").select("repeat", "cell_id", "pseudotime", F.sqrt(squared_distance("vec", "_s")).alias("_d"))
    apart = cut_lineage(apart)
    ranked = _average_rank(_average_rank(apart, ["repeat"], "pseudotime", "_ra"), ["repeat"], "_d", "_rb")
    out = ranked.groupBy("repeat").agg(
        F.count(F.lit(1)).alias("n_cells"), F.when((F.max("_d") - F.min("_d") > 1e-12) & (F.min("_ra") < F.max("_ra")), F.corr("_ra", "_rb")).alias("spearman")
    )
    return out


def stability_score(repeats: DataFrame) -> DataFrame:
    return repeats.agg(F.count("spearman").alias("n_defined"), F.avg("spearman").alias("stability"))


def order_association(values: DataFrame, times: DataFrame, genes: DataFrame, min_abs_rho: float = 0.3, fdr: float = 0.05) -> DataFrame:
    """Spearman correlation of every gene with pseudotime, p, adjusted p, and the trend of discoveries.

    Unstored zeros share the lowest rank, so only stored values are ranked.
    """
    n = times.agg(F.count(F.lit(1)).cast("double").alias("n")).scalar()
    ranked = cut_lineage(_average_rank(times.select("cell_id", "pseudotime"), [], "pseudotime", "_rt").select("cell_id", "_rt"))
    total = ranked.agg(F.struct(F.sum("_rt").alias("s"), F.sum(F.col("_rt") ** 2).alias("ss")).alias("t")).scalar()
    stored = values.where(F.col("value") > 0).select("cell_id", "gene_id", F.col("value").cast("double").alias("value"))
    placed = _average_rank(stored, ["gene_id"], "value", "_rs").join(ranked, "cell_id")
    sums = placed.groupBy("gene_id").agg(
        F.count(F.lit(1)).alias("k"), F.sum("_rs").alias("s1"), F.sum(F.col("_rs") ** 2).alias("s2"),
        F.sum(F.col("_rs") * F.col("_rt")).alias("sx"), F.sum("_rt").alias("st"),
    )
    j = genes.select("gene_id").join(sums, "gene_id", "left").na.fill(0).withColumns({"n": n, "_t": total})
    z = F.col("n") - F.col("k")
    low, mid = (z + 1) / 2, (F.col("n") + 1) / 2
    # a stored value ranks above all z zeros
    cross = F.col("sx") + z * F.col("st") + low * (F.col("_t.s") - F.col("st")) - F.col("n") * mid * mid
    var_g = F.col("s2") + 2 * z * F.col("s1") + F.col("k") * z * z + z * low * low - F.col("n") * mid * mid
    var_t = F.col("_t.ss") - F.col("n") * mid * mid
    ok = (var_g > 1e-9) & (var_t > 1e-9)
    rho = F.when(ok, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cross / F.sqrt(var_g * var_t)))).otherwise(F.lit(0.0))
    r = j.select("gene_id", "n", ok.alias("_ok"), rho.alias("spearman_rho"))
    t = F.when(F.abs("spearman_rho") < 1, F.col("spearman_rho") * F.sqrt((F.col("n") - 2) / (1 - F.col("spearman_rho") ** 2))).otherwise(F.lit(float("inf")))
    scored = r.withColumn("_tt", F.when(F.col("_ok"), t)).withColumn("p_value", F.coalesce(t_two_sided("_tt", F.col("n") - 2), F.lit(1.0)))
    out = benjamini_hochberg(scored.select("gene_id", "spearman_rho", "p_value"))
    hit = (F.col("fdr_q_value") <= fdr) & (F.abs("spearman_rho") >= min_abs_rho)
    return out.withColumn("trend", F.when(hit, F.when(F.col("spearman_rho") >= 0, "upregulated_along_pseudotime").otherwise("downregulated_along_pseudotime")))


def absorption(edges: DataFrame, terminals: DataFrame, tolerance: float = 1e-6, max_rounds: int = 1000, check_every: int = 5) -> DataFrame:
    """Probability of reaching each terminal set from every cell of a row-stochastic graph.

    ``terminals`` maps cells to a ``fate``. Each round moves probability one step
    back along the edges; rounds are checkpointed and stop when nothing moves
    by more than the tolerance. A cell that can reach no fate has no row.
    """
    fixed = cut_lineage(terminals.select("cell_id", "fate").distinct())
    free = cut_lineage(edges.join(fixed.select(F.col("cell_id").alias("src")), "src", "left_anti").select("src", "dst", "weight"))
    ends = fixed.withColumn("p", F.lit(1.0))
    now = ends
    for round_ in range(1, max_rounds + 1):
        step = free.join(now, free["dst"] == now["cell_id"]).groupBy(F.col("src").alias("cell_id"), "fate").agg(F.sum(F.col("weight") * F.col("p")).alias("p"))
        new = cut_lineage(ends.unionByName(step))
        if round_ % check_every == 0:
            gap = new.withColumnRenamed("p", "_n").join(now, ["cell_id", "fate"], "full_outer").agg(
                F.max(F.abs(F.coalesce("_n", F.lit(0.0)) - F.coalesce("p", F.lit(0.0))))
            ).first()[0]
            if gap is None or gap < tolerance:
                return new.select("cell_id", "fate", F.col("p").alias("probability"))
        now = new
    raise ValueError("Absorption did not settle within max_rounds")


def flow_index(edges: DataFrame, labels: DataFrame, pairs: DataFrame) -> DataFrame:
    """Forward and reverse mean flow between named groups, and (f - r) / (f + r). ``pairs`` has source and target."""
    totals = edges.where(F.col("weight") > 0).groupBy("src").agg(F.sum("weight").alias("_t"))
    share = edges.where(F.col("weight") > 0).join(totals, "src").select("src", "dst", (F.col("weight") / F.col("_t")).alias("w"))
    a = labels.select(F.col("cell_id").alias("src"), F.col("label").alias("source"))
    b = labels.select(F.col("cell_id").alias("dst"), F.col("label").alias("target"))
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("_n"))
    flow = share.join(a, "src").join(b, "dst").groupBy("source", "target").agg(F.sum("w").alias("_w"), F.count(F.lit(1)).alias("_e")).join(
        sizes.withColumnRenamed("label", "source"), "source"
    ).select("source", "target", (F.col("_w") / F.col("_n")).alias("flow"), "_e")
    back = flow.select(F.col("source").alias("target"), F.col("target").alias("source"), F.col("flow").alias("back"), F.col("_e").alias("_be"))
    j = pairs.select("source", "target").distinct().join(flow, ["source", "target"], "left").join(back, ["source", "target"], "left")
    f, r = F.coalesce("flow", F.lit(0.0)), F.coalesce("back", F.lit(0.0))
    return j.select(
        "source", "target", f.alias("forward_flow"), r.alias("reverse_flow"), F.when(f + r > 0, (f - r) / (f + r)).otherwise(F.lit(0.0)).alias("direction_index"),
        (F.coalesce("_e", F.lit(0)) + F.coalesce("_be", F.lit(0))).alias("cross_state_edges"),
    )
