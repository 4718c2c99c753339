"""Spatial graphs inside sections, autocorrelation, contacts and niches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from countloom.functions.moments import fourth_dev_with_zeros, mean_with_zeros, sq_dev_with_zeros
from countloom.functions.ranking import benjamini_hochberg, hash_shuffle_rank
from countloom.functions.shuffle import shuffled_places
from countloom.functions.special import normal_two_sided
from countloom.operators.checks import identity_missing
from countloom.operators.embed import kmeans
from countloom.operators.markers import group_sums, level_sizes
from countloom.operators.neighbors import exact_neighbors
from countloom.session import cut_lineage

# Column names that may hold coordinates, in order of preference.
COORDINATE_COLUMNS = [
    ("x_coord", "y_coord", "z_coord"), ("spatial_x", "spatial_y", "spatial_z"), ("x", "y", "z"), ("X", "Y", "Z"),
]


def coordinate_columns(cells: DataFrame) -> list[str]:
    for x, y, z in COORDINATE_COLUMNS:
        if x in cells.columns and y in cells.columns:
            return [x, y] + ([z] if z in cells.columns else [])
    raise ValueError("No measured coordinates; cell order cannot stand in for them")


def check_coordinates(cells: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row: cells, non-finite coordinates, total variance, and whether the layout is usable."""
    columns = columns or coordinate_columns(cells)
    bad = [F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf")) for c in columns]
    any_bad = bad[0]
    for b in bad[1:]:
        any_bad = any_bad | b
    spread = sum((F.coalesce(F.var_pop(c), F.lit(0.0)) for c in columns), F.lit(0.0))
    return cells.agg(
        F.lit(len(columns)).cast("long").alias("n_dims"), F.count(F.lit(1)).alias("n_cells"), F.count_if(any_bad).alias("n_nonfinite"), spread.alias("variance")
    ).withColumn("valid", (F.col("n_nonfinite") == 0) & (F.col("variance") > 1e-12))


def section_partitions(cells: DataFrame, section: str | None = None, donor: str | None = None) -> DataFrame:
    """Cells with a ``partition`` that keeps the sections of different donors apart.

    Several donors without section labels cannot share one coordinate system.
    """
    for c in (section, donor):
        if c and cells.where(identity_missing(F.col(c))).limit(1).count():
            raise ValueError(f"Column {c!r} has missing identities")
    if section is None and donor and cells.agg(F.coalesce(F.min(donor) != F.max(donor), F.lit(False))).first()[0]:
        raise ValueError("Several donors need observed sections")
    parts = [F.trim(F.col(c).cast("string")) for c in (donor, section) if c]
    return cells.withColumn("partition", F.to_json(F.array(*parts)) if parts else F.lit("[]"))


def section_sizes(partitioned: DataFrame) -> DataFrame:
    return partitioned.groupBy("partition").agg(F.count(F.lit(1)).alias("n_cells"))


def section_neighbors(cells: DataFrame, k: int = 6, metric: str = "euclidean", section: str | None = "section", columns: list[str] | None = None, block_rows: int = 2000) -> DataFrame:
    """Directed k-nearest edges inside sections; smaller sections give fewer neighbours."""
    columns = columns or coordinate_columns(cells)
    keep = ["cell_id"] + ([section] if section else [])
    points = cells.select(*keep, F.array(*[F.col(c).cast("double") for c in columns]).alias("vec"))
    return exact_neighbors(points, max(1, k), metric, section, block_rows)


def symmetric_graph(edges: DataFrame) -> DataFrame:
    """Both directions of every edge with weight 1, its distance, and the row-normalised weight."""
    both = edges.select("src", "dst", "distance").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "distance"))
    once = both.groupBy("src", "dst").agg(F.max("distance").alias("distance"))
    degree = once.groupBy("src").agg(F.count(F.lit(1)).alias("_d"))
    return once.join(degree, "src").select("src", "dst", "distance", F.lit(1.0).alias("weight"), (1.0 / F.col("_d")).alias("weight_norm"))


def check_graph(edges: DataFrame, cells: DataFrame, section: str = "section") -> DataFrame:
    """One row: edges with invalid weights, self edges, unknown ends, and edges between sections."""
    s = cells.select(F.col("cell_id").alias("src"), F.col(section).alias("_a"), F.lit(True).alias("_ka"))
    t = cells.select(F.col("cell_id").alias("dst"), F.col(section).alias("_b"), F.lit(True).alias("_kb"))
    w = F.col("weight")
    bad = w.isNull() | F.isnan(w) | (w < 0) | (w == float("inf"))
    return edges.join(s, "src", "left").join(t, "dst", "left").agg(
        F.count(F.lit(1)).alias("n_edges"), F.count_if(bad).alias("n_invalid"), F.count_if(F.col("src") == F.col("dst")).alias("n_self"),
        F.count_if(F.col("_ka").isNull() | F.col("_kb").isNull()).alias("n_unknown"), F.count_if(F.col("_a") != F.col("_b")).alias("n_cross_section"),
    ).withColumn("valid", F.col("n_invalid") + F.col("n_self") + F.col("n_unknown") + F.col("n_cross_section") == 0)


def smooth_embedding(vectors: DataFrame, graph: DataFrame, dims: int, strength: float = 0.3) -> DataFrame:
    """(1 - s) own vector + s mean of the neighbours; a cell without neighbours has a zero mean."""
    s = max(0.0, min(1.0, strength))
    other = vectors.select(F.col("cell_id").alias("dst"), F.col("vec").alias("_v"))
    means = graph.join(other, "dst").groupBy("src").agg(*[F.sum(F.col("weight_norm") * F.get("_v", F.lit(i))).alias(f"_{i}") for i in range(dims)])
    mixed = F.array(*[(1 - s) * F.get("vec", F.lit(i)) + s * F.coalesce(f"_{i}", F.lit(0.0)) for i in range(dims)])
    return vectors.join(means.withColumnRenamed("src", "cell_id"), "cell_id", "left").select(*[c for c in vectors.columns if c != "vec"], mixed.alias("vec"))


def spatial_domains(vectors: DataFrame, graph: DataFrame, dims: int, k: int = 5, strength: float = 0.3, seed: int = 42) -> DataFrame:
    """Clusters of the smoothed embedding, as ``domain``."""
    return kmeans(smooth_embedding(vectors, graph, dims, strength), k, seed).withColumnRenamed("cluster", "domain").drop("vec")


def _graph_sums(graph: DataFrame) -> Column:
    """S0, S1 and S2 of a weight table, computed once as one scalar struct."""
    both = graph.select("src", "dst", "weight").unionByName(graph.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    paired = both.groupBy("src", "dst").agg(F.sum("weight").alias("w"))
    ends = graph.select(F.explode(F.array("src", "dst")).alias("cell_id"), "weight").groupBy("cell_id").agg(F.sum("weight").alias("w"))
    return graph.agg(F.sum("weight").alias("s0")).select(F.struct(
        "s0", paired.agg((0.5 * F.sum(F.col("w") ** 2)).alias("s")).scalar().alias("s1"), ends.agg(F.sum(F.col("w") ** 2).alias("s")).scalar().alias("s2")
    ).alias("g")).scalar()


def autocorrelation(values: DataFrame, cells: DataFrame, genes: DataFrame, graph: DataFrame) -> DataFrame:
    """Moran's I and Geary's C of every gene with randomisation variances, z and two-sided p.

    Zeros are never stored: moments merge the zero block in, and only edges
    whose ends both hold a value enter the cross products.
    """
    graph = cut_lineage(graph.select("src", "dst", "weight"))
    n_cells = cells.agg(F.count(F.lit(1)).cast("double").alias("n")).scalar()
    x = values.select("cell_id", "gene_id", F.col("value").cast("double").alias("x")).where(F.col("x") != 0)
    ends = graph.select(F.explode(F.array("src", "dst")).alias("cell_id"), "weight").groupBy("cell_id").agg(F.sum("weight").alias("deg"))
    k, mean, var = F.col("k"), F.col("mean"), F.col("var")
    stats = x.join(ends, "cell_id", "left").groupBy("gene_id").agg(
        F.count(F.lit(1)).cast("double").alias("k"), F.avg("x").alias("mean"), F.var_pop("x").alias("var"), F.skewness("x").alias("skew"), F.kurtosis("x").alias("kurt"),
        F.sum(F.coalesce("deg", F.lit(0.0)) * F.col("x")).alias("a1"), F.sum(F.coalesce("deg", F.lit(0.0)) * F.col("x") ** 2).alias("a2"),
    )
    a = x.select(F.col("cell_id").alias("src"), "gene_id", F.col("x").alias("xi"))
    b = x.select(F.col("cell_id").alias("dst"), "gene_id", F.col("x").alias("xj"))
    cross = graph.join(a, "src").join(b, ["dst", "gene_id"]).groupBy("gene_id").agg(F.sum(F.col("weight") * F.col("xi") * F.col("xj")).alias("cross"))
    j = genes.select("gene_id").join(stats, "gene_id", "left").join(cross, "gene_id", "left").na.fill(0.0).withColumns({"n": n_cells, "g": _graph_sums(graph)})
    n = F.col("n")
    stored_m2 = var * k
    stored_m3 = F.when(var > 0, F.col("skew") * k * F.pow(var, 1.5)).otherwise(F.lit(0.0))
    stored_m4 = F.when(var > 0, (F.col("kurt") + 3) * k * var * var).otherwise(F.lit(0.0))
    j = j.select(
        "gene_id", "n", F.coalesce("g.s0", F.lit(0.0)).alias("s0"), F.col("g.s1").alias("s1"), F.col("g.s2").alias("s2"), "a1", "a2", "cross",
        mean_with_zeros(k, mean, n).alias("m"), sq_dev_with_zeros(k, mean, var, n).alias("m2"),
        fourth_dev_with_zeros(k, mean, stored_m2, stored_m3, stored_m4, n).alias("m4"),
    )
    m, m2, s0, s1, s2 = (F.col(c) for c in ("m", "m2", "s0", "s1", "s2"))
    small, flat = n < 4, (m2 <= 1e-15) | (s0 <= 1e-15)
    num = F.col("cross") - m * F.col("a1") + m * m * s0
    b2 = n * F.col("m4") / (m2 * m2)
    ei = -1.0 / (n - 1)
    top = n * ((n * n - 3 * n + 3) * s1 - n * s2 + 3 * s0 * s0) - b2 * ((n * n - n) * s1 - 2 * n * s2 + 6 * s0 * s0)
    low = (n - 1) * (n - 2) * (n - 3) * s0 * s0
    var_i = F.when(low <= 1e-15, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), top / low - ei * ei))
    diff = F.col("a2") - 2 * F.col("cross")
    ca = (n - 1) * s1 * (n * n - 3 * n + 3 - (n - 1) * b2)
    cb = -0.25 * (n - 1) * s2 * (n * n + 3 * n - 6 - (n * n - n + 2) * b2)
    cc = s0 * s0 * (n * n - 3 - (n - 1) * (n - 1) * b2)
    raw_c = F.when(low <= 1e-15, F.lit(0.0)).otherwise((ca + cb + cc) / low)
    normal_c = ((2 * s1 + s2) * (n - 1) - 4 * s0 * s0) / (2 * (n + 1) * s0 * s0)
    var_c = F.when(raw_c <= 0, F.greatest(F.lit(1e-12), normal_c)).otherwise(raw_c)

    def pick(tiny, degenerate, value):
        return F.when(small, F.lit(tiny)).when(flat, degenerate).otherwise(value)

    out = j.select(
        "gene_id", pick(0.0, F.lit(0.0), n / s0 * num / m2).alias("moran_i"), pick(0.0, ei, ei).alias("moran_expected"), pick(0.0, F.lit(0.0), var_i).alias("moran_variance"),
        pick(1.0, F.lit(1.0), (n - 1) / (2 * s0) * diff / m2).alias("geary_c"), F.lit(1.0).alias("geary_expected"), pick(0.0, F.lit(0.0), var_c).alias("geary_variance"),
    )
    z_i = F.when(F.col("moran_variance") > 1e-15, (F.col("moran_i") - F.col("moran_expected")) / F.sqrt("moran_variance")).otherwise(F.lit(0.0))
    z_c = F.when(F.col("geary_variance") > 1e-15, (F.col("geary_c") - 1.0) / F.sqrt("geary_variance")).otherwise(F.lit(0.0))
    return out.withColumns({"moran_z": z_i, "geary_z": z_c}).withColumns({"moran_p": normal_two_sided("moran_z"), "geary_p": normal_two_sided("geary_z")})


def spatially_variable(values: DataFrame, cells: DataFrame, genes: DataFrame, graph: DataFrame, section: str | None = None, fdr: float = 0.05, min_moran: float = 0.15) -> DataFrame:
    """Autocorrelation of every gene with adjusted p and the discovery flag; several sections are refused."""
    if section and cells.agg(F.coalesce(F.min(section) != F.max(section), F.lit(False))).first()[0]:
        raise ValueError("The randomisation null supports one section; test sections apart")
    out = benjamini_hochberg(autocorrelation(values, cells, genes, graph), "moran_p")
    return out.withColumn("is_spatially_variable", (F.col("fdr_q_value") < fdr) & (F.col("moran_i") > min_moran))


def _typed(edges: DataFrame, cells: DataFrame, cell_type: str) -> DataFrame:
    a = cells.select(F.col("cell_id").alias("src"), F.col(cell_type).cast("string").alias("source"))
    b = cells.select(F.col("cell_id").alias("dst"), F.col(cell_type).cast("string").alias("target"))
    return edges.join(a, "src").join(b, "dst")


def _type_grid(cells: DataFrame, cell_type: str) -> DataFrame:
    sizes = level_sizes(cells, cell_type)
    return cells.sparkSession.range(1).select(F.inline(sizes), sizes.alias("_s")).select(
        F.col("level").alias("source"), F.col("n").alias("n_source"), F.inline("_s")
    ).withColumnsRenamed({"level": "target", "n": "n_target"})


def contact_density(graph: DataFrame, cells: DataFrame, cell_type: str = "cell_type") -> DataFrame:
    """Summed weight between every two cell types over the product of their sizes."""
    sums = _typed(graph, cells, cell_type).groupBy("source", "target").agg(F.sum("weight").alias("contact"))
    return _type_grid(cells, cell_type).join(sums, ["source", "target"], "left").select(
        "source", "target", F.coalesce("contact", F.lit(0.0)).alias("contact"),
        (F.coalesce("contact", F.lit(0.0)) / (F.col("n_source") * F.col("n_target"))).alias("density"),
    )


def pair_scores(values: DataFrame, cells: DataFrame, genes: DataFrame, pairs: DataFrame, graph: DataFrame, cell_type: str = "cell_type") -> DataFrame:
    """Ligand-receptor score of every two types: root of mean ligand times mean receptor, times contact density.

    Genes are matched without regard to case; the table holds every combination, zeros included.
    """
    named = genes.groupBy(F.lower("gene_name").alias("_g")).agg(F.max_by("gene_id", "gene_index").alias("gene_id"))
    used = pairs.select("ligand", "receptor", F.lower("ligand").alias("_l"), F.lower("receptor").alias("_r")).join(
        named.select(F.col("_g").alias("_l"), F.col("gene_id").alias("_lid")), "_l"
    ).join(named.select(F.col("_g").alias("_r"), F.col("gene_id").alias("_rid")), "_r").select("ligand", "receptor", "_lid", "_rid")
    wanted = used.select(F.explode(F.array("_lid", "_rid")).alias("gene_id")).distinct()
    sizes = cells.groupBy(F.col(cell_type).cast("string").alias("level")).agg(F.count(F.lit(1)).alias("n"))
    means = group_sums(values.join(wanted, "gene_id", "left_semi"), cells, cell_type).join(sizes, "level").select("level", "gene_id", (F.col("total") / F.col("n")).alias("m"))
    dens = contact_density(graph, cells, cell_type)
    types = dens.agg(F.collect_list(F.struct("source", "target", "density")).alias("l")).scalar()
    grid = used.select("*", F.inline(types))
    lig = means.select(F.col("level").alias("source"), F.col("gene_id").alias("_lid"), F.col("m").alias("_lm"))
    rec = means.select(F.col("level").alias("target"), F.col("gene_id").alias("_rid"), F.col("m").alias("_rm"))
    l, r = F.coalesce("_lm", F.lit(0.0)), F.coalesce("_rm", F.lit(0.0))
    raw = F.sqrt(F.greatest(F.lit(0.0), l * r))
    return grid.join(lig, ["source", "_lid"], "left").join(rec, ["target", "_rid"], "left").select(
        "source", "target", "ligand", "receptor", l.alias("mean_ligand_expr"), r.alias("mean_receptor_expr"), raw.alias("raw_score"),
        F.col("density").alias("spatial_weight"), (raw * F.col("density")).alias("spatial_score"),
    )


def contact_permutations(graph: DataFrame, cells: DataFrame, n_permutations: int = 100, seed: int = 42, cell_type: str = "cell_type", section: str = "section", perms_per_batch: int = 50) -> DataFrame:
    """How often shuffled labels reach the observed contact of each type pair; labels move inside sections only.

    Cells are ranked once, in a seeded hash order of their section. In every permutation a cell's place follows from its
    rank by arithmetic (``shuffled_places``), and its label from the place and the label counts of its section. So no
    permutation is sorted, and no list of cells is built: each cell carries one array of shuffled labels, and edges are
    read once per batch.
    """
    n = max(10, n_permutations)
    labels = cut_lineage(cells.select("cell_id", F.col(section).cast("string").alias("section"), F.col(cell_type).cast("string").alias("type")))
    graph = cut_lineage(graph.select("src", "dst", "weight"))
    counts = labels.groupBy("section", "type").agg(F.count(F.lit(1)).alias("c")).groupBy("section").agg(F.sort_array(F.collect_list(F.struct("type", "c"))).alias("_l"))
    counts = counts.select("section", F.transform("_l", lambda x: x["type"]).alias("types"), F.transform("_l", lambda x: x["c"]).alias("counts"))
    ranked = cut_lineage(hash_shuffle_rank(labels, ["section"], "cell_id", seed, "pos").join(counts, "section").select("cell_id", "section", "pos", "types", "counts"))
    id_type = labels.schema["cell_id"].dataType.simpleString()

    def shuffled(numbers: np.ndarray):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for _, rows in batch.groupby("section", dropna=False, sort=False):
                    upto = np.cumsum(np.asarray(rows["counts"].iloc[0], np.int64))
                    places = shuffled_places(rows["pos"].to_numpy() - 1, np.full(len(rows), upto[-1]), seed, numbers)
                    drawn = np.asarray(rows["types"].iloc[0], object)[np.searchsorted(upto, places, side="right")]
                    yield pd.DataFrame({"cell_id": rows["cell_id"].to_numpy(), "ts": list(drawn)})

        return run

    total = None
    for start in range(1, n + 1, perms_per_batch):
        stop = min(n, start + perms_per_batch - 1)
        packed = cut_lineage(ranked.mapInPandas(shuffled(np.arange(start, stop + 1)), f"cell_id {id_type}, ts array<string>"))
        a, b = packed.select(F.col("cell_id").alias("src"), F.col("ts").alias("_a")), packed.select(F.col("cell_id").alias("dst"), F.col("ts").alias("_b"))
        both = graph.join(a, "src").join(b, "dst").select("weight", F.posexplode(F.arrays_zip("_a", "_b")).alias("p", "z"))
        sums = both.groupBy("p", F.col("z._a").alias("source"), F.col("z._b").alias("target")).agg(F.sum("weight").alias("s"))
        sums = cut_lineage(sums.withColumn("p", F.col("p") + start))
        total = sums if total is None else total.unionByName(sums)
    observed = contact_density(graph, labels, "type")
    hits = total.join(observed.select("source", "target", "contact"), ["source", "target"]).groupBy("source", "target").agg(
        F.count_if(F.col("s") >= F.col("contact") * (1 - 1e-12)).alias("_ge")
    )
    reached = F.when(F.col("contact") <= 0, F.lit(n)).otherwise(F.coalesce("_ge", F.lit(0)))
    return observed.join(hits, ["source", "target"], "left").select("source", "target", "contact", "density", ((reached + 1.0) / (n + 1.0)).alias("contact_p"))


def pair_significance(scores: DataFrame, permuted: DataFrame, fdr: float = 0.05) -> DataFrame:
    """Permutation p of every pair score: the contact p where expression is positive, else 1; adjusted over all rows."""
    j = scores.join(permuted.select("source", "target", "contact_p"), ["source", "target"], "left")
    out = benjamini_hochberg(j.withColumn("p_value", F.when(F.col("raw_score") > 0, F.col("contact_p")).otherwise(F.lit(1.0))).drop("contact_p"))
    return out.withColumn("is_significant", (F.col("fdr_q_value") < fdr) & (F.col("spatial_score") > 0))


def composition(edges: DataFrame, cells: DataFrame, cell_type: str = "cell_type") -> DataFrame:
    """Share of each type among the directed neighbours of a cell; absent types have no row."""
    typed = edges.join(cells.select(F.col("cell_id").alias("dst"), F.col(cell_type).cast("string").alias("cell_type")), "dst")
    counts = typed.groupBy("src", "cell_type").agg(F.count(F.lit(1)).alias("_n"))
    sizes = counts.groupBy("src").agg(F.sum("_n").alias("_t"))
    return counts.join(sizes, "src").select(F.col("src").alias("cell_id"), "cell_type", (F.col("_n") / F.col("_t")).alias("share"))


def contact_enrichment(edges: DataFrame, cells: DataFrame, k: int, cell_type: str = "cell_type", section: str = "section") -> DataFrame:
    """Observed directed contacts over those expected from mixing inside each section, each plus one."""
    observed = _typed(edges, cells, cell_type).groupBy("source", "target").agg(F.count(F.lit(1)).alias("_o"))
    mix = cells.groupBy(F.col(section).alias("_s"), F.col(cell_type).cast("string").alias("t")).agg(F.count(F.lit(1)).alias("n"))
    size = mix.groupBy("_s").agg(F.sum("n").alias("_n"))
    a = mix.select("_s", F.col("t").alias("source"), F.col("n").alias("na")).join(size, "_s")
    b = mix.select("_s", F.col("t").alias("target"), F.col("n").alias("nb"))
    near = F.least(F.lit(k), F.col("_n") - 1)
    others = F.greatest(F.lit(0), F.col("nb") - F.when(F.col("source") == F.col("target"), 1).otherwise(0))
    expected = a.join(b, "_s").where(F.col("_n") > 1).groupBy("source", "target").agg(F.sum(F.col("na") * others * near / (F.col("_n") - 1)).alias("_e"))
    obs, exp = F.coalesce("_o", F.lit(0)).cast("double"), F.coalesce("_e", F.lit(0.0))
    return _type_grid(cells, cell_type).join(observed, ["source", "target"], "left").join(expected, ["source", "target"], "left").select(
        "source", "target", obs.alias("observed_contacts"), exp.alias("expected_contacts"), ((obs + 1) / (exp + 1)).alias("enrichment_ratio")
    )


def section_moran(values: DataFrame, cells: DataFrame, genes: DataFrame, graph: DataFrame, first: int | None = None, section: str = "section") -> DataFrame:
    """Moran's I with values centred inside sections; constant genes are left out. ``first`` asks for the first genes by index only."""
    chosen = (genes if first is None else genes.orderBy("gene_index").limit(first)).select("gene_id")
    where = cells.select("cell_id", F.col(section).alias("_s"))
    sizes = where.groupBy("_s").agg(F.count(F.lit(1)).alias("_n"))
    graph = cut_lineage(graph.select("src", "dst", "weight"))
    ends = graph.select(F.explode(F.array("src", "dst")).alias("cell_id"), "weight").groupBy("cell_id").agg(F.sum("weight").alias("deg"))
    flow = graph.join(where.withColumnRenamed("cell_id", "src"), "src").groupBy("_s").agg(F.sum("weight").alias("_s0"))
    x = values.join(chosen, "gene_id", "left_semi").select("cell_id", "gene_id", F.col("value").cast("double").alias("x"))
    per = x.join(where, "cell_id").join(ends, "cell_id", "left").groupBy("gene_id", "_s").agg(
        F.sum("x").alias("sx"), F.sum(F.col("x") ** 2).alias("sxx"), F.sum(F.coalesce("deg", F.lit(0.0)) * F.col("x")).alias("a1")
    ).join(sizes, "_s").join(flow, "_s", "left").withColumn("m", F.col("sx") / F.col("_n"))
    sums = per.groupBy("gene_id").agg(
        F.sum(F.col("sxx") - F.col("_n") * F.col("m") ** 2).alias("den"),
        F.sum(F.col("m") ** 2 * F.coalesce("_s0", F.lit(0.0)) - F.col("m") * F.col("a1")).alias("shift"),
    )
    a = x.select(F.col("cell_id").alias("src"), "gene_id", F.col("x").alias("xi"))
    b = x.select(F.col("cell_id").alias("dst"), "gene_id", F.col("x").alias("xj"))
    cross = graph.join(a, "src").join(b, ["dst", "gene_id"]).groupBy("gene_id").agg(F.sum(F.col("weight") * F.col("xi") * F.col("xj")).alias("cross"))
    n = cells.agg(F.count(F.lit(1)).cast("double").alias("n")).scalar()
    s0 = graph.agg(F.sum("weight").alias("s")).scalar()
    return sums.where(F.col("den") > 1e-8).join(cross, "gene_id", "left").select(
        "gene_id", F.round(n / s0 * (F.coalesce("cross", F.lit(0.0)) + F.col("shift")) / F.col("den"), 4).alias("moran_i")
    )


def niches(shares: DataFrame, cells: DataFrame, types: list[str], k: int = 5, seed: int = 42) -> DataFrame:
    """Clusters of neighbourhood composition, as ``niche``, for every cell. ``types`` is the short list of cell types."""
    wide = shares.groupBy("cell_id").agg(F.array(*[F.coalesce(F.sum(F.when(F.col("cell_type") == t, F.col("share"))), F.lit(0.0)) for t in types]).alias("vec"))
    none = F.array(*[F.lit(0.0) for _ in types])
    full = cells.select("cell_id").join(wide, "cell_id", "left").select("cell_id", F.coalesce("vec", none).alias("vec"))
    return kmeans(full, k, seed).withColumnRenamed("cluster", "niche")


def niche_summary(labelled: DataFrame, types: list[str]) -> DataFrame:
    """Size, dominant type and its mean share per niche; ties go to the first type."""
    means = labelled.groupBy("niche").agg(
        F.count(F.lit(1)).alias("cell_count"),
        F.array(*[F.struct(F.avg(F.get("vec", F.lit(i))).alias("share"), F.lit(-i).alias("o"), F.lit(t).alias("t")) for i, t in enumerate(types)]).alias("_m"),
    ).withColumn("_top", F.array_max("_m"))
    return means.select(
        F.concat(F.lit("Niche_"), F.col("niche").cast("string")).alias("niche_id"), "cell_count", F.col("_top.t").alias("dominant_cell_type"), F.col("_top.share").alias("dominant_cell_type_fraction")
    )
