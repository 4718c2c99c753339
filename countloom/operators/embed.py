"""Principal components, batch centring, clustering and their quality scores."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from countloom.functions.ranking import hash_sample
from countloom.operators.checks import subset_by_label
from countloom.operators.markers import group_sums
from countloom.operators.lowrank import principal_components
from countloom.operators.neighbors import exact_neighbors
from countloom.session import cut_lineage


def pca_scores(values: DataFrame, cells: DataFrame, k: int = 20, centre: bool = False, genes: DataFrame | None = None) -> DataFrame:
    """Component scores of every cell from the long value table: cell_id, vec.

    ``centre=False`` is the uncentred decomposition used for sparse input.
    Signs are fixed so that the largest loading is positive. Any number of
    genes; see ``lowrank.principal_components``.
    """
    used = values if genes is None else values.join(genes.select("gene_id"), "gene_id", "left_semi")
    used = used.join(cells.select("cell_id"), "cell_id", "left_semi")
    return principal_components(used, cells, k, centre)[0]


def centre_batches(vectors: DataFrame, batch: str = "batch", strength: float = 0.8) -> DataFrame:
    """Move each batch mean towards the global mean."""
    v = array_to_vector("vec")
    means = vectors.groupBy(batch).agg(vector_to_array(Summarizer.mean(v)).alias("_m"))
    overall = vectors.agg(vector_to_array(Summarizer.mean(v)).alias("m")).scalar()
    shift = means.withColumn("_g", overall).select(batch, F.zip_with("_m", "_g", lambda m, g: (m - g) * strength).alias("_s"))
    return vectors.join(shift, batch).select(*[c for c in vectors.columns if c != "vec"], F.zip_with("vec", "_s", lambda x, s: x - s).alias("vec"))


def _sample_top(queries, k):
    """Keep, per sampled cell, the k nearest cells seen in a partition."""
    ids, vecs = queries

    def run(batches):
        best = [([], [], []) for _ in ids]
        for batch in batches:
            if not len(batch):
                continue
            other, cell, group = np.vstack(batch["vec"].to_numpy()).astype(float), batch["cell_id"].to_numpy(), batch["batch"].to_numpy()
            for q, (i, x) in enumerate(zip(ids, vecs)):
                d = np.sqrt(((other - x) ** 2).sum(axis=1))
                ok = cell != i
                dist, who, grp = np.concatenate([best[q][0], d[ok]]), np.concatenate([best[q][1], cell[ok]]), np.concatenate([best[q][2], group[ok]])
                keep = np.lexsort((who, dist))[:k]
                best[q] = (dist[keep], who[keep], grp[keep])
        for q, i in enumerate(ids):
            if len(best[q][0]):
                yield pd.DataFrame({"query": i, "cell_id": best[q][1], "batch": best[q][2], "distance": best[q][0]})

    return run


def batch_mixing(vectors: DataFrame, batch: str = "batch", k: int = 15, sample: int = 300, seed: int = 42) -> DataFrame:
    """Mean share of other-batch cells among the k nearest, over a fixed number of sampled cells.

    The sample, at most ``sample`` vectors, travels to the tasks; each partition
    answers with its own k nearest per sampled cell.
    """
    rows = vectors.select("cell_id", F.col(batch).cast("string").alias("batch"), "vec")
    drawn = hash_sample(rows, "cell_id", seed, n=sample).collect()
    n, n_batches = rows.agg(F.count(F.lit(1)), F.countDistinct("batch")).first()
    spark = vectors.sparkSession
    if n_batches <= 1 or n <= 1:
        return spark.range(1).select(F.lit(len(drawn)).cast("long").alias("n_sampled"), F.lit(1.0).alias("mixing_score"))
    k = min(max(1, k), n - 1)
    queries = ([r["cell_id"] for r in drawn], [np.array(r["vec"], dtype=float) for r in drawn])
    kind = rows.schema["cell_id"].dataType.simpleString()
    top = rows.mapInPandas(_sample_top(queries, k), f"query {kind}, cell_id {kind}, batch string, distance double")
    own = rows.select(F.col("cell_id").alias("query"), F.col("batch").alias("_own"))
    best = top.withColumn("_r", F.row_number().over(W.partitionBy("query").orderBy("distance", "cell_id"))).where(F.col("_r") <= k)
    per = best.join(own, "query").groupBy("query").agg((1 - F.count_if(F.col("batch") == F.col("_own")) / k).alias("_s"))
    return per.agg(F.count(F.lit(1)).alias("n_sampled"), F.avg("_s").alias("mixing_score"))


def _sample_sums(queries):
    ids, vecs = queries

    def run(batches):
        total: dict = {}
        for batch in batches:
            if not len(batch):
                continue
            other, cell, label = np.vstack(batch["vec"].to_numpy()).astype(float), batch["cell_id"].to_numpy(), batch["label"].to_numpy()
            names, code = np.unique(label, return_inverse=True)
            for i, x in zip(ids, vecs):
                d = np.sqrt(((other - x) ** 2).sum(axis=1))
                ok = cell != i
                sums, counts = np.bincount(code[ok], d[ok], len(names)), np.bincount(code[ok], minlength=len(names))
                for name, s, c in zip(names, sums, counts):
                    if c:
                        old = total.get((i, name), (0.0, 0))
                        total[(i, name)] = (old[0] + s, old[1] + int(c))
        if total:
            yield pd.DataFrame([(i, n, s, c) for (i, n), (s, c) in total.items()], columns=["query", "label", "s", "n"])

    return run


def silhouette(vectors: DataFrame, label: str = "label", sample: int = 200, seed: int = 42) -> DataFrame:
    """Mean Euclidean silhouette over a fixed number of sampled cells against all cells.

    A cell alone in its cluster has own distance 0; a single cluster scores 0.
    """
    rows = vectors.select("cell_id", F.col(label).cast("string").alias("label"), "vec")
    drawn = hash_sample(rows, "cell_id", seed, n=sample).collect()
    queries = ([r["cell_id"] for r in drawn], [np.array(r["vec"], dtype=float) for r in drawn])
    kind = rows.schema["cell_id"].dataType.simpleString()
    parts = rows.mapInPandas(_sample_sums(queries), f"query {kind}, label string, s double, n long")
    own = rows.select(F.col("cell_id").alias("query"), F.col("label").alias("_own")).where(F.col("query").isin(queries[0]))
    means = parts.groupBy("query", "label").agg((F.sum("s") / F.sum("n")).alias("m"))
    per = own.join(means, "query", "left").groupBy("query", "_own").agg(
        F.coalesce(F.max(F.when(F.col("label") == F.col("_own"), F.col("m"))), F.lit(0.0)).alias("a"),
        F.min(F.when(F.col("label") != F.col("_own"), F.col("m"))).alias("b"),
    )
    n_labels = rows.agg(F.countDistinct("label").alias("n")).scalar()
    b = F.coalesce("b", F.lit(0.0))
    score = F.when(F.greatest(F.col("a"), b) > 0, (b - F.col("a")) / F.greatest(F.col("a"), b)).otherwise(F.lit(0.0))
    return per.agg(F.count(F.lit(1)).alias("n_sampled"), F.avg(score).alias("_s")).select(
        "n_sampled", F.when(n_labels > 1, F.col("_s")).otherwise(F.lit(0.0)).alias("silhouette")
    )


def kmeans(vectors: DataFrame, k: int = 4, seed: int = 42, max_iter: int = 50) -> DataFrame:
    """Lloyd clustering by Spark ML: every column of ``vectors`` plus an integer ``cluster``.

    Fewer than two clusters are one, cluster 0. The vectors are checkpointed, as every iteration reads them.
    """
    if k < 2:
        return vectors.withColumn("cluster", F.lit(0))
    data = cut_lineage(vectors).withColumn("_features", array_to_vector("vec"))
    model = KMeans(k=k, seed=seed, maxIter=max_iter, featuresCol="_features", predictionCol="cluster").fit(data)
    return model.transform(data).drop("_features")


def display_coordinates(vectors: DataFrame) -> DataFrame:
    """Two display coordinates from the first two components."""
    a, b = F.get("vec", F.lit(0)), F.get("vec", F.lit(1))
    second = F.coalesce(b, a + 0.5 * F.cos(a))
    return vectors.select("cell_id", (a + 0.5 * F.sin(F.coalesce(b, a))).alias("x"), second.alias("y"))


def _resolved_markers(markers: DataFrame, genes: DataFrame, exact_only: bool) -> DataFrame:
    """Marker symbols as gene ids: as written, else capitalised, upper or lower case."""
    name = F.col("marker")
    forms = [name] if exact_only else [name, F.concat(F.upper(F.substring(name, 1, 1)), F.lower(F.expr("substring(marker, 2)"))), F.upper(name), F.lower(name)]
    tried = markers.select("label", "label_order", "marker", F.posexplode(F.array(*forms)).alias("_try", "gene_name"))
    known = genes.select("gene_name", "gene_id")
    best = tried.join(known, "gene_name").groupBy("label", "label_order", "marker")
    if exact_only:
        return best.agg(F.collect_set("gene_id").alias("g")).select("label", "label_order", "marker", F.explode("g").alias("gene_id"))
    return best.agg(F.min(F.struct("_try", "gene_id")).alias("b")).select("label", "label_order", "marker", F.col("b.gene_id").alias("gene_id"))


def annotate_clusters(values: DataFrame, cells: DataFrame, genes: DataFrame, markers: DataFrame, cluster: str = "cluster", how: str = "sum") -> DataFrame:
    """Best label per cluster by its markers' mean values.

    ``how="sum"`` adds the means with case fallbacks and needs more than 0.05;
    ``how="mean"`` averages the markers present, needs more than 0 and takes
    names as written. Ties go to the label listed first (``label_order``).
    """
    resolved = _resolved_markers(markers, genes, how == "mean")
    sizes = cells.groupBy(F.col(cluster).cast("string").alias("level")).agg(F.count(F.lit(1)).alias("n"))
    sums = group_sums(values.join(resolved.select("gene_id").distinct(), "gene_id", "left_semi"), cells, cluster)
    levels = sizes.agg(F.collect_list(F.struct("level", "n")).alias("l")).scalar()
    grid = resolved.select("label", "label_order", "gene_id", F.inline(levels))
    means = grid.join(sums, ["level", "gene_id"], "left").withColumn("_m", F.coalesce("total", F.lit(0.0)) / F.col("n"))
    agg = F.sum("_m") if how == "sum" else F.avg("_m")
    scored = means.groupBy("level", "label", "label_order").agg(agg.alias("score"))
    best = scored.groupBy("level").agg(F.max(F.struct("score", (-F.col("label_order")).alias("o"), "label")).alias("b"))
    floor = 0.05 if how == "sum" else 0.0
    named = F.when(F.col("b.score") > floor, F.col("b.label")).otherwise(F.concat(F.lit("Cluster_"), "level"))
    return sizes.join(best, "level", "left").select(
        F.col("level").alias("cluster"), F.coalesce(named, F.concat(F.lit("Cluster_"), "level")).alias("cell_type"), F.col("b.score").alias("score")
    )


def sub_states(values: DataFrame, cells: DataFrame, label: str, column: str = "cell_type", k: int = 3, components: int = 15, genes: DataFrame | None = None, seed: int = 42) -> DataFrame:
    """States S1..Sk inside one cell type: subset, components, clustering."""
    chosen = subset_by_label(cells, label, column)
    scores = pca_scores(values.join(chosen.select("cell_id"), "cell_id", "left_semi"), chosen, components, genes=genes)
    found = kmeans(scores, k, seed)
    return found.select("cell_id", F.concat(F.lit("S"), (F.col("cluster") + 1).cast("string")).alias("sub_state"))


def knn_graph(vectors: DataFrame, k: int = 15, block_rows: int = 2000) -> DataFrame:
    """Exact k nearest neighbours of every cell in the embedding."""
    return exact_neighbors(vectors, k, block_rows=block_rows)


def squared_distance(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
