import numpy as np
import pytest
from pyspark.sql import functions as F

from countloom.operators import embed, spatial as sx


@pytest.fixture(scope="module")
def blobs(spark):
    """Three far-apart groups of points in two dimensions."""
    rng = np.random.default_rng(9)
    points = np.vstack([rng.normal(c, 0.2, size=(30, 2)) for c in ((0, 0), (10, 0), (0, 10))])
    rows = [(i, str(i // 30), [float(x) for x in p]) for i, p in enumerate(points)]
    return spark.createDataFrame(rows, "cell_id long, truth string, vec array<double>")


def _pure(df, found, truth="truth"):
    table = df.groupBy(found, truth).count().groupBy(found).agg(F.count(F.lit(1)).alias("n"))
    return {r["n"] for r in table.collect()} == {1}


def test_kmeans_finds_separate_groups(blobs):
    out = embed.kmeans(blobs, 3)
    assert out.select("cluster").distinct().count() == 3 and _pure(out, "cluster")
    score = embed.silhouette(out.withColumn("label", F.col("cluster"))).first()
    assert score["silhouette"] > 0.9 and score["n_sampled"] == 90
    assert embed.silhouette(out.withColumn("label", F.lit("one"))).first()["silhouette"] == 0.0


def test_batch_mixing_extremes(blobs):
    apart = blobs.withColumn("batch", F.col("truth"))
    assert embed.batch_mixing(apart, k=5).first()["mixing_score"] == 0.0
    assert embed.batch_mixing(blobs.withColumn("batch", F.lit("b"))).first()["mixing_score"] == 1.0
    moved = embed.centre_batches(apart, strength=1.0)
    ends = moved.groupBy("batch").agg(F.avg(F.get("vec", F.lit(0))).alias("x")).agg(F.max("x") - F.min("x")).first()[0]
    assert abs(ends) < 1e-9


def test_domains_and_niches(blobs):
    cells = blobs.select("cell_id", "truth", F.get("vec", F.lit(0)).alias("x"), F.get("vec", F.lit(1)).alias("y"), F.lit("s").alias("section"))
    edges = sx.section_neighbors(cells, 4, columns=["x", "y"])
    graph = sx.symmetric_graph(edges)
    assert _pure(sx.spatial_domains(blobs, graph, 2, k=3), "domain")
    typed = cells.withColumn("cell_type", F.col("truth"))
    shares = sx.composition(edges, typed)
    found = sx.niches(shares, typed, ["0", "1", "2"], k=3)
    out = sx.niche_summary(found, ["0", "1", "2"]).collect()
    assert sorted(r["dominant_cell_type"] for r in out) == ["0", "1", "2"]
    assert {(r["cell_count"], r["dominant_cell_type_fraction"]) for r in out} == {(30, 1.0)}


def test_sub_states_split_one_type(spark):
    rng = np.random.default_rng(10)
    values, cells = [], []
    for i in range(60):
        cells.append((i, "Micro" if i < 45 else "Other"))
        for g in range(6):
            v = rng.poisson(20 if g // 2 == i % 3 else 1)
            if v:
                values.append((i, g, float(v)))
    values = spark.createDataFrame(values, "cell_id long, gene_id long, value double")
    cells = spark.createDataFrame(cells, "cell_id long, cell_type string")
    out = embed.sub_states(values, cells, "micro", components=3)
    assert out.count() == 45 and {r["sub_state"] for r in out.select("sub_state").distinct().collect()} == {"S1", "S2", "S3"}
    assert _pure(out.withColumn("truth", F.col("cell_id") % 3), "sub_state")
