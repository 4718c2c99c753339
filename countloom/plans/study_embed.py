"""Queries for embeddings, clustering and ordering (M, T)."""

from pyspark.sql import functions as F

from countloom.operators import embed as em, normalize, ordering as od
from countloom.operators.neighbors_approx import approximate_neighbors
from countloom.plans import sql_parts as sp, views as v
from countloom.plans.catalog import query
from countloom.plans.study_donors import rounded
from countloom.plans.study_qc import LOGN


def _top(spark, sf):
    logs = normalize.log_normalize(v.counts(spark, sf))
    return logs, v.cells(spark, sf), normalize.top_variable_genes(logs, v.cells(spark, sf), v.genes(spark, sf), 100)


@query("m01_pca_scores", v.with_ctes(v.PLACE_COUNTS) + """
, z AS (SELECT cell_id, gene_id FROM (SELECT vec_id AS cell_id FROM embeddings) CROSS JOIN (SELECT DISTINCT gene_id FROM pcounts)),
x AS (SELECT z.cell_id, z.gene_id, coalesce(value, 0)::DOUBLE AS x FROM z LEFT JOIN pcounts p ON p.cell_id = z.cell_id AND p.gene_id = z.gene_id)
SELECT a.cell_id, round(sum(pow(a.x - b.x, 2)), 4) AS squared_distance FROM x a JOIN x b ON b.cell_id = a.cell_id + 1 AND b.gene_id = a.gene_id GROUP BY 1""".lstrip())
def _(spark, sf):
    # With as many components as genes, distances between scores are those between the cells; signs are free.
    scores = em.pca_scores(v.place_counts(spark, sf), v.vectors(spark, sf), 64, centre=True)
    after = scores.select((F.col("cell_id") - 1).alias("cell_id"), F.col("vec").alias("other"))
    return scores.join(after, "cell_id").select("cell_id", F.round(em.squared_distance("vec", "other"), 4).alias("squared_distance"))


@query("m02_batch_centring", v.with_ctes(v.VECTORS) + """
, l AS (SELECT cell_id, batch, i, vec[i] AS x FROM vectors, range(1, 65) t(i)), b AS (SELECT batch, i, avg(x) AS m FROM l GROUP BY 1, 2), g AS (SELECT i, avg(x) AS m FROM l GROUP BY 1)
SELECT cell_id, i - 1 AS component, round(x - 0.8 * (b.m - g.m), 6) AS value FROM l JOIN b USING (batch, i) JOIN g USING (i)""".lstrip())
def _(spark, sf):
    out = em.centre_batches(v.vectors(spark, sf))
    return out.select("cell_id", F.posexplode("vec").alias("component", "value")).select("cell_id", F.col("component").cast("long").alias("component"), F.round("value", 6).alias("value"))


DIST = "sqrt(list_sum(list_transform(list_zip(a.vec, b.vec), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))"
SAMPLE = "s AS (SELECT * FROM vectors ORDER BY substr(md5('42:' || cell_id), 1, 15), cell_id LIMIT {0})"


@query("m03_batch_mixing", v.with_ctes(v.VECTORS, SAMPLE.format(300)) + f"""
, d AS (SELECT a.cell_id AS q, a.batch AS qb, b.batch AS ob, row_number() OVER (PARTITION BY a.cell_id ORDER BY {DIST}, b.cell_id) AS r FROM s a JOIN vectors b ON a.cell_id <> b.cell_id)
SELECT count(DISTINCT q) AS n_sampled, round(avg(CASE WHEN qb = ob THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END), 6) AS mixing_score FROM d WHERE r <= 15""".lstrip())
def _(spark, sf):
    return rounded(em.batch_mixing(v.vectors(spark, sf)), "mixing_score")


@query("m04_kmeans", "SELECT vec_id AS cell_id, min(vec_id) OVER (PARTITION BY label) AS cluster FROM embeddings")
def _(spark, sf):
    return v.by_first_cell(em.kmeans(v.separate_vectors(spark, sf), 10), "cluster")


@query("m04_embedding_kmeans")
def _(spark, sf):
    # The measured vectors as they are; Lloyd steps have no SQL form, tests hold their cost and agreement against NumPy.
    return em.kmeans(v.vectors(spark, sf).select("cell_id", "vec"), 10).select("cell_id", "cluster")


@query("m05_silhouette", v.with_ctes(v.VECTORS, SAMPLE.format(200)) + f"""
, d AS (SELECT a.cell_id AS q, a.label AS ql, b.label AS ol, avg({DIST}) AS m FROM s a JOIN vectors b ON a.cell_id <> b.cell_id GROUP BY 1, 2, 3),
p AS (SELECT q, coalesce(max(m) FILTER (WHERE ql = ol), 0) AS a, coalesce(min(m) FILTER (WHERE ql <> ol), 0) AS b FROM d GROUP BY 1)
SELECT count(*) AS n_sampled, round(avg((b - a) / greatest(a, b)), 6) AS silhouette FROM p""".lstrip())
def _(spark, sf):
    return rounded(em.silhouette(v.vectors(spark, sf)), "silhouette")


@query("m06_display_coordinates", v.with_ctes(v.VECTORS) + "SELECT cell_id, round(vec[1] + 0.5 * sin(vec[2]), 6) AS x, round(vec[2], 6) AS y FROM vectors")
def _(spark, sf):
    return rounded(em.display_coordinates(v.vectors(spark, sf)), "x", "y")


def marker_reference(spark, sf):
    """The part types as labels and some of their parts as markers, written in mixed case."""
    return v.table(spark, sf, "part").select(
        F.col("p_type").alias("label"), F.ascii("p_type").alias("label_order"),
        F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("G"), F.col("p_partkey").cast("string"))).otherwise(F.concat(F.lit("g"), F.col("p_partkey").cast("string"))).alias("marker"),
    )


ANNOTATE = """
r AS (SELECT p_type AS label, ascii(p_type) AS o, p_partkey AS gene_id, p_partkey % 2 = 1 AS ok FROM part),
cs AS (SELECT cluster, count(*) AS n FROM cells GROUP BY 1), sm AS (SELECT cluster, gene_id, sum(value) AS t FROM logn JOIN cells USING (cell_id) GROUP BY 1, 2),
mm AS (SELECT cs.cluster, label, o, ok, coalesce(t, 0) / n AS m FROM r CROSS JOIN cs LEFT JOIN sm ON sm.cluster = cs.cluster AND sm.gene_id = r.gene_id)"""


@query("m07_marker_annotation", v.with_ctes(v.COUNTS, v.CELLS, LOGN, ANNOTATE) + """
, z AS (SELECT cluster, label, o, sum(m) AS s FROM mm GROUP BY 1, 2, 3), k AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY s DESC, o, label DESC) AS n FROM z)
SELECT cluster, CASE WHEN s > 0.05 THEN label ELSE 'Cluster_' || cluster END AS cell_type, round(s, 6) AS score FROM k WHERE n = 1""".lstrip())
def _(spark, sf):
    logs = normalize.log_normalize(v.counts(spark, sf))
    return rounded(em.annotate_clusters(logs, v.cells(spark, sf), v.genes(spark, sf), marker_reference(spark, sf)), "score")


@query("m07_mean_annotation", v.with_ctes(v.COUNTS, v.CELLS, LOGN, ANNOTATE) + """
, z AS (SELECT cluster, label, o, avg(m) AS s FROM mm WHERE ok GROUP BY 1, 2, 3), k AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY s DESC, o, label DESC) AS n FROM z)
SELECT cluster, CASE WHEN s > 0 THEN label ELSE 'Cluster_' || cluster END AS cell_type, round(s, 6) AS score FROM k WHERE n = 1""".lstrip())
def _(spark, sf):
    logs = normalize.log_normalize(v.counts(spark, sf))
    return rounded(em.annotate_clusters(logs, v.cells(spark, sf), v.genes(spark, sf), marker_reference(spark, sf), how="mean"), "score")


@query("m08_sub_states", "SELECT vec_id AS cell_id, min(vec_id) OVER (PARTITION BY label) AS sub_state FROM embeddings WHERE label % 2 = 1")
def _(spark, sf):
    # Inside one section, each label has a gene of its own beside the small values of the others.
    own = v.vectors(spark, sf).select("cell_id", (F.col("label").cast("long") + 1000).alias("gene_id"), F.lit(100.0).alias("value"))
    small = v.place_counts(spark, sf).select("cell_id", "gene_id", (F.col("value") / 100).alias("value"))
    found = em.sub_states(own.unionByName(small), v.places(spark, sf), "1", "section", k=5, components=8)
    return v.by_first_cell(found, "sub_state")


@query("m09_approximate_graph")
def _(spark, sf):
    # Neighbour descent is not exact; tests measure its recall and its distances.
    return approximate_neighbors(v.vectors(spark, sf), 15).select("src", "dst", F.round("distance", 6).alias("distance"), "rank")


@query("m09_knn_graph", v.with_ctes(v.VECTORS) + f"""
, d AS (SELECT a.cell_id AS src, b.cell_id AS dst, {DIST} AS distance FROM vectors a JOIN vectors b ON a.cell_id <> b.cell_id),
r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY distance, dst) AS rank FROM d) SELECT src, dst, round(distance, 6) AS distance, rank FROM r WHERE rank <= 15""".lstrip())
def _(spark, sf):
    return rounded(em.knn_graph(v.vectors(spark, sf)), "distance")


def root(spark, sf):
    """The cell with the lowest value of the first expression component."""
    return od.root_by_gene(v.place_counts(spark, sf), v.vectors(spark, sf), 0)


PT = f"""
rt AS (SELECT v.cell_id FROM vectors v LEFT JOIN pcounts p ON p.cell_id = v.cell_id AND gene_id = 0 ORDER BY coalesce(value, 0), v.cell_id LIMIT 1),
ds AS (SELECT b.cell_id, {DIST} AS d FROM (SELECT * FROM vectors WHERE cell_id = (SELECT cell_id FROM rt)) a CROSS JOIN vectors b),
pt AS (SELECT cell_id, d, (d - (SELECT min(d) FROM ds)) / ((SELECT max(d) FROM ds) - (SELECT min(d) FROM ds)) AS pt FROM ds)"""


@query("t01_pseudotime", v.with_ctes(v.VECTORS, v.PLACE_COUNTS, PT) + "SELECT cell_id, round(d, 6) AS distance, round(pt, 6) AS pseudotime FROM pt")
def _(spark, sf):
    return rounded(od.pseudotime(v.vectors(spark, sf), root(spark, sf)), "distance", "pseudotime")


@query("t02_stability", v.with_ctes(v.VECTORS, v.PLACE_COUNTS, PT) + f"""
, dr AS (SELECT vectors.*, pt, d AS d0, k AS repeat, row_number() OVER (PARTITION BY k ORDER BY substr(md5('42/' || k || ':' || cell_id), 1, 15), cell_id) AS n
  FROM vectors JOIN pt USING (cell_id), range(1, 6) t(k)),
sb AS (SELECT * FROM dr WHERE n <= (SELECT floor(count(*) * 0.8 + 0.5) FROM vectors)),
st AS (SELECT repeat, arg_min(vec, (d0, cell_id)) AS vec FROM sb GROUP BY 1),
sd AS (SELECT b.repeat, b.cell_id, b.pt, {DIST} AS d FROM st a JOIN sb b ON a.repeat = b.repeat),
rk AS (SELECT repeat, rank() OVER (PARTITION BY repeat ORDER BY pt) + (count(*) OVER (PARTITION BY repeat, pt) - 1) / 2 AS ra, rank() OVER (PARTITION BY repeat ORDER BY d) + (count(*) OVER (PARTITION BY repeat, d) - 1) / 2 AS rb FROM sd)
SELECT CAST(repeat AS INTEGER) AS repeat, count(*) AS n_cells, round(corr(ra, rb), 6) AS spearman FROM rk GROUP BY 1""".lstrip())
def _(spark, sf):
    vec, start = v.vectors(spark, sf), root(spark, sf)
    return rounded(od.stability(vec, od.pseudotime(vec, start), start), "spearman")


@query("t03_order_association", v.with_ctes(v.VECTORS, v.PLACE_COUNTS, PT) + f"""
, g AS (SELECT DISTINCT gene_id FROM pcounts), f AS (SELECT g.gene_id, pt.cell_id, pt, coalesce(value, 0) AS x FROM g CROSS JOIN pt LEFT JOIN pcounts USING (cell_id, gene_id)),
k AS (SELECT gene_id, rank() OVER (PARTITION BY gene_id ORDER BY pt) + (count(*) OVER (PARTITION BY gene_id, pt) - 1) / 2 AS ra, rank() OVER (PARTITION BY gene_id ORDER BY x) + (count(*) OVER (PARTITION BY gene_id, x) - 1) / 2 AS rb FROM f),
c AS (SELECT gene_id, corr(ra, rb) AS rho, CAST(count(*) - 2 AS DOUBLE) AS df FROM k GROUP BY 1), w AS (SELECT *, rho * sqrt(df / (1 - rho * rho)) AS t_stat FROM c), {sp.t_tail('w', 'gene_id')},
r AS (SELECT gene_id, rho, p, {sp.bh_ranks('p')} FROM w JOIN tails USING (gene_id)), q AS (SELECT *, {sp.bh('p')} AS q FROM r)
SELECT gene_id, round(rho, 6) AS spearman_rho, round(p, 5) AS p_value, round(q, 5) AS fdr_q_value,
  CASE WHEN q <= 0.05 AND abs(rho) >= 0.3 THEN CASE WHEN rho >= 0 THEN 'upregulated_along_pseudotime' ELSE 'downregulated_along_pseudotime' END END AS trend FROM q""".lstrip())
def _(spark, sf):
    values = v.place_counts(spark, sf)
    out = od.order_association(values, od.pseudotime(v.vectors(spark, sf), root(spark, sf)), values.select("gene_id").distinct())
    return rounded(rounded(out, "spearman_rho"), "p_value", "fdr_q_value", digits=5)


def walk(spark, sf):
    """Vectors as a chain of choices: each cell moves to a third of its id or stays close above it."""
    e = v.table(spark, sf, "embeddings").where(F.col("vec_id") >= 8)
    i = F.col("vec_id")
    edges = e.select(F.inline(F.array(
        F.struct(i.alias("src"), F.floor(i / 3).alias("dst"), F.lit(0.5).alias("weight")), F.struct(i.alias("src"), F.floor(i / 2).alias("dst"), F.lit(0.3).alias("weight")),
        F.struct(i.alias("src"), (i - 1).alias("dst"), F.lit(0.2).alias("weight")),
    ))).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    ends = v.table(spark, sf, "embeddings").where(i < 8).select(i.alias("cell_id"), F.when(i % 2 == 0, "even").otherwise("odd").alias("fate"))
    return edges, ends


# Sixty rounds written out; far fewer leave no probability behind.
ROUNDS = [
    "ed AS (SELECT vec_id AS src, vec_id // 3 AS dst, 0.5::DOUBLE AS w FROM embeddings WHERE vec_id >= 8 UNION ALL SELECT vec_id, vec_id // 2, 0.3 FROM embeddings WHERE vec_id >= 8 "
    "UNION ALL SELECT vec_id, vec_id - 1, 0.2 FROM embeddings WHERE vec_id >= 8)",
    "en AS (SELECT vec_id AS cell_id, CASE WHEN vec_id % 2 = 0 THEN 'even' ELSE 'odd' END AS fate, 1.0::DOUBLE AS p FROM embeddings WHERE vec_id < 8)",
    "a0 AS MATERIALIZED (SELECT * FROM en)",
] + [
    f"a{k} AS MATERIALIZED (SELECT * FROM en UNION ALL SELECT src, fate, sum(w * p) FROM ed JOIN a{k - 1} ON dst = cell_id GROUP BY 1, 2)" for k in range(1, 61)
]


@query("t04_absorption", v.with_ctes(*ROUNDS) + "SELECT cell_id, fate, round(p, 6) AS probability FROM a60")
def _(spark, sf):
    return rounded(od.absorption(*walk(spark, sf), tolerance=1e-9), "probability")


@query("t05_flow_index", v.with_ctes(v.VECTORS) + """
, e AS (SELECT vec_id AS src, (vec_id * 7 + k) % (SELECT count(*) FROM embeddings) AS dst, CAST(1 + vec_id % 3 + k AS DOUBLE) AS w FROM embeddings, range(0, 3) t(k)),
s AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS w FROM e), n AS (SELECT label, count(*) AS n FROM vectors GROUP BY 1),
f AS (SELECT a.label AS source, b.label AS target, sum(w) / max(n.n) AS flow, count(*) AS c FROM s JOIN vectors a ON a.cell_id = src JOIN vectors b ON b.cell_id = dst JOIN n ON n.label = a.label GROUP BY 1, 2),
p AS (SELECT DISTINCT a.label AS source, b.label AS target FROM vectors a JOIN vectors b ON a.label < b.label),
z AS (SELECT source, target, coalesce(f.flow, 0) AS f, coalesce(r.flow, 0) AS r, coalesce(f.c, 0) + coalesce(r.c, 0) AS c FROM p LEFT JOIN f USING (source, target) LEFT JOIN f r ON r.source = p.target AND r.target = p.source)
SELECT source, target, round(f, 6) AS forward_flow, round(r, 6) AS reverse_flow, round(CASE WHEN f + r > 0 THEN (f - r) / (f + r) ELSE 0 END, 6) AS direction_index, c AS cross_state_edges FROM z""".lstrip())
def _(spark, sf):
    e = v.table(spark, sf, "embeddings")
    n = e.agg(F.count(F.lit(1)).alias("n")).scalar()
    edges = e.select(F.col("vec_id").alias("src"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k")).select(
        "src", ((F.col("src") * 7 + F.col("k")) % n).alias("dst"), (1 + F.col("src") % 3 + F.col("k")).cast("double").alias("weight")
    )
    vec = v.vectors(spark, sf)
    names = vec.agg(F.collect_set("label").alias("l")).scalar()
    pairs = vec.select(F.col("label").alias("source")).distinct().withColumn("target", F.explode(names)).where("source < target")
    return rounded(od.flow_index(edges, vec.select("cell_id", "label"), pairs), "forward_flow", "reverse_flow", "direction_index")
