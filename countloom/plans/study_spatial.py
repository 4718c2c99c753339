"""Queries for spatial graphs, autocorrelation, contacts and niches (X)."""

from pyspark.sql import functions as F

from countloom.functions.shuffle import shuffled_place_sql
from countloom.operators import spatial as sx
from countloom.plans import sql_parts as sp, views as v
from countloom.plans.catalog import query
from countloom.plans.study_donors import rounded
from countloom.session import cut_lineage

K = 6
KNN = """
kd AS (SELECT a.cell_id AS src, b.cell_id AS dst, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS distance FROM places a JOIN places b ON a.section = b.section AND a.cell_id <> b.cell_id),
knn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY distance, dst) AS rank FROM kd) WHERE rank <= 6),
sym AS (SELECT src, dst, max(distance) AS distance FROM (SELECT src, dst, distance FROM knn UNION ALL SELECT dst, src, distance FROM knn) GROUP BY 1, 2),
graph AS (SELECT *, 1.0::DOUBLE AS weight, 1.0::DOUBLE / count(*) OVER (PARTITION BY src) AS wn FROM sym)"""
GRAPH = (v.PLACES, KNN)
# One section for the tests whose null allows no more.
ONE = v.PLACES.replace("CAST(label % 2 AS VARCHAR) AS section", "'all' AS section")


def edges(spark, sf):
    return sx.section_neighbors(v.places(spark, sf), K, columns=["x", "y"])


def graph(spark, sf):
    return sx.symmetric_graph(edges(spark, sf))


def one_graph(spark, sf):
    return sx.symmetric_graph(sx.section_neighbors(v.places(spark, sf), K, section=None, columns=["x", "y"]))


def genes(spark, sf):
    return v.place_counts(spark, sf).select("gene_id").distinct().select(
        "gene_id", F.col("gene_id").alias("gene_index"), F.concat(F.lit("Gene"), F.col("gene_id").cast("string")).alias("gene_name")
    )


@query("x01_coordinate_check", v.with_ctes(v.PLACES) + """
SELECT CAST(2 AS BIGINT) AS n_dims, count(*) AS n_cells, CAST(0 AS BIGINT) AS n_nonfinite, round(var_pop(x) + var_pop(y), 6) AS variance, true AS valid FROM places""")
def _(spark, sf):
    return rounded(sx.check_coordinates(v.places(spark, sf)), "variance")


@query("x02_section_partition", v.with_ctes(v.PLACES) + """
SELECT '["' || batch || '","' || section || '"]' AS "partition", count(*) AS n_cells FROM (SELECT *, cell_id % 3 AS batch FROM places) GROUP BY 1""")
def _(spark, sf):
    p = v.places(spark, sf).withColumn("donor", (F.col("cell_id") % 3).cast("string"))
    return sx.section_sizes(sx.section_partitions(p, "section", "donor"))


@query("x03_section_neighbors", v.with_ctes(*GRAPH) + "SELECT src, dst, round(distance, 6) AS distance, rank FROM knn")
def _(spark, sf):
    return rounded(edges(spark, sf), "distance")


@query("x03_manhattan_neighbors", v.with_ctes(v.PLACES, KNN.replace("sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))", "abs(a.x - b.x) + abs(a.y - b.y)")) + """
SELECT src, dst, round(distance, 6) AS distance, rank FROM knn""")
def _(spark, sf):
    return rounded(sx.section_neighbors(v.places(spark, sf), K, "manhattan", columns=["x", "y"]), "distance")


@query("x04_symmetric_graph", v.with_ctes(*GRAPH) + "SELECT src, dst, round(distance, 6) AS distance, weight, round(wn, 6) AS weight_norm FROM graph")
def _(spark, sf):
    return rounded(graph(spark, sf), "distance", "weight_norm")


@query("x05_graph_check", v.with_ctes(*GRAPH) + """
SELECT count(*) + 2 AS n_edges, CAST(0 AS BIGINT) AS n_invalid, CAST(1 AS BIGINT) AS n_self, CAST(1 AS BIGINT) AS n_unknown, CAST(0 AS BIGINT) AS n_cross_section, false AS valid FROM graph""")
def _(spark, sf):
    g = graph(spark, sf).select("src", "dst", "weight")
    first = v.places(spark, sf).agg(F.min("cell_id").alias("i"))
    odd = first.select(F.col("i").alias("src"), F.col("i").alias("dst"), F.lit(1.0).alias("weight")).unionByName(
        first.select(F.col("i").alias("src"), F.lit(-5).cast("long").alias("dst"), F.lit(1.0).alias("weight"))
    )
    return sx.check_graph(g.unionByName(odd), v.places(spark, sf))


@query("x06_smoothed_embedding", v.with_ctes(*GRAPH, v.VECTORS) + """
, n AS (SELECT src, i, sum(wn * vec[i]) AS m FROM graph JOIN vectors ON cell_id = dst, range(1, 65) t(i) GROUP BY 1, 2)
SELECT cell_id, i - 1 AS component, round(0.7 * vec[i] + 0.3 * coalesce(m, 0), 6) AS value FROM vectors CROSS JOIN range(1, 65) t(i) LEFT JOIN n USING (i) WHERE n.src = cell_id""".lstrip())
def _(spark, sf):
    out = sx.smooth_embedding(v.vectors(spark, sf).select("cell_id", "vec"), graph(spark, sf), 64)
    return out.select("cell_id", F.posexplode("vec").alias("component", "value")).select("cell_id", F.col("component").cast("long").alias("component"), F.round("value", 6).alias("value"))


@query("x07_spatial_domains", "SELECT vec_id AS cell_id, min(vec_id) OVER (PARTITION BY label) AS domain FROM embeddings")
def _(spark, sf):
    # Labels far apart: smoothing over the graph moves no cell into another group.
    found = sx.spatial_domains(v.separate_vectors(spark, sf), graph(spark, sf), 74, k=10, strength=0.1)
    return v.by_first_cell(found.select("cell_id", "domain"), "domain")


@query("x07_embedding_domains")
def _(spark, sf):
    # The measured vectors, smoothed over the graph; Lloyd steps have no SQL form, tests hold them against NumPy.
    return sx.spatial_domains(v.vectors(spark, sf).select("cell_id", "vec"), graph(spark, sf), 64, k=10).select("cell_id", "domain")


MORAN = f"""
c AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM places), gn AS (SELECT DISTINCT gene_id FROM pcounts),
fx AS (SELECT gene_id, cell_id, coalesce(value, 0)::DOUBLE AS x FROM gn CROSS JOIN places LEFT JOIN pcounts USING (gene_id, cell_id)),
mo AS (SELECT gene_id, avg(x) AS m FROM fx GROUP BY 1), de AS (SELECT gene_id, sum(pow(x - m, 2)) AS m2, sum(pow(x - m, 4)) AS m4 FROM fx JOIN mo USING (gene_id) GROUP BY 1),
pr AS (SELECT a.gene_id, sum((a.x - m) * (b.x - m)) AS num, sum(pow(a.x - b.x, 2)) AS dif FROM graph JOIN fx a ON a.cell_id = src JOIN fx b ON b.cell_id = dst AND b.gene_id = a.gene_id JOIN mo ON mo.gene_id = a.gene_id GROUP BY 1),
s AS (SELECT (SELECT count(*) FROM graph)::DOUBLE AS s0, 2.0::DOUBLE * (SELECT count(*) FROM graph) AS s1, (SELECT sum(4 * d * d) FROM (SELECT count(*) AS d FROM graph GROUP BY src))::DOUBLE AS s2),
z AS (SELECT gene_id, n, s0, s1, s2, num, dif, m2, n * m4 / (m2 * m2) AS b2, n / s0 * num / m2 AS i, -1 / (n - 1) AS ei, (n - 1) / (2 * s0) * dif / m2 AS g FROM pr JOIN de USING (gene_id), s, c),
w AS (SELECT *, (n * ((n * n - 3 * n + 3) * s1 - n * s2 + 3 * s0 * s0) - b2 * ((n * n - n) * s1 - 2 * n * s2 + 6 * s0 * s0)) / ((n - 1) * (n - 2) * (n - 3) * s0 * s0) - ei * ei AS vi,
  ((n - 1) * s1 * (n * n - 3 * n + 3 - (n - 1) * b2) - 0.25 * (n - 1) * s2 * (n * n + 3 * n - 6 - (n * n - n + 2) * b2) + s0 * s0 * (n * n - 3 - (n - 1) * (n - 1) * b2)) / ((n - 1) * (n - 2) * (n - 3) * s0 * s0) AS vg FROM z),
mz AS (SELECT *, (i - ei) / sqrt(vi) AS zi, (g - 1) / sqrt(vg) AS zg FROM w), {sp.normal_tail('mz', 'gene_id', 'pi', 'zi')}, {sp.normal_tail('mz', 'gene_id', 'pg', 'zg')}"""
AUTO = (ONE, KNN, v.PLACE_COUNTS, MORAN)


def _auto(spark, sf):
    return sx.autocorrelation(v.place_counts(spark, sf), v.places(spark, sf), genes(spark, sf), one_graph(spark, sf))


@query("x08_morans_i", v.with_ctes(*AUTO) + """
SELECT gene_id, round(i, 6) AS moran_i, round(ei, 6) AS moran_expected, round(vi, 8) AS moran_variance, round(zi, 5) AS moran_z, round(pi.p, 5) AS moran_p FROM mz JOIN pi USING (gene_id)""")
def _(spark, sf):
    out = _auto(spark, sf).select("gene_id", "moran_i", "moran_expected", "moran_variance", "moran_z", "moran_p")
    return rounded(rounded(rounded(out, "moran_i", "moran_expected"), "moran_variance", digits=8), "moran_z", "moran_p", digits=5)


@query("x09_gearys_c", v.with_ctes(*AUTO) + """
SELECT gene_id, round(g, 6) AS geary_c, round(vg, 8) AS geary_variance, round(zg, 5) AS geary_z, round(pg.p, 5) AS geary_p FROM mz JOIN pg USING (gene_id)""")
def _(spark, sf):
    out = _auto(spark, sf).select("gene_id", "geary_c", "geary_variance", "geary_z", "geary_p")
    return rounded(rounded(rounded(out, "geary_c"), "geary_variance", digits=8), "geary_z", "geary_p", digits=5)


@query("x10_spatially_variable", v.with_ctes(*AUTO) + f"""
, r AS (SELECT gene_id, i, p, {sp.bh_ranks('p')} FROM mz JOIN pi USING (gene_id)), q AS (SELECT *, {sp.bh('p')} AS q FROM r)
SELECT gene_id, round(i, 6) AS moran_i, round(q, 5) AS fdr_q_value, q < 0.05 AND i > 0.15 AS is_spatially_variable FROM q""".lstrip())
def _(spark, sf):
    out = sx.spatially_variable(v.place_counts(spark, sf), v.places(spark, sf), genes(spark, sf), one_graph(spark, sf))
    return rounded(rounded(out.select("gene_id", "moran_i", "fdr_q_value", "is_spatially_variable"), "moran_i"), "fdr_q_value", digits=5)


CONTACT = """
ts AS (SELECT cell_type AS t, count(*) AS n FROM places GROUP BY 1),
ce AS (SELECT a.cell_type AS source, b.cell_type AS target, sum(weight) AS s FROM graph JOIN places a ON a.cell_id = src JOIN places b ON b.cell_id = dst GROUP BY 1, 2),
cd AS (SELECT a.t AS source, b.t AS target, coalesce(s, 0) AS contact, coalesce(s, 0) / (a.n * b.n) AS density FROM ts a CROSS JOIN ts b LEFT JOIN ce ON source = a.t AND target = b.t)"""


@query("x11_contact_density", v.with_ctes(*GRAPH, CONTACT) + "SELECT source, target, contact, round(density, 8) AS density FROM cd")
def _(spark, sf):
    return rounded(sx.contact_density(graph(spark, sf), v.places(spark, sf)), "density", digits=8)


def lr_pairs(spark, sf):
    g = genes(spark, sf)
    return g.select(F.upper("gene_name").alias("ligand"), F.concat(F.lit("gene"), (F.col("gene_id") + 1).cast("string")).alias("receptor"))


SCORES = """
lp AS (SELECT DISTINCT gene_id AS l, gene_id + 1 AS r FROM pcounts WHERE gene_id + 1 IN (SELECT gene_id FROM pcounts)),
tm AS (SELECT cell_type AS t, gene_id, sum(value) / max(n) AS m FROM pcounts JOIN places USING (cell_id) JOIN ts ON t = cell_type GROUP BY 1, 2),
ps AS (SELECT source, target, 'GENE' || l AS ligand, 'gene' || r AS receptor, coalesce(a.m, 0) AS lm, coalesce(b.m, 0) AS rm, sqrt(coalesce(a.m, 0) * coalesce(b.m, 0)) AS raw, density
  FROM cd CROSS JOIN lp LEFT JOIN tm a ON a.t = source AND a.gene_id = l LEFT JOIN tm b ON b.t = target AND b.gene_id = r)"""


def _scores(spark, sf, found=None):
    return sx.pair_scores(v.place_counts(spark, sf), v.places(spark, sf), genes(spark, sf), lr_pairs(spark, sf), graph(spark, sf) if found is None else found)


@query("x12_pair_scores", v.with_ctes(*GRAPH, v.PLACE_COUNTS, CONTACT, SCORES) + """
SELECT source, target, ligand, receptor, round(lm, 6) AS mean_ligand_expr, round(rm, 6) AS mean_receptor_expr, round(raw, 6) AS raw_score, round(density, 8) AS spatial_weight,
  round(raw * density, 8) AS spatial_score FROM ps""")
def _(spark, sf):
    return rounded(rounded(_scores(spark, sf), "mean_ligand_expr", "mean_receptor_expr", "raw_score"), "spatial_weight", "spatial_score", digits=8)


PERMUTED = f"""
r0 AS (SELECT cell_id, section, row_number() OVER (PARTITION BY section ORDER BY substr(md5('42:' || cell_id), 1, 15), cell_id) - 1 AS p, count(*) OVER (PARTITION BY section) AS m FROM places),
rk AS (SELECT cell_id, section, k, 1 + {shuffled_place_sql('p', 'm', '42', 'k')} AS pos FROM r0, range(1, 21) t(k)),
cu AS (SELECT section, cell_type AS t, sum(count(*)) OVER (PARTITION BY section ORDER BY cell_type) AS hi, sum(count(*)) OVER (PARTITION BY section ORDER BY cell_type) - count(*) AS lo FROM places GROUP BY 1, 2),
pl AS (SELECT cell_id, k, t FROM rk JOIN cu ON cu.section = rk.section AND pos > lo AND pos <= hi),
pc AS (SELECT a.k, a.t AS source, b.t AS target, sum(weight) AS s FROM graph JOIN pl a ON a.cell_id = src JOIN pl b ON b.cell_id = dst AND b.k = a.k GROUP BY 1, 2, 3),
pp AS (SELECT cd.source, cd.target, contact, density, (CASE WHEN contact <= 0 THEN 20 ELSE count(pc.k) END + 1) / 21.0::DOUBLE AS p FROM cd LEFT JOIN pc ON pc.source = cd.source AND pc.target = cd.target AND s >= contact GROUP BY ALL)"""
PERMUTED = PERMUTED.replace("GROUP BY ALL)", "GROUP BY cd.source, cd.target, contact, density)")


@query("x13_label_permutation", v.with_ctes(*GRAPH, v.PLACE_COUNTS, CONTACT, PERMUTED) + "SELECT source, target, round(p, 6) AS contact_p FROM pp")
def _(spark, sf):
    out = sx.contact_permutations(graph(spark, sf), v.places(spark, sf), 20)
    return rounded(out.select("source", "target", "contact_p"), "contact_p")


@query("x13_pair_significance", v.with_ctes(*GRAPH, v.PLACE_COUNTS, CONTACT, SCORES, PERMUTED) + f"""
, r AS (SELECT ps.*, CASE WHEN raw > 0 THEN p ELSE 1.0 END AS p_value FROM ps JOIN pp USING (source, target)), b AS (SELECT *, {sp.bh_ranks()} FROM r), q AS (SELECT *, {sp.bh()} AS q FROM b)
SELECT source, target, ligand, receptor, round(p_value, 6) AS p_value, round(q, 6) AS fdr_q_value, q < 0.2 AND raw * density > 0 AS is_significant FROM q""".lstrip())
def _(spark, sf):
    found = cut_lineage(graph(spark, sf))  # searched once for both
    permuted = sx.contact_permutations(found, v.places(spark, sf), 20)
    out = sx.pair_significance(_scores(spark, sf, found), permuted, fdr=0.2)
    return rounded(out.select("source", "target", "ligand", "receptor", "p_value", "fdr_q_value", "is_significant"), "p_value", "fdr_q_value")


@query("x14_composition", v.with_ctes(*GRAPH) + """
SELECT src AS cell_id, cell_type, round(count(*) / sum(count(*)) OVER (PARTITION BY src), 6) AS share FROM knn JOIN places ON cell_id = dst GROUP BY 1, 2""")
def _(spark, sf):
    return rounded(sx.composition(edges(spark, sf), v.places(spark, sf)), "share")


@query("x15_contact_enrichment", v.with_ctes(*GRAPH, CONTACT) + """
, o AS (SELECT a.cell_type AS source, b.cell_type AS target, count(*) AS o FROM knn JOIN places a ON a.cell_id = src JOIN places b ON b.cell_id = dst GROUP BY 1, 2),
m AS (SELECT section, cell_type AS t, count(*) AS n FROM places GROUP BY 1, 2), z AS (SELECT section, count(*) AS n FROM places GROUP BY 1),
e AS (SELECT a.t AS source, b.t AS target, sum(a.n * greatest(0, b.n - (a.t = b.t)::INT) * least(6, z.n - 1) / (z.n - 1)) AS e FROM m a JOIN m b USING (section) JOIN z USING (section) GROUP BY 1, 2)
SELECT source, target, CAST(coalesce(o, 0) AS DOUBLE) AS observed_contacts, round(coalesce(e, 0), 6) AS expected_contacts, round((coalesce(o, 0) + 1) / (coalesce(e, 0) + 1), 6) AS enrichment_ratio
FROM cd LEFT JOIN o USING (source, target) LEFT JOIN e USING (source, target)""".lstrip())
def _(spark, sf):
    return rounded(sx.contact_enrichment(edges(spark, sf), v.places(spark, sf), K), "expected_contacts", "enrichment_ratio")


@query("x16_section_moran", v.with_ctes(*GRAPH, v.PLACE_COUNTS) + """
, gn AS (SELECT DISTINCT gene_id FROM pcounts), fx AS (SELECT gene_id, cell_id, section, coalesce(value, 0) AS x FROM gn CROSS JOIN places LEFT JOIN pcounts USING (gene_id, cell_id)),
d AS (SELECT gene_id, cell_id, x - avg(x) OVER (PARTITION BY gene_id, section) AS d FROM fx), v AS (SELECT gene_id, sum(d * d) AS v FROM d GROUP BY 1)
SELECT a.gene_id, round((SELECT count(*) FROM places) / (SELECT count(*) FROM graph) * sum(a.d * b.d) / max(v), 4) AS moran_i
FROM graph JOIN d a ON a.cell_id = src JOIN d b ON b.cell_id = dst AND b.gene_id = a.gene_id JOIN v ON v.gene_id = a.gene_id GROUP BY 1""".lstrip())
def _(spark, sf):
    return sx.section_moran(v.place_counts(spark, sf), v.places(spark, sf), genes(spark, sf), graph(spark, sf))


@query("x17_niche_summary", "SELECT count(*) AS cell_count, CAST((label + 1) % 10 AS VARCHAR) AS dominant_cell_type, 1.0::DOUBLE AS dominant_cell_type_fraction FROM embeddings GROUP BY label")
def _(spark, sf):
    # Every cell's neighbourhood is all of the next type, so the niches are the types and SQL knows them.
    cells = v.places(spark, sf)
    shares = cells.select("cell_id", F.pmod(F.col("cell_type").cast("int") + 1, F.lit(10)).cast("string").alias("cell_type"), F.lit(1.0).alias("share"))
    types = [r[0] for r in cells.select("cell_type").distinct().orderBy("cell_type").collect()]
    found = sx.niches(shares, cells, types, k=len(types))
    return rounded(sx.niche_summary(found, types).drop("niche_id"), "dominant_cell_type_fraction")


@query("x17_neighbourhood_niches")
def _(spark, sf):
    # Niches of the compositions that the graph gives; tests hold them against NumPy.
    cells = v.places(spark, sf)
    types = [r[0] for r in cells.select("cell_type").distinct().orderBy("cell_type").collect()]
    found = sx.niches(sx.composition(edges(spark, sf), cells), cells, types, k=5)
    return rounded(sx.niche_summary(found, types), "dominant_cell_type_fraction")
