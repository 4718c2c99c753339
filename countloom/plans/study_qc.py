"""Queries for quality control, audit and normalisation (Q, N)."""

from pyspark.sql import functions as F

from countloom.operators import normalize, qc
from countloom.plans import views as v
from countloom.plans.catalog import query
from countloom.session import spread

METRICS = (
    "metrics AS (SELECT c.cell_id, c.donor, c.condition, c.cluster, c.batch, count(value) AS n_genes, "
    "CAST(coalesce(sum(value), 0) AS BIGINT) AS total_counts, "
    "CASE WHEN coalesce(sum(value), 0) > 0 THEN coalesce(sum(value) FILTER (WHERE mt), 0) * 100.0::DOUBLE / sum(value) "
    "ELSE 0.0::DOUBLE END AS mito_pct, coalesce(sum(value), 0) > 0 AS mito_pct_available "
    "FROM cells c LEFT JOIN counts USING (cell_id) LEFT JOIN genes USING (gene_id) GROUP BY ALL)"
)
BASE = (v.COUNTS, v.CELLS, v.GENES, METRICS)


def disposed(name: str, min_genes: int, max_mito: float) -> str:
    return (
        f"{name} AS (SELECT cell_id, cluster, n_genes, total_counts, CASE WHEN mito_pct_available THEN mito_pct END AS mito_pct, "
        f"n_genes < {min_genes} AS low_gene_flag, mito_pct > {max_mito} AS high_mito_flag, "
        f"NOT (n_genes < {min_genes} OR mito_pct > {max_mito}) AS retained, "
        f"CASE WHEN n_genes < {min_genes} AND mito_pct > {max_mito} THEN 'low_gene_count_and_high_mito_percentage' "
        f"WHEN mito_pct > {max_mito} THEN 'high_mito_percentage' WHEN n_genes < {min_genes} THEN 'low_gene_count' "
        f"ELSE 'retained' END AS reason FROM metrics)"
    )


REASON_LIST = (
    "reasons AS (SELECT unnest(['retained','low_gene_count','high_mito_percentage',"
    "'low_gene_count_and_high_mito_percentage']) AS reason)"
)


def metrics(spark, sf):
    return qc.cell_metrics(v.counts(spark, sf), v.cells(spark, sf), v.genes(spark, sf))


def dispositions(spark, sf, min_genes=3, max_mito=30.0):
    return qc.disposition(metrics(spark, sf), min_genes, max_mito)


@query("q01_cell_metrics", v.with_ctes(*BASE) + """
SELECT cell_id, n_genes, total_counts, round(mito_pct, 6) AS mito_pct, mito_pct_available FROM metrics""")
def _(spark, sf):
    return metrics(spark, sf).select("cell_id", "n_genes", "total_counts", F.round("mito_pct", 6).alias("mito_pct"), "mito_pct_available")


@query("q02_disposition", v.with_ctes(*BASE, disposed("d", 3, 30.0)) + """
SELECT cell_id, n_genes, round(mito_pct, 6) AS mito_pct, low_gene_flag, high_mito_flag, retained, reason FROM d""")
def _(spark, sf):
    return dispositions(spark, sf).select(
        "cell_id", "n_genes", F.round("mito_pct", 6).alias("mito_pct"), "low_gene_flag", "high_mito_flag", "retained", "reason"
    )


@query("q03_retention", v.with_ctes(*BASE, disposed("d", 3, 30.0), REASON_LIST) + """
SELECT r.reason, count(d.cell_id) AS n_cells, round(count(d.cell_id) / (SELECT count(*) FROM d), 6) AS fraction
FROM reasons r LEFT JOIN d USING (reason) GROUP BY 1""")
def _(spark, sf):
    return qc.retention_summary(dispositions(spark, sf)).withColumn("fraction", F.round("fraction", 6))


@query("q04_review_features", v.with_ctes(*BASE, disposed("d", 3, 30.0), REASON_LIST) + """
, sizes AS (SELECT r.reason, count(d.cell_id) AS n_cells FROM reasons r LEFT JOIN d USING (reason) GROUP BY 1),
sums AS (SELECT reason, gene_id, count(*) AS n_detected, CAST(sum(value) AS BIGINT) AS total FROM counts JOIN d USING (cell_id) GROUP BY 1, 2)
SELECT s.reason, g.gene_id, s.n_cells, coalesce(n_detected, 0) AS n_detected, coalesce(total, 0) AS total_counts,
       round(CASE WHEN n_cells > 0 THEN coalesce(n_detected, 0) / n_cells END, 6) AS detection_fraction,
       round(CASE WHEN n_cells > 0 THEN coalesce(total, 0) / n_cells END, 6) AS mean_raw_count,
       CASE WHEN n_cells > 0 THEN 'described' ELSE 'no_cells' END AS status
FROM sizes s CROSS JOIN genes g LEFT JOIN sums USING (reason, gene_id)""".lstrip())
def _(spark, sf):
    out = qc.review_features(v.counts(spark, sf), dispositions(spark, sf), v.genes(spark, sf))
    return out.drop("gene_index").withColumns({
        "detection_fraction": F.round("detection_fraction", 6), "mean_raw_count": F.round("mean_raw_count", 6),
    })


@query("q05_dataset_audit", v.with_ctes(v.CELLS) + """
SELECT (SELECT count(*) FROM cells) AS n_cells, (SELECT count(*) FROM part) AS n_genes,
  (SELECT string_agg(condition, ', ' ORDER BY condition) FROM (SELECT DISTINCT condition FROM cells)) AS conditions,
  (SELECT min(n) FROM (SELECT count(DISTINCT nation) AS n FROM cells GROUP BY condition)) AS min_replicates_per_condition,
  (SELECT count(DISTINCT nation) FROM cells) AS total_donors,
  (SELECT max(n) > 1 FROM (SELECT count(DISTINCT condition) AS n FROM cells GROUP BY nation)) AS paired_donors_observed,
  (SELECT count(DISTINCT batch) FROM cells) AS n_batches, true AS donor_metadata_complete,
  (SELECT min(n) FROM (SELECT count(DISTINCT nation) AS n FROM cells GROUP BY condition)) >= 2 AS biological_replication_sufficient,
  (SELECT count(DISTINCT batch) FROM cells) > 1 AS batch_effect_possible""")
def _(spark, sf):
    return qc.dataset_audit(v.cells(spark, sf), v.genes(spark, sf), donor="nation")


@query("q05_donors_per_condition", v.with_ctes(v.CELLS) + """
SELECT condition, count(*) AS n_cells, count(DISTINCT donor) AS n_donors FROM cells GROUP BY 1""")
def _(spark, sf):
    return qc.donors_per_condition(v.cells(spark, sf))


MEDIANS = (
    "g AS (SELECT ln(1 + n_genes) AS x FROM metrics), gm AS (SELECT median(x) AS m FROM g), "
    "gd AS (SELECT median(abs(x - (SELECT m FROM gm))) AS d FROM g), "
    "mm AS (SELECT median(mito_pct) AS m FROM metrics), "
    "md AS (SELECT median(abs(mito_pct - (SELECT m FROM mm))) AS d FROM metrics), "
    "limits AS (SELECT k AS multiplier, "
    "CAST(greatest(1, floor(exp((SELECT m FROM gm) - k * 1.4826 * (SELECT d FROM gd)) - 1)) AS BIGINT) AS min_genes, "
    "least(100.0::DOUBLE, greatest(5.0::DOUBLE, (SELECT m FROM mm) + k * 1.4826 * (SELECT d FROM md))) AS max_mito_pct "
    "FROM (SELECT unnest([2.0::DOUBLE, 3.0::DOUBLE, 4.0::DOUBLE]) AS k))"
)


@query("q06_mad_thresholds", v.with_ctes(*BASE, MEDIANS) + """
SELECT multiplier, min_genes, round(max_mito_pct, 6) AS max_mito_pct FROM limits WHERE multiplier = 3""")
def _(spark, sf):
    return qc.mad_thresholds(metrics(spark, sf)).withColumn("max_mito_pct", F.round("max_mito_pct", 6))


@query("q07_batch_confounding", v.with_ctes(v.CELLS) + """
SELECT count(*) AS n_batches, count(*) FILTER (WHERE n = 1) AS n_single_condition, bool_and(n = 1) AS confounded
FROM (SELECT batch, count(DISTINCT condition) AS n FROM cells GROUP BY 1)""")
def _(spark, sf):
    return qc.batch_confounding(v.cells(spark, sf))


@query("q07_confounded_design", """
SELECT count(*) AS n_batches, count(*) FILTER (WHERE n = 1) AS n_single_condition, bool_and(n = 1) AS confounded
FROM (SELECT c_custkey, count(DISTINCT c_mktsegment) AS n FROM customer GROUP BY 1)""")
def _(spark, sf):
    c = v.table(spark, sf, "customer")
    return qc.batch_confounding(c.select(F.col("c_custkey").alias("batch"), F.col("c_mktsegment").alias("condition")))


@query("q08_population_eligibility", v.with_ctes(v.CELLS) + """
, d AS (SELECT cluster AS cell_type, nation, count(*) AS n, max(condition = 'BUILDING') AS a, max(condition = 'MACHINERY') AS b
       FROM cells GROUP BY 1, 2),
s AS (SELECT cell_type, CAST(sum(n) AS BIGINT) AS n_cells, count(*) FILTER (WHERE a) AS n_donors_tested,
      count(*) FILTER (WHERE b) AS n_donors_reference, count(*) FILTER (WHERE a AND b) AS n_donors_both FROM d GROUP BY 1)
SELECT *, n_donors_both > 0 AS paired,
  least(n_donors_tested, n_donors_reference) >= 2 AND (n_donors_both = 0 OR (n_donors_both = n_donors_tested AND n_donors_both = n_donors_reference)) AS eligible,
  CASE WHEN least(n_donors_tested, n_donors_reference) >= 2 AND n_donors_both = n_donors_tested AND n_donors_both = n_donors_reference THEN 'paired_donor_sets'
       WHEN least(n_donors_tested, n_donors_reference) >= 2 AND n_donors_both = 0 THEN 'disjoint_donor_sets' ELSE 'not_eligible' END AS reason
FROM s""".lstrip())
def _(spark, sf):
    return qc.population_eligibility(v.cells(spark, sf), "BUILDING", "MACHINERY", cell_type="cluster", donor="nation")


TWO = (disposed("a", 3, 30.0), disposed("b", 2, 40.0))


def _pair(spark, sf):
    m = metrics(spark, sf)
    return qc.disposition(m, 3, 30.0), qc.disposition(m, 2, 40.0)


@query("q09_branch_comparison", v.with_ctes(*BASE, *TWO) + """
SELECT count(*) FILTER (WHERE a.retained) AS primary_retained, count(*) FILTER (WHERE b.retained) AS branch_retained,
       count(*) FILTER (WHERE NOT a.retained AND b.retained) AS n_added, count(*) FILTER (WHERE a.retained AND NOT b.retained) AS n_removed,
       count(*) FILTER (WHERE a.retained <> b.retained) AS n_changed FROM a JOIN b USING (cell_id)""")
def _(spark, sf):
    return qc.compare_branches(*_pair(spark, sf))


@query("q09_reason_transitions", v.with_ctes(*BASE, *TWO) + """
SELECT a.reason AS primary_reason, b.reason AS branch_reason, count(*) AS n_cells FROM a JOIN b USING (cell_id) GROUP BY 1, 2""")
def _(spark, sf):
    return qc.reason_transitions(*_pair(spark, sf))


@query("q09_group_retention", v.with_ctes(*BASE, *TWO) + """
SELECT a.cluster AS observed_group, count(*) AS original_cells, count(*) FILTER (WHERE a.retained) AS primary_retained,
  count(*) FILTER (WHERE b.retained) AS branch_retained,
  round(count(*) FILTER (WHERE a.retained) / count(*), 6) AS primary_retention_fraction,
  round(count(*) FILTER (WHERE b.retained) / count(*), 6) AS branch_retention_fraction
FROM a JOIN b USING (cell_id) GROUP BY 1""")
def _(spark, sf):
    out = qc.group_retention(*_pair(spark, sf), "cluster")
    return out.withColumns({c: F.round(c, 6) for c in ("primary_retention_fraction", "branch_retention_fraction")})


@query("q10_branch_plan", v.with_ctes(*BASE, MEDIANS) + """
, n AS (SELECT multiplier, min_genes, max_mito_pct,
  (SELECT count(*) FROM metrics m WHERE m.n_genes >= l.min_genes AND m.mito_pct <= l.max_mito_pct) AS kept FROM limits l)
SELECT multiplier, min_genes, round(max_mito_pct, 6) AS max_mito_pct, kept AS predicted_retained_cells,
  CASE WHEN kept < 3 THEN 'not_estimable'
       WHEN multiplier <> 3 AND min_genes = (SELECT min_genes FROM limits WHERE multiplier = 3)
        AND max_mito_pct = (SELECT max_mito_pct FROM limits WHERE multiplier = 3) THEN 'duplicate_primary'
       ELSE 'planned' END AS status FROM n""".lstrip())
def _(spark, sf):
    return qc.branch_plan(metrics(spark, sf)).withColumn("max_mito_pct", F.round("max_mito_pct", 6))


def _flagged(spark, sf):
    cells = v.cells(spark, sf)
    scores = v.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("cell_id"), (F.col("o_totalprice") / 500000).alias("doublet_score")
    )
    limits = cells.select("batch").distinct().withColumn("threshold", F.when(F.col("batch") == "F", 0.9).otherwise(0.8))
    return qc.apply_doublet_scores(cells, scores, limits, drop=True)


FLAGGED = (
    "flagged AS (SELECT c.cell_id, c.batch, o_totalprice / 500000 AS score, "
    "o_totalprice / 500000 > CASE WHEN batch = 'F' THEN 0.9 ELSE 0.8 END AS hit FROM cells c JOIN orders ON o_orderkey = cell_id)"
)


@query("q11_doublet_flags", v.with_ctes(v.CELLS, FLAGGED) + """
SELECT cell_id, round(score, 8) AS doublet_score, hit AS predicted_doublet, NOT hit AS retained_after_filter FROM flagged""")
def _(spark, sf):
    return _flagged(spark, sf).select("cell_id", F.round("doublet_score", 8).alias("doublet_score"), "predicted_doublet", "retained_after_filter")


@query("q11_doublet_retention", v.with_ctes(v.CELLS, FLAGGED) + """
SELECT batch, count(*) AS n_before, count(*) FILTER (WHERE NOT hit) AS n_after, count(*) FILTER (WHERE hit) AS n_marked,
  round(count(*) FILTER (WHERE NOT hit) / count(*), 6) AS retention_rate FROM flagged GROUP BY 1""")
def _(spark, sf):
    return qc.doublet_retention(_flagged(spark, sf)).withColumn("retention_rate", F.round("retention_rate", 6))


@query("q12_annotation_merge", v.with_ctes(v.CELLS) + """
, m AS (SELECT cell_id, CASE WHEN batch = 'O' THEN 'unknown' ELSE cluster END AS old,
        CASE WHEN cell_id % 5 = 0 THEN 'Unassigned' WHEN cell_id % 5 = 1 THEN '5-LOW' ELSE cluster END AS new FROM cells)
SELECT cell_id, old AS label_existing, new AS predicted_label, new = 'Unassigned' AS label_unknown,
  old <> 'unknown' AND new <> 'Unassigned' AND old <> new AS label_conflict,
  CASE WHEN new <> 'Unassigned' AND NOT (old <> 'unknown' AND old <> new) THEN new ELSE old END AS cell_type FROM m""".lstrip())
def _(spark, sf):
    c = v.cells(spark, sf)
    old = c.select("cell_id", F.when(F.col("batch") == "O", "unknown").otherwise(F.col("cluster")).alias("cell_type"))
    k = F.col("cell_id") % 5
    new = c.select("cell_id", F.when(k == 0, "Unassigned").when(k == 1, "5-LOW").otherwise(F.col("cluster")).alias("predicted_label"))
    return qc.merge_annotation(old, new)


LOGN = (
    "logn AS (SELECT cell_id, gene_id, ln(1 + value / sum(value) OVER (PARTITION BY cell_id) * 10000.0::DOUBLE) AS value FROM counts)"
)


@query("n01_log_normalize", v.with_ctes(v.COUNTS, LOGN) + "SELECT cell_id, gene_id, round(value, 6) AS value FROM logn")
def _(spark, sf):
    return normalize.log_normalize(v.counts(spark, sf)).withColumn("value", F.round("value", 6))


@query("n02_variable_genes", v.with_ctes(v.COUNTS, LOGN) + """
, n AS (SELECT count(*) AS n FROM orders),
s AS (SELECT p_partkey AS gene_id, count(value) AS k, coalesce(avg(value), 0) AS m, coalesce(var_pop(value), 0) AS vp
      FROM part LEFT JOIN logn ON gene_id = p_partkey GROUP BY 1)
SELECT gene_id, round((vp * k + m * m * k * (n - k) / n) / n, 6) AS variance FROM s, n
ORDER BY (vp * k + m * m * k * (n - k) / n) / n DESC, gene_id LIMIT 300""".lstrip())
def _(spark, sf):
    logs = normalize.log_normalize(v.counts(spark, sf))
    out = normalize.top_variable_genes(logs, v.cells(spark, sf), v.genes(spark, sf))
    return out.select("gene_id", F.round("variance", 6).alias("variance"))


@query("n03_pseudobulk_cpm", v.with_ctes(v.COUNTS, v.CELLS) + """
, b AS (SELECT nation, condition, gene_id, sum(value) AS value FROM counts JOIN cells USING (cell_id) GROUP BY 1, 2, 3)
SELECT nation, condition, gene_id, round(ln(1 + value / sum(value) OVER (PARTITION BY nation, condition) * 1000000.0::DOUBLE), 6) AS cpm
FROM b""".lstrip())
def _(spark, sf):
    rows = v.table(spark, sf, "lineitem").count()
    placed = spread(spread(v.counts(spark, sf, rows), rows, "cell_id").join(v.cells(spark, sf), "cell_id"), rows, "nation", "condition", "gene_id")
    bulk = placed.groupBy("nation", "condition", "gene_id").agg(F.sum("value").alias("value"))
    out = normalize.counts_per_million(bulk, ["nation", "condition"], log=True)
    return out.select("nation", "condition", "gene_id", F.round("cpm", 6).alias("cpm"))
