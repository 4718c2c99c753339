"""Queries for partition comparison and reconciliation (R, B)."""

from pyspark.sql import functions as F

from countloom.functions.ranking import exact_median
from countloom.operators import markers as mk, normalize, partitions as pt, reconcile as rc
from countloom.plans import views as v
from countloom.plans.catalog import query
from countloom.plans.study_donors import MARKERS, rounded
from countloom.plans.study_qc import LOGN


def _labels(spark, sf):
    """Two partitions of the documents, each covering part of them."""
    d = v.table(spark, sf, "documents")
    first = d.where(F.col("doc_id") % 10 != 0).select(F.col("doc_id").alias("cell_id"), F.col("lang").alias("label"))
    second = d.where(F.col("doc_id") % 7 != 0).select(
        F.col("doc_id").alias("cell_id"), F.when(F.col("doc_id") % 3 == 0, F.col("lang")).otherwise(F.concat(F.lit("k"), (F.length("source") + F.col("n_chars") % 2).cast("string"))).alias("label")
    )
    return first, second


LABELS = """
la AS (SELECT doc_id AS cell_id, lang AS label FROM documents WHERE doc_id % 10 <> 0),
lb AS (SELECT doc_id AS cell_id, CASE WHEN doc_id % 3 = 0 THEN lang ELSE 'k' || (length(source) + n_chars % 2) END AS label FROM documents WHERE doc_id % 7 <> 0),
ct AS (SELECT la.label AS a, lb.label AS b, count(*) AS n FROM la JOIN lb USING (cell_id) GROUP BY 1, 2),
ra AS (SELECT a, sum(n) AS n FROM ct GROUP BY 1), rb AS (SELECT b, sum(n) AS n FROM ct GROUP BY 1)"""


@query("r01_r02_agreement", "WITH " + LABELS + """, z AS (SELECT (SELECT sum(n) FROM ct) AS n, (SELECT sum(n * (n - 1) / 2) FROM ct) AS t,
  (SELECT sum(n * (n - 1) / 2) FROM ra) AS r, (SELECT sum(n * (n - 1) / 2) FROM rb) AS c),
e AS (SELECT -sum(n / (SELECT n FROM z) * ln(n / (SELECT n FROM z))) AS h FROM ct), ea AS (SELECT -sum(n / (SELECT n FROM z) * ln(n / (SELECT n FROM z))) AS h FROM ra),
eb AS (SELECT -sum(n / (SELECT n FROM z) * ln(n / (SELECT n FROM z))) AS h FROM rb)
SELECT CAST(n AS BIGINT) AS n_shared_cells, (SELECT count(*) FROM ra) AS n_first_labels, (SELECT count(*) FROM rb) AS n_second_labels,
  round((t - r * c / (n * (n - 1) / 2)) / ((r + c) / 2 - r * c / (n * (n - 1) / 2)), 6) AS ari,
  round(((SELECT h FROM ea) + (SELECT h FROM eb) - (SELECT h FROM e)) / (((SELECT h FROM ea) + (SELECT h FROM eb)) / 2), 6) AS nmi, 'computed' AS status FROM z""")
def _(spark, sf):
    return rounded(pt.agreement(pt.contingency(*_labels(spark, sf))), "ari", "nmi")


@query("r01_contingency", "WITH " + LABELS + "SELECT a, b, n FROM ct")
def _(spark, sf):
    return pt.contingency(*_labels(spark, sf))


# Every one-to-one assignment of the few primary labels, the best total Jaccard taken.
ASSIGN = """
sj AS (SELECT ct.a, ct.b, ct.n, ra.n AS na, rb.n AS nb, ct.n / (ra.n + rb.n - ct.n) AS j FROM ct JOIN ra USING (a) JOIN rb USING (b)),
al AS (SELECT a, row_number() OVER (ORDER BY a) AS k FROM ra),
rec AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS VARCHAR[]) AS bs, CAST(0 AS DOUBLE) AS t UNION ALL
  SELECT r.k + 1, list_append(r.bs, rb.b), r.t + coalesce(sj.j, 0) FROM rec r JOIN al ON al.k = r.k + 1 CROSS JOIN rb LEFT JOIN sj ON sj.a = al.a AND sj.b = rb.b
  WHERE NOT list_contains(r.bs, rb.b)),
best AS (SELECT bs FROM rec WHERE k = (SELECT count(*) FROM al) ORDER BY t DESC LIMIT 1),
mt AS (SELECT al.a, best.bs[al.k] AS b FROM al, best)"""


@query("r03_cluster_matching", "WITH RECURSIVE " + LABELS + "," + ASSIGN + """
SELECT mt.a AS primary_cluster, (SELECT count(*) FROM la WHERE label = mt.a) AS primary_total_cells, CAST(ra.n AS BIGINT) AS shared_cells,
  round(ra.n / (SELECT count(*) FROM la WHERE label = mt.a), 6) AS shared_coverage, (SELECT count(*) FROM la WHERE label = mt.a) < 10 AS small_primary_support,
  CASE WHEN ra.n < 10 THEN 'small_support' ELSE 'described' END AS support_status, mt.b AS matched_branch_cluster, 'matched' AS matching_status,
  coalesce(sj.n, 0) AS intersection_cells, CAST(ra.n + rb.n - coalesce(sj.n, 0) AS BIGINT) AS union_cells, round(coalesce(sj.n, 0) / (ra.n + rb.n - coalesce(sj.n, 0)), 6) AS shared_jaccard,
  round(coalesce(sj.n, 0) / ra.n, 6) AS shared_recall, round(coalesce(sj.n, 0) / rb.n, 6) AS shared_precision
FROM mt JOIN ra ON ra.a = mt.a JOIN rb ON rb.b = mt.b LEFT JOIN sj ON sj.a = mt.a AND sj.b = mt.b
UNION ALL SELECT NULL, NULL, CAST(coalesce(rb.n, 0) AS BIGINT), NULL, NULL, NULL, s.label, 'branch_unmatched', NULL, NULL, NULL, NULL, NULL
FROM (SELECT DISTINCT label FROM lb) s LEFT JOIN rb ON rb.b = s.label WHERE s.label NOT IN (SELECT b FROM mt)""")
def _(spark, sf):
    out = pt.match_clusters(*_labels(spark, sf))
    return rounded(out, "shared_coverage", "shared_jaccard", "shared_recall", "shared_precision")


@query("r04_class_retention", "WITH " + LABELS + """, u AS (SELECT cell_id, unnest(['__all__', label]) AS class FROM la)
SELECT class, count(*) AS source_cells, count(lb.cell_id) AS retained_cells, count(*) - count(lb.cell_id) AS excluded_cells, round(count(lb.cell_id) / count(*), 6) AS retention
FROM u LEFT JOIN lb USING (cell_id) GROUP BY 1""")
def _(spark, sf):
    return rounded(pt.class_retention(*_labels(spark, sf)), "retention")


RECOVER = """
ct AS (SELECT batch AS a, cluster AS b, count(*) AS n FROM cells GROUP BY 1, 2),
dm AS (SELECT a, arg_min(b, (-n, b)) AS b, max(n) AS n FROM ct GROUP BY 1),
dp AS (SELECT a, dm.b AS b, dm.n / (SELECT sum(n) FROM ct WHERE ct.b = dm.b) AS purity FROM dm),
rk AS (SELECT cluster, gene_name, mean_in - mean_rest AS d, row_number() OVER (PARTITION BY cluster ORDER BY round(mean_in - mean_rest, 12) DESC, round(detection_in - detection_rest, 12) DESC, gene_name, gene_index) AS rank FROM marks),
ex AS (SELECT unnest(['F', 'O', 'P']) AS a, gene_name FROM genes WHERE size <= 5)"""


@query("r05_marker_recovery", v.with_ctes(v.COUNTS, v.CELLS, v.GENES, LOGN, MARKERS, RECOVER) + """
SELECT a AS class, b AS dominant_cluster, round(purity, 6) AS purity, count(*) AS n_expected, count(rk.gene_name) AS n_recovered,
  count(rk.gene_name) > 0 AND purity >= 0.3 AS supported
FROM ex JOIN dp USING (a) LEFT JOIN rk ON rk.cluster = b AND rk.gene_name = ex.gene_name AND rank <= 50 AND d > 0 GROUP BY a, b, purity""")
def _(spark, sf):
    cells, genes = v.cells(spark, sf), v.genes(spark, sf)
    ranked = mk.rank_markers(mk.cluster_markers(normalize.log_normalize(v.counts(spark, sf)), cells, genes), 50)
    truth = cells.select("cell_id", F.col("batch").alias("label"))
    clusters = cells.select("cell_id", F.col("cluster").alias("label"))
    expected = genes.where(F.col("size") <= 5).select(F.explode(F.array(F.lit("F"), F.lit("O"), F.lit("P"))).alias("label"), "gene_name")
    return rounded(pt.marker_recovery(truth, clusters, ranked, expected, min_purity=0.3), "purity")


@query("r06_annotation_scores", "WITH " + LABELS + """,
m AS (SELECT la.label AS r, lb.label AS p, count(*) AS n FROM la JOIN lb USING (cell_id) GROUP BY 1, 2),
al(alias, canonical) AS (VALUES ('en', 'english'), ('de', 'german'), ('fr', 'french'), ('k4', 'english'), ('k5', 'german')),
x AS (SELECT n, x.canonical AS cp, y.canonical AS cr FROM m LEFT JOIN al x ON x.alias = p LEFT JOIN al y ON y.alias = r),
t AS (SELECT cr AS c, sum(n) AS pos, coalesce(sum(n) FILTER (WHERE cp = cr), 0) AS tp FROM x WHERE cr IS NOT NULL GROUP BY 1),
g AS (SELECT cp AS c, sum(n) AS pred FROM x WHERE cr IS NOT NULL AND cp IS NOT NULL GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS n_shared_cells, CAST(sum(n) FILTER (WHERE cr IS NOT NULL) AS BIGINT) AS n_cells_scored,
  CAST(coalesce(sum(n) FILTER (WHERE cr IS NULL), 0) AS BIGINT) AS n_reference_unmapped, CAST(coalesce(sum(n) FILTER (WHERE cp IS NULL), 0) AS BIGINT) AS n_prediction_unmapped,
  round(sum(n) FILTER (WHERE cp = cr) / sum(n) FILTER (WHERE cr IS NOT NULL), 6) AS accuracy,
  round((SELECT avg(2.0::DOUBLE * tp / (pos + coalesce(pred, 0))) FROM t LEFT JOIN g USING (c)), 6) AS macro_f1 FROM x""")
def _(spark, sf):
    first, second = _labels(spark, sf)
    rows = [("EN", "english"), ("de ", "german"), ("fr", "french"), ("k4", "english"), ("K5", "german")]
    return rounded(pt.score_annotation(second, first, spark.createDataFrame(rows, "alias string, canonical string")), "accuracy", "macro_f1")


@query("r07_all_donors", v.with_ctes(v.CELLS) + """
, s AS (SELECT cell_id FROM cells ORDER BY substr(md5('20261003:' || cell_id), 1, 15), cell_id LIMIT (SELECT CAST(floor(count(*) * 0.8) AS BIGINT) FROM cells))
SELECT branch, count(*) AS n_cells, CAST(sum(cell_id) AS BIGINT) AS id_sum FROM (SELECT 'primary' AS branch, cell_id FROM cells UNION ALL SELECT 'uniform_sample_80pct', cell_id FROM s
UNION ALL SELECT 'leave_out_' || d.nation, c.cell_id FROM (SELECT DISTINCT nation FROM cells) d JOIN cells c ON c.nation <> d.nation) GROUP BY 1""".lstrip())
def _(spark, sf):
    return pt.perturbed_sets(v.cells(spark, sf), donor="nation").groupBy("branch").agg(F.count(F.lit(1)).alias("n_cells"), F.sum("cell_id").alias("id_sum"))


@query("r07_fold_status", v.with_ctes(v.CELLS) + """
SELECT count(DISTINCT nation) AS n_donors, CASE WHEN count(DISTINCT nation) > 4 THEN 'not_eligible' ELSE 'planned' END AS status, CASE WHEN count(DISTINCT nation) > 4 THEN 'more than 4 donors' END AS reason FROM cells""")
def _(spark, sf):
    return pt.fold_status(v.cells(spark, sf), "nation", most=4)


@query("r07_perturbed_sets", v.with_ctes(v.CELLS) + """
, s AS (SELECT cell_id FROM cells ORDER BY substr(md5('20261003:' || cell_id), 1, 15), cell_id LIMIT (SELECT CAST(floor(count(*) * 0.8) AS BIGINT) FROM cells))
SELECT 'primary' AS branch, cell_id FROM cells UNION ALL SELECT 'uniform_sample_80pct', cell_id FROM s
UNION ALL SELECT 'leave_out_' || d.batch, c.cell_id FROM (SELECT DISTINCT batch FROM cells) d JOIN cells c ON c.batch <> d.batch""".lstrip())
def _(spark, sf):
    return pt.perturbed_sets(v.cells(spark, sf), donor="batch")


GENES = ["src", "chars", "lang"]


def summary_cells(spark, sf):
    """Labelled documents as cells: sources as samples, languages as states, labels as masks."""
    d, lab = v.table(spark, sf, "documents"), v.table(spark, sf, "labels")
    j = d.join(lab, "doc_id", "left")
    return j.select(
        F.col("doc_id").alias("cell_id"), F.when(F.col("doc_id") % 2 == 0, "ref").otherwise("query").alias("sample_id"), F.col("lang").alias("state"),
        F.col("n_chars").cast("long").alias("total_counts"), F.length("source").cast("long").alias("src_raw_UMI"), (F.col("n_chars") % 17).cast("long").alias("chars_raw_UMI"),
        F.length("lang").cast("long").alias("lang_raw_UMI"),
        F.lit(True).alias("mask_all_pass"), F.lit(True).alias("mask_all_metadata_known"),
        F.coalesce(F.col("quality") == 1, F.lit(False)).alias("mask_quality_pass"), F.col("quality").isNotNull().alias("mask_quality_metadata_known"),
        F.coalesce(F.col("toxic") == 0, F.lit(False)).alias("mask_clean_pass"), F.col("toxic").isNotNull().alias("mask_clean_metadata_known"),
        F.coalesce(F.col("quality") == 1, F.lit(False)).alias("mask_good_pass"), F.col("quality").isNotNull().alias("mask_good_metadata_known"),
    )


MASKS = ["all", "quality", "clean", "good"]
SUMMARY = """
sc AS (SELECT doc_id AS cell_id, CASE WHEN doc_id % 2 = 0 THEN 'ref' ELSE 'query' END AS sample_id, lang AS state, n_chars AS total, length(source) AS src, n_chars % 17 AS chars, length(lang) AS lg, quality, toxic
  FROM documents LEFT JOIN labels USING (doc_id)),
ml AS (SELECT *, true AS passed, true AS known, 'all' AS mask FROM sc UNION ALL SELECT *, coalesce(quality = 1, false), quality IS NOT NULL, 'quality' FROM sc
  UNION ALL SELECT *, coalesce(toxic = 0, false), toxic IS NOT NULL, 'clean' FROM sc UNION ALL SELECT *, coalesce(quality = 1, false), quality IS NOT NULL, 'good' FROM sc),
gr AS (SELECT DISTINCT state, mask, s.sample_id FROM ml CROSS JOIN (SELECT DISTINCT sample_id FROM sc) s),
se AS (SELECT state, mask, sample_id, count(ml.cell_id) AS n_in, count(*) FILTER (WHERE known) AS n_known, count(*) FILTER (WHERE passed) AS n_sel,
  coalesce(sum(total) FILTER (WHERE passed), 0) AS lib FROM gr LEFT JOIN ml USING (state, mask, sample_id) GROUP BY 1, 2, 3),
sel AS (SELECT *, n_in = 0 OR n_known > 0 AS av FROM se),
gl AS (SELECT state, mask, sample_id, unnest(['src', 'chars', 'lang']) AS gene_symbol, unnest([src, chars, lg]) AS raw FROM ml WHERE passed),
gg AS (SELECT state, mask, sample_id, gene_symbol, sum(raw) AS s, count(*) FILTER (WHERE raw > 0) AS d FROM gl GROUP BY 1, 2, 3, 4),
gs AS (SELECT state, mask, sample_id, x.gene_symbol, n_sel AS n_cells, av, lib, coalesce(s, 0) AS s, coalesce(d, 0) AS d
  FROM sel CROSS JOIN (SELECT unnest(['src', 'chars', 'lang']) AS gene_symbol) x LEFT JOIN gg USING (state, mask, sample_id, gene_symbol))"""


def masked(spark, sf):
    keep = ["cell_id", "sample_id", "state", "total_counts"] + [f"{g}_raw_UMI" for g in GENES]
    return rc.long_masks(summary_cells(spark, sf), MASKS, keep)


def selections(spark, sf):
    return rc.selection_counts(masked(spark, sf), ["state"], summary_cells(spark, sf))


@query("b01_selection_counts", "WITH " + SUMMARY + """
SELECT state, mask, sample_id, n_in AS n_input_cells, n_known AS n_metadata_known, n_in - n_known AS n_metadata_missing, n_sel AS n_cells, av AS mask_available,
  CASE WHEN NOT av THEN 'unavailable' WHEN n_in = 0 THEN 'missing_cells' WHEN n_known < n_in THEN 'available_with_missing_metadata' ELSE 'available' END AS mask_status,
  CASE WHEN av THEN CAST(lib AS BIGINT) END AS total_selected_library FROM sel""")
def _(spark, sf):
    return selections(spark, sf)


def gene_rows(spark, sf):
    return rc.gene_summaries(masked(spark, sf), GENES, ["state"], selections(spark, sf))


@query("b02_gene_summaries", "WITH " + SUMMARY + """
SELECT state, mask, sample_id, gene_symbol, n_cells, CASE WHEN av THEN CAST(s AS BIGINT) END AS raw_count_sum, CASE WHEN av THEN d END AS detected_cells,
  round(CASE WHEN av AND n_cells > 0 THEN d / n_cells END, 6) AS detection_fraction, round(CASE WHEN av AND lib > 0 THEN s / lib * 1e6 END, 6) AS pseudobulk_cpm FROM gs""")
def _(spark, sf):
    return rounded(gene_rows(spark, sf).drop("mask_available", "total_selected_library"), "detection_fraction", "pseudobulk_cpm")


@query("b03_reconciliation", "WITH " + SUMMARY + """
SELECT state, mask, sample_id, gene_symbol, 'raw_count_sum' AS problem FROM gs WHERE av AND state = 'de' AND gene_symbol = 'chars' UNION ALL
SELECT state, mask, sample_id, gene_symbol, 'pseudobulk_cpm' FROM gs WHERE av AND lib > 0 AND s > 0 AND state = 'fr' AND gene_symbol = 'src' UNION ALL
SELECT state, mask, sample_id, gene_symbol, 'missing_row' FROM gs WHERE state = 'es' AND mask = 'clean'""")
def _(spark, sf):
    fresh = gene_rows(spark, sf)
    supplied = fresh.where(~((F.col("state") == "es") & (F.col("mask") == "clean"))).withColumns({
        "raw_count_sum": F.col("raw_count_sum") + F.when((F.col("state") == "de") & (F.col("gene_symbol") == "chars"), 1).otherwise(0),
        "pseudobulk_cpm": F.col("pseudobulk_cpm") * F.when((F.col("state") == "fr") & (F.col("gene_symbol") == "src"), 1.0001).otherwise(1.0),
    })
    return rc.reconcile(fresh, supplied, ["state", "mask", "sample_id", "gene_symbol"], ["n_cells", "raw_count_sum", "detected_cells"], ["detection_fraction", "pseudobulk_cpm"])


MODULES = """
mo AS (SELECT state, mask, module_id, count(*) FILTER (WHERE sample_id = 'ref') AS fr, count(*) FILTER (WHERE sample_id = 'query') AS fq,
  median(score) FILTER (WHERE sample_id = 'ref') AS mr, median(score) FILTER (WHERE sample_id = 'query') AS mq
  FROM (SELECT state, mask, sample_id, unnest(['m1', 'm2']) AS module_id, unnest([chars * 1.0::DOUBLE, total * 1.0::DOUBLE / (1 + src)]) AS score FROM ml WHERE passed) GROUP BY 1, 2, 3),
ms AS (SELECT mo.*, r.n_sel AS nr, q.n_sel AS nq, CASE WHEN NOT (r.av AND q.av) THEN 'unavailable' WHEN least(r.n_sel, q.n_sel) = 0 OR least(fr, fq) = 0 THEN 'missing'
    WHEN least(r.n_sel, q.n_sel, fr, fq) < 25 THEN 'low_cells' ELSE 'comparable' END AS st
  FROM mo JOIN sel r ON r.state = mo.state AND r.mask = mo.mask AND r.sample_id = 'ref' JOIN sel q ON q.state = mo.state AND q.mask = mo.mask AND q.sample_id = 'query'),
md AS (SELECT *, CASE WHEN st = 'comparable' THEN mq - mr END AS delta FROM ms)"""


def module_rows(spark, sf):
    score = F.array(
        F.struct(F.lit("m1").alias("module_id"), F.col("chars_raw_UMI").cast("double").alias("score")),
        F.struct(F.lit("m2").alias("module_id"), (F.col("total_counts") / (1 + F.col("src_raw_UMI"))).alias("score")),
    )
    rows = masked(spark, sf).where("passed").select("state", "mask", "sample_id", F.inline(score))
    per = rows.groupBy("state", "mask", "module_id", "sample_id").agg(F.count("score").alias("n")).join(
        exact_median(rows, ["state", "mask", "module_id", "sample_id"], "score", "m"), ["state", "mask", "module_id", "sample_id"], "left"
    )
    ref, qry = F.col("sample_id") == "ref", F.col("sample_id") == "query"
    modules = per.groupBy("state", "mask", "module_id").agg(
        F.coalesce(F.max(F.when(ref, F.col("n"))), F.lit(0)).alias("n_finite_scores_reference"), F.coalesce(F.max(F.when(qry, F.col("n"))), F.lit(0)).alias("n_finite_scores_query"),
        F.max(F.when(ref, F.col("m"))).alias("median_score_reference"), F.max(F.when(qry, F.col("m"))).alias("median_score_query"),
    )
    return rc.module_status(modules, selections(spark, sf), ["state"], "ref", "query", 25)


@query("b04_module_status", "WITH " + SUMMARY + ",\n" + MODULES + """
SELECT state, mask, module_id, nr AS n_cells_reference, nq AS n_cells_query, st AS comparison_status, round(delta, 6) AS median_score_delta FROM md""")
def _(spark, sf):
    out = module_rows(spark, sf).select("state", "mask", "module_id", "n_cells_reference", "n_cells_query", "comparison_status", "median_score_delta")
    return rounded(out, "median_score_delta")


WORD = "CAST(sum(CASE WHEN passed THEN CAST('0x' || substr(sha256(CAST(cell_id AS VARCHAR)), {0}, 15) AS BIGINT)::HUGEINT ELSE 0 END) AS VARCHAR)"
MEMBERS = ("mb AS (SELECT state, mask, count(*) FILTER (WHERE passed) AS n_cells, sha256(count(*) FILTER (WHERE passed) || '/' || "
           + " || '/' || ".join(WORD.format(1 + 15 * i) for i in range(4)) + ") AS h FROM ml GROUP BY 1, 2)")


@query("b05_mask_equivalence", "WITH " + SUMMARY + ",\n" + MEMBERS + """
SELECT state, n_cells, h AS membership_sha256, min(mask) AS canonical_mask, string_agg(DISTINCT mask, ',' ORDER BY mask) AS masks FROM mb GROUP BY 1, 2, 3""")
def _(spark, sf):
    members = rc.membership(masked(spark, sf), ["state"])
    return rc.equivalent_masks(members, ["state"]).withColumn("masks", F.array_join("masks", ","))


@query("b06_module_sensitivity", "WITH " + SUMMARY + ",\n" + MODULES + ",\n" + MEMBERS + """
, f AS (SELECT state, module_id, h, arg_min(st, mask) AS st, arg_min(delta, mask) FILTER (WHERE delta IS NOT NULL) AS delta, count(*) FILTER (WHERE st = 'comparable') AS n,
  max(delta) FILTER (WHERE mask = 'all') AS a FROM md JOIN mb USING (state, mask) GROUP BY 1, 2, 3)
SELECT state, module_id, round(max(a), 6) AS all_delta, CAST(sum(n) AS BIGINT) AS n_comparable_masks, count(*) FILTER (WHERE st = 'comparable') AS n_distinct_comparable_cell_sets,
  round(min(delta) FILTER (WHERE st = 'comparable'), 6) AS delta_min, round(max(delta) FILTER (WHERE st = 'comparable'), 6) AS delta_max,
  CASE WHEN count(*) FILTER (WHERE st = 'comparable') < 2 THEN 'insufficient_distinct_comparable_cell_sets'
    WHEN min(sign(delta)) FILTER (WHERE st = 'comparable') = -1 AND max(sign(delta)) FILTER (WHERE st = 'comparable') = 1 THEN 'sign_flip'
    WHEN min(sign(delta)) FILTER (WHERE st = 'comparable') <> max(sign(delta)) FILTER (WHERE st = 'comparable') THEN 'mixed_zero_and_nonzero'
    WHEN min(sign(delta)) FILTER (WHERE st = 'comparable') = 1 THEN 'consistent_positive' WHEN min(sign(delta)) FILTER (WHERE st = 'comparable') = -1 THEN 'consistent_negative'
    ELSE 'consistent_zero' END AS sign_status FROM f GROUP BY 1, 2""")
def _(spark, sf):
    out = rc.module_sensitivity(module_rows(spark, sf), rc.membership(masked(spark, sf), ["state"]), ["state"])
    return rounded(out, "all_delta", "delta_min", "delta_max")


@query("b07_gene_contrasts", "WITH " + SUMMARY + """
, w AS (SELECT r.state, r.mask, r.gene_symbol, r.n_cells AS nr, q.n_cells AS nq, r.av AND q.av AS av, q.d / nullif(q.n_cells, 0) - r.d / nullif(r.n_cells, 0) AS dd,
  q.s / nullif(q.lib, 0) * 1e6 - r.s / nullif(r.lib, 0) * 1e6 AS dc FROM gs r JOIN gs q USING (state, mask, gene_symbol) WHERE r.sample_id = 'ref' AND q.sample_id = 'query'),
z AS (SELECT *, CASE WHEN NOT av THEN 'unavailable' WHEN least(nr, nq) = 0 THEN 'missing' WHEN least(nr, nq) < 25 THEN 'low_cells' ELSE 'comparable' END AS st FROM w)
SELECT state, mask, gene_symbol, st AS comparison_status, nr AS n_cells_reference, nq AS n_cells_query, round(CASE WHEN st = 'comparable' THEN dd END, 6) AS detection_fraction_delta,
  round(CASE WHEN st = 'comparable' THEN dc END, 6) AS pseudobulk_cpm_delta FROM z""")
def _(spark, sf):
    out = rc.gene_contrasts(gene_rows(spark, sf), ["state"], "ref", "query", 25)
    return rounded(out, "detection_fraction_delta", "pseudobulk_cpm_delta")
