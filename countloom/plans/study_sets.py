"""Queries for gene sets, text ranking, pairs and signatures (F, G, L, P)."""

from pyspark.sql import functions as F

from countloom.functions.special import hypergeom_tail, normal_two_sided
from countloom.operators import genesets as gs, normalize, pairs as lr, signatures as sg
from countloom.plans import sql_parts as sp, views as v
from countloom.plans.catalog import query
from countloom.plans.study_donors import A, B, N_A, N_B, PAIRED_CELLS, PAIRS, rounded
from countloom.plans.study_qc import LOGN
from countloom.session import spread


def sets(spark, sf):
    """Brands as sets of parts."""
    p = v.table(spark, sf, "part").select(F.col("p_brand").alias("set_id"), F.concat(F.lit("g"), F.col("p_partkey").cast("string")).alias("gene"))
    sizes = p.groupBy("set_id").agg(F.count(F.lit(1)).alias("set_size"))
    return p.join(sizes, "set_id").withColumn("category", F.lit("BP"))


def set_query(spark, sf):
    return v.table(spark, sf, "part").where((F.col("p_size") <= 12) & F.col("p_type").isin("SMALL", "PROMO")).select(
        F.concat(F.lit(" G"), F.col("p_partkey").cast("string"), F.lit(" ")).alias("gene")
    )


HYPER = """
q AS (SELECT p_partkey AS g FROM part WHERE p_size <= 12 AND p_type IN ('SMALL', 'PROMO')),
s AS (SELECT p_brand AS set_id, count(*) AS set_size, count(*) FILTER (WHERE p_partkey IN (SELECT g FROM q)) AS k,
      (SELECT count(*) FROM q) AS n, (SELECT count(*) FROM part) AS m FROM part GROUP BY 1),
tail AS (SELECT set_id, sum(exp(lgamma(set_size + 1) - lgamma(j + 1) - lgamma(set_size - j + 1) + lgamma(m - set_size + 1) - lgamma(n - j + 1)
      - lgamma(m - set_size - n + j + 1) - lgamma(m + 1) + lgamma(n + 1) + lgamma(m - n + 1))) AS p
      FROM s, LATERAL (SELECT unnest(range(k, least(set_size, n) + 1)) AS j) GROUP BY 1),
hyper AS (SELECT s.*, CASE WHEN k > 0 THEN least(1.0, p) ELSE 1.0 END AS p_value FROM s JOIN tail USING (set_id)),
hr AS (SELECT *, """ + sp.bh_ranks() + """ FROM hyper)"""


@query("g01_over_representation", "WITH " + HYPER + f""", e AS (SELECT *, {sp.bh()} AS q FROM hr)
SELECT set_id, k AS gene_count, set_size, n AS sample_size, round((k / n) / (set_size / m), 3) AS fold_enrichment, round(p_value, 6) AS p_value,
  round(q, 6) AS fdr_q_value FROM e WHERE k > 0 AND q <= 0.999""")
def _(spark, sf):
    m = v.table(spark, sf, "part").agg(F.count(F.lit(1)).alias("n")).scalar()
    out = gs.over_representation(sets(spark, sf), set_query(spark, sf), m, fdr_cutoff=0.999).drop("category", "background_size")
    return rounded(out, "p_value", "fdr_q_value")


@query("g01_matched_genes", "SELECT p_brand AS set_id, 'G' || p_partkey AS gene FROM part WHERE p_size <= 12 AND p_type IN ('SMALL', 'PROMO')")
def _(spark, sf):
    return gs.matched_genes(sets(spark, sf), set_query(spark, sf))


@query("g02_odds_enrichment", "WITH " + HYPER + f"""
SELECT set_id, k AS gene_count, set_size, round(p_value, 6) AS p_value, round({sp.bh()}, 6) AS fdr_q_value,
  CASE WHEN k > 0 THEN round(((k + 0.5) / greatest(n - k + 0.5, 0.5)) / (greatest(set_size - k + 0.5, 0.5) / greatest(m - set_size - n + k + 0.5, 0.5)), 3) ELSE 0 END AS odds_ratio FROM hr""")
def _(spark, sf):
    m = v.table(spark, sf, "part").agg(F.count(F.lit(1)).alias("n")).scalar()
    out = gs.odds_enrichment(sets(spark, sf), set_query(spark, sf), m).drop("category", "background_size", "sample_size")
    return rounded(out, "p_value", "fdr_q_value")


@query("g03_query_genes", "SELECT CAST(event_id AS VARCHAR) AS gene FROM events WHERE abs(value - 20) >= 15 AND event_id % 1000 / 1000.0 <= 0.05")
def _(spark, sf):
    e = v.table(spark, sf, "events").select(
        F.col("event_id").alias("gene"), (F.col("value") - 20).alias("log2_fold_change"), (F.col("event_id") % 1000 / 1000.0).alias("padj")
    )
    return gs.query_genes(e, min_log2fc=15)


def gene_info(spark, sf):
    p = v.table(spark, sf, "part")
    key = F.col("p_partkey").cast("string")
    return p.select(
        F.when(F.col("p_partkey") % 20 == 4, F.concat(F.lit("abC"), key)).when(F.col("p_partkey") % 20 == 5, F.concat(F.lit("aBC"), (F.col("p_partkey") - 1).cast("string")))
        .when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("Abc"), key)).otherwise(F.concat(F.lit("ABC"), (F.col("p_partkey") - 1).cast("string"))).alias("gene_symbol"),
        F.when(F.col("p_partkey") % 2 == 0, "mus_musculus").otherwise("homo_sapiens").alias("species"),
        F.array(F.concat(F.lit("al"), key), F.concat(F.lit("x"), key)).alias("aliases"),
        F.create_map(F.lit("human"), F.concat(F.lit("HO"), key), F.lit("rat"), F.concat(F.lit("Ro"), key)).alias("orthologs"),
        F.col("p_partkey").alias("entry_order"),
    )


def symbols(spark, sf):
    p = v.table(spark, sf, "part")
    k, key = F.col("p_partkey") % 6, F.col("p_partkey").cast("string")
    return p.select(
        F.when(k == 0, F.concat(F.lit("Abc"), key)).when(k == 1, F.concat(F.lit("abc"), (F.col("p_partkey") - 1).cast("string")))
        .when(k == 2, F.concat(F.lit("ABC"), key)).when(k == 3, F.concat(F.lit("AL"), key)).when(k == 4, F.concat(F.lit("ho"), key))
        .otherwise(F.concat(F.lit("none"), key)).alias("symbol")
    )


LOOKUP = """
WITH info AS (SELECT p_partkey AS o, CASE WHEN p_partkey % 20 = 4 THEN 'abC' || p_partkey WHEN p_partkey % 20 = 5 THEN 'aBC' || (p_partkey - 1) WHEN p_partkey % 2 = 0 THEN 'Abc' || p_partkey ELSE 'ABC' || (p_partkey - 1) END AS gene_symbol,
  CASE WHEN p_partkey % 2 = 0 THEN 'mus_musculus' ELSE 'homo_sapiens' END AS species, 'AL' || p_partkey AS alias, 'HO' || p_partkey AS human FROM part),
s AS (SELECT DISTINCT CASE p_partkey % 6 WHEN 0 THEN 'Abc' || p_partkey WHEN 1 THEN 'abc' || (p_partkey - 1) WHEN 2 THEN 'ABC' || p_partkey
  WHEN 3 THEN 'AL' || p_partkey WHEN 4 THEN 'ho' || p_partkey ELSE 'none' || p_partkey END AS symbol FROM part),
c AS (SELECT symbol, gene_symbol, species, o, human, CASE WHEN symbol = gene_symbol THEN 1 ELSE 2 END AS tier FROM s JOIN info ON upper(symbol) = upper(gene_symbol)
  UNION ALL SELECT symbol, gene_symbol, species, o, human, 3 FROM s JOIN info ON upper(symbol) = alias
  UNION ALL SELECT symbol, gene_symbol, species, o, human, 4 FROM s JOIN info ON upper(symbol) = human),
r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY tier, CASE WHEN tier = 2 AND symbol LIKE 'Abc%' THEN species <> 'mus_musculus' WHEN tier = 2 AND symbol LIKE 'ABC%' THEN species <> 'homo_sapiens' ELSE false END, o) AS rn FROM c)
"""


@query("g04_gene_lookup", LOOKUP + "SELECT symbol, gene_symbol, species, CAST(tier AS BIGINT) AS tier FROM r WHERE rn = 1")
def _(spark, sf):
    return gs.lookup_genes(symbols(spark, sf), gene_info(spark, sf)).drop("orthologs")


@query("g05_orthologs", LOOKUP + "SELECT symbol, human AS ortholog FROM r WHERE rn = 1")
def _(spark, sf):
    return gs.map_orthologs(symbols(spark, sf), gene_info(spark, sf))


def records(spark, sf):
    d = v.table(spark, sf, "documents")
    return d.select(
        F.col("doc_id").alias("record_id"), F.split_part(F.col("text"), F.lit("\n"), F.lit(1)).alias("title"), F.col("text").alias("abstract"),
        (1990 + F.col("doc_id") % 30).alias("year"), (F.col("n_chars") % 50).alias("citation_count"), "source",
    )


WORDS = ["that", "therin", "eaux", "question"]
RANK = (
    "r AS (SELECT doc_id, n_chars % 50 AS c, split_part(lower(text), chr(10), 1) AS t, lower(text) AS a FROM documents WHERE 1990 + doc_id % 30 >= 1995),\n"
    "sc AS (SELECT doc_id, c, " + " + ".join(
        f"CASE WHEN contains(t, '{w}') THEN 3.0::DOUBLE WHEN contains(a, '{w}') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END" for w in WORDS
    ) + " AS s FROM r)"
)


@query("g06_ranked_records", "WITH " + RANK + """
SELECT doc_id AS record_id, c AS citation_count, round(least(1.0::DOUBLE, s / 13.0::DOUBLE * 0.7 + log10(1.0 + c) * 0.15), 3) AS relevance_score FROM sc WHERE s > 0
ORDER BY relevance_score DESC, c DESC, doc_id LIMIT 25""")
def _(spark, sf):
    return gs.rank_records(records(spark, sf), "that AND therin, eaux question", 25, min_year=1995).select("record_id", "citation_count", "relevance_score")


@query("g07_genes_in_text", """
WITH w AS (SELECT DISTINCT item_id AS text_id, upper(trim(unnest(regexp_split_to_array(replace(text, 'ß', 'ss'), '[\\s,\\-_()/]+')))) AS gene FROM benchmark),
k AS (SELECT DISTINCT upper(unnest(regexp_split_to_array(replace(text, 'ß', 'ss'), '[\\s,\\-_()/]+'))) AS gene FROM conversations WHERE role = 'user')
SELECT text_id, gene FROM w WHERE gene <> '' AND gene IN (SELECT gene FROM k)""")
def _(spark, sf):
    texts = v.table(spark, sf, "benchmark").select(F.col("item_id").alias("text_id"), "text")
    known = v.table(spark, sf, "conversations").where(F.col("role") == "user").select(F.explode(F.split("text", r"[\s,\-_()/]+")).alias("gene")).distinct()
    return gs.genes_in_text(texts, known)


@query("g08_gene_set_report", "WITH " + HYPER + f""", e AS (SELECT *, {sp.bh()} AS fq FROM hr), {RANK.replace(" WHERE 1990 + doc_id % 30 >= 1995", "")},
top AS (SELECT set_id, fq FROM e WHERE k > 0 AND fq <= 1 ORDER BY fq, p_value, set_id LIMIT 3),
rec AS (SELECT doc_id, round(least(1.0::DOUBLE, s / 13.0::DOUBLE * 0.7 + log10(1.0 + c) * 0.15), 3) AS z FROM sc WHERE s > 0 ORDER BY z DESC, c DESC, doc_id LIMIT 3),
gl AS (SELECT 'G' || p_partkey AS g FROM part WHERE p_size <= 12 AND p_type IN ('SMALL', 'PROMO') ORDER BY g LIMIT 3)
SELECT 'gene_set' AS section, set_id AS item, round(1 - fq, 6) AS score FROM top UNION ALL SELECT 'gene', lower(g), 1.0 FROM gl UNION ALL SELECT 'record', CAST(doc_id AS VARCHAR), z FROM rec""")
def _(spark, sf):
    part = v.table(spark, sf, "part")
    m = part.agg(F.count(F.lit(1)).alias("n")).scalar()
    key = F.col("p_partkey").cast("string")
    info = part.select(
        F.concat(F.lit("g"), key).alias("gene_symbol"), F.lit("homo_sapiens").alias("species"), F.array(F.concat(F.lit("al"), key)).alias("aliases"),
        F.create_map(F.lit("human"), F.concat(F.lit("HO"), key)).alias("orthologs"), F.col("p_partkey").alias("entry_order"),
    )
    out = gs.gene_set_report(sets(spark, sf), set_query(spark, sf).select(F.trim("gene").alias("gene")), info, records(spark, sf), " ".join(WORDS), m, fdr_cutoff=1.0)
    return rounded(out, "score")


@query("f02_normal_tail", f"""
WITH r AS (SELECT event_id, value / 10 AS z FROM events), {sp.normal_tail('r', 'event_id', 't', 'z')}
SELECT event_id, round(p, 5) AS p FROM t""")
def _(spark, sf):
    return v.table(spark, sf, "events").select("event_id", F.round(normal_two_sided(F.col("value") / 10), 5).alias("p"))


@query("f03_hypergeometric_tail", """
WITH r AS (SELECT event_id, 500 AS m, 20 + event_id % 80 AS s, 30 + event_id % 37 AS n, 1 + event_id % 9 AS k FROM events),
t AS (SELECT event_id, sum(exp(lgamma(s + 1) - lgamma(j + 1) - lgamma(s - j + 1) + lgamma(m - s + 1) - lgamma(n - j + 1) - lgamma(m - s - n + j + 1)
  - lgamma(m + 1) + lgamma(n + 1) + lgamma(m - n + 1))) AS p FROM r, LATERAL (SELECT unnest(range(k, least(s, n) + 1)) AS j) GROUP BY 1)
SELECT event_id, round(p, 6) AS p FROM t""")
def _(spark, sf):
    i = F.col("event_id")
    return v.table(spark, sf, "events").select("event_id", F.round(hypergeom_tail(1 + i % 9, F.lit(500), 20 + i % 80, 30 + i % 37), 6).alias("p"))


def resource(spark, sf):
    """Each part paired with the next key; a third of the rows repeat with odd headers and blanks."""
    p = v.table(spark, sf, "part")
    k = F.col("p_partkey")
    name = F.concat(F.lit(" g"), k.cast("string"))
    nxt = F.concat(F.lit("g"), (k + 1).cast("string"), F.when(k % 5 == 0, F.concat(F.lit("_g"), (k * 3).cast("string"))).otherwise(F.lit("")))
    return p.select(name.alias("Ligand"), F.when(k % 11 == 0, " ").otherwise(nxt).alias("RECEPTOR"), k.alias("row"), F.col("p_brand").alias("pathway")).unionByName(
        p.where(k % 3 == 0).select(name.alias("Ligand"), nxt.alias("RECEPTOR"), (k + 1_000_000_000).alias("row"), F.lit("repeat").alias("pathway"))
    )


RES = """res0 AS (SELECT 'g' || p_partkey AS ligand, CASE WHEN p_partkey % 11 = 0 THEN '' ELSE 'g' || (p_partkey + 1) || CASE WHEN p_partkey % 5 = 0 THEN '_g' || (p_partkey * 3) ELSE '' END END AS receptor,
  p_partkey AS "row", p_brand AS pathway FROM part UNION ALL
  SELECT 'g' || p_partkey, 'g' || (p_partkey + 1) || CASE WHEN p_partkey % 5 = 0 THEN '_g' || (p_partkey * 3) ELSE '' END, p_partkey + 1000000000, 'repeat' FROM part WHERE p_partkey % 3 = 0),
res AS (SELECT ligand, receptor, min("row") AS "row", arg_min(pathway, "row") AS pathway FROM res0 WHERE receptor <> '' GROUP BY 1, 2)"""


@query("l01_clean_pairs", "WITH " + RES + 'SELECT ligand, receptor, "row", pathway FROM res')
def _(spark, sf):
    return lr.clean_pairs(resource(spark, sf), "row")


@query("l02_evaluable_pairs", "WITH " + RES + """, c AS (SELECT ligand, receptor, unnest(list_distinct(string_split(ligand, '_') || string_split(receptor, '_'))) AS g FROM res)
SELECT ligand, receptor, coalesce(string_agg(g, ',' ORDER BY g) FILTER (WHERE g NOT IN (SELECT 'g' || p_partkey FROM part)), '') AS missing_genes,
  count(*) FILTER (WHERE g NOT IN (SELECT 'g' || p_partkey FROM part)) = 0 AS evaluable FROM c GROUP BY 1, 2""")
def _(spark, sf):
    genes = v.genes(spark, sf).select(F.col("gene_name").alias("gene"))
    return lr.evaluable_pairs(lr.clean_pairs(resource(spark, sf), "row"), genes).withColumn("missing_genes", F.array_join("missing_genes", ","))


def _pair_rows(spark, sf):
    """Rows in which group b misses some pairs and group c holds unknown ones."""
    pairs = lr.clean_pairs(resource(spark, sf), "row")
    groups = F.array(F.lit("a"), F.lit("b"), F.lit("c"))
    rows = pairs.withColumn("group_id", F.explode(groups)).where(~((F.col("group_id") == "b") & (F.col("row") % 7 == 0)))
    ghost = pairs.where(F.col("row") % 50 == 0).select(F.concat(F.lit("z"), "ligand").alias("ligand"), "receptor", F.lit("c").alias("group_id"))
    return pairs, rows.select("ligand", "receptor", "group_id").unionByName(ghost)


@query("l03_coverage_gaps", "WITH " + RES + """
SELECT 'b' AS group_id, ligand, receptor, 'missing_pair' AS problem FROM res WHERE "row" % 7 = 0 UNION ALL
SELECT 'c', 'z' || ligand, receptor, 'unexpected_pair' FROM res WHERE "row" % 50 = 0""")
def _(spark, sf):
    pairs, rows = _pair_rows(spark, sf)
    return lr.coverage_gaps(rows, rows.select("group_id").distinct(), pairs)


def _pair_keys(spark, sf):
    """Pairs of neighbouring parts, as gene ids."""
    return v.table(spark, sf, "part").select(F.col("p_partkey").alias("ligand"), (F.col("p_partkey") + 1).alias("receptor"))


PK = "pk AS (SELECT p_partkey AS ligand, p_partkey + 1 AS receptor FROM part)"
GROUP_SCORES = """
tn AS (SELECT donor, condition, cluster AS cell_type, count(*) AS n FROM two GROUP BY 1, 2, 3),
tm AS (SELECT two.donor, two.condition, cluster AS cell_type, gene_id, sum(value) / max(n) AS m FROM counts JOIN two USING (cell_id)
  JOIN tn ON tn.donor = two.donor AND tn.condition = two.condition AND tn.cell_type = two.cluster GROUP BY two.donor, two.condition, cluster, gene_id),
tt AS (SELECT *, m / sum(m) OVER (PARTITION BY donor, condition, gene_id) AS share FROM tm),
gr AS (SELECT donor, condition, count(*) * count(*) * (SELECT count(*) FROM pk) AS g FROM tn GROUP BY 1, 2),
gp AS (SELECT l.donor, l.condition, l.cell_type AS source, r.cell_type AS target, ligand, receptor, sqrt(l.m * r.m) AS magnitude, l.share * r.share AS specificity
  FROM pk JOIN tt l ON l.gene_id = ligand JOIN tt r ON r.gene_id = receptor AND r.donor = l.donor AND r.condition = l.condition),
gx AS (SELECT gp.*, (rank() OVER (PARTITION BY gp.donor, gp.condition ORDER BY magnitude DESC) - 1) / (g - 1) AS magnitude_rank,
  (rank() OVER (PARTITION BY gp.donor, gp.condition ORDER BY specificity DESC) - 1) / (g - 1) AS specificity_rank FROM gp JOIN gr USING (donor, condition))"""
# two-type quotients of small whole numbers tie exactly on both engines only after this rounding
GROUP_SCORES = GROUP_SCORES.replace("sqrt(l.m * r.m) AS magnitude, l.share * r.share AS specificity", "round(sqrt(l.m * r.m), 9) AS magnitude, round(l.share * r.share, 9) AS specificity")


def dealt_counts(spark, sf):
    """Counts by cell, in as many tasks as the line items need."""
    rows = v.table(spark, sf, "lineitem").count()
    return spread(v.counts(spark, sf, rows), rows, "cell_id")


def group_scores(spark, sf):
    counts, cells = dealt_counts(spark, sf), v.paired_cells(spark, sf)
    return lr.group_pair_scores(counts, cells, _pair_keys(spark, sf), cell_type="cluster", digits=9)


@query("l05_group_pair_scores", v.with_ctes(v.COUNTS, PAIRED_CELLS, PAIRS, PK, GROUP_SCORES) + """
SELECT donor, condition, source, target, ligand, receptor, round(magnitude, 5) AS magnitude, round(specificity, 5) AS specificity,
  round(magnitude_rank, 6) AS magnitude_rank, round(specificity_rank, 6) AS specificity_rank FROM gx""")
def _(spark, sf):
    return rounded(rounded(group_scores(spark, sf), "magnitude", "specificity", digits=5), "magnitude_rank", "specificity_rank")


L04 = f"""
li AS (SELECT source, target, ligand, receptor, donor, condition, avg(magnitude_rank) AS x, avg(specificity_rank) AS y FROM gx GROUP BY 1, 2, 3, 4, 5, 6),
lw AS (SELECT source, target, ligand, receptor, donor, max(x) FILTER (WHERE condition = '{A}') AS xa, max(x) FILTER (WHERE condition = '{B}') AS xb,
  max(y) FILTER (WHERE condition = '{A}') AS ya, max(y) FILTER (WHERE condition = '{B}') AS yb, xa - xb AS dx, ya - yb AS dy FROM li GROUP BY 1, 2, 3, 4, 5),
lt AS (SELECT source, target, ligand, receptor, count(dx) AS n, CAST(count(dx) - 1 AS DOUBLE) AS df,
  avg(xa) FILTER (WHERE dx IS NOT NULL) AS mxa, avg(xb) FILTER (WHERE dx IS NOT NULL) AS mxb, avg(ya) FILTER (WHERE dy IS NOT NULL) AS mya, avg(yb) FILTER (WHERE dy IS NOT NULL) AS myb,
  CASE WHEN count(dx) > 1 AND max(dx) - min(dx) > 1e-12 THEN avg(dx) / (stddev_samp(dx) / sqrt(count(dx))) END AS tx, CASE WHEN count(dx) > 1 AND max(dy) - min(dy) > 1e-12 THEN avg(dy) / (stddev_samp(dy) / sqrt(count(dx))) END AS ty
  FROM lw GROUP BY 1, 2, 3, 4),
{sp.t_tail('lt', 'source, target, ligand, receptor', 'px', 'tx')}, {sp.t_tail('lt', 'source, target, ligand, receptor', 'py', 'ty')},
rx AS (SELECT *, {sp.bh_ranks('p')} FROM px), qx AS (SELECT *, {sp.bh('p')} AS q FROM rx),
ry AS (SELECT *, {sp.bh_ranks('p')} FROM py), qy AS (SELECT *, {sp.bh('p')} AS q FROM ry)"""


@query("l04_pair_comparison", v.with_ctes(v.COUNTS, PAIRED_CELLS, PAIRS, PK, GROUP_SCORES, L04) + """
SELECT source, target, ligand, receptor, n AS n_donors_a, n AS n_donors_b, round(mxa, 5) AS mean_magnitude_rank_a, round(mxb, 5) AS mean_magnitude_rank_b,
  round(mya, 5) AS mean_specificity_rank_a, round(myb, 5) AS mean_specificity_rank_b, round(px.p, 5) AS p_magnitude, round(py.p, 5) AS p_specificity, round(qx.q, 5) AS fdr_magnitude, round(qy.q, 5) AS fdr_specificity,
  CASE WHEN n < 2 THEN 'insufficient_donors' WHEN px.p IS NULL OR py.p IS NULL THEN 'not_estimated' ELSE 'tested' END AS status
FROM lt LEFT JOIN px USING (source, target, ligand, receptor) LEFT JOIN py USING (source, target, ligand, receptor) LEFT JOIN qx USING (source, target, ligand, receptor) LEFT JOIN qy USING (source, target, ligand, receptor)""")
def _(spark, sf):
    out = lr.compare_pair_scores(group_scores(spark, sf), A, B, paired=True)
    means = [f"mean_{s}_rank_{x}" for s in ("magnitude", "specificity") for x in "ab"]
    tests = [f"{x}_{s}" for s in ("magnitude", "specificity") for x in ("p", "fdr")]
    return rounded(out.select("source", "target", "ligand", "receptor", "n_donors_a", "n_donors_b", *means, *tests, "status"), *means, *tests, digits=5)


def condition_sides(cells, a, b):
    return cells.where(F.col("condition").isin(a, b)).select("cell_id", F.when(F.col("condition") == a, "a").otherwise("b").alias("side"))


def sig_sql(name, a, b):
    return f"""{name} AS (SELECT p_partkey AS gene_id, log2((coalesce(sum(value) FILTER (WHERE condition = '{a}'), 0) / (SELECT count(*) FROM cells WHERE condition = '{a}') + 1e-3)
  / (coalesce(sum(value) FILTER (WHERE condition = '{b}'), 0) / (SELECT count(*) FROM cells WHERE condition = '{b}') + 1e-3)) AS value
  FROM part LEFT JOIN (SELECT * FROM counts JOIN cells USING (cell_id)) ON gene_id = p_partkey GROUP BY 1)"""


def signature(spark, sf, a, b):
    return sg.group_signature(v.counts(spark, sf), condition_sides(v.cells(spark, sf), a, b), v.genes(spark, sf)).select("gene_id", "value")


@query("p01_group_signature", v.with_ctes(v.COUNTS, v.CELLS, sig_sql("sa", A, B)) + "SELECT gene_id, round(value, 6) AS value FROM sa")
def _(spark, sf):
    return rounded(signature(spark, sf, A, B), "value")


SIGS = (sig_sql("sa", A, B), sig_sql("s1", "FURNITURE", "HOUSEHOLD"), sig_sql("s2", "MACHINERY", "AUTOMOBILE"),
        "sigs AS (SELECT 'one' AS signature_id, * FROM s1 UNION ALL SELECT 'two', * FROM s2)")


def signature_table(spark, sf):
    return signature(spark, sf, "FURNITURE", "HOUSEHOLD").withColumn("signature_id", F.lit("one")).unionByName(
        signature(spark, sf, "MACHINERY", "AUTOMOBILE").withColumn("signature_id", F.lit("two"))
    )


@query("p02_discordance", v.with_ctes(v.COUNTS, v.CELLS, *SIGS) + """
SELECT signature_id, round(sum(a.value * s.value) / (sqrt(sum(a.value * a.value)) * sqrt(sum(s.value * s.value))), 6) AS cosine,
  round(-sum(a.value * s.value) / (sqrt(sum(a.value * a.value)) * sqrt(sum(s.value * s.value))), 6) AS discordance FROM sigs s JOIN sa a USING (gene_id) GROUP BY 1""")
def _(spark, sf):
    return rounded(sg.discordance(signature(spark, sf, A, B), signature_table(spark, sf)), "cosine", "discordance")


@query("p03_discordance_permutation", v.with_ctes(v.COUNTS, v.CELLS, *SIGS) + """
, d AS (SELECT value AS d, row_number() OVER (ORDER BY substr(md5('0:' || gene_id), 1, 15), gene_id) AS pos FROM sa),
pr AS (SELECT signature_id, k AS perm, value, row_number() OVER (PARTITION BY signature_id, k ORDER BY substr(md5('42/' || k || '/' || signature_id || ':' || gene_id), 1, 15), gene_id) AS pos
  FROM sigs, range(1, 21) t(k)),
dots AS (SELECT signature_id, perm, sum(d * value) AS z FROM pr JOIN d USING (pos) GROUP BY 1, 2),
r AS (SELECT signature_id, sum(a.value * s.value) AS z FROM sigs s JOIN sa a USING (gene_id) GROUP BY 1)
SELECT signature_id, round((count(*) FILTER (WHERE -dots.z >= -r.z - 1e-12) + 1) / 21.0::DOUBLE, 6) AS p_value FROM dots JOIN r USING (signature_id) GROUP BY 1""".lstrip())
def _(spark, sf):
    out = sg.discordance_permutation(signature(spark, sf, A, B), signature_table(spark, sf), n_permutations=20)
    return rounded(out.select("signature_id", "p_value"), "p_value")


@query("p04_reversal_table", v.with_ctes(v.COUNTS, v.CELLS, *SIGS) + """
SELECT gene_id, round(sa.value, 6) AS disease_log2fc, round(s1.value, 6) AS compound_log2fc, round(-sa.value * s1.value, 6) AS reversal_concordance,
  sa.value * s1.value < -1e-4 AS is_reversed FROM sa JOIN s1 USING (gene_id)""")
def _(spark, sf):
    out = sg.reversal_table(signature(spark, sf, A, B), signature(spark, sf, "FURNITURE", "HOUSEHOLD"))
    return rounded(out, "disease_log2fc", "compound_log2fc", "reversal_concordance")


SOFT = """
cn AS (SELECT cluster, count(*) AS n FROM cells GROUP BY 1),
ce AS (SELECT cluster, gene_id, sum(value) / max(n) AS c FROM logn JOIN cells USING (cell_id) JOIN cn USING (cluster) GROUP BY 1, 2),
cc AS (SELECT cluster, sum(c * c) AS cc FROM ce GROUP BY 1),
xx AS (SELECT cell_id, sum(value * value) AS xx FROM logn GROUP BY 1),
xc AS (SELECT cell_id, ce.cluster, sum(value * c) AS xc FROM logn JOIN ce USING (gene_id) GROUP BY 1, 2),
dd AS (SELECT c.cell_id, c.cluster AS from_state, k.cluster AS to_state, greatest(0, coalesce(xx, 0) - 2 * coalesce(xc, 0) + cc) AS sq
  FROM cells c CROSS JOIN cc k LEFT JOIN xx USING (cell_id) LEFT JOIN xc ON xc.cell_id = c.cell_id AND xc.cluster = k.cluster),
ex AS (SELECT *, exp(-(sq - min(sq) OVER (PARTITION BY cell_id)) / (2 * (SELECT avg(sq) + 1e-4 FROM dd))) AS e FROM dd),
pp AS (SELECT *, e / sum(e) OVER (PARTITION BY cell_id) AS p FROM ex)"""


@query("p05_state_transitions", v.with_ctes(v.COUNTS, v.CELLS, LOGN, SOFT) + "SELECT from_state, to_state, round(avg(p), 6) AS probability FROM pp GROUP BY 1, 2")
def _(spark, sf):
    logs = normalize.log_normalize(v.counts(spark, sf))
    return rounded(sg.state_transitions(sg.soft_assignment(logs, v.cells(spark, sf), "cluster")), "probability")


CORR = """
N AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM cells),
st AS (SELECT gene_id, sum(value) / max(n) AS m, sqrt(sum(value * value) / max(n) - pow(sum(value) / max(n), 2)) AS s FROM logn, N GROUP BY 1),
xs AS (SELECT a.gene_id AS i, b.gene_id AS j, sum(a.value * b.value) AS xy FROM logn a JOIN logn b ON a.cell_id = b.cell_id AND a.gene_id < b.gene_id GROUP BY 1, 2),
cr AS (SELECT x.gene_id AS i, y.gene_id AS j, (coalesce(xy, 0) / n - x.m * y.m) / (x.s * y.s) AS r FROM st x JOIN st y ON x.gene_id < y.gene_id CROSS JOIN N LEFT JOIN xs ON xs.i = x.gene_id AND xs.j = y.gene_id),
strong AS (SELECT i AS src, j AS dst, r FROM cr WHERE abs(r) >= 0.02 UNION ALL SELECT j, i, r FROM cr WHERE abs(r) >= 0.02),
tk AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY abs(r) DESC, dst) AS k FROM strong),
nw AS (SELECT src, dst, r, r / sum(abs(r)) OVER (PARTITION BY src) AS weight FROM tk WHERE k <= 8)"""


def _network(spark, sf):
    # Dealt by cell alone, so that counts, totals of cells and logs need one shuffle.
    counts = v.counts(spark, sf, v.table(spark, sf, "lineitem").count(), ("l_orderkey",))
    return sg.correlation_network(normalize.log_normalize(counts), v.cells(spark, sf), threshold=0.02, max_degree=8)


@query("p06_correlation_network", v.with_ctes(v.COUNTS, v.CELLS, LOGN, CORR) + "SELECT src, dst, round(r, 6) AS correlation, round(weight, 6) AS weight FROM nw")
def _(spark, sf):
    return rounded(_network(spark, sf), "correlation", "weight")


STEPS = ["v0 AS (SELECT gene_id AS g, value AS x FROM sa)"] + [
    f"v{k} AS (SELECT dst AS g, 0.25 * sum(weight * x) AS x FROM ed JOIN v{k - 1} ON src = g GROUP BY 1)" for k in range(1, 13)
]


@query("p07_propagation", v.with_ctes(
    v.COUNTS, v.CELLS, sig_sql("sa", A, B), "pp AS (SELECT p_partkey AS src, p_partkey + 1 AS dst, 0.6 AS weight FROM part UNION ALL SELECT p_partkey, p_partkey - 1, -0.4 FROM part)",
    "ed AS (SELECT * FROM pp WHERE dst IN (SELECT p_partkey FROM part))", *STEPS,
) + "SELECT g AS gene_id, round(sum(x), 6) AS value FROM (" + " UNION ALL ".join(f"SELECT * FROM v{k}" for k in range(13)) + ") GROUP BY 1")
def _(spark, sf):
    p = v.table(spark, sf, "part")
    k = F.col("p_partkey")
    edges = p.select(F.inline(F.array(
        F.struct(k.alias("src"), (k + 1).alias("dst"), F.lit(0.6).alias("weight")), F.struct(k.alias("src"), (k - 1).alias("dst"), F.lit(-0.4).alias("weight"))
    ))).join(p.select(k.alias("dst")), "dst", "left_semi")
    return rounded(sg.propagate(edges, signature(spark, sf, A, B)), "value")


SHIFT = f"""
sh AS (SELECT p_partkey AS gene_id, p_size = 7 AS act, p_size = 9 AS hom,
  coalesce(sum(value) FILTER (WHERE condition = '{A}'), 0) / (SELECT count(*) FROM cells WHERE condition = '{A}') AS s,
  coalesce(sum(value) FILTER (WHERE condition = '{B}'), 0) / (SELECT count(*) FROM cells WHERE condition = '{B}') AS t,
  count(*) FILTER (WHERE condition = '{A}') * 100 / (SELECT count(*) FROM cells WHERE condition = '{A}') AS sd,
  count(*) FILTER (WHERE condition = '{B}') * 100 / (SELECT count(*) FROM cells WHERE condition = '{B}') AS td
  FROM part LEFT JOIN (SELECT * FROM logn JOIN cells USING (cell_id)) ON gene_id = p_partkey GROUP BY 1, 2, 3),
sf AS (SELECT *, log2(t + 1) - log2(s + 1) AS l, CASE WHEN act THEN 'activation_marker' WHEN hom THEN 'homeostatic_marker' ELSE 'other' END AS c FROM sh)"""


def _shifts(spark, sf):
    logs = normalize.log_normalize(v.counts(spark, sf))
    return sg.marker_shifts(logs, v.cells(spark, sf), v.genes(spark, sf), A, B, F.col("size") == 7, F.col("size") == 9)


@query("p08_marker_shifts", v.with_ctes(v.COUNTS, v.CELLS, LOGN, SHIFT) + """
SELECT gene_id, c AS marker_category, round(s, 6) AS source_mean_expr, round(t, 6) AS target_mean_expr, round(sd, 5) AS source_pct_expressing, round(td, 5) AS target_pct_expressing,
  round(l, 6) AS log2_fold_change, CASE WHEN l > 0.2 THEN 'UP' WHEN l < -0.2 THEN 'DOWN' ELSE 'UNCHANGED' END AS direction FROM sf""")
def _(spark, sf):
    out = rounded(_shifts(spark, sf), "source_mean_expr", "target_mean_expr", "log2_fold_change")
    return rounded(out, "source_pct_expressing", "target_pct_expressing", digits=5)


@query("p08_shift_score", v.with_ctes(v.COUNTS, v.CELLS, LOGN, SHIFT) + """
SELECT round(sqrt(sum(l * l)), 6) AS magnitude, round(1 / (1 + exp(-sum(CASE WHEN act THEN l WHEN hom THEN -l ELSE 0 END) / 3)), 6) AS probability FROM sf""")
def _(spark, sf):
    return rounded(sg.shift_score(_shifts(spark, sf)), "magnitude", "probability")
