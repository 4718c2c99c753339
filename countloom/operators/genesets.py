"""Gene-set over-representation, gene lookup and keyword ranking of records."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from countloom.functions.ranking import benjamini_hochberg
from countloom.functions.special import hypergeom_tail

# Words a text query ignores.
STOP_WORDS = ["AND", "OR", "NOT", "THE", "A", "OF", "IN", "TO", "WITH"]
# Column names under which a result table may hold its gene, effect and adjusted p-value.
GENE_COLUMNS = ["gene_name", "gene", "symbol", "Gene", "Gene_Name"]
EFFECT_COLUMNS = ["log2fc", "log2FC", "logFC", "log2_fold_change"]
FDR_COLUMNS = ["p_val_adj", "fdr", "fdr_q_val", "padj", "p_adj", "fdr_q_value"]


def _query(genes: DataFrame) -> DataFrame:
    text = F.upper(F.trim(F.col("gene").cast("string")))
    return genes.select(text.alias("gene")).where(F.col("gene").isNotNull() & (F.col("gene") != "")).distinct()


def matched_genes(sets: DataFrame, query: DataFrame) -> DataFrame:
    """(set_id, gene) for every query gene in every set, one row each, without regard to case.

    ``sets`` holds one row per set with an array ``genes``, or one row per member with ``gene``.
    """
    member = F.explode("genes") if "genes" in sets.columns else F.col("gene")
    long = sets.select("set_id", member.alias("gene")).select("set_id", F.upper(F.trim("gene")).alias("gene")).distinct()
    return long.join(_query(query), "gene", "left_semi").select("set_id", "gene")


def _overlaps(sets: DataFrame, query: DataFrame, background: int | Column) -> DataFrame:
    n = _query(query).agg(F.count(F.lit(1)).alias("n")).scalar()
    background = F.lit(background) if isinstance(background, int) else background
    k = matched_genes(sets, query).groupBy("set_id").agg(F.count(F.lit(1)).alias("_k"))
    info = [c for c in sets.columns if c not in ("genes", "gene")]
    base = sets.select(*info) if "genes" in sets.columns else sets.select(*info).distinct()
    return base.join(k, "set_id", "left").select(
        *info, F.coalesce("_k", F.lit(0)).alias("gene_count"), n.alias("sample_size"), background.cast("long").alias("background_size")
    ).withColumn("p_value", F.when(
        F.col("gene_count") > 0, hypergeom_tail(F.col("gene_count"), F.col("background_size"), F.col("set_size"), F.col("sample_size"))
    ).otherwise(F.lit(1.0)))


def over_representation(sets: DataFrame, query: DataFrame, background: int | Column = 20000, category: str | None = None, fdr_cutoff: float | None = 0.05) -> DataFrame:
    """Sets holding more query genes than chance. All sets enter the adjustment; hits at the cutoff are returned."""
    chosen = sets if category is None else sets.where(F.upper("category") == category.upper())
    rows = _overlaps(chosen, query, background)
    share = (F.col("gene_count") / F.col("sample_size")) / (F.col("set_size") / F.col("background_size"))
    scored = benjamini_hochberg(rows.withColumn("fold_enrichment", F.when(F.col("gene_count") > 0, F.round(share, 3)).otherwise(F.lit(0.0))))
    kept = scored.where(F.col("gene_count") > 0)
    return kept if fdr_cutoff is None else kept.where(F.col("fdr_q_value") <= fdr_cutoff)


def odds_enrichment(sets: DataFrame, query: DataFrame, universe: int | Column = 20000) -> DataFrame:
    """Every set with its 0.5-corrected odds ratio."""
    rows = _overlaps(sets, query, universe)
    k, n, size, all_ = (F.col(c) for c in ("gene_count", "sample_size", "set_size", "background_size"))
    top = (k + 0.5) / F.greatest(n - k + 0.5, F.lit(0.5))
    low = F.greatest(size - k + 0.5, F.lit(0.5)) / F.greatest(all_ - size - n + k + 0.5, F.lit(0.5))
    return benjamini_hochberg(rows.withColumn("odds_ratio", F.when(k > 0, F.round(top / low, 3)).otherwise(F.lit(0.0))))


def query_genes(results: DataFrame, min_log2fc: float = 0.3, max_fdr: float = 0.05) -> DataFrame:
    """Genes of a result table: the filtered rows, or all rows when no row passes the filter."""
    def first(names):
        return next((c for c in names if c in results.columns), None)

    gene, effect, fdr = first(GENE_COLUMNS) or results.columns[0], first(EFFECT_COLUMNS), first(FDR_COLUMNS)
    if effect is None:
        return results.select(F.col(gene).cast("string").alias("gene"))
    passes = F.abs(F.col(effect)) >= min_log2fc
    if fdr is not None:
        passes = passes & (F.col(fdr) <= max_fdr)
    passes = F.coalesce(passes, F.lit(False))
    any_pass = results.agg(F.coalesce(F.max(passes), F.lit(False)).alias("a")).scalar()
    return results.where(passes | ~any_pass).select(F.col(gene).cast("string").alias("gene"))


def lookup_genes(queries: DataFrame, info: DataFrame, species: str = "auto") -> DataFrame:
    """Best entry per query symbol: exact, then any case, then alias, then ortholog.

    Among case-insensitive matches, Title-case queries prefer mouse and upper-case
    ones human entries; ``entry_order`` settles the rest.
    """
    entries = info if species == "auto" else info.where(F.lower("species") == species.lower())
    q = queries.select(F.trim("symbol").alias("symbol")).distinct().withColumn("_up", F.upper("symbol"))
    keep = ["symbol", "gene_symbol", "species", "orthologs", "entry_order"]
    named = q.join(entries.withColumn("_up", F.upper("gene_symbol")), "_up")
    is_upper = F.col("symbol") == F.col("_up")
    # Upper case only after no letter, lower case only after a letter: Cox7a2 is no title case.
    is_title = F.col("symbol").rlike(r"^\P{L}*\p{Lu}\p{Ll}*(\P{L}+\p{Lu}\p{Ll}*)*\P{L}*$") & ~is_upper
    wanted = F.when(is_title, F.lit("mus_musculus")).when(is_upper, F.lit("homo_sapiens"))
    by_name = named.select(
        *keep, F.when(F.col("symbol") == F.col("gene_symbol"), 1).otherwise(2).alias("tier"),
        F.when(F.col("species") == wanted, 0).otherwise(1).alias("_pref"),
    )
    aliases = entries.withColumn("_alias", F.explode("aliases")).withColumn("_up", F.upper("_alias"))
    by_alias = q.join(aliases, "_up").select(*keep, F.lit(3).alias("tier"), F.lit(0).alias("_pref"))
    orth = entries.select("*", F.explode("orthologs").alias("_sp", "_orth")).withColumn("_up", F.upper("_orth"))
    by_orth = q.join(orth, "_up").select(*keep, F.lit(4).alias("tier"), F.lit(0).alias("_pref"))
    found = by_name.unionByName(by_alias).unionByName(by_orth)
    pref = F.when(F.col("tier") == 2, F.col("_pref")).otherwise(F.lit(0))
    best = found.groupBy("symbol").agg(
        F.min_by(F.struct("gene_symbol", "species", "orthologs", "tier"), F.struct("tier", pref.alias("p"), "entry_order")).alias("b")
    )
    return best.select("symbol", "b.gene_symbol", "b.species", F.col("b.tier").cast("long").alias("tier"), "b.orthologs")


def map_orthologs(queries: DataFrame, info: DataFrame, target_species: str = "human") -> DataFrame:
    """Symbol in the target species for every query that the lookup resolves."""
    found = lookup_genes(queries, info)
    return found.select("symbol", F.col("orthologs")[target_species.lower()].alias("ortholog")).where(F.col("ortholog").isNotNull())


def query_tokens(text: str) -> list[str]:
    """Words of a one-line search text, without stop words."""
    return [t for t in re.split(r'[\s,;"()]+', text) if t and t.upper() not in STOP_WORDS]


def rank_records(records: DataFrame, query: str | list[str], limit: int = 10, source: str = "all", min_year: int | None = None, min_citations: int = 0) -> DataFrame:
    """Records ranked by words found: 3 in the title, else 1 in the abstract, plus a citation share.

    Words are tested as column expressions on the scan, so no join is needed.
    """
    tokens = query_tokens(query) if isinstance(query, str) else [t.strip() for t in query if t.strip()]
    if not tokens:
        raise ValueError("The query holds no words")
    rows = records.where(F.col("citation_count") >= min_citations)
    if source.lower() != "all":
        rows = rows.where(F.lower("source") == source.lower())
    if min_year is not None:
        rows = rows.where(F.col("year") >= min_year)
    rows = rows.withColumns({"_t": F.lower("title"), "_a": F.lower("abstract")})
    points = [
        F.when(F.contains("_t", F.lit(t.lower())), 3.0).when(F.contains("_a", F.lit(t.lower())), 1.0).otherwise(0.0) for t in tokens
    ]
    total = sum(points[1:], points[0])
    boost = F.log10(1.0 + F.greatest(F.lit(0), F.col("citation_count"))) * 0.15
    hits = F.array_sort(F.array_distinct(F.filter(
        F.array(*[F.when(p > 0, F.lit(t)) for p, t in zip(points, tokens)]), lambda x: x.isNotNull()
    )))
    scored = rows.select(*records.columns, total.alias("_score"), hits.alias("matched_keywords"), boost.alias("_boost")).where(F.col("_score") > 0)
    relevance = F.round(F.least(F.lit(1.0), F.col("_score") / (len(tokens) * 3.0 + 1.0) * 0.7 + F.col("_boost")), 3)
    return scored.withColumn("relevance_score", relevance).orderBy(
        F.desc("relevance_score"), F.desc("citation_count"), "record_id"
    ).limit(limit).drop("_score", "_boost")


def genes_in_text(texts: DataFrame, genes: DataFrame) -> DataFrame:
    """Known genes named in each text."""
    words = texts.select("text_id", F.explode(F.split("text", r"[\s,\-_()/]+")).alias("w")).select(
        "text_id", F.upper(F.trim("w")).alias("gene")
    ).where(F.col("gene") != "").distinct()
    known = genes.select(F.upper(F.trim(F.col("gene").cast("string"))).alias("gene"))
    return words.join(known, "gene", "left_semi").select("text_id", "gene")


def gene_set_report(sets: DataFrame, query: DataFrame, info: DataFrame, records: DataFrame, text: str, background: int | Column = 20000, fdr_cutoff: float = 0.05) -> DataFrame:
    """Top three enriched sets, top three gene entries and top three records in one table."""
    top_sets = over_representation(sets, query, background, fdr_cutoff=fdr_cutoff).orderBy("fdr_q_value", "p_value", "set_id").limit(3)
    found = lookup_genes(query.select(F.col("gene").alias("symbol")), info).orderBy("symbol").limit(3)
    top_records = rank_records(records, text, limit=3)
    return (
        top_sets.select(F.lit("gene_set").alias("section"), F.col("set_id").cast("string").alias("item"), (1 - F.col("fdr_q_value")).alias("score"))
        .unionByName(found.select(F.lit("gene").alias("section"), F.col("gene_symbol").alias("item"), F.lit(1.0).alias("score")))
        .unionByName(top_records.select(F.lit("record").alias("section"), F.col("record_id").cast("string").alias("item"), F.col("relevance_score").alias("score")))
    )
