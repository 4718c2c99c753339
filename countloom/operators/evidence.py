"""Lineage, evidence, claims, table audits and result views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from countloom.functions.ranking import benjamini_hochberg, ordered_positions
from countloom.functions.tails import normal_quantile
from countloom.operators.graph import components
from countloom.session import cut_lineage

# Verbs that claim a cause.
CAUSAL_PATTERNS = [
    r"\bdrives\b", r"\bdrive\b", r"\bcauses\b", r"\bcause\b", r"\bproves\b", r"\bdemonstrates causality\b", r"\bis responsible for\b",
]
# Weight of each evidence strength.
STRENGTH_WEIGHTS = {"very_strong": 1.0, "strong": 0.8, "moderate": 0.6, "weak": 0.3, "insufficient": 0.0}
# Evidence types by the confidence dimension they count towards.
ASSOCIATION_TYPES = [
    "differential_abundance", "pseudobulk_deg", "cell_level_deg", "qc_metrics", "dataset_audit", "clustering_stability", "cell_annotation",
]
MECHANISTIC_TYPES = [
    "trajectory_stability", "root_sensitivity", "pathway_enrichment", "literature_support", "spatial_localization", "functional_activity",
    "cell_communication",
]
CAUSAL_TYPES = ["perturbation"]
# Evidence types that carry an adjusted statistic.
STATISTICAL_TYPES = ["pseudobulk_deg", "differential_abundance", "spatial_localization", "pathway_enrichment", "functional_activity"]
# Run-event kinds that report a problem.
ISSUE_KINDS = ["task_failed", "task_blocked", "audit_rejected", "run_failed"]


def closure(edges: DataFrame, starts: DataFrame, up: bool = True, max_rounds: int = 10_000) -> DataFrame:
    """(start, node, depth): every node reachable from each start, the start itself at depth 0.

    ``edges`` has parent and child. Only rows found in the last round are joined
    again, and each round is checkpointed.
    """
    here, there = ("child", "parent") if up else ("parent", "child")
    links = cut_lineage(edges.select(F.col(here).alias("_from"), F.col(there).alias("_to")).distinct())
    seen = frontier = cut_lineage(starts.select(F.col("uri").alias("start"), F.col("uri").alias("node")).distinct().withColumn("depth", F.lit(0).cast("long")))
    for depth in range(1, max_rounds):
        step = frontier.join(links, F.col("node") == F.col("_from")).select("start", F.col("_to").alias("node")).distinct()
        frontier = cut_lineage(step.join(seen, ["start", "node"], "left_anti").withColumn("depth", F.lit(depth).cast("long")))
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)
        if depth % 8 == 0:
            seen = cut_lineage(seen)
    raise ValueError("Lineage is deeper than max_rounds")


def cyclic_nodes(edges: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """Nodes on or below a cycle: what is left after removing nodes without parents, round by round."""
    left = cut_lineage(edges.select("parent", "child").distinct())
    n = left.count()
    for _ in range(max_rounds):
        has_parent = left.select(F.col("child").alias("parent")).distinct()
        left = cut_lineage(left.join(has_parent, "parent", "left_semi"))
        now = left.count()
        if now == n or now == 0:
            return left.select(F.col("child").alias("uri")).distinct()
        n = now
    raise ValueError("Lineage is deeper than max_rounds")


def provenance(artifacts: DataFrame, edges: DataFrame, starts: DataFrame) -> DataFrame:
    """Per start: number of roots, inherited simulation flag, missing ancestors and cycles."""
    reached = closure(edges, starts)
    known = artifacts.select(F.col("uri").alias("node"), "is_simulated", F.lit(True).alias("_known"))
    parents = edges.select(F.col("child").alias("node")).distinct().withColumn("_child", F.lit(True))
    loops = cyclic_nodes(edges).select(F.col("uri").alias("node"), F.lit(True).alias("_loop"))
    j = reached.join(known, "node", "left").join(parents, "node", "left").join(loops, "node", "left")
    return j.groupBy("start").agg(
        F.count(F.lit(1)).alias("n_lineage"), F.count_if(F.col("_child").isNull()).alias("n_roots"),
        F.max(F.coalesce("is_simulated", F.lit(False))).alias("is_simulated"), F.count_if(F.col("_known").isNull()).alias("n_missing"),
        F.max(F.coalesce("_loop", F.lit(False))).alias("has_cycle"),
    ).withColumn("valid", (F.col("n_missing") == 0) & ~F.col("has_cycle"))


def lineage_roots(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, root) pairs."""
    return closure(edges, starts).join(edges.select(F.col("child").alias("node")).distinct(), "node", "left_anti").select("start", F.col("node").alias("root"))


def common_ancestors(edges: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """Ancestors (starts included) shared by two sets of artifacts."""
    return closure(edges, first).select(F.col("node").alias("uri")).intersect(closure(edges, second).select(F.col("node").alias("uri")))


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def select_evidence(results: DataFrame, table: str = "table_id", alpha: float | str = 0.05, top: int = 10, effect: str = "log2_fold_change", gene: str = "gene_id") -> DataFrame:
    """Per result table: the ``top`` rows by q among q < alpha, then only non-zero finite effects.

    ``alpha`` is one level or the name of a column; rows whose level is not between 0 and 1 give no evidence.
    """
    level = F.col(alpha) if isinstance(alpha, str) else F.lit(float(alpha))
    hits = results.where((F.col("fdr_q_value") >= 0) & (F.col("fdr_q_value") < level) & (level > 0) & (level < 1))
    ranked = hits.withColumn("_r", F.row_number().over(W.partitionBy(table).orderBy("fdr_q_value", gene))).where(F.col("_r") <= top)
    return ranked.where(finite(F.col(effect)) & (F.col(effect) != 0)).select(
        table, gene, effect, "fdr_q_value", (1 - F.col("fdr_q_value")).alias("score"),
        F.when(F.col(effect) > 0, "higher").otherwise("lower").alias("direction"),
    )


def merge_origins(evidence: DataFrame, groups: list[str]) -> DataFrame:
    """Label evidence rows connected by shared origins, inside each group, with one component id, the least evidence_id.

    ``evidence`` has evidence_id and an array ``origins``. Origins are the nodes of a graph: each row ties its other
    origins to its least one, and rows with the same origins give the same links. Components of the numbered origins
    are found by star contraction, in a logarithmic number of steps.
    """
    node = lambda c: F.struct(*groups, F.col(c).alias("origin"))
    own = evidence.select(*groups, "evidence_id", F.explode("origins").alias("origin")).where("origin IS NOT NULL")
    tied = own.withColumn("_first", F.min("origin").over(W.partitionBy(*groups, "evidence_id")))
    tied = cut_lineage(tied.select(*groups, "evidence_id", node("origin").alias("node"), node("_first").alias("first")))
    names = cut_lineage(tied.select("node").distinct().withColumn("id", F.monotonically_increasing_id()))
    links = tied.where("node != first").select("node", "first").distinct().join(names.withColumnRenamed("id", "a"), "node").join(
        names.select(F.col("node").alias("first"), F.col("id").alias("b")), "first"
    )
    found = components(links.select("a", "b")).withColumnRenamed("node", "id")
    stars = names.join(found, "id", "left").select(F.col("node").alias("first"), F.coalesce("component", "id").alias("_star"))
    placed = cut_lineage(tied.select(*groups, "evidence_id", "first").distinct().join(stars, "first").drop("first"))
    least = placed.groupBy("_star").agg(F.min("evidence_id").alias("component"))
    return placed.join(least, "_star").select(*groups, "evidence_id", "component")


def score_confidence(evidence: DataFrame) -> DataFrame:
    """Confidence of each claim from its supporting and contradicting evidence.

    Support that shares an origin counts once, at its lowest score. Causal
    confidence is capped at one half and contradictions subtract.
    """
    def weight(default):
        expr = F.lit(default)
        for name, w in STRENGTH_WEIGHTS.items():
            expr = F.when(F.col("strength") == name, w).otherwise(expr)
        return expr

    dimension = (
        F.when(F.col("type").isin(ASSOCIATION_TYPES), "association").when(F.col("type").isin(MECHANISTIC_TYPES), "mechanistic")
        .when(F.col("type").isin(CAUSAL_TYPES), "causal")
    )
    support = evidence.where(F.col("polarity") == "supporting").withColumn("dimension", dimension).where(F.col("dimension").isNotNull())
    own = F.when(F.size("origins") > 0, F.col("origins")).otherwise(F.array(F.concat(F.lit("task:"), F.col("task_id").cast("string"))))
    support = cut_lineage(support.select("claim_id", "dimension", "evidence_id", own.alias("origins"), (weight(0.6) * F.col("score")).alias("_s")))
    parts = merge_origins(support, ["claim_id", "dimension"])
    merged = support.join(parts, ["claim_id", "dimension", "evidence_id"]).groupBy("claim_id", "dimension", "component").agg(F.min("_s").alias("_s"))
    dims = merged.groupBy("claim_id").agg(*[
        F.coalesce(F.avg(F.when(F.col("dimension") == d, F.col("_s"))), F.lit(0.0)).alias(d) for d in ("association", "mechanistic", "causal")
    ])
    against = evidence.where(F.col("polarity") == "contradicting").groupBy("claim_id").agg(F.sum(weight(0.4) * 0.25).alias("_penalty"))
    j = evidence.select("claim_id").distinct().join(dims, "claim_id", "left").join(against, "claim_id", "left").na.fill(0.0)
    causal = F.least(F.lit(0.5), F.col("causal"))
    raw = F.when(causal > 0, 0.35 * F.col("association") + 0.35 * F.col("mechanistic") + 0.30 * causal).otherwise(
        0.55 * F.col("association") + 0.45 * F.col("mechanistic")
    )

    def unit(c):
        return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)), 3)

    return j.select(
        "claim_id", unit(F.col("association")).alias("association"), unit(F.col("mechanistic")).alias("mechanistic"), unit(causal).alias("causal"),
        unit(raw - F.col("_penalty")).alias("overall"),
    )


def causal_wording(statement: Column, causal_status: Column) -> Column:
    """True when a statement claims a cause that its study cannot support."""
    hit = F.lit(False)
    for pattern in CAUSAL_PATTERNS:
        hit = hit | statement.rlike("(?i)" + pattern)
    return hit & (causal_status != "experimental_perturbed")


def admit_claims(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """Per claim: admitted or the first rule it breaks, and the statement as it may be published.

    ``claims`` has claim_id, statement, tier (1-4), causal_status, support_ids
    and contradiction_ids; ``evidence`` has evidence_id, polarity, audit_passed,
    n_artifacts, type, fdr_q_value, alpha, summary, source_verified,
    is_simulated and a ``context`` map.
    """
    prefix = "[SIMULATED DATA] "
    bare = F.when(F.col("statement").startswith(prefix), F.expr(f"substring(statement, {len(prefix) + 1})")).otherwise(F.col("statement"))
    tagged = F.concat(
        F.transform("support_ids", lambda x: F.struct(x.alias("evidence_id"), F.lit(True).alias("supports"))),
        F.transform("contradiction_ids", lambda x: F.struct(x.alias("evidence_id"), F.lit(False).alias("supports"))),
    )
    cited = claims.select("claim_id", bare.alias("_text"), F.inline(tagged)).distinct().join(
        evidence.withColumn("_known", F.lit(True)), "evidence_id", "left"
    )
    sup = F.col("supports") & F.col("_known").isNotNull()
    alpha = F.coalesce("alpha", F.lit(0.05))
    stat = (
        sup & F.col("audit_passed") & (F.col("n_artifacts") > 0) & F.col("type").isin(STATISTICAL_TYPES) & (alpha > 0) & (alpha < 1)
        & (F.col("fdr_q_value") >= 0) & (F.col("fdr_q_value") < alpha)
    )
    exact = stat & (F.col("summary") == F.col("_text"))
    knows = sup & F.col("source_verified") & F.col("type").isin("literature_support", "pathway_enrichment")
    flags = cited.groupBy("claim_id").agg(
        F.count_if(F.col("_known").isNull()).alias("_unknown"), F.count_if(F.col("supports")).alias("_n"),
        F.count_if(sup & (F.col("polarity") != "supporting")).alias("_wrong"),
        F.count_if(sup & (~F.col("audit_passed") | (F.col("n_artifacts") == 0))).alias("_unaudited"),
        F.count_if(stat).alias("_stat"), F.count_if(exact).alias("_exact"), F.count_if(knows).alias("_knows"),
        F.max(F.coalesce(sup & F.col("is_simulated"), F.lit(False))).alias("_sim"),
    )
    pairs = cited.where(exact).select("claim_id", F.col("context").alias("_c1")).join(
        cited.where(knows).select("claim_id", F.col("context").alias("_c2")), "claim_id"
    )
    shared = F.array_intersect(F.map_keys("_c1"), F.map_keys("_c2"))
    named = F.exists(shared, lambda k: k.isin("gene", "state", "pathway"))
    equal = F.forall(shared, lambda k: F.element_at("_c1", k) == F.element_at("_c2", k))
    fits = pairs.where(named & equal).select("claim_id").distinct().withColumn("_fit", F.lit(True))
    j = claims.join(flags, "claim_id", "left").join(fits, "claim_id", "left")
    n = {c: F.coalesce(c, F.lit(0)) for c in ("_unknown", "_n", "_wrong", "_unaudited", "_stat", "_exact", "_knows")}
    strict = F.col("tier").isin(2, 3)
    reason = (
        F.when(n["_unknown"] > 0, "unknown_evidence").when(n["_n"] == 0, "no_support")
        .when(causal_wording(F.col("statement"), F.col("causal_status")), "causal_wording")
        .when(n["_wrong"] > 0, "support_is_not_supporting").when(n["_unaudited"] > 0, "support_not_audited")
        .when(strict & (n["_stat"] == 0), "no_significant_support").when(strict & (n["_exact"] == 0), "statement_not_exact")
        .when((F.col("tier") == 3) & (n["_knows"] == 0), "no_verified_knowledge").when((F.col("tier") == 3) & F.col("_fit").isNull(), "context_mismatch")
        .otherwise("admitted")
    )
    mark = F.coalesce("_sim", F.lit(False)) & ~F.contains("statement", F.lit(prefix.strip()))
    return j.select(
        "claim_id", (reason == "admitted").alias("admitted"), reason.alias("reason"),
        F.when(mark, F.concat(F.lit(prefix), "statement")).otherwise(F.col("statement")).alias("statement"),
    )


def _close(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= 1e-8 + 1e-6 * F.abs(b)


def audit_intervals(results: DataFrame, alpha: float = 0.05) -> DataFrame:
    """One row: are the intervals ``effect -/+ z * se``, with no negative standard error? Rows with a missing part are passed over."""
    z = normal_quantile(1.0 - alpha / 2.0)
    low, high, se, effect = (F.col(c).try_cast("double") for c in ("ci_low", "ci_high", "lfc_se", "log2_fold_change"))
    whole = results.where(low.isNotNull() & high.isNotNull() & se.isNotNull() & effect.isNotNull())
    out = whole.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(se < 0).alias("n_negative_se"),
        F.count_if(~_close(low, effect - z * se)).alias("n_wrong_low"), F.count_if(~_close(high, effect + z * se)).alias("n_wrong_high"),
    )
    return out.withColumn("passed", F.col("n_negative_se") + F.col("n_wrong_low") + F.col("n_wrong_high") == 0)


def audit_statistics(results: DataFrame) -> DataFrame:
    """One row: values out of range, adjusted values without a raw one, and missing values that no status explains.

    ``results`` has p_value, fdr_q_value, status and status_reason.
    """
    p, q = F.col("p_value").try_cast("double"), F.col("fdr_q_value").try_cast("double")
    gap = lambda c: c.isNull() | F.isnan(c)
    infinite = lambda c: F.abs(c) == float("inf")
    explainable = F.coalesce(F.col("status").isin("not_estimated", "estimated_fdr_missing", "skipped"), F.lit(False))
    silent = F.trim(F.coalesce("status_reason", F.lit(""))) == ""
    out = results.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(~gap(p) & ~p.between(0, 1)).alias("n_p_out_of_range"), F.count_if(~gap(q) & ~q.between(0, 1)).alias("n_q_out_of_range"),
        F.count_if(infinite(p) | infinite(q)).alias("n_infinite"), F.count_if(~gap(q) & gap(p)).alias("n_q_without_p"), F.count_if(explainable & silent).alias("n_without_reason"),
        F.count_if(gap(p) & ~explainable).alias("n_unmarked_p"), F.count_if(gap(q) & ~explainable).alias("n_unmarked_q"),
    )
    return out.withColumn("passed", sum((F.col(c) for c in out.columns[1:]), F.lit(0)) == 0)


def audit_table(df: DataFrame, numeric: list[str], nullable: list[str] = (), fdr: str | None = None, moran: str | None = None, geary: str | None = None, score: str | None = None) -> DataFrame:
    """Check rows of one result table from a single aggregate: emptiness, finite values and value ranges."""
    def bad(c, allow_null):
        x = F.col(c).cast("double")
        wrong = F.isnan(x) | (F.abs(x) == float("inf"))
        return wrong if allow_null else (x.isNull() | wrong)

    def outside(c, low=None, high=None):
        x = F.col(c).cast("double")
        wrong = F.isnan(x)
        if low is not None:
            wrong = wrong | (x < low)
        if high is not None:
            wrong = wrong | (x > high)
        return F.count_if(F.coalesce(wrong, F.lit(False)))

    checks = {"table_non_empty": F.when(F.count(F.lit(1)) == 0, 1).otherwise(0).cast("long")}
    checks["table_finite_values"] = sum((F.count_if(bad(c, c in nullable)) for c in numeric), F.lit(0).cast("long"))
    if fdr:
        checks["fdr_valid_range"] = outside(fdr, 0, 1)
    if moran:
        checks["moran_bounds"] = outside(moran, -1, 1)
    if geary:
        checks["geary_bounds"] = outside(geary, 0)
    if score:
        checks["score_non_negative"] = outside(score, 0)
    one = df.agg(*[e.alias(name) for name, e in checks.items()])
    rows = F.array(*[F.struct(F.lit(name).alias("check"), F.col(name).alias("n_violations")) for name in checks])
    return one.select(F.inline(rows)).withColumn("passed", F.col("n_violations") == 0)


def audit_adjustment(stored: DataFrame, key: str, p: str = "p_value", q: str = "fdr_q_value", tolerance: float = 1e-9) -> DataFrame:
    """Recompute the adjusted p-values of a stored table and count rows that differ, overall and in significance."""
    fresh = benjamini_hochberg(stored.select(key, p, F.col(q).alias("_stored")), p, "_fresh")
    gap = F.abs(F.col("_stored") - F.col("_fresh"))
    return fresh.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.coalesce(gap > tolerance, F.lit(True))).alias("n_wrong_q"),
        F.count_if(F.coalesce((F.col("_stored") < 0.05) != (F.col("_fresh") < 0.05), F.lit(True))).alias("n_wrong_decision"),
        F.count_if(F.col("_stored") < 0.05).alias("n_stored_supported"), F.count_if(F.col("_fresh") < 0.05).alias("n_fresh_supported"),
    ).withColumn("passed", F.col("n_wrong_q") == 0)


def audit_rebuilt(stored: DataFrame, rebuilt: DataFrame, keys: list[str], exact: list[str], close: list[str]) -> DataFrame:
    """Compare a stored table with the same table rebuilt from counts: one row per problem kind."""
    from countloom.operators.reconcile import reconcile

    return reconcile(rebuilt, stored, keys, exact, close).groupBy("problem").agg(F.count(F.lit(1)).alias("n_rows"))


def requirement_coverage(requirements: DataFrame, results: DataFrame) -> DataFrame:
    """Per requirement: admitted results for all its capabilities in scope, what is missing and the overall status.

    ``requirements`` has requirement_id, capabilities, target_cell_type (null for
    all) and prerequisite_gaps; ``results`` has task_id, capability, status,
    scientific_status, n_features_tested and target_cell_type.
    """
    wants = requirements.select("requirement_id", "target_cell_type", F.explode("capabilities").alias("capability"))
    ok = results.where(F.col("status") == "success").select(
        F.col("capability").alias("_cap"), F.col("target_cell_type").alias("_target"), "task_id", "scientific_status", "n_features_tested"
    )
    j = wants.join(ok, (F.col("capability") == F.col("_cap")) & F.col("target_cell_type").eqNullSafe(F.col("_target")), "left")
    inferential = F.col("capability").isin("deg", "donor_sensitivity", "functional_activity", "differential_abundance")
    usable = F.col("task_id").isNotNull() & (
        ~inferential | (F.col("scientific_status").isin("estimated_supported", "estimated_inconclusive") & (F.coalesce("n_features_tested", F.lit(0)) >= 1))
    )
    per_cap = j.groupBy("requirement_id", "capability").agg(
        F.count_if(usable).alias("_n"), F.max(F.coalesce(F.col("scientific_status") == "not_estimable", F.lit(False))).alias("_ne"),
    )
    out = per_cap.groupBy("requirement_id").agg(
        F.sum("_n").alias("n_results"), F.sort_array(F.collect_list(F.when(F.col("_n") == 0, F.col("capability")))).alias("missing_capabilities"),
        F.max("_ne").alias("_ne"),
    )
    gaps = F.size("prerequisite_gaps") > 0
    status = F.when(gaps | (F.col("_ne") & (F.size("missing_capabilities") > 0)), "not_estimable").when(
        F.size("missing_capabilities") > 0, "missing"
    ).otherwise("passed")
    return requirements.join(out, "requirement_id", "left").select("requirement_id", "n_results", "missing_capabilities", status.alias("status"))


def result_page(results: DataFrame, page: int = 1, size: int = 50, query: str = "", fdr_max: float | None = None, min_abs_lfc: float | None = None, order: str = "row_index", gene: str = "gene") -> DataFrame:
    """One page of matching rows in stored order, with the number of matches on every row."""
    rows = results
    if query:
        rows = rows.where(F.contains(F.lower(F.coalesce(gene, F.lit(""))), F.lit(query.lower())))
    if fdr_max is not None:
        rows = rows.where(F.col("fdr_q_value") <= fdr_max)
    if min_abs_lfc is not None:
        rows = rows.where(F.abs("log2_fold_change") >= min_abs_lfc)
    total = rows.agg(F.count(F.lit(1)).alias("n")).scalar()
    return rows.orderBy(order).offset((page - 1) * size).limit(size).withColumn("total_matches", total)


def display_points(points: DataFrame, max_points: int = 2000, order: str = "cell_id") -> DataFrame:
    """At most ``max_points`` rows with finite coordinates, evenly spaced in cell order; first and last are kept."""
    good = points.where(finite(F.col("x")) & finite(F.col("y")))
    at = ordered_positions(good, order).withColumnsRenamed({"n_below": "_p", "n_total": "_n"})
    span, last = F.col("_n") - 1, F.lit(max_points - 1).cast("long")
    # the i-th point shown is row floor(i * (n - 1) / (m - 1)); exact in whole numbers
    step = F.when(F.pmod(F.col("_p") * last, span) == 0, F.expr(f"(_p * {max_points - 1}L) div (_n - 1)")).otherwise(F.expr(f"(_p * {max_points - 1}L) div (_n - 1) + 1"))
    chosen = (F.col("_n") <= max_points) | (step * span < (F.col("_p") + 1) * last)
    return at.where(chosen).select(*points.columns)


def group_counts(points: DataFrame, group: str) -> DataFrame:
    return points.groupBy(F.coalesce(F.col(group).cast("string"), F.lit("unlabelled")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def row_fingerprint(df: DataFrame, cited: list[str], out: str = "fingerprint") -> DataFrame:
    """SHA-256 of the cited fields as JSON with sorted keys."""
    return df.withColumn(out, F.sha2(F.to_json(F.struct(*sorted(cited)), {"ignoreNullFields": "false"}), 256))


def matrix_fingerprint(counts: DataFrame) -> DataFrame:
    """Digest of all non-zero entries, the same for any row order or partitioning.

    Every entry is hashed and the words of the hashes are added up, so one
    partial aggregate is enough and nothing is sorted.
    """
    digest = F.sha2(F.concat_ws(":", F.col("cell_id").cast("string"), F.col("gene_id").cast("string"), F.col("value").cast("long").cast("string")), 256)
    words = [F.sum(F.conv(F.substring(F.col("_h"), 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).cast("string").alias(f"_w{i}") for i in range(4)]
    one = counts.where(F.col("value") != 0).select(digest.alias("_h")).agg(F.count(F.lit(1)).alias("n_entries"), *words)
    return one.select("n_entries", F.sha2(F.concat_ws("/", F.col("n_entries").cast("string"), *[f"_w{i}" for i in range(4)]), 256).alias("fingerprint"))


def marker_presence(expected: DataFrame, labels: DataFrame, genes: DataFrame, gene: str = "gene_name") -> DataFrame:
    """Per observed label: expected markers, how many the gene table holds, and which. ``expected`` has label and markers."""
    long = expected.select("label", F.explode("markers").alias("gene")).distinct()
    known = genes.select(F.col(gene).alias("gene"), F.lit(True).alias("_k")).distinct()
    per = long.join(known, "gene", "left").groupBy("label").agg(
        F.count(F.lit(1)).alias("n_expected"), F.count("_k").alias("n_present"), F.sort_array(F.collect_list(F.when(F.col("_k"), F.col("gene")))).alias("present"),
    )
    return labels.select("label").distinct().join(per, "label", "left").select(
        "label", "n_expected", "n_present", "present",
        F.when(F.col("n_expected").isNull(), "no_reference").when(F.col("n_present") == 0, "no_marker_present").otherwise("represented").alias("status"),
    )


def run_summary(events: DataFrame, run: str = "run_id") -> DataFrame:
    """Per run: events, last event, elapsed time and number of problems."""
    return events.groupBy(run).agg(
        F.count(F.lit(1)).alias("n_events"), F.max_by("kind", "sequence").alias("last_event"), F.max_by("elapsed_seconds", "sequence").alias("elapsed_seconds"),
        F.count_if(F.col("kind").isin(ISSUE_KINDS)).alias("n_issues"),
    )


def run_kind_counts(events: DataFrame, run: str = "run_id") -> DataFrame:
    return events.groupBy(run, "kind").agg(F.count(F.lit(1)).alias("n_events"))


def run_issues(events: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    return events.where(F.col("kind").isin(kinds or ISSUE_KINDS))
