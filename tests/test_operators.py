import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from countloom.functions.ranking import ordered_positions
from countloom.operators import checks, donor_stats as ds, embed, evidence as ev, genesets, markers, neighbors, normalize, ordering, partitions as pt
from countloom.operators import pairs, qc, reconcile as rc, sensitivity as sens, signatures as sg, spatial as sx


@pytest.fixture(scope="module")
def triples(spark):
    """Three cells by two genes: [[8, 2], [1, 9], [0, 0]], the second gene mitochondrial."""
    counts = spark.createDataFrame([("ok", "A", 8), ("ok", "MT-CO1", 2), ("mt", "A", 1), ("mt", "MT-CO1", 9)], "cell_id string, gene_id string, value long")
    cells = spark.createDataFrame([("ok",), ("mt",), ("none",)], "cell_id string")
    genes = spark.createDataFrame([("A", "A", 0), ("MT-CO1", "MT-CO1", 1)], "gene_id string, gene_name string, gene_index int")
    return counts, cells, genes


def test_qc_keeps_every_cell(triples):
    m = qc.cell_metrics(*triples)
    out = {r["cell_id"]: r for r in qc.disposition(m, 1, 20.0).collect()}
    assert out["ok"]["reason"] == "retained" and out["ok"]["mito_pct"] == 20.0
    assert out["mt"]["reason"] == "high_mito_percentage"
    assert out["none"]["reason"] == "low_gene_count" and out["none"]["mito_pct"] is None and out["none"]["total_counts"] == 0
    kept = {r["reason"]: r["n_cells"] for r in qc.retention_summary(qc.disposition(m, 1, 20.0)).collect()}
    assert kept["low_gene_count_and_high_mito_percentage"] == 0 and sum(kept.values()) == 3


def test_qc_mito_sources(triples, spark):
    counts, cells, genes = triples
    own = cells.withColumn("percent_mito", F.lit(7.0))
    assert {r["mito_pct"] for r in qc.cell_metrics(counts, own, genes).collect()} == {7.0}
    none = genes.withColumn("gene_name", F.lit("x"))
    m = qc.cell_metrics(counts, cells, none)
    assert all(r["mito_pct"] is None for r in m.collect())
    assert qc.mad_thresholds(m).first()["max_mito_pct"] == 100.0


def test_review_features_of_empty_groups(triples):
    counts, cells, genes = triples
    d = qc.disposition(qc.cell_metrics(*triples), 1, 20.0)
    out = rows(qc.review_features(counts, d, genes).where("status = 'no_cells'"), "gene_id")
    assert len(out) == 2 and all(r["mean_raw_count"] is None and r["n_detected"] == 0 for r in out)


def test_donor_roles(spark):
    cells = spark.createDataFrame([("a", "d1", "s1"), ("b", "d1", "s2"), ("c", "d2", "s3")], "cell_id string, donor string, sample string")
    assert checks.resolve_donor_column(cells) == "donor"
    with pytest.raises(ValueError, match="splits"):
        checks.resolve_donor_column(cells, "sample")
    with pytest.raises(ValueError, match="disagree"):
        checks.resolve_donor_column(cells.withColumn("mouse_id", F.col("sample")))
    assert checks.resolve_donor_column(cells.drop("donor")) is None


def test_contrasts(spark):
    cells = spark.createDataFrame([("a", "Ctrl"), ("b", "drug")], "cell_id string, condition string")
    assert checks.resolve_contrast(cells) == ("drug", "Ctrl")
    with pytest.raises(ValueError):
        checks.resolve_contrast(cells, pair=("drug", "drug"))
    three = cells.unionByName(spark.createDataFrame([("c", "x")], "cell_id string, condition string"))
    with pytest.raises(ValueError, match="Two conditions"):
        checks.resolve_contrast(three)


def test_count_layers(spark):
    layers = spark.createDataFrame([("counts", 1.5), ("X", 2.0), ("raw", 3.0)], "layer string, value double")
    assert checks.choose_count_layer(layers).first()["status"] == "counts layer is invalid"
    assert checks.choose_count_layer(layers.where("layer <> 'counts'")).first()["chosen_layer"] == "X"
    bad = spark.createDataFrame([("X", float("nan")), ("raw", 2.0**63)], "layer string, value double")
    assert checks.choose_count_layer(bad).first()["chosen_layer"] is None


def test_derived_names():
    for name in ("leiden_res1", "X_umap", "PC12", "nCount_RNA", "pct_counts_mt", "Phase", "dpt_pseudotime"):
        assert checks.is_derived_column(name)
    for name in ("donor", "condition", "batch", "cell_type", "age"):
        assert not checks.is_derived_column(name)


def test_mapping_and_invariants(spark):
    t = spark.createDataFrame([("a",), ("b",)], "cell_id string")
    e = spark.createDataFrame([("a",), ("a",), ("c",)], "cell_id string")
    r = checks.mapping_report(t, e, "cell_id").first()
    assert (r["n_duplicate_external"], r["n_missing"], r["n_extra"], r["valid"]) == (1, 1, 1, False)
    with pytest.raises(ValueError, match="mapping"):
        checks.require(checks.mapping_report(t, e, "cell_id"), "valid", "mapping")


@pytest.fixture(scope="module")
def study(spark):
    """Three donors per condition and one gene that is never seen, one seen in a single donor."""
    rng = np.random.default_rng(3)
    cells, counts = [], []
    for d, (donor, cond) in enumerate((f"d{i}", "A" if i < 4 else "B") for i in range(8)):
        for c in range(5):
            cid = f"{donor}_{c}"
            cells.append((cid, donor, cond, f"b{d % 2}"))
            for g, centre in enumerate((30, 8, 25, 60)):
                counts.append((cid, f"g{g}", int(rng.poisson(centre * (2 if cond == "A" and g == 1 else 1)))))
    counts.append(("d0_0", "single", 9))
    genes = [(f"g{g}", g) for g in range(4)] + [("single", 4), ("never", 5)]
    return (
        spark.createDataFrame([c for c in counts if c[2]], "cell_id string, gene_id string, value long"),
        spark.createDataFrame(cells, "cell_id string, donor string, condition string, batch string"),
        spark.createDataFrame(genes, "gene_id string, gene_index int").withColumn("gene_name", F.col("gene_id")), counts, cells,
    )


def _cpm(counts, cells):
    where = {c[0]: (c[1], c[2]) for c in cells}
    donors = sorted(set(where.values()))
    genes = ["g0", "g1", "g2", "g3", "single", "never"]
    m = np.zeros((len(donors), len(genes)))
    for cid, g, n in counts:
        m[donors.index(where[cid]), genes.index(g)] += n
    return donors, genes, m / m.sum(axis=1, keepdims=True) * 1e6


def _welch(a, b):
    va, vb = a.var(ddof=1) / len(a), b.var(ddof=1) / len(b)
    if va + vb == 0:
        return None, None
    df = (va + vb) ** 2 / (va**2 / (len(a) - 1) + vb**2 / (len(b) - 1))
    return (a.mean() - b.mean()) / np.sqrt(va + vb), df


def test_welch_and_every_fold_equal_refits(study):
    counts, cells, genes, raw, raw_cells = study
    donors, names, cpm = _cpm(raw, raw_cells)
    cond = np.array([d[1] for d in donors])
    de = {r["gene_id"]: r for r in ds.welch_de(counts, cells, genes, "A", "B").collect()}
    for j, g in enumerate(names):
        t, df = _welch(cpm[cond == "A", j], cpm[cond == "B", j])
        assert de[g]["t_stat"] == (None if t is None else pytest.approx(t, rel=1e-9))
        if t is None:
            assert de[g]["p_value"] == 1.0
    folds = {(r["gene_id"], r["left_out_donor"]): r for r in sens.leave_one_out(counts, cells, genes, "A", "B").collect()}
    assert len(folds) == 6 * 9
    for d, (donor, _) in enumerate(donors):
        keep = np.arange(len(donors)) != d
        for j, g in enumerate(names):
            a, b = cpm[keep & (cond == "A"), j], cpm[keep & (cond == "B"), j]
            t, df = _welch(a, b)
            row = folds[(g, donor)]
            assert row["log2_fold_change"] == pytest.approx(np.log2((a.mean() + 0.5) / (b.mean() + 0.5)), abs=1e-9)
            assert row["t_stat"] == (None if t is None else pytest.approx(t, rel=1e-6))
    bad = ds.donor_sides(cells, "A", "B")
    ok = sens.fold_integrity(sens.leave_one_out(counts, cells, genes, "A", "B"), bad, genes, removed=1)
    assert all(r["complete"] for r in ok.collect())


def test_folds_fail_with_two_donors(study):
    counts, cells, genes, *_ = study
    few = cells.where(F.col("donor").isin("d0", "d1", "d4", "d5"))
    out = sens.leave_one_out(counts, few, genes, "A", "B")
    assert {r["fit_status"] for r in out.where("left_out_donor <> '__full_model__'").collect()} == {"failed"}
    assert sens.leave_one_out_gate(few, "A", "B").first()["status"] == "skipped"
    assert sens.leave_one_out_gate(cells, "A", "B").count() == 0
    infl = sens.donor_influence(out, ds.donor_sides(few, "A", "B"))
    assert {r["direction_status"] for r in infl.collect()} <= {"incomplete_coverage", "undefined_full_effect"}


def test_ols_contrast_matches_least_squares(study, spark):
    counts, cells, genes, raw, raw_cells = study
    donors, names, cpm = _cpm(raw, raw_cells)
    batch = {c[1]: c[3] for c in raw_cells}
    samples = spark.createDataFrame([(d, c, batch[d]) for d, c in donors], "donor string, condition string, batch string")
    logs = ds.donor_cpm(counts, cells, "A", "B", log=True).withColumnRenamed("cpm", "y")
    got = {r["gene_id"]: r for r in ds.ols_contrast(samples, logs, genes, "A", covariates=["batch"]).collect()}
    x = np.array([[1, c == "A", batch[d] == "b1"] for d, c in donors], dtype=float)
    for j, g in enumerate(names):
        y = np.log1p(cpm[:, j])
        beta, *_ = np.linalg.lstsq(x, y, rcond=None)
        res = y - x @ beta
        se = np.sqrt(res @ res / (len(y) - 3) * np.linalg.inv(x.T @ x)[1, 1])
        assert got[g]["effect"] == pytest.approx(beta[1], abs=1e-9)
        assert got[g]["se"] == pytest.approx(se, abs=1e-7)
    with pytest.raises(ValueError, match="rank deficient"):
        ds.ols_contrast(samples, logs, genes, "A", paired=True)


def test_safe_tests_refuse_flat_input(spark):
    data = [("k", d, c, 1.0) for d in "abc" for c in "AB"] + [("m", d, c, float(i)) for i, (d, c) in enumerate(itertools.product("abc", "AB"))]
    df = spark.createDataFrame(data, "key string, donor string, condition string, x double")
    for paired in (True, False):
        out = {r["key"]: r for r in ds.safe_test(df, ["key"], "x", "A", "B", paired).collect()}
        assert out["k"]["p_value"] is None
    assert ds.safe_test(df, ["key"], "x", "A", "B", False).where("key = 'm'").first()["p_value"] is not None


def test_markers_small(spark):
    values = spark.createDataFrame([(c, "m", 2.0) for c in "abcd"] + [("e", "n", 1.0)], "cell_id string, gene_id string, value double")
    cells = spark.createDataFrame([(c, "A" if c in "abcd" else "B") for c in "abcdefgh"], "cell_id string, cluster string")
    genes = spark.createDataFrame([("m", "m", 0), ("n", "n", 1), ("z", "z", 2)], "gene_id string, gene_name string, gene_index int")
    out = {(r["cluster"], r["gene_id"]): r for r in markers.rank_markers(markers.cluster_markers(values, cells, genes)).collect()}
    assert out[("A", "m")]["rank"] == 1 and out[("A", "m")]["mean_in"] == 2.0 and out[("A", "m")]["mean_rest"] == 0.0
    assert out[("B", "n")]["mean_in"] == 0.25 and out[("B", "z")]["rank"] == 2 and out[("B", "m")]["rank"] == 3
    with pytest.raises(ValueError):
        markers.rank_markers(markers.cluster_markers(values, cells, genes), 5)


def _brute(ids, vec, grp, k, metric):
    out = {}
    for i in range(len(ids)):
        diff = np.abs(vec - vec[i])
        d = np.sqrt((diff**2).sum(1)) if metric == "l2" else diff.sum(1) if metric == "l1" else diff.max(1)
        cand = sorted((d[j], ids[j]) for j in range(len(ids)) if j != i and grp[j] == grp[i])[:k]
        out[ids[i]] = [c[1] for c in cand]
    return out


@pytest.mark.parametrize("metric", ["l2", "l1", "linf"])
@pytest.mark.parametrize("block", [40, 5000])
def test_neighbors_equal_brute_force(spark, metric, block):
    rng = np.random.default_rng(4)
    vec = np.vstack([rng.normal(size=(150, 2)), rng.normal(size=(120, 2)) * 0.01 + 5, np.tile([[9.0, 9.0]], (60, 1)), rng.normal(size=(3, 2))])
    grp = ["a"] * 330 + ["b"] * 3
    ids = [int(x) for x in rng.permutation(len(vec))]
    df = spark.createDataFrame([(i, g, [float(x) for x in v]) for i, g, v in zip(ids, grp, vec)], "cell_id long, s string, vec array<double>")
    got = {}
    for r in neighbors.exact_neighbors(df, 5, metric, "s", block_rows=block).collect():
        got.setdefault(r["src"], {})[r["rank"]] = r["dst"]
    want = _brute(ids, vec, grp, 5, metric)
    assert {i: [got.get(i, {}).get(k + 1) for k in range(len(w))] for i, w in want.items()} == want
    assert sum(len(v) for v in got.values()) == sum(len(w) for w in want.values())


def test_pca_equals_svd(spark):
    rng = np.random.default_rng(5)
    x = rng.poisson(1.0, size=(40, 7)).astype(float)
    x[0] = 0
    values = spark.createDataFrame([(i, j, float(x[i, j])) for i in range(40) for j in range(7) if x[i, j]], "cell_id long, gene_id long, value double")
    cells = spark.createDataFrame([(i,) for i in range(40)], "cell_id long")
    for centre in (True, False):
        got = np.array([r["vec"] for r in embed.pca_scores(values, cells, 3, centre).orderBy("cell_id").collect()])
        u, s, _ = np.linalg.svd(x - x.mean(0) if centre else x, full_matrices=False)
        assert np.allclose(np.abs(got), np.abs(u[:, :3] * s[:3]), atol=1e-8)


def test_absorption_equals_linear_solve(spark):
    rng = np.random.default_rng(6)
    n = 12
    w = rng.random((n, n)) * (rng.random((n, n)) < 0.4)
    w[np.arange(n), (np.arange(n) + 1) % n] += 0.5
    w /= w.sum(1, keepdims=True)
    ends = {0: "x", 1: "y", 2: "y"}
    free = [i for i in range(n) if i not in ends]
    p = np.linalg.solve(np.eye(len(free)) - w[np.ix_(free, free)], w[np.ix_(free, [0])])[:, 0]
    edges = spark.createDataFrame([(i, j, float(w[i, j])) for i in range(n) for j in range(n) if w[i, j]], "src long, dst long, weight double")
    out = ordering.absorption(edges, spark.createDataFrame(list(ends.items()), "cell_id long, fate string"), tolerance=1e-10)
    got = {r["cell_id"]: r["probability"] for r in out.where("fate = 'x'").collect()}
    assert [got[i] for i in free] == pytest.approx(list(p), abs=1e-7)


def test_matching_is_optimal(spark):
    rng = np.random.default_rng(7)
    a, b = rng.integers(0, 4, 200), rng.integers(0, 5, 200)
    first = spark.createDataFrame([(i, f"a{x}") for i, x in enumerate(a)], "cell_id int, label string")
    second = spark.createDataFrame([(i, f"b{x}") for i, x in enumerate(b)], "cell_id int, label string")
    table = np.array([[((a == i) & (b == j)).sum() for j in range(5)] for i in range(4)])
    jac = table / (table.sum(1, keepdims=True) + table.sum(0) - table)
    best = max(sum(jac[i, p[i]] for i in range(4)) for p in itertools.permutations(range(5), 4))
    for x, y in ((first, second), (second, first)):
        out = pt.match_clusters(x, y).collect()
        assert sum(r["shared_jaccard"] for r in out if r["matching_status"] == "matched") == pytest.approx(best)
    assert {r["matching_status"] for r in pt.match_clusters(second, first).collect()} == {"matched", "unmatched"}


def test_agreement_edges(spark):
    one = spark.createDataFrame([(i, "x") for i in range(5)], "cell_id int, label string")
    r = pt.agreement(pt.contingency(one, one)).first()
    assert (r["ari"], r["nmi"]) == (1.0, 1.0)
    lone = one.limit(1)
    assert pt.agreement(pt.contingency(lone, lone)).first()["status"] == "not_estimable"


def test_correlation_network_equals_numpy(spark):
    rng = np.random.default_rng(8)
    x = rng.poisson(0.8, size=(60, 6)).astype(float)
    x[:30, 4], x[30:, 5], x[30:, 4], x[:30, 5] = 3, 3, 0, 0
    values = spark.createDataFrame([(i, j, float(x[i, j])) for i in range(60) for j in range(6) if x[i, j]], "cell_id long, gene_id long, value double")
    cells = spark.createDataFrame([(i,) for i in range(60)], "cell_id long")
    c = np.corrcoef(x.T)
    got = {(r["src"], r["dst"]): r["correlation"] for r in sg.correlation_network(values, cells, 0.05, 32).collect()}
    want = {(i, j): c[i, j] for i in range(6) for j in range(6) if i != j and abs(c[i, j]) >= 0.05}
    assert set(got) == set(want) and got[(4, 5)] == pytest.approx(-1.0)
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_moran_patterns(spark):
    side = 6
    cells = spark.createDataFrame([(i * side + j, float(i), float(j)) for i in range(side) for j in range(side)], "cell_id long, x double, y double")
    graph = sx.symmetric_graph(sx.section_neighbors(cells, 4, section=None))
    halves = [(i * side + j, "hot", 5.0) for i in range(3) for j in range(side)]
    board = [(i * side + j, "board", 5.0) for i in range(side) for j in range(side) if (i + j) % 2]
    flat = [(i, "flat", 2.0) for i in range(side * side)]
    values = spark.createDataFrame(halves + board + flat, "cell_id long, gene_id string, value double")
    genes = values.select("gene_id").distinct()
    out = {r["gene_id"]: r for r in sx.autocorrelation(values, cells, genes, graph).collect()}
    assert out["hot"]["moran_i"] > 0.5 and out["hot"]["moran_p"] < 1e-3 and out["hot"]["geary_c"] < 0.6
    assert out["board"]["moran_i"] < -0.3 and out["board"]["geary_c"] > 1.2
    assert out["flat"]["moran_i"] == 0.0 and out["flat"]["moran_p"] == 1.0 and out["flat"]["geary_c"] == 1.0
    with pytest.raises(ValueError, match="one section"):
        sx.spatially_variable(values, cells.withColumn("s", F.col("cell_id") % 2), genes, graph, "s")


def test_separate_groups_never_touch(spark):
    cells = spark.createDataFrame([(i, float(i % 5) + (0 if i < 20 else 1000), float(i // 5), "A" if i < 20 else "B", "s") for i in range(40)], "cell_id long, x double, y double, cell_type string, section string")
    graph = sx.symmetric_graph(sx.section_neighbors(cells, 4, columns=["x", "y"]))
    d = {(r["source"], r["target"]): r["density"] for r in sx.contact_density(graph, cells).collect()}
    assert d[("A", "B")] == 0.0 and d[("A", "A")] > 0
    p = {(r["source"], r["target"]): r["contact_p"] for r in sx.contact_permutations(graph, cells, 30, perms_per_batch=12).collect()}
    assert p[("A", "B")] == 1.0 and p[("A", "A")] <= 2 / 31


def test_sections_need_labels(spark):
    cells = spark.createDataFrame([(1, "d1", "s1"), (2, "d2", "s1")], "cell_id long, donor string, section string")
    with pytest.raises(ValueError, match="observed sections"):
        sx.section_partitions(cells, None, "donor")
    assert sx.section_sizes(sx.section_partitions(cells, "section", "donor")).count() == 2


def test_lineage_cycles_and_gaps(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b"), ("x", "y")], "parent string, child string")
    arts = spark.createDataFrame([("a", True), ("b", False), ("c", False), ("y", False)], "uri string, is_simulated boolean")
    out = {r["start"]: r for r in ev.provenance(arts, edges, spark.createDataFrame([("c",), ("y",)], "uri string")).collect()}
    assert out["c"]["has_cycle"] and out["c"]["is_simulated"] and not out["c"]["valid"]
    assert out["y"]["n_missing"] == 1 and not out["y"]["has_cycle"]


def test_origins_bridge(spark):
    e = spark.createDataFrame([(1, 1, ["a"]), (1, 2, ["b"]), (1, 3, ["b", "c"]), (1, 4, ["c", "a"]), (1, 5, ["z"])], "g int, evidence_id int, origins array<string>")
    out = {r["evidence_id"]: r["component"] for r in ev.merge_origins(e, ["g"]).collect()}
    assert out == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5}


def test_audits_catch_edits(spark, study):
    counts, cells, genes, *_ = study
    res = ds.welch_de(counts, cells, genes, "A", "B")
    assert ev.audit_adjustment(res, "gene_id").first()["passed"]
    edited = res.withColumn("fdr_q_value", F.when(F.col("gene_id") == "g0", 0.001).otherwise(F.col("fdr_q_value")))
    assert ev.audit_adjustment(edited, "gene_id").first()["n_wrong_q"] == 1
    t = sens.table_equality(res, res.withColumn("t_stat", F.when(F.col("gene_id") == "g1", None).otherwise(F.col("t_stat"))), ["gene_id"], ["t_stat"])
    assert t.first()["n_mask_mismatch"] == 1 and not t.first()["passed"]
    logs = normalize.log_normalize(counts)
    fresh = markers.cluster_markers(logs, cells, genes, "condition")
    gone = fresh.where("gene_id <> 'g2'")
    assert {r["problem"]: r["n_rows"] for r in ev.audit_rebuilt(gone, fresh, ["cluster", "gene_id"], ["n_in"], ["mean_in"]).collect()} == {"missing_row": 2}
    assert rc.reconcile(fresh, fresh, ["cluster", "gene_id"], ["n_in"], ["mean_in"]).count() == 0


def test_fingerprint_ignores_layout(spark, study):
    counts = study[0]
    a = ev.matrix_fingerprint(counts).first()["fingerprint"]
    assert a == ev.matrix_fingerprint(counts.repartition(7).orderBy(F.desc("value"))).first()["fingerprint"]
    assert a != ev.matrix_fingerprint(counts.withColumn("value", F.col("value") + 1)).first()["fingerprint"]


def test_pair_resources(spark):
    res = spark.createDataFrame([(1, " L ", "R1_R2"), (2, "L", "R1_R2"), (3, "", "R"), (4, "Q", "R1")], "n int, LIGAND string, Receptor string")
    clean = pairs.clean_pairs(res, "n")
    assert rows(clean.select("ligand", "receptor", "n"), "ligand") == [{"ligand": "L", "receptor": "R1_R2", "n": 1}, {"ligand": "Q", "receptor": "R1", "n": 4}]
    genes = spark.createDataFrame([("L",), ("R1",)], "gene string")
    out = {r["ligand"]: r for r in pairs.evaluable_pairs(clean, genes).collect()}
    assert out["L"]["missing_genes"] == ["R2"] and out["Q"]["missing_genes"] == ["Q"] and not out["L"]["evaluable"]


def test_display_rows_are_evenly_spaced(spark):
    for n, m in ((10, 20), (100, 7), (101, 100), (5, 5)):
        pts = spark.range(n).select(F.col("id").alias("cell_id"), F.col("id").cast("double").alias("x"), F.lit(0.0).alias("y"))
        got = sorted(r["cell_id"] for r in ev.display_points(pts, m).collect())
        assert got == sorted({i * (n - 1) // (min(n, m) - 1) for i in range(min(n, m))})


def test_soft_assignment_is_a_distribution(spark):
    values = spark.createDataFrame([(1, "g", 4.0), (2, "g", 4.2), (3, "h", 4.0)], "cell_id long, gene_id string, value double")
    cells = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "b")], "cell_id long, state string")
    out = sg.state_transitions(sg.soft_assignment(values, cells)).groupBy("from_state").agg(F.sum("probability").alias("s"))
    assert all(r["s"] == pytest.approx(1.0) for r in out.collect())


def test_network_check_and_refusal(spark):
    genes = spark.createDataFrame([("g1",), ("g2",)], "gene_id string")
    net = spark.createDataFrame([("tf", "g1", 1.0), ("tf", None, 1.0), (" ", "g2", 1.0), ("tf", "g2", None), ("tf", "g2", float("nan"))], "source string, target string, weight double")
    one = ds.check_network(net).head()
    assert (one["n_edges"], one["n_missing_ends"], one["n_bad_weights"], one["valid"]) == (5, 2, 2, False)
    assert [tuple(r) for r in ds.prepare_network(net, genes).collect()] == [("tf", "g1", 1.0)]
    with pytest.raises(ValueError):
        ds.prepare_network(net, genes, strict=True)


def test_pair_without_a_common_donor_stays(spark):
    rows = spark.createDataFrame(
        [("s", "t", "L", "R", "d1", "a", 0.1, 0.2), ("s", "t", "L", "R", "d2", "b", 0.3, 0.4)],
        "source string, target string, ligand string, receptor string, donor string, condition string, magnitude_rank double, specificity_rank double",
    )
    out = pairs.compare_pair_scores(rows, "a", "b", paired=True).collect()
    assert len(out) == 1 and out[0]["n_donors_a"] == 0 and out[0]["status"] == "insufficient_donors"


def test_title_case_of_symbols(spark):
    info = spark.createDataFrame(
        [("COX7A2", "homo_sapiens", [], {}, 1), ("cox7A2", "mus_musculus", [], {}, 2), ("ACTB", "homo_sapiens", [], {}, 1), ("actB", "mus_musculus", [], {}, 2)],
        "gene_symbol string, species string, aliases array<string>, orthologs map<string,string>, entry_order int",
    )
    asked = spark.createDataFrame([("Cox7a2",), ("Actb",)], "symbol string")
    found = {r["symbol"]: r["species"] for r in genesets.lookup_genes(asked, info).collect()}
    assert found == {"Cox7a2": "homo_sapiens", "Actb": "mus_musculus"}


def test_one_cluster_and_ordered_positions(spark):
    vectors = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(5)], "cell_id long, vec array<double>")
    assert {r["cluster"] for r in embed.kmeans(vectors, 1).collect()} == {0}
    names = spark.createDataFrame([(n,) for n in ("b", "a", "d", "c")], "name string")
    assert {r["name"]: (r["n_below"], r["n_total"]) for r in ordered_positions(names, "name").collect()} == {"a": (0, 4), "b": (1, 4), "c": (2, 4), "d": (3, 4)}


def test_donor_folds_have_no_silent_bound(spark):
    cells = spark.createDataFrame([(i, f"d{i % 6}") for i in range(60)], "cell_id long, donor string")
    branches = {r["branch"] for r in pt.perturbed_sets(cells).select("branch").distinct().collect()}
    assert {f"leave_out_d{k}" for k in range(6)} <= branches
    assert pt.fold_status(cells, most=4).head()["status"] == "not_eligible"
    assert not any(b.startswith("leave_out") for b in {r["branch"] for r in pt.perturbed_sets(cells, most=4).select("branch").distinct().collect()})
