"""Steps whose memory, traffic or files must not grow with one group of the data."""

import numpy as np
from pyspark.sql import functions as F

from countloom.operators import evidence as ev, neighbors, neighbors_approx, sensitivity, signatures
from countloom.sources import tables


def test_points_meet_pivots_in_bounded_chunks(spark):
    n, pivots = 300_000, 150
    chunks = spark.range(1).select(F.lit(n).alias("n")).select(neighbors._chunks(2000, 1024)).head()[0]
    assert n / chunks * pivots <= neighbors.CHUNK_PAIRS


def test_close_points_in_few_dimensions_meet_only_points_near_them(monkeypatch):
    distances, asked = neighbors.pair_distances, []
    monkeypatch.setattr(neighbors, "pair_distances", lambda a, b, metric: asked.append(len(a) * len(b)) or distances(a, b, metric))
    rng, k = np.random.default_rng(6), 7
    for points in (rng.normal(size=(2000, 2)), rng.integers(0, 30, (2000, 2)).astype(float)):  # the second has ties
        ids = rng.permutation(9000)[:2000]
        for radius in (None, rng.choice([0.01, 1.5], 2000)):
            asked.clear()
            found = neighbors.nearest_rows(ids, points, ids, points, k, "l2", radius)
            d = distances(points, points, "l2")
            want = {(ids[i], ids[j], d[i, j]) for i in range(2000) for j in np.lexsort((ids, d[i]))[:k] if radius is None or d[i, j] <= radius[i]}
            assert set(zip(found["src"], found["dst"], found["distance"])) == want
            assert radius is not None or sum(asked) < 2000 * 2000 / 4, sum(asked)


def test_pair_significance_searches_its_neighbours_once(spark, monkeypatch):
    from countloom.operators import spatial
    from countloom.plans import load_catalog

    searched, search = [], spatial.exact_neighbors
    monkeypatch.setattr(spatial, "exact_neighbors", lambda *a, **k: searched.append(1) or search(*a, **k))
    assert load_catalog()[0]["x13_pair_significance"](spark, "/root/testdata/sf0.001").count() and len(searched) == 1


def test_folds_without_adjustment(spark):
    counts = spark.createDataFrame([(c, g, 1 + (c * g) % 5) for c in range(12) for g in range(3)], "cell_id long, gene_id long, value long")
    cells = spark.createDataFrame([(c, str(c % 3), "ab"[c % 2]) for c in range(12)], "cell_id long, donor string, condition string")
    genes = spark.range(3).withColumnRenamed("id", "gene_id")
    whole = sensitivity.leave_one_out(counts, cells, genes, "a", "b")
    bare = sensitivity.leave_one_out(counts, cells, genes, "a", "b", adjust=False)
    assert bare.columns == [c for c in whole.columns if c not in ("p_value", "fdr_q_value")]
    assert sorted(map(str, bare.collect())) == sorted(map(str, whole.select(bare.columns).collect()))


def test_cells_meet_a_block_of_states_in_parts(spark):
    values = spark.range(40).select(F.col("id").alias("cell_id"), (F.col("id") % 3).alias("gene_id"), F.lit(1.0).alias("value"))
    cells = spark.range(40).select(F.col("id").alias("cell_id"), (F.col("id") % 2).alias("state"))
    found = signatures.soft_assignment(values, cells)
    assert found.count() == 80 and "_part" in found._jdf.queryExecution().toString()


def test_logs_need_no_file_each(spark):
    lines = [(str(u), n, f'{{"run_id": "r", "study_id": "s", "sequence": {n}, "elapsed_seconds": 1.0}}') for u in range(50) for n in (1, 2)]
    df = spark.createDataFrame(lines + [("7", 3, '{"run')], "log string, _position int, value string")
    assert tables.parse_run_events(df).groupBy("log").count().where("count = 2").count() == 50


def test_rows_with_the_same_origins_are_linked_once(spark, monkeypatch):
    rows = [(g, i, o) for g in (1, None) for i, o in enumerate([["a", "b", None]] * 50 + [["c"], ["b", "d"], ["e", "c"], []])]
    rows.append((1, 0, ["f"]))  # a second row of the same evidence
    sizes, components = [], ev.components
    monkeypatch.setattr(ev, "components", lambda links: sizes.append(links.count()) or components(links))
    found = ev.merge_origins(spark.createDataFrame(rows, "g int, evidence_id int, origins array<string>"), ["g"]).collect()
    assert sizes == [7]  # of each group a-b, b-d, c-e; a-f
    assert len(found) == 106 and {(r["g"], r["evidence_id"], r["component"]) for r in found} == {
        (g, i, 50 if i in (50, 52) else 0) for g in (1, None) for i in range(53)
    }


def test_matrix_entries_are_added_up_where_their_join_put_them(spark):
    lines = ["%%MatrixMarket matrix coordinate integer general", "% note", "3 2 5", "1 1 5", "3 1 2", "2 2 7", "3 2 1", "3 1 4"]
    seen = spark.sparkContext.accumulator(0)

    def watched(batches):
        for batch in batches:
            seen.add(int(batch["line"].str.startswith("1 1").sum()))
            yield batch

    matrix = spark.createDataFrame(list(enumerate(lines)), "position long, line string").mapInPandas(watched, "position long, line string")
    barcodes, features = (spark.createDataFrame([(i + 1, x) for i, x in enumerate(xs)], "position long, line string") for xs in (["A", "B"], ["G", "H", "I"]))
    counts, _, _ = tables.parse_matrix_market(matrix, barcodes, features)
    assert {(r["cell_id"], r["gene_id"], r["value"]) for r in counts.collect()} == {("A", "G", 5), ("A", "I", 6), ("B", "H", 7), ("B", "I", 1)}
    assert seen.value == 3  # banner and size, checks, counts
    assert "hashpartitioning(cell_id" not in counts._jdf.queryExecution().toString()


def test_only_pairs_that_can_enter_a_list_leave_a_round(spark, monkeypatch):
    n, k, passed, best = 500, 5, [], neighbors_approx._best
    x = np.random.default_rng(4).normal(size=(n, 16))
    monkeypatch.setattr(neighbors_approx, "_best", lambda pairs, k: passed.append(pairs.count()) or best(pairs, k))
    points = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "cell_id long, vec array<double>")
    found = neighbors_approx.approximate_neighbors(points, k)
    assert found.count() == n * k and len(passed) == 3 and max(passed[1:]) < 20 * n, passed


def test_large_tables_are_dealt_to_more_tasks(spark):
    from countloom.plans import load_catalog
    from countloom.session import spread

    df = spark.range(1000).withColumn("k", F.col("id") % 100)
    assert spread(df, 10, "k").rdd.getNumPartitions() == 4 and spread(df, 1000, "k", rows_per_task=100).rdd.getNumPartitions() == 10
    plan = load_catalog()[0]["n03_pseudobulk_cpm"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert plan.count("REPARTITION_BY_NUM") >= 3  # line items, counts by cell, counts by sample and gene


def test_pair_scores_deal_their_counts(spark):
    from countloom.plans.study_sets import group_scores

    seen, repartition = [], type(spark.range(1)).repartition
    type(spark.range(1)).repartition = lambda df, n, *keys: seen.append(keys) or repartition(df, n, *keys)
    try:
        assert group_scores(spark, "/root/testdata/sf0.001").count()
    finally:
        type(spark.range(1)).repartition = repartition
    assert seen == [("l_orderkey", "l_partkey"), ("cell_id",)]


def test_correlation_network_deals_its_pairs(spark, monkeypatch):
    seen, spread = [], signatures.spread
    monkeypatch.setattr(signatures, "spread", lambda df, n, *keys, **k: seen.append((n, keys)) or spread(df, n, *keys, **k))
    values = spark.range(90).select((F.col("id") / 3).cast("long").alias("cell_id"), (F.col("id") * 7 % 31).alias("gene_id"), (F.col("id") % 5 + 1).alias("value"))
    assert signatures.correlation_network(values, values.select("cell_id").distinct(), 0.05).count()
    assert seen[:2] == [(90, ("_b",)), (90, ("gene_i", "gene_j"))]  # 3 pairs in each of 30 cells
    assert {keys for n, keys in seen if n == 90} >= {("gene_i",), ("gene_j",), ("src",)}


def test_pair_scores_are_compared_in_one_shuffle(spark, monkeypatch):
    from countloom.operators import pairs

    plans, adjust = [], pairs.benjamini_hochberg
    monkeypatch.setattr(pairs, "benjamini_hochberg", lambda df, *a, **k: plans.append(df._jdf.queryExecution().executedPlan().toString()) or adjust(df, *a, **k))
    rows = spark.range(80).select(
        *[(F.col("id") % 5).cast("string").alias(c) for c in ("source", "target", "ligand", "receptor")], (F.col("id") % 4).alias("donor"),
        F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("condition"), (F.col("id") % 7 / 7).alias("magnitude_rank"), (F.col("id") % 11 / 11).alias("specificity_rank"),
    )
    assert pairs.compare_pair_scores(rows, "a", "b", paired=True).count() == 5
    assert plans[0].count("Exchange hashpartitioning") == 1, plans[0]


def test_rows_without_p_values_keep_their_place(spark):
    from countloom.functions.ranking import benjamini_hochberg

    df = spark.createDataFrame([(i, p) for i, p in enumerate([0.01, None, 0.04, float("nan"), 0.02, None])], "id int, p double")
    out = {r["id"]: r["q"] for r in benjamini_hochberg(df, "p", "q", missing="keep").collect()}
    assert out == {0: 0.03, 1: None, 2: 0.04, 3: None, 4: 0.03, 5: None}


def test_branches_share_their_sums(spark, monkeypatch):
    from countloom.operators import donor_stats
    from countloom.plans import study_donors

    summed, pseudobulk = [], donor_stats.pseudobulk
    monkeypatch.setattr(donor_stats, "pseudobulk", lambda *a, **k: summed.append(1) or pseudobulk(*a, **k))
    first, second = study_donors._two_results(spark, "/root/testdata/sf0.001")
    assert first.count() > second.count() > 0 and len(summed) == 1
