"""The pipeline's stages against what they promise, each on its own input."""

import corpus_pipeline
import pytest
from odd_input import none, odd  # noqa: F401
from pyspark.sql import functions as F
from compare import compare, oracle_connection
from test_training_data import brute_classes, brute_contaminated

from countloom.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_stages_keep_and_drop(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        left = {r["doc_id"]: r["text"] for r in docs.collect()}
        gone = rows.keys() - left.keys()
        if name == "language ID":
            assert not any(any(c.isalpha() for c in rows[d] or "") for d in gone)
        elif name == "exact dedup":
            assert len({t.casefold() for t in left.values()}) == len(left)
        elif name == "MinHash near-dedup":
            classes = brute_classes(sorted(rows.items()))
            assert set(left) == set(classes.values())
        else:
            assert gone == {d for d, _ in brute_contaminated(rows.items(), items)}
        rows = left
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r["doc_id"] for r in mixed} <= set(rows) and all(r["copies"] in (1, 2) and r["text"] == rows[r["doc_id"]] for r in mixed)


def test_run_of_the_whole(spark):
    out = corpus_pipeline.run(spark, SF)
    assert set(out.columns) == {"doc_id", "text", "lang", "source", "n_chars", "copies", "taken"} and 0 < out.count() < 200


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracles(spark, name):
    _took, _n, result = compare(spark, oracle_connection(SF), SF, name, QUERIES[name], ORACLES[name])
    assert result == "ok", result


def run_stages(spark, docs, sf_dir):
    """Each stage's rows, written and read again as the pipeline does."""
    from countloom.llm.common import stash

    for name, stage in corpus_pipeline.STAGES:
        docs = stash(stage(spark, docs, sf_dir), "test-stage")
        yield name, docs


@pytest.fixture(scope="module")
def bench_dir(spark, tmp_path_factory):
    place = tmp_path_factory.mktemp("bench")
    rows = [(1, "the quick brown fox jumps over the lazy dog near the river bank today"), (2, None), (3, ""), (None, "one two")]
    spark.createDataFrame(rows, "item_id long, text string").write.parquet(f"{place}/benchmark.parquet")
    return str(place)


def test_stages_on_odd_rows(spark, odd, bench_dir):  # noqa: F811
    before = odd
    for name, docs in run_stages(spark, odd, bench_dir):
        assert set(before.columns) <= set(docs.columns), name
        ids = sorted((r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect() if r["doc_id"] is not None)
        had = [(r["doc_id"], r["text"] or "") for r in before.select("doc_id", "text").collect() if r["doc_id"] is not None]
        assert set(ids) <= set(had)
        if name == "language ID":
            assert not {1, 2, 3, 4} & {d for d, _ in ids} and {5, 6, 7} <= {d for d, _ in ids}
        if name == "exact dedup":
            texts = [t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for _, t in ids]
            assert len(set(texts)) == len(texts) and (8, "The quick brown fox jumps over the lazy dog near the river bank today") in ids
        if name == "benchmark decontamination":
            assert 8 not in {d for d, _ in ids} and 5 in {d for d, _ in ids}
        before = docs


def test_stages_on_empty_tables(spark, none, odd, tmp_path):  # noqa: F811
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, docs in run_stages(spark, none, str(tmp_path)):
        assert docs.count() == 0 and set(none.columns) <= set(docs.columns), name
    left = [docs.count() for _, docs in run_stages(spark, odd, str(tmp_path))]
    assert left[2] == left[3] > 0  # an empty benchmark takes nothing away


def test_documents_without_languages_stay(spark, odd):  # noqa: F811
    from countloom.llm import language_id

    bare = odd.withColumn("lang", F.lit(None).cast("string"))
    assert language_id.keep_recognised(bare).count() == odd.count()
