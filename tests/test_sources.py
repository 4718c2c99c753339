import gzip
import json

import pytest

from countloom.sources import tables


def _write(folder, zipped):
    body = "%%MatrixMarket matrix coordinate integer general\n% note\n3 2 4\n1 1 5\n3 1 2\n2 2 7\n3 2 1\n"
    if zipped:
        with gzip.open(folder / "matrix.mtx.gz", "wt") as f:
            f.write(body)
    else:
        (folder / "matrix.mtx").write_text(body)
    (folder / "barcodes.tsv").write_text("AAA\nBBB\n")
    (folder / "features.tsv").write_text("G1\tone\tGene\nG2\ttwo\nG3\tthree\n")


@pytest.mark.parametrize("zipped", [False, True])
def test_matrix_market(spark, tmp_path, zipped):
    _write(tmp_path, zipped)
    counts, cells, genes = tables.read_matrix_market(spark, str(tmp_path))
    got = {(r["cell_id"], r["gene_id"]): r["value"] for r in counts.collect()}
    assert got == {("AAA", "G1"): 5.0, ("AAA", "G3"): 2.0, ("BBB", "G2"): 7.0, ("BBB", "G3"): 1.0}
    assert [r["gene_name"] for r in genes.orderBy("gene_index").collect()] == ["one", "two", "three"]
    done, done_genes = tables.complete_tables(counts, cells, genes)
    assert {r["cell_id"]: r["n_genes"] for r in done.collect()} == {"AAA": 2, "BBB": 2}
    assert {r["gene_id"]: r["n_cells"] for r in done_genes.collect()} == {"G1": 1, "G2": 1, "G3": 2}


@pytest.mark.parametrize("edit", ["shape", "negative", "duplicate", "missing"])
def test_matrix_market_rejects(spark, tmp_path, edit):
    _write(tmp_path, False)
    m = tmp_path / "matrix.mtx"
    if edit == "shape":
        m.write_text(m.read_text().replace("3 2 4", "2 3 4"))
    elif edit == "negative":
        m.write_text(m.read_text().replace("1 1 5", "1 1 -5"))
    elif edit == "duplicate":
        (tmp_path / "barcodes.tsv").write_text("AAA\nAAA\n")
    else:
        (tmp_path / "features.tsv").unlink()
    with pytest.raises((ValueError, FileNotFoundError)):
        tables.read_matrix_market(spark, str(tmp_path))


def test_reference_tables(spark, tmp_path):
    (tmp_path / "a.csv").write_text("source,target,weight\nx,g,1.5\n")
    (tmp_path / "a.tsv").write_text("source\ttarget\tweight\nx\tg\t1.5\n")
    (tmp_path / "a.jsonl").write_text('{"source": "x", "target": "g", "weight": 1.5}\n')
    (tmp_path / "a.json").write_text('[{"source": "x", "target": "g", "weight": 1.5}]')
    spark.createDataFrame([("x", "g", 1.5)], "source string, target string, weight double").write.parquet(str(tmp_path / "a.parquet"))
    for name in ("a.csv", "a.tsv", "a.jsonl", "a.json", "a.parquet"):
        r = tables.read_reference_table(spark, str(tmp_path / name)).first()
        assert (r["source"], r["target"], r["weight"]) == ("x", "g", 1.5)
    for bad in ("https://example.org/a.csv", str(tmp_path / "a.xlsx")):
        with pytest.raises(ValueError):
            tables.read_reference_table(spark, bad)


def _event(i, run="r"):
    return json.dumps({"run_id": run, "study_id": "s", "sequence": i, "timestamp": "2024-01-01T00:00:00", "elapsed_seconds": float(i), "kind": "k"})


def test_run_events(spark, tmp_path):
    log = tmp_path / "e.jsonl"
    log.write_text("\n".join(_event(i) for i in range(1, 5)) + '\n{"run_id": "r", "seq')
    assert tables.read_run_events(spark, str(log)).count() == 4
    log.write_text("\n".join(_event(i) for i in (1, 3, 4)) + "\n")
    with pytest.raises(ValueError):
        tables.read_run_events(spark, str(log))
    log.write_text(_event(1) + "\n" + _event(2, "other") + "\n")
    with pytest.raises(ValueError):
        tables.read_run_events(spark, str(log))
    log.write_text(_event(1) + "\n{broken\n" + _event(2) + "\n")
    with pytest.raises(ValueError):
        tables.read_run_events(spark, str(log))


def test_versions_are_never_overwritten(spark, tmp_path):
    base = str(tmp_path / "table")
    df = spark.range(3)
    assert [tables.write_version(df, base).rsplit("/", 1)[1] for _ in range(3)] == ["v1", "v2", "v3"]
    assert spark.read.parquet(base + "/v1").count() == 3
