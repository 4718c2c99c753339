"""Scans and sinks: Matrix Market directories, reference tables, run-event logs, versioned tables."""

from __future__ import annotations

import re
from urllib.parse import urlparse

from pyspark.sql import DataFrame, Row, SparkSession, Window as W, functions as F

RUN_EVENT_SCHEMA = (
    "run_id string, study_id string, sequence int, timestamp timestamp, elapsed_seconds double, "
    "kind string, task_id string, details string, _bad string"
)


def _first_existing(spark: SparkSession, folder: str, names: list[str]) -> str:
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    for name in names:
        path = jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{name}")
        if path.getFileSystem(conf).exists(path):
            return path.toString()
    raise FileNotFoundError(f"None of {names} is in {folder}")


def _placed_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their place in the file, whatever order the splits are read in."""
    return spark.read.text(path).select(
        F.rtrim("value").alias("line"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"),
    )


def _numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    lines = _placed_lines(spark, path).where(F.trim("line") != "")
    per_block = lines.groupBy("_block").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(F.lit(1)).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    offsets = per_block.select("_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    at = F.col("_before") + F.row_number().over(W.partitionBy("_block").orderBy("_row"))
    return lines.join(offsets, "_block").select("line", at.cast("long").alias("position"))


def read_matrix_market(spark: SparkSession, folder: str, partitions: int | None = None):
    """Read ``matrix``, ``barcodes`` and ``features`` files into (counts, cells, genes).

    A compressed matrix is read by one task and then spread over ``partitions``.
    """
    matrix = _first_existing(spark, folder, ["matrix.mtx", "matrix.mtx.gz"])
    placed = _placed_lines(spark, matrix).select("line", F.struct("_block", "_row").alias("position"))
    if matrix.endswith(".gz"):
        placed = placed.repartition(partitions or spark.sparkContext.defaultParallelism)
    return parse_matrix_market(
        placed, _numbered_lines(spark, _first_existing(spark, folder, ["barcodes.tsv", "barcodes.tsv.gz"])),
        _numbered_lines(spark, _first_existing(spark, folder, ["features.tsv", "features.tsv.gz", "genes.tsv", "genes.tsv.gz"])),
    )


def parse_matrix_market(matrix: DataFrame, barcodes: DataFrame, features: DataFrame):
    """(counts, cells, genes) from the lines of the three files, each with its ``position`` in the file.

    The matrix is features by barcodes; positions of its lines need only be
    ordered, those of the others count from 1. Shape, ids and values are checked
    with one aggregate per table. Values are long where the banner says integer.
    The matrix is read three times: lines that are costly to make should be written first.
    """
    cells = barcodes.select(F.col("line").alias("cell_id"), F.col("position").alias("cell_index"))
    tabs = F.split("line", "\t")
    genes = features.select(
        tabs.getItem(0).alias("gene_id"),
        F.when(F.size(tabs) > 1, tabs.getItem(1)).otherwise(F.split(F.trim("line"), r"\s+").getItem(0)).alias("gene_name"),
        F.col("position").alias("gene_index"),
    )
    lines = matrix.where(F.trim("line") != "")
    comment = F.col("line").startswith("%")
    body = lines.where(~comment)
    size = F.when(~comment, F.struct("position", "line"))
    head = lines.agg(F.min_by("line", "position").alias("banner"), F.min(size).alias("first")).select("banner", F.col("first.line").alias("size"), F.col("first.position").alias("at")).head()
    if head is None or head["size"] is None:
        raise ValueError("Matrix Market file has no size line")
    n_rows, n_cols, n_stored = (int(v) for v in head["size"].split()[:3])
    kind = "long" if "integer" in head["banner"].lower().split() else "double"
    part = F.split(F.trim("line"), r"\s+")
    at = head["at"]  # a number, or the parts of a position
    size_line = F.struct(*[F.lit(v).cast("long").alias(c) for c, v in at.asDict().items()]) if isinstance(at, Row) else F.lit(at)
    entries = body.where(F.col("position") != size_line).select(
        part.getItem(0).cast("long").alias("gene_index"), part.getItem(1).cast("long").alias("cell_index"),
        part.getItem(2).cast("double").alias("value"),
    )
    seen_cells = cells.agg(F.count(F.lit(1)), F.countDistinct("cell_id")).first()
    seen_genes = genes.agg(F.count(F.lit(1)), F.countDistinct("gene_id")).first()
    if (n_rows, n_cols) != (seen_genes[0], seen_cells[0]):
        raise ValueError(f"Matrix shape ({n_rows}, {n_cols}) does not match {seen_genes[0]} features, {seen_cells[0]} barcodes")
    if seen_cells[0] != seen_cells[1] or seen_genes[0] != seen_genes[1] or min(n_rows, n_cols) == 0:
        raise ValueError("Feature ids and barcodes must be nonempty and unique")
    value = F.col("value")
    bad = value.isNull() | F.isnan(value) | (value < 0) | (value == float("inf"))
    found = entries.agg(
        F.count(F.lit(1)), F.count_if(bad),
        F.count_if(~F.col("gene_index").between(1, n_rows) | ~F.col("cell_index").between(1, n_cols)),
    ).first()
    if found[0] != n_stored or found[1] or found[2]:
        raise ValueError("Matrix entries must match the size line and be finite, nonnegative and inside the shape")
    # Ids are unique, so entries may be added up by their indices, where the join has put them.
    counts = (
        entries.where(F.col("value") != 0).join(genes.select("gene_id", "gene_index"), "gene_index")
        .join(cells, "cell_index").groupBy("cell_index", "gene_index", "cell_id", "gene_id").agg(F.sum("value").cast(kind).alias("value"))
        .select("cell_id", "gene_id", "value")
    )
    return counts, cells, genes


def complete_tables(counts: DataFrame, cells: DataFrame, genes: DataFrame):
    """Fill absent summary columns of the cell and gene tables; columns already there stay."""
    by_cell = counts.groupBy("cell_id").agg(
        F.sum("value").alias("_n_counts"), F.count_if(F.col("value") > 0).alias("_n_genes")
    )
    by_gene = counts.groupBy("gene_id").agg(F.count_if(F.col("value") > 0).alias("_n_cells"))
    out_cells = cells
    if not {"n_counts", "n_genes"} <= set(cells.columns):
        out_cells = cells.join(by_cell, "cell_id", "left").select(
            *cells.columns,
            *[F.coalesce(f"_{c}", F.lit(0)).alias(c) for c in ("n_counts", "n_genes") if c not in cells.columns],
        )
    out_genes = genes
    if "gene_name" not in genes.columns:
        out_genes = out_genes.withColumn("gene_name", F.col("gene_id").cast("string"))
    if "n_cells" not in genes.columns:
        out_genes = out_genes.join(by_gene, "gene_id", "left").select(
            *out_genes.columns, F.coalesce("_n_cells", F.lit(0)).alias("n_cells")
        )
    return out_cells, out_genes


def read_reference_table(spark: SparkSession, path: str) -> DataFrame:
    """Read a CSV, TSV/TXT, JSON, JSONL or Parquet table, chosen by its suffix. Web addresses are refused."""
    if urlparse(path).scheme in {"http", "https", "ftp"}:
        raise ValueError("Reference tables are read from local or cluster storage, not from the web")
    suffix = re.search(r"\.([^./]+)$", path.lower())
    kind = suffix.group(1) if suffix else ""
    if kind == "csv":
        return spark.read.csv(path, header=True, inferSchema=True)
    if kind in {"tsv", "txt"}:
        return spark.read.csv(path, header=True, inferSchema=True, sep="\t")
    if kind == "json":
        return spark.read.json(path, multiLine=True)
    if kind == "jsonl":
        return spark.read.json(path)
    if kind in {"parquet", "pq"}:
        return spark.read.parquet(path)
    raise ValueError(f"Unsupported table format {kind!r}: use CSV, TSV, JSON, JSONL or Parquet")


def check_run_events(events: DataFrame, log: str = "log") -> DataFrame:
    """One row per log: is the sequence 1..n in file order, and is there one run and one study?

    Every event must follow exactly one predecessor, numbered one less and
    placed before it. Predecessors are found by an equi-join, so a long log is
    not sorted by one task.
    """
    here = events.select(log, F.col("sequence").cast("long").alias("sequence"), "_position", "run_id", "study_id", "elapsed_seconds")
    before = here.groupBy(log, (F.col("sequence") + 1).alias("sequence")).agg(
        F.count(F.lit(1)).alias("_n"), F.max("_position").alias("_last")
    )
    follows = F.when(F.col("sequence") == 1, F.col("_n").isNull()).otherwise((F.col("_n") == 1) & (F.col("_last") < F.col("_position")))
    out = here.join(before, [log, "sequence"], "left").groupBy(log).agg(
        F.count(F.lit(1)).alias("n_events"), F.count_if(~F.coalesce(follows, F.lit(False))).alias("_gaps"), F.max("sequence").alias("_top"),
        F.count_if(F.col("elapsed_seconds") < 0).alias("n_negative_elapsed"),
        ((F.min("run_id") == F.max("run_id")) & (F.min("study_id") == F.max("study_id"))).alias("one_identity"),
    )
    breaks = F.col("_gaps") + F.coalesce(F.abs(F.col("_top") - F.col("n_events")), F.lit(0))
    return out.select(log, "n_events", breaks.alias("n_sequence_breaks"), "n_negative_elapsed", "one_identity").withColumn(
        "valid", (F.col("n_sequence_breaks") == 0) & (F.col("n_negative_elapsed") == 0) & F.col("one_identity")
    )


def read_run_events(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Read JSON-lines run logs, one log per file. A malformed last line is dropped; any other is an error."""
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("log"),
        F.struct(F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("r")).alias("_position"),
    )
    return parse_run_events(lines, strict)


def parse_run_events(lines: DataFrame, strict: bool = True) -> DataFrame:
    """Events of run-log lines (value, log, _position), of any number of logs; positions need only be ordered within a log."""
    parsed = F.from_json("value", RUN_EVENT_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    raw = lines.select(parsed.alias("e"), "log", "_position").select("e.*", "log", "_position")
    last = lines.groupBy("log").agg(F.max("_position").alias("_last"))
    kept = raw.join(last, "log").where(F.col("_bad").isNull() | (F.col("_position") != F.col("_last")))
    if strict:
        wrong = kept.agg(F.count_if(F.col("_bad").isNotNull())).first()[0]
        checks = check_run_events(kept).where(~F.col("valid")).limit(1).collect()
        if wrong or checks:
            raise ValueError(f"Run-event log is invalid: {wrong} malformed lines, {checks}")
    return kept.drop("_bad", "_last")


def write_version(df: DataFrame, base: str) -> str:
    """Write the next ``vN`` folder under ``base``; an existing version is never overwritten."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    taken = [0]
    if fs.exists(path):
        for status in fs.listStatus(path):
            match = re.fullmatch(r"v(\d+)", status.getPath().getName())
            if match:
                taken.append(int(match.group(1)))
    out = f"{base.rstrip('/')}/v{max(taken) + 1}"
    df.write.mode("errorifexists").parquet(out)
    return out
