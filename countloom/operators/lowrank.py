"""Leading singular vectors of a long table by a randomised range finder with a tall-skinny QR tree.

The table is a matrix of cells by genes, mostly zeros. Only matrices of width x width numbers reach the driver, where
the width is the number of components and a few more; cell and gene sides stay tables of short rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from countloom.session import cut_lineage

FAN_IN = 8  # factors merged at a time
SMALLEST = 1e-9  # directions below this share of the largest are left out of a basis


def _dense(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _local_factor(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, width))
        for batch in batches:
            if batch.num_rows:
                r = np.linalg.qr(np.vstack([r, _dense(batch.column("vec"), width)]), mode="r")
        if len(r):
            yield pa.record_batch([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([r.ravel().tolist()], pa.list_(pa.float64()))], names=["part", "r"])

    return run


def tall_factor(rows: DataFrame, width: int) -> np.ndarray:
    """R of the QR factorisation of all ``vec`` rows: each task's factor, merged FAN_IN at a time in a tree of tasks.

    The last at most FAN_IN factors are merged on the driver. Missing rows are zeros, so R is width x width.
    """
    level = cut_lineage(rows.select("vec").mapInArrow(_local_factor(width), "part int, r array<double>"))

    def merge(part: pd.DataFrame) -> pd.DataFrame:
        stacked = np.vstack([np.asarray(r).reshape(-1, width) for r in part.sort_values("part")["r"]])
        return pd.DataFrame({"part": [int(part["part"].iloc[0]) // FAN_IN], "r": [np.linalg.qr(stacked, mode="r").ravel()]})

    while level.count() > FAN_IN:
        level = cut_lineage(level.groupBy(F.floor(F.col("part") / FAN_IN)).applyInPandas(merge, "part int, r array<double>"))
    last = [np.asarray(x["r"]).reshape(-1, width) for x in level.orderBy("part").collect()]
    return np.linalg.qr(np.vstack([*last, np.zeros((width, width))]), mode="r")


def rotate(rows: DataFrame, matrix: np.ndarray) -> DataFrame:
    """``rows`` (key, vec) with every vec times the small matrix."""
    key = rows.columns[0]
    width = matrix.shape[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.ascontiguousarray(_dense(batch.column("vec"), width) @ matrix)
            cuts = np.arange(0, out.size + 1, matrix.shape[1], dtype=np.int32)
            yield pa.record_batch([batch.column(key), pa.ListArray.from_arrays(pa.array(cuts), pa.array(out.ravel()))], names=[key, "vec"])

    return rows.select(key, "vec").mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, vec array<double>")


def orthonormal(rows: DataFrame, width: int, twice: bool = False) -> tuple[DataFrame, int]:
    """(a basis of the column space of ``rows``, its width); ``twice`` removes the rounding left by the first pass."""
    _, s, vt = np.linalg.svd(tall_factor(rows, width))
    kept = max(1, int((s > SMALLEST * s[0]).sum()))
    basis = cut_lineage(rotate(rows, vt[:kept].T / np.where(s[:kept] > 0, s[:kept], 1.0)))
    if twice:
        r = tall_factor(basis, kept)
        if np.abs(np.diag(r)).min() > 0.5:
            basis = cut_lineage(rotate(basis, np.linalg.inv(r)))
    return basis, kept


def _product(values: DataFrame, side: DataFrame, width: int, by: str, over: str) -> DataFrame:
    """Sum of value * side.vec over ``over``, for every ``by``."""
    w = F.col("vec")
    sums = values.join(side, over).groupBy(by).agg(*[F.sum(F.col("value") * w[c]).alias(f"_{c}") for c in range(width)])
    return sums.select(by, F.array(*[f"_{c}" for c in range(width)]).alias("vec"))


def _totals(rows: DataFrame, width: int, weight=None) -> np.ndarray:
    w = F.lit(1.0) if weight is None else weight
    one = rows.agg(*[F.coalesce(F.sum(w * F.col("vec")[c]), F.lit(0.0)).alias(f"_{c}") for c in range(width)]).head()
    return np.array(list(one), dtype=float)


def _minus(rows: DataFrame, shift: np.ndarray, factor=None) -> DataFrame:
    """Take ``factor`` (1 by default) times the short vector off every row."""
    if not shift.any():
        return rows.select(rows.columns[0], "vec")
    f = F.lit(1.0) if factor is None else factor
    return rows.select(rows.columns[0], F.array(*[F.col("vec")[c] - f * float(x) for c, x in enumerate(shift)]).alias("vec"))


def principal_components(values: DataFrame, cells: DataFrame, k: int, centre: bool = False, oversample: int = 10, power: int = 4) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """(scores: cell_id, vec; loadings: gene_id, vec; singular values) of the k leading components.

    ``values`` has one row per stored (cell_id, gene_id, value) of the given cells; other entries are zero. ``centre``
    takes gene means off without filling zeros in. The range finder starts from k + oversample random sign vectors over
    the genes, or from unit vectors when the genes are no more, which is exact. Every power pass multiplies by the
    matrix and its transpose, as two joins and sums, and makes both sides orthonormal again. No limit on genes or cells;
    runs jobs and checkpoints when called. Components beyond the rank of the matrix are zero. Signs make each
    component's largest loading positive.
    """
    spark = values.sparkSession
    used = cut_lineage(values.select("cell_id", "gene_id", F.col("value").cast("double").alias("value")))
    genes = cut_lineage(used.groupBy("gene_id").agg(F.sum("value").alias("s")))
    ids = cells.select("cell_id")
    n, g = ids.count(), genes.count()
    k = min(k, n, g) if centre else min(k, max(1, n - 2), max(1, g - 2))
    width = min(k + oversample, g)
    if g == 0 or n == 0:
        none = [0.0] * max(0, k)
        return ids.withColumn("vec", F.array(*[F.lit(x) for x in none]).cast("array<double>")), genes.select("gene_id", F.array().cast("array<double>").alias("vec")), np.zeros(max(0, k))

    def on_cells(side: DataFrame, width: int) -> DataFrame:
        y = ids.join(_product(used, side, width, "cell_id", "gene_id"), "cell_id", "left")
        y = y.withColumn("vec", F.coalesce("vec", F.array(*[F.lit(0.0)] * width)))
        shift = _totals(genes.join(side, "gene_id"), width, F.col("s")) / n if centre else np.zeros(width)
        return cut_lineage(_minus(y, shift))

    def on_genes(side: DataFrame, width: int) -> DataFrame:
        b = _product(used, side, width, "gene_id", "cell_id")
        if centre:
            b = _minus(b.join(genes, "gene_id"), _totals(side, width), F.col("s") / n)
        return cut_lineage(b)

    complete = width == g
    if complete:
        order = [r["gene_id"] for r in genes.select("gene_id").orderBy("gene_id").collect()]  # at most k + oversample
        kind = genes.schema["gene_id"].dataType.simpleString()
        side = spark.createDataFrame([(x, [float(i == j) for j in range(g)]) for i, x in enumerate(order)], f"gene_id {kind}, vec array<double>")
    else:
        sign = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda c: F.when(F.pmod(F.xxhash64(F.col("gene_id").cast("string"), c), F.lit(2)) == 0, 1.0).otherwise(-1.0))
        side = rotate(genes.select("gene_id", sign.alias("vec")), np.eye(width))  # columns of its own, as it is joined with genes
        for step in range(power):
            basis, width = orthonormal(on_cells(side, width), width)
            side, width = orthonormal(on_genes(basis, width), width, twice=step == power - 1)
    y = on_cells(side, width)
    _, s, vt = np.linalg.svd(tall_factor(y, width))
    turn = np.zeros((width, k))
    turn[:, : min(k, width)] = vt[:k].T
    turn[:, np.flatnonzero(np.pad(s, (0, k))[:k] <= 1e-12 * s[0])] = 0.0
    loadings = cut_lineage(rotate(side, turn))
    top = loadings.agg(*[F.max_by(F.col("vec")[c], F.abs(F.col("vec")[c])).alias(f"_{c}") for c in range(k)]).head()
    signs = np.where(np.array(list(top), dtype=float) < 0, -1.0, 1.0)
    return rotate(y, turn * signs), rotate(loadings, np.diag(signs)), np.pad(s, (0, k))[:k]
