"""Mixing sources to target weights by pivotal dependent rounding."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from countloom.llm.common import columns_of, stash

WORD = r"[^\x20\x09-\x0D]+"
_ROUND = "row long, doc_id string, source string, size long, source_size long, target double, slot long, place long, whole long, p double"


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, key): the words of each whole text, null holding none; rows alike in all share a key."""
    d = columns_of(docs, id_col, source_col, text_col)
    return d.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.col(id_col), F.col(source_col), F.col(text_col)).alias("key"),
    )


def source_targets(sized: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, slot, rows, source_size, target) of each source, ordered by code point with null last.

    The targets share ``share`` times all sizes by weight; what exceeds ``most`` times a source's size is shared again
    by weight among the rest, until none is above. One small job per round over the table of sources; the rounds end,
    as each fixes at least one more source. Sources are numbered from range partitions, not in one task.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    ranged = stash(totals.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "mix-sources")
    parts = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # one row per partition of the range exchange
    before = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    nr = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    slot = (F.col("before") + nr).cast("long")
    given = F.array(*[F.lit(float(x)) for x in weights])
    table = ranged.join(before, "part").withColumn("slot", slot).withColumn("weight", F.element_at(given, (F.col("slot") % len(weights) + 1).cast("int")))
    table = stash(table.drop("part", "before"), "mix-slots")
    cap, weight = F.lit(float(most)) * F.col("source_size"), F.col("weight")
    total, left = table.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).head()
    rate = share * total / left if left else 0.0
    while left:  # a source is full when its fair share, rate * weight, reaches its cap
        full, open_weight = table.agg(F.sum(F.when(cap <= rate * weight, cap).otherwise(0.0)), F.sum(F.when(cap > rate * weight, weight).otherwise(0.0))).head()
        if open_weight == left or not open_weight:
            break
        left, rate = open_weight, (share * total - full) / open_weight
    return table.select("source", "slot", "rows", "source_size", F.least(cap, F.lit(rate) * weight).alias("target"))


def pivot_block(p: np.ndarray, size: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Pivotal rounding of fractional copy probabilities: every entry ends at 0 or 1, but one residual at most.

    Two open entries at a time: mass moves from one to the other until one is integral, the direction drawn so that
    each entry's expectation stays, the amounts so that the sum of ``p * size`` stays exactly. ``size`` is positive.
    """
    p, size, held = p.tolist(), size.tolist(), -1
    for i, draw in enumerate(draws.tolist()):
        if not 0.0 < p[i] < 1.0:
            continue
        if held < 0:
            held = i
            continue
        ratio = size[i] / size[held]
        gain, loss = min(1.0 - p[held], p[i] * ratio), min(p[held], (1.0 - p[i]) * ratio)
        move = gain if draw * (gain + loss) < loss else -loss
        for k, x in ((held, p[held] + move), (i, p[i] - move / ratio)):
            p[k] = 0.0 if x < 1e-9 else 1.0 if x > 1.0 - 1e-9 else x
        held = next((k for k in (held, i) if 0.0 < p[k] < 1.0), -1)
    return np.array(p)


def _draws(rows: pd.DataFrame, salt: int) -> np.ndarray:
    mixed = rows["row"].to_numpy(np.int64).view(np.uint64) ^ np.uint64(salt % (1 << 64))
    return (pd.util.hash_array(mixed) >> np.uint64(11)).astype(np.float64) / 2.0**53


def _rounding(salt: int, last: bool):
    def apply(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "row"], ascending=False, kind="stable").reset_index(drop=True)
        p = pivot_block(rows["p"].to_numpy(np.float64), rows["size"].to_numpy(np.float64), _draws(rows, salt))
        if last:  # a source's one residual: an ordinary draw
            p = np.where((p > 0.0) & (p < 1.0), (_draws(rows, salt + 1) < p).astype(np.float64), p)
        return rows.assign(p=p)

    return apply


def mix_sources(
    docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 0, block: int = 4096,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken (words), copies, source.

    Each document of a source is wanted ``target / source_size`` times. The whole part is taken outright; the fractions
    are rounded by pivotal sampling that keeps the source's words: first inside blocks of about ``block`` rows, dealt by
    a hash, so that a source with a third of all rows is many blocks; then the blocks' single residuals are paired in
    turn, ``block`` to one, until each source has one. So a source's words miss its target by one document at most.
    Draws hash the row and ``seed``: reruns agree. Rows alike in id, source and text are told apart by a number. Empty
    and null texts have size 0 and take 0 words; a null source is a source of its own, the last; a null id is allowed.
    Further columns are ignored. An empty input gives no row.
    """
    each = stash(sizes(docs, id_col, text_col, source_col), "mix-sizes")
    table = stash(source_targets(each, weights, share, most), "mix-targets").withColumnRenamed("source", "of_source")
    number = F.row_number().over(Window.partitionBy("key").orderBy("doc_id"))
    numbered = each.select("doc_id", "source", "size", F.xxhash64("key", number).alias("row"))
    wanted = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    blocks = F.ceil(F.col("rows") / F.lit(block)).cast("long")
    level = numbered.join(table, numbered["source"].eqNullSafe(table["of_source"])).select(
        "row", F.col("doc_id").cast("string").alias("doc_id"), "source", "size", "source_size", "target", "slot", F.pmod(F.xxhash64("row", F.lit(seed)), blocks).alias("place"),
        F.floor(wanted + 1e-9).cast("long").alias("whole"),
        F.when(F.col("size") > 0, F.greatest(F.lit(0.0), wanted - F.floor(wanted + 1e-9))).otherwise(0.0).alias("p"),
    )
    width = table.agg(F.coalesce(F.max(F.ceil(F.col("rows") / F.lit(block))), F.lit(1))).head()[0]
    levels: list[DataFrame] = []
    while not levels or width > 1:
        width = width if not levels else -(-width // block)
        salt, last = seed * 1000 + 2 * len(levels), width <= 1
        levels.append(stash(level.groupBy("slot", "place").applyInPandas(_rounding(salt, last), _ROUND), "mix-level"))
        level = levels[-1].where("p > 0.0 AND p < 1.0").withColumn("place", F.floor(F.col("place") / block).cast("long"))
    out, p = levels[0], F.col("p")
    if len(levels) > 1:  # what was open after the first level has ended in a later one
        ends = reduce(DataFrame.unionByName, levels[1:]).where("p = 0.0 OR p = 1.0").select("row", F.col("p").alias("end"))
        out, p = out.join(ends, "row", "left"), F.coalesce("end", "p")
    copies = F.col("whole") + p.cast("long")
    return out.select(
        F.col("doc_id").cast("long").alias("doc_id"), "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"), "source",
    )


def take_mix(docs: DataFrame, seed: int = 0) -> DataFrame:
    """The rows of ``docs`` that the mix takes, with their columns and ``copies`` and ``taken`` (words).

    A text without words adds nothing to any source's words and is taken once. Rows that share an id share the larger
    number of copies. A column of ``docs`` named as one of the two new ones gives way to it.
    """
    mixed = mix_sources(docs, seed=seed)
    copies = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.col("copies"))
    per_id = mixed.groupBy(F.col("doc_id").alias("_mixed_id")).agg(F.max(copies).alias("copies"), F.max("taken").alias("taken")).where("copies > 0")
    kept = docs.drop("copies", "taken")
    return kept.join(per_id, kept["doc_id"].eqNullSafe(per_id["_mixed_id"])).drop("_mixed_id")
