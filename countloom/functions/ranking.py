"""Ranks, running minima, medians and exact-size samples without one big sort.

Values are cut into ordered buckets. The bucket table is small, so its prefix
sums are cheap; the rows inside a bucket are ranked in parallel. Ties are
collapsed first, so one value that holds a third of all rows is one row here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from countloom.session import cut_lineage, stored


def value_bucket(value: Column, per_octave: int = 64) -> Column:
    """Order-preserving integer bucket of a finite double."""
    size = F.floor(F.log2(F.abs(value)) * per_octave) + 1100 * per_octave
    return F.when(value == 0, F.lit(0)).when(value > 0, size).otherwise(-size).cast("long")


def _bucket_offsets(collapsed: DataFrame, groups: list[str]) -> DataFrame:
    sums = collapsed.groupBy(*groups, "_bucket").agg(F.sum("n_tie").alias("_bucket_n"))
    whole = W.partitionBy(*groups) if groups else W.partitionBy(F.lit(1))
    before = whole.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    return sums.select(
        *groups, "_bucket", "_bucket_n",
        F.coalesce(F.sum("_bucket_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_bucket_n").over(whole).alias("n_total"),
    )


def tie_positions(df: DataFrame, groups: list[str], value: str, keep_bucket: bool = False) -> DataFrame:
    """One row per distinct value: how many rows tie with it, lie below it, and exist in its group.

    Groups and values must not be null. Average rank is ``n_below + (n_tie + 1) / 2``.
    """
    collapsed = df.groupBy(*groups, value).agg(F.count(F.lit(1)).alias("n_tie")).withColumn(
        "_bucket", value_bucket(F.col(value))
    )
    inside = W.partitionBy(*groups, "_bucket").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    placed = collapsed.join(_bucket_offsets(collapsed, groups), [*groups, "_bucket"]).withColumn(
        "n_below", F.col("_before") + F.coalesce(F.sum("n_tie").over(inside), F.lit(0))
    )
    cols = [*groups, value, "n_tie", "n_below", "n_total"]
    return placed.select(*cols, "_bucket") if keep_bucket else placed.select(*cols)


def ordered_positions(df: DataFrame, order: str) -> DataFrame:
    """Add ``n_below`` (rows before, in order of a column of any type) and ``n_total``, without one big sort.

    Rows are dealt to ranges, checkpointed there, counted by range and numbered
    inside their range. Null comes first; rows with equal values are numbered in some order.
    """
    ranged = cut_lineage(df.repartitionByRange(F.col(order).asc_nulls_first()).withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)  # one row per range
    offsets = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(W.partitionBy()).alias("n_total"))
    inside = F.row_number().over(W.partitionBy("_range").orderBy(F.col(order).asc_nulls_first())) - 1
    return ranged.join(offsets, "_range").withColumn("n_below", F.col("_before") + inside).drop("_range", "_before")


def benjamini_hochberg(
    df: DataFrame, p: str = "p_value", out: str = "fdr_q_value", family: list[str] | None = None,
    missing: str = "one",
) -> DataFrame:
    """Add adjusted p-values within each family.

    ``missing="one"`` counts null, NaN and +inf as 1 and -inf as 0. ``missing="keep"``
    adjusts only finite values and leaves the others null. The rows are written
    first: they are joined on their own p, which must be the same on both sides.
    """
    family = list(family or [])
    raw = F.col(p)
    if missing == "one":
        clean = (
            F.when(raw.isNull() | F.isnan(raw), F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)))
        )
    elif missing == "keep":
        finite = raw.isNotNull() & ~F.isnan(raw) & (F.abs(raw) != F.lit(float("inf")))
        clean = F.when(finite, F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)))
    else:
        raise ValueError("missing must be 'one' or 'keep'")
    rows = stored(df.withColumn("_p", clean))
    pos = tie_positions(rows.where(F.col("_p").isNotNull()).select(*family, "_p"), family, "_p", keep_bucket=True)
    pos = pos.withColumn(
        "_cand", F.least(F.lit(1.0), F.col("_p") * F.col("n_total") / (F.col("n_below") + F.col("n_tie")).cast("double"))
    )
    later = (W.partitionBy(*family) if family else W.partitionBy(F.lit(1))).orderBy(F.desc("_bucket")).rowsBetween(
        W.unboundedPreceding, -1
    )
    suffix = pos.groupBy(*family, "_bucket").agg(F.min("_cand").alias("_low")).select(
        *family, "_bucket", F.min("_low").over(later).alias("_later")
    )
    down = W.partitionBy(*family, "_bucket").orderBy(F.desc("_p")).rowsBetween(W.unboundedPreceding, 0)
    adjusted = pos.join(suffix, [*family, "_bucket"]).select(
        *family, "_p", F.least(F.min("_cand").over(down), F.coalesce("_later", F.lit(1.0))).alias(out)
    )
    known = rows.where(F.col("_p").isNotNull()).join(adjusted, [*family, "_p"], "left").select(*df.columns, out)
    if missing == "one":
        return known
    # Rows without a p need no join, where they would all meet in one task.
    return known.unionByName(rows.where(F.col("_p").isNull()).select(*df.columns, F.lit(None).cast("double").alias(out)))


def exact_median(df: DataFrame, groups: list[str], value: str, out: str) -> DataFrame:
    """Exact median per group, sorting only the buckets that hold the middle ranks."""
    collapsed = df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(
        F.count(F.lit(1)).alias("n_tie")
    ).withColumn("_bucket", value_bucket(F.col(value)))
    low = F.floor((F.col("n_total") - 1) / 2)
    high = F.floor(F.col("n_total") / 2)
    offsets = _bucket_offsets(collapsed, groups).where(
        (F.col("_before") <= high) & (F.col("_before") + F.col("_bucket_n") > low)
    )
    inside = W.partitionBy(*groups, "_bucket").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    middle = collapsed.join(offsets, [*groups, "_bucket"]).withColumn(
        "_below", F.col("_before") + F.coalesce(F.sum("n_tie").over(inside), F.lit(0))
    )
    upto = F.col("_below") + F.col("n_tie")
    picked = middle.groupBy(*groups).agg(
        F.max(F.when((F.col("_below") <= low) & (upto > low), F.col(value))).alias("_a"),
        F.max(F.when((F.col("_below") <= high) & (upto > high), F.col(value))).alias("_b"),
    )
    return picked.select(*groups, ((F.col("_a") + F.col("_b")) / 2).alias(out))


def draw_key(id_col: Column, seed: Column | int) -> Column:
    """Uniform 60-bit hexadecimal key of an id under a seed; the same text in any SQL engine with md5."""
    seed = F.lit(seed) if isinstance(seed, int) else seed
    return F.substring(F.md5(F.concat_ws(":", seed.cast("string"), id_col.cast("string"))), 1, 15)


def hash_shuffle_rank(df: DataFrame, groups: list[str], id_col: str, seed: Column | int, out: str) -> DataFrame:
    """Position (from 1) of each row in a seeded random order of its group."""
    keyed = df.withColumn("_key", draw_key(F.col(id_col), seed)).withColumn("_bucket", F.substring("_key", 1, 3))
    counted = keyed.groupBy(*groups, "_bucket").agg(F.count(F.lit(1)).alias("n_tie"))
    inside = W.partitionBy(*groups, "_bucket").orderBy("_key", id_col)
    return (
        keyed.join(_bucket_offsets(counted, groups), [*groups, "_bucket"])
        .withColumn(out, (F.col("_before") + F.row_number().over(inside)).cast("long"))
        .select(*df.columns, out)
    )


def hash_sample(
    df: DataFrame, id_col: str, seed: Column | int, n: int | None = None, fraction: float | None = None,
    groups: list[str] | None = None, size: Column | None = None,
) -> DataFrame:
    """Exactly ``n`` (or floor(fraction x group size)) rows per group, without replacement.

    ``size`` may give the number as an expression of ``n_total``. Only the one bucket at the boundary of each group is sorted.
    """
    groups = list(groups or [])
    keyed = df.withColumn("_key", draw_key(F.col(id_col), seed)).withColumn("_bucket", F.substring("_key", 1, 3))
    counted = keyed.groupBy(*groups, "_bucket").agg(F.count(F.lit(1)).alias("n_tie"))
    want = size if size is not None else F.lit(n) if n is not None else F.floor(F.col("n_total") * F.lit(fraction))
    offsets = _bucket_offsets(counted, groups).withColumn("_want", want).where(F.col("_before") < F.col("_want"))
    near = keyed.join(offsets, [*groups, "_bucket"])
    full = near.where(F.col("_before") + F.col("_bucket_n") <= F.col("_want"))
    edge = near.where(F.col("_before") + F.col("_bucket_n") > F.col("_want")).withColumn(
        "_pos", F.row_number().over(W.partitionBy(*groups, "_bucket").orderBy("_key", id_col))
    ).where(F.col("_before") + F.col("_pos") <= F.col("_want"))
    return full.select(*df.columns).unionByName(edge.select(*df.columns))
