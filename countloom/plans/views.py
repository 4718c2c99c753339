"""The driver tables seen as a study: cells, genes, counts, vectors and so on.

Each view has a Spark form (a function) and the same definition as a SQL common
table expression, used by the oracle queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from countloom.session import spread


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def counts(spark, sf, rows: int | None = None, keys: tuple[str, ...] = ("l_orderkey", "l_partkey")) -> DataFrame:
    """``rows``, the number of line items, deals them by ``keys`` to as many tasks as they need."""
    items = table(spark, sf, "lineitem")
    return (items if rows is None else spread(items, rows, *keys)).groupBy(
        F.col("l_orderkey").alias("cell_id"), F.col("l_partkey").alias("gene_id")
    ).agg(F.sum("l_quantity").cast("long").alias("value"))


def cells(spark, sf) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("cell_id"), F.col("c_custkey").cast("string").alias("donor"),
        F.col("c_nationkey").cast("string").alias("nation"), F.col("c_mktsegment").alias("condition"),
        F.col("o_orderpriority").alias("cluster"), F.col("o_orderstatus").alias("batch"),
    )


def genes(spark, sf) -> DataFrame:
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("gene_id"), F.col("p_partkey").alias("gene_index"),
        F.concat(F.lit("g"), F.col("p_partkey").cast("string")).alias("gene_name"),
        (F.col("p_type") == "PROMO").alias("mt"), F.col("p_brand").alias("brand"), F.col("p_size").alias("size"),
    )


def paired_cells(spark, sf) -> DataFrame:
    """Nations as donors, each seen under both conditions."""
    return cells(spark, sf).where(F.col("condition").isin("BUILDING", "MACHINERY")).withColumn("donor", F.col("nation"))


def vectors(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("cell_id"), F.transform("embedding", lambda v: v.cast("double")).alias("vec"),
        F.col("label").cast("string").alias("label"), (F.col("vec_id") % 3).cast("string").alias("batch"),
    )


def separate_vectors(spark, sf) -> DataFrame:
    """Vectors with a long one-hot part for the label in front, so that the labels are groups far apart."""
    one_hot = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.when(i.cast("string") == F.col("label"), 100.0).otherwise(0.0))
    return vectors(spark, sf).select("cell_id", F.concat(one_hot, "vec").alias("vec"), "label")


def by_first_cell(found: DataFrame, column: str) -> DataFrame:
    """Groups named by their smallest cell id, as their own names are free."""
    first = found.groupBy(column).agg(F.min("cell_id").alias("_first"))
    return found.join(first, column).select("cell_id", F.col("_first").alias(column))


def places(spark, sf) -> DataFrame:
    """Cells with coordinates: two components of a vector, in two sections."""
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("cell_id"), F.element_at("embedding", 1).cast("double").alias("x"),
        F.element_at("embedding", 2).cast("double").alias("y"), (F.col("label") % 2).cast("string").alias("section"),
        F.col("label").cast("string").alias("cell_type"),
    )


def place_counts(spark, sf) -> DataFrame:
    """Expression on the same cells: positive parts of all vector components."""
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("cell_id"),
        F.posexplode("embedding").alias("gene_id", "raw"),
    ).where(F.col("raw") > 0).select(
        "cell_id", F.col("gene_id").cast("long").alias("gene_id"), F.floor(F.col("raw").cast("double") * 100).alias("value")
    ).where(F.col("value") > 0)


COUNTS = (
    "counts AS (SELECT l_orderkey AS cell_id, l_partkey AS gene_id, CAST(sum(l_quantity) AS BIGINT) AS value "
    "FROM lineitem GROUP BY 1, 2)"
)
CELLS = (
    "cells AS (SELECT o_orderkey AS cell_id, CAST(c_custkey AS VARCHAR) AS donor, CAST(c_nationkey AS VARCHAR) AS nation, "
    "c_mktsegment AS condition, o_orderpriority AS cluster, o_orderstatus AS batch "
    "FROM orders JOIN customer ON o_custkey = c_custkey)"
)
GENES = (
    "genes AS (SELECT p_partkey AS gene_id, p_partkey AS gene_index, 'g' || p_partkey AS gene_name, "
    "(p_type = 'PROMO') AS mt, p_brand AS brand, p_size AS size FROM part)"
)
PAIRED = (
    "pcells AS (SELECT cell_id, nation AS donor, nation, condition, cluster, batch FROM cells "
    "WHERE condition IN ('BUILDING', 'MACHINERY'))"
)
VECTORS = (
    "vectors AS (SELECT vec_id AS cell_id, CAST(embedding AS DOUBLE[]) AS vec, CAST(label AS VARCHAR) AS label, "
    "CAST(vec_id % 3 AS VARCHAR) AS batch FROM embeddings)"
)
PLACES = (
    "places AS (SELECT vec_id AS cell_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, "
    "CAST(label % 2 AS VARCHAR) AS section, CAST(label AS VARCHAR) AS cell_type FROM embeddings)"
)
PLACE_COUNTS = (
    "pcounts AS (SELECT * FROM (SELECT vec_id AS cell_id, CAST(i - 1 AS BIGINT) AS gene_id, "
    "CAST(floor(CAST(embedding[i] AS DOUBLE) * 100) AS BIGINT) AS value "
    "FROM (SELECT vec_id, embedding, unnest(generate_series(1, len(embedding))) AS i FROM embeddings) WHERE embedding[i] > 0) WHERE value > 0)"
)


def with_ctes(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"
