"""Exact duplicates through a persistent digest index, bucketed and sorted by digest."""

from __future__ import annotations

import uuid
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from countloom.llm.common import columns_of, new_path, scratch, stash


HOT_SHARE = 2000
BROADCAST_ROWS = 500_000  # of an id and 32 letters each


def normal_text(text: str | Column = "text") -> Column:
    """The text with A-Z in lower case and nothing else changed; null is empty."""
    text = F.col(text) if isinstance(text, str) else text
    return F.translate(F.coalesce(text, F.lit("")), ascii_uppercase, ascii_lowercase)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_sha256) of every row; SHA-256 of the normal text, as lower-case hex."""
    d = columns_of(docs, id_col, text_col)
    return d.select(F.col(id_col).alias("doc_id"), F.sha2(normal_text(text_col).cast("binary"), 256).alias("text_sha256"))


class DigestIndex:
    """A table with one row per digest seen: (text_sha256, keep_id, group_size, batch).

    It is bucketed and sorted by digest, so that the anti-join of a new batch moves only the batch: the index side is
    read in place and already sorted. Appends never rewrite earlier files; a copy that comes later is not appended. A
    failed append leaves no rows, as the file committer publishes them at its end.
    """

    def __init__(self, spark: SparkSession, name: str, buckets: int, path: str | None = None):
        self.spark, self.name = spark, name
        if not spark.catalog.tableExists(name):
            place = f" LOCATION '{path}'" if path else ""
            spark.sql(
                f"CREATE TABLE {name} (text_sha256 STRING, keep_id BIGINT, group_size BIGINT, batch STRING) USING parquet "
                f"CLUSTERED BY (text_sha256) SORTED BY (text_sha256) INTO {buckets} BUCKETS{place}"
            )

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, batch_digests: DataFrame, batch: str) -> None:
        """Add the batch's digests that the index lacks; in a batch the largest id of a digest stays.

        Copies are counted before the shuffle, so a text that fills a third of the batch is one row per task. A batch
        whose rows are there already is left as it is, so a rerun changes nothing.
        """
        if not self.rows().where(F.col("batch") == batch).isEmpty():
            return
        found = batch_digests.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        found = stash(found, "digest-groups")  # else Spark moves the anti-join below the grouping and shuffles every copy
        new = found.join(self.rows().select("text_sha256").hint("merge"), "text_sha256", "left_anti")
        new.withColumn("batch", F.lit(batch)).write.insertInto(self.name)


def exact_duplicates(docs: DataFrame, index: DigestIndex | None = None, batch: str = "first", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical after lower-casing A-Z; null equals the empty text. Of the equal rows of a
    batch the largest doc_id stays, unless an earlier batch holds the text: then none stays, keep_id is the earlier row
    and group_size counts the earlier batch's rows. A null id counts as the smallest; rows that share text and id are
    all marked alike. Further columns of the input are ignored; no row is dropped; an empty input gives no row.

    Without ``index`` a new one is made in the shared folder, with as many buckets as shuffle partitions.
    """
    spark = docs.sparkSession
    if index is None:
        buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        index = DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}", buckets, new_path(spark, "digest-index"))
    each = stash(digests(docs, id_col, text_col), "digests")
    index.append(each, batch)
    known = index.rows()
    # A digest with over 1/HOT_SHARE of the rows would meet its index row in one task. There are fewer than HOT_SHARE
    # such digests at any size of the input, so they are broadcast; the others meet in the index's buckets.
    hot = F.broadcast(known.where(F.col("group_size") * HOT_SHARE > each.count()).select("text_sha256", "keep_id", "group_size", "batch"))
    rest = each.join(hot.select("text_sha256"), "text_sha256", "left_anti").join(known.hint("merge"), "text_sha256")
    both = each.join(hot, "text_sha256").unionByName(rest)
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("batch") == batch)
    return both.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``exact_duplicates`` keeps, one per text, with all their columns.

    A row that is there several times with the same id and text stays once. Only the rows that go are named, by id and
    half of their digest. Up to BROADCAST_ROWS of them are sent to the tasks, so the texts stay where they are; beyond
    that Spark shuffles both.
    """
    spark = docs.sparkSession
    with scratch(spark) as keep:
        marked = exact_duplicates(docs)
        named = marked.groupBy(F.col("doc_id").alias("_id"), F.substring("text_sha256", 1, 32).alias("_sha"), "kept").agg(F.count(F.lit(1)).alias("_rows"))
        named = keep(stash(named.where("NOT kept OR _rows > 1"), "dropped-digests"))
    small = named.count() <= BROADCAST_ROWS
    sha = F.substring(F.sha2(normal_text(docs["text"]).cast("binary"), 256), 1, 32)
    same = docs["doc_id"].eqNullSafe(F.col("_id")) & (sha == F.col("_sha"))
    side = lambda rows: F.broadcast(rows) if small else rows
    out = docs.join(side(named), same, "left_anti")
    again = named.where("kept")
    return out if again.isEmpty() else out.unionByName(docs.join(side(again), same, "left_semi").dropDuplicates(["doc_id", "text"]))
