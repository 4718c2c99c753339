"""Benchmark decontamination by SimHash fingerprints of item-sized windows, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from countloom.llm.common import columns_of, stash

WORDS, LEAST = 5, 0.8
#: 63 fingerprint bits in 21 blocks: fingerprints that differ in at most RADIUS = 20 bits agree in one block at least.
#: Sets of similarity 0.8 differ in 9.5 bits on average with a deviation of 2.8, so a radius of 20 is 3.7 deviations off.
BLOCKS, BLOCK_BITS = 21, 3
RADIUS = BLOCKS - 1
LANE = 20  # bits of a counter; items may have up to a million words
BROADCAST_ROWS = 500_000


def words_of(text: Column) -> Column:
    """The runs of letters and digits of the lower-case text."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _starts(words: Column, size: int = WORDS) -> Column:
    """One struct per word: it and the words after it; the fields past the end are null."""
    return F.arrays_zip(*[F.slice(words, F.lit(k), F.greatest(F.size(words), F.lit(1))).alias(f"w{k}") for k in range(1, size + 1)])


def _shingle(part: Column) -> Column:
    return F.xxhash64(*[part[f"w{k}"] for k in range(1, WORDS + 1)])


def _shingle_rows(rows: DataFrame, *keep: str) -> DataFrame:
    """(keep, pos, h): every run of five words of ``words``; fewer words are one shingle, none give no row.

    xxhash64 passes over nulls, so the first run of a shorter text is the hash of all its words.
    """
    found = rows.select(*keep, F.size("words").alias("_n"), F.posexplode(_starts(F.col("words"))).alias("pos", "_run"))
    return found.where(F.col("pos") < F.greatest(F.col("_n") - (WORDS - 1), F.lit(1))).select(*keep, "pos", _shingle(F.col("_run")).alias("h"))


def _shingle_array(words: Column) -> Column:
    runs = F.transform(_starts(words), _shingle)
    return F.slice(runs, 1, F.when(F.size(words) == 0, 0).otherwise(F.greatest(F.size(words) - (WORDS - 1), F.lit(1))))


def _bit_sums() -> list[Column]:
    """Counts of set bits over the rows of a group: three counters in each of 21 sums."""
    out = []
    for block in range(BLOCKS):
        lanes = [f"shiftleft(shiftright(h, {block * BLOCK_BITS + k}) & 1L, {LANE * k})" for k in range(BLOCK_BITS)]
        out.append(F.sum(F.expr(" + ".join(lanes))).alias(f"s{block}"))
    return out


def _fingerprint() -> Column:
    """Majority of each bit: set where over half of the shingles, each as often as it occurs, have it set."""
    bits = []
    for block in range(BLOCKS):
        for k in range(BLOCK_BITS):
            count = f"(shiftright(s{block}, {LANE * k}) & {(1 << LANE) - 1}L)"
            bits.append(f"CASE WHEN {count} * 2 > n THEN {1 << (block * BLOCK_BITS + k)}L ELSE 0L END")
    return F.expr(" + ".join(bits))


def fingerprints(shingles: DataFrame, *keys: str) -> DataFrame:
    """(keys, n, fp): the SimHash of each group's shingles ``h``."""
    return shingles.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *_bit_sums()).select(*keys, "n", _fingerprint().alias("fp"))


def _block_rows(prints: DataFrame, *keep: str) -> DataFrame:
    return prints.select(*keep, F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))).alias("block")).withColumn(
        "value", F.expr(f"shiftright(fp, block * {BLOCK_BITS}) & {(1 << BLOCK_BITS) - 1}L")
    )


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """One row per document and benchmark item it holds: doc_id, item_id, word_from, n_words, similarity, distance.

    A document holds an item when a window of the item's length has a weighted Jaccard similarity of 0.8 or more with
    it, over five-word shingles weighted by their counts; a window may end with the document. The most similar window
    is given, of equal ones the first, with the distance of the fingerprints.

    1. Each whole text is cut into shingles; those of any item are anchors. The items' shingles are broadcast if they
       are few, else joined by hash. Where any window reaches 0.8, so does one that starts at an anchor of that item:
       moving the start past words without an anchor loses no common shingle and may gain some. So windows start at
       anchors, and documents without one, nearly all, go no further.
    2. Each window gets a SimHash: bit sums are packed three to a long and summed by group.
    3. Windows meet items of their length in any of 21 blocks of fingerprint bits. That finds every item whose
       fingerprint is within 20 bits; the distance is then checked.
    4. The candidates' similarity is computed exactly.

    Rows that share an id are searched one by one and reported together; a null id is reported as null. Null and empty
    texts hold nothing, and items without words are in no text. Further columns are ignored. Long texts are only rows
    of shingles here, except that the few texts with an anchor are kept as one array of hashes each.
    """
    d = columns_of(docs, id_col, text_col).select(
        F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("key"), words_of(F.col(text_col)).alias("words"),
    )
    items = columns_of(benchmark, item_col, "text").where(F.col(item_col).isNotNull()).select(F.col(item_col).cast("long").alias("item_id"), words_of(F.col("text")).alias("words"))
    items = stash(items.where(F.size("words") > 0).dropDuplicates(["item_id", "words"]).withColumn("variant", F.xxhash64("words")), "decon-items")
    item_rows = stash(_shingle_rows(items, "item_id", "variant"), "decon-item-shingles")
    item_prints = fingerprints(item_rows, "item_id", "variant").withColumnRenamed("n", "m")
    item_prints = stash(item_prints.join(items.select("item_id", "variant", F.size("words").alias("item_words")), ["item_id", "variant"]), "decon-item-prints")
    lengths = item_prints.select("item_id", "variant", "m")
    wanted = stash(item_rows.join(lengths, ["item_id", "variant"]).select("h", "m").distinct(), "decon-wanted")

    n_wanted = wanted.count()
    anchors = stash(_shingle_rows(d, "key").join(_small(wanted, n_wanted), "h").select("key", "pos", "m").distinct(), "decon-anchors")
    held = anchors.select("key").distinct()
    n_held = held.count()
    hashed = d.join(_small(held, n_held), "key", "left_semi").select("key", "doc_id", _shingle_array(F.col("words")).alias("shingles")).dropDuplicates(["key"])
    hashed = stash(hashed, "decon-hashed")
    windows = anchors.join(hashed.select("key", "shingles"), "key")
    inside = windows.select("key", "pos", "m", F.explode(F.slice("shingles", F.col("pos") + 1, F.col("m").cast("int"))).alias("h"))
    prints = stash(fingerprints(inside, "key", "pos", "m"), "decon-prints")

    left = _block_rows(prints, "key", "pos", "m", "n", "fp")
    right = _block_rows(item_prints, "item_id", "variant", "m", "fp", "item_words").withColumnRenamed("fp", "item_fp")
    distance = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp")))
    met = left.join(_small(right, n_wanted * BLOCKS), ["m", "block", "value"]).where(distance <= RADIUS)
    met = stash(met.select("key", "pos", "m", "n", "item_id", "variant", "item_words", distance.alias("distance")).distinct(), "decon-candidates")

    again = met.join(hashed, "key").select("key", "doc_id", "pos", "m", "n", "item_id", "variant", "item_words", "distance", F.explode(F.slice("shingles", F.col("pos") + 1, F.col("m").cast("int"))).alias("h"))
    spot = ["key", "doc_id", "pos", "m", "n", "item_id", "variant", "item_words", "distance"]
    seen = again.groupBy(*spot, "h").agg(F.count(F.lit(1)).alias("times"))
    there = item_rows.groupBy("item_id", "variant", "h").agg(F.count(F.lit(1)).alias("item_times"))
    common = seen.join(there, ["item_id", "variant", "h"]).groupBy(*spot).agg(F.sum(F.least("times", "item_times")).alias("common"))
    similarity = F.col("common") / (F.col("n") + F.col("m") - F.col("common"))
    good = common.withColumn("similarity", similarity).where(F.col("similarity") >= LEAST)
    best = F.max_by(F.struct("pos", "item_words", "similarity", "distance"), F.struct("similarity", -F.col("pos"), -F.col("distance"), "key")).alias("best")
    return good.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", F.col("best.pos").cast("long").alias("word_from"), F.col("best.item_words").cast("long").alias("n_words"), "best.similarity", F.col("best.distance").cast("int").alias("distance"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with all their columns."""
    gone = contaminated(docs, benchmark).select(F.col("doc_id").alias("_gone_id")).distinct()
    return docs.join(gone, docs["doc_id"].eqNullSafe(F.col("_gone_id")), "left_anti")
