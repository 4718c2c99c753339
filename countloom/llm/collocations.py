"""Phrases whose words belong together, counted over a weighted de Bruijn graph of four-word runs."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countloom.llm.common import columns_of, stash, text_slices

LONGEST = 4
GAPS = b".,;:!?\n\x0b\x0c\r"
#: One table for all bytes: A-Z in lower case, what ends a piece to a line feed, a tab to a space.
_BYTES = bytes.maketrans((ascii_uppercase.encode() + GAPS + b"\t"), (ascii_lowercase.encode() + b"\n" * len(GAPS) + b" "))
FILTER_BITS = 1 << 26
_HELD = 400_000  # distinct keys that a task counts before it hands them on


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    for part in text_slices(batches):
        yield from zip(part.column("lang").to_pylist(), (t.translate(_BYTES) for t in part.column("text").cast(pa.binary()).to_pylist()))


def _batch(lang: list[str], key: list[bytes], n: list[int]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(lang, pa.string()), pa.array(key, pa.binary()).cast(pa.string()), pa.array(n, pa.int64())], names=["lang", "phrase", "n"])


def _handed_on(counts: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
    for lang, found in counts.items():
        keys, n = list(found), list(found.values())
        for k in range(0, len(keys), 50_000):
            yield _batch([lang] * len(keys[k : k + 50_000]), keys[k : k + 50_000], n[k : k + 50_000])
    counts.clear()


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, Counter] = {}
    for lang, text in _texts(batches):
        counts.setdefault(lang, Counter()).update(text.split())
        if len(counts[lang]) > _HELD:
            yield from _handed_on(counts)
    yield from _handed_on(counts)


def _slots(lang: str, word: bytes) -> tuple[int, int]:
    h = int.from_bytes(hashlib.blake2b(lang.encode() + b"\n" + word, digest_size=16).digest(), "little")
    return h % FILTER_BITS, (h >> 64) % FILTER_BITS


def _filter_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        slots = np.array([s for lang, word in zip(batch.column("lang").to_pylist(), batch.column("phrase").to_pylist()) for s in _slots(lang, word.encode())], np.int64)
        bits = np.left_shift(np.uint64(1), (slots & 63).astype(np.uint64)).view(np.int64)
        yield pa.record_batch([pa.array(slots >> 6), pa.array(bits)], names=["cell", "bits"])


def _filter_of(words: DataFrame) -> bytes:
    """A Bloom filter of the given words, of a fixed size: it may let further words pass, but none of these is lost."""
    found = words.mapInArrow(_filter_bits, "cell long, bits long").groupBy("cell").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[found.column("cell").to_numpy()] = found.column("bits").to_numpy()
    return out.tobytes()


def _graph_counts(bits):
    """Edges (four words) and piece ends (the last three and the last two words) of runs of words that pass the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, join = bits.value, b" ".join
        known: dict[str, dict[bytes, bool]] = {}
        counts: dict[str, Counter] = {}
        for lang, text in _texts(batches):
            seen, count = known.setdefault(lang, {b"\n": False}), counts.setdefault(lang, Counter())
            if len(seen) > _HELD:
                seen.clear()
                seen[b"\n"] = False
            now: list[bytes] = []
            for word in text.replace(b"\n", b" \n ").split(b" "):
                if not word:
                    continue
                passes = seen.get(word)
                if passes is None:
                    a, b = _slots(lang, word)
                    passes = seen[word] = bool(held[a >> 3] >> (a & 7) & 1 and held[b >> 3] >> (b & 7) & 1)
                if passes:
                    now.append(word)
                elif now:
                    _count_run(now, count, join)
                    now = []
            if now:
                _count_run(now, count, join)
            if len(count) > _HELD:
                yield from _handed_on(counts)
        yield from _handed_on(counts)

    return run


def _count_run(words: list[bytes], count: Counter, join) -> None:
    if len(words) >= 2:
        count[join(words[-2:])] += 1
        if len(words) >= 3:
            count[join(words[-3:])] += 1
            if len(words) >= 4:
                count.update(map(join, zip(words, words[1:], words[2:], words[3:])))


def _flows(least: int):
    """Counts of four, three and two words in one pass over rows sorted by two words, three words, whole phrase.

    What flows through a node is what leaves it by its edges and what ends in it. Sums at the borders of batches are
    carried on, so memory holds one batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[int, tuple] = {}  # level: (lang, phrase, sum)
        for batch in batches:
            if not batch.num_rows:
                continue
            lang, n = batch.column("lang"), batch.column("n").to_numpy()
            out: list[tuple[str, str, int, int]] = []
            for level, name in ((2, "two"), (3, "three"), (4, "phrase")):
                column = batch.column(name)
                new = np.ones(batch.num_rows, bool)
                new[1:] = pc.or_(pc.not_equal(column[1:], column[:-1]), pc.not_equal(lang[1:], lang[:-1])).to_numpy(zero_copy_only=False)
                starts = np.flatnonzero(new)
                sums = np.add.reduceat(n, starts)
                before = open_.get(level)
                if before is not None:
                    if before[:2] == (lang[0].as_py(), column[0].as_py()):
                        sums[0] += before[2]
                    else:
                        out.append((*before[:2], level, before[2]))
                open_[level] = (lang[int(starts[-1])].as_py(), column[int(starts[-1])].as_py(), int(sums[-1]))
                strong = np.flatnonzero(sums[:-1] >= least)
                at = pa.array(starts[strong])
                out += zip(lang.take(at).to_pylist(), column.take(at).to_pylist(), [level] * len(strong), sums[strong].tolist())
            yield from _strong(out, least)
        yield from _strong([(*rest[:2], level, rest[2]) for level, rest in open_.items()], least)

    return run


def _strong(rows: list[tuple[str, str, int, int]], least: int) -> Iterator[pa.RecordBatch]:
    rows = [r for r in rows if r[3] >= least and r[1].count(" ") + 1 == r[2]]  # shorter phrases at a level are its piece ends
    if rows:
        lang, phrase, words, n = zip(*rows)
        yield pa.record_batch([pa.array(lang, pa.string()), pa.array(phrase, pa.string()), pa.array(words, pa.int32()), pa.array(n, pa.int64())], names=["lang", "phrase", "words", "f"])


def _of(docs: DataFrame) -> DataFrame:
    d = columns_of(docs, "text", "lang")
    return d.select(F.coalesce(d["text"].cast("string"), F.lit("")).alias("text"), F.coalesce(d["lang"].cast("string"), F.lit("und")).alias("lang"))


def phrase_counts(docs: DataFrame, least: int = 30) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, words, f) of all phrases of one to four words with f >= least, (lang, n) with n words in all).

    Texts are cut into pieces and words as ``collocations`` says. A word with fewer occurrences is in no such phrase, so
    pieces are cut at it as well; which words these are is told by a filter of a fixed size (8 MB) that is never wrong
    about a frequent word. Then four-word edges and piece ends are counted, within tasks first, and dealt out by their
    first two words: so one sorted pass gives the counts of four, three and two words at once, by the flow through nodes.
    """
    spark = docs.sparkSession
    d = _of(docs)
    words = stash(d.mapInArrow(_word_counts, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n")), "words")
    frequent = words.where(F.col("n") >= least)
    bits = spark.sparkContext.broadcast(_filter_of(frequent))
    rows = d.mapInArrow(_graph_counts(bits), "lang string, phrase string, n long")
    rows = rows.withColumn("bucket", F.hash("lang", F.substring_index("phrase", " ", 2))).repartition("bucket")
    rows = rows.withColumn("two", F.substring_index("phrase", " ", 2)).withColumn("three", F.substring_index("phrase", " ", 3))
    rows = rows.sortWithinPartitions("bucket", "lang", "two", "three", "phrase").select("lang", "two", "three", "phrase", "n")
    longer = rows.mapInArrow(_flows(least), "lang string, phrase string, words int, f long")
    single = frequent.select("lang", "phrase", F.lit(1).alias("words"), F.col("n").alias("f"))
    return stash(single.unionByName(longer), "phrases"), words.groupBy("lang").agg(F.sum("n").alias("n"))


def _head(phrase: str, words: int):
    return F.substring_index(phrase, " ", words)


def _tail(phrase: str, words: int):
    return F.substring_index(phrase, " ", -words)


def compact_paths(phrases: DataFrame) -> DataFrame:
    """(lang, path, edges, weight): the four-word edges of ``phrases``, with unary paths as one row each.

    A node (three words) is inside a path when one edge brings all that flows through it and one takes it all away; no
    piece then begins or ends there, and all edges of the path have its weight. Edges find the first of their path by
    pointer doubling, so a path takes a logarithmic number of joins; a cycle cannot occur, as every piece ends. A path is
    a passage that occurs in full as often as its weight says, so a row is never longer than a text.
    """
    edges = phrases.where(F.col("words") == LONGEST).select("lang", F.col("phrase").alias("edge"), F.col("f").alias("weight"))
    nodes = phrases.where(F.col("words") == LONGEST - 1).select("lang", F.col("phrase").alias("node"), F.col("f").alias("weight"))
    into = edges.select("lang", F.col("edge").alias("before"), _tail("edge", LONGEST - 1).alias("node"), "weight")
    out = edges.select("lang", "edge", _head("edge", LONGEST - 1).alias("node"), "weight")
    inside = nodes.join(into, ["lang", "node", "weight"]).join(out, ["lang", "node", "weight"])
    at = edges.join(inside.select("lang", "edge", "before"), ["lang", "edge"], "left")
    at = stash(at.select("lang", "edge", "weight", F.coalesce("before", "edge").alias("first"), F.when(F.col("before").isNull(), 0).otherwise(1).alias("place")), "path-edges")
    while True:
        jump = at.select("lang", F.col("edge").alias("first"), F.col("first").alias("_first"), F.col("place").alias("_place"))
        moved = stash(at.join(jump, ["lang", "first"]).select("lang", "edge", "weight", F.col("_first").alias("first"), (F.col("place") + F.col("_place")).alias("place")), "path-edges")
        done = moved.agg(F.sum("place")).head()[0] == at.agg(F.sum("place")).head()[0]
        at = moved
        if done:
            break
    whole = at.groupBy("lang", "first").agg(F.sort_array(F.collect_list(F.struct("place", F.substring_index("edge", " ", -1).alias("word")))).alias("all"), F.max("weight").alias("weight"))
    path = F.concat_ws(" ", F.substring_index("first", " ", LONGEST - 1), F.transform("all", lambda x: x["word"]))
    return whole.select("lang", path.alias("path"), F.size("all").alias("edges"), "weight")


def collocations(docs: DataFrame, least: int = 30, share: int = 80, top: int = 2000) -> DataFrame:
    """The first ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    A-Z are lower-cased; a null text is empty, a null language ``und``. Pieces end at ``.,;:!?``, line feed to carriage
    return; words at space and tab. Candidates are phrases of 2 to 4 words that occur a >= least times inside pieces, by
    language, overlaps included. Cut after its first k words, a candidate has l = f(first part), r = f(rest) and
    floor(2000000 a / (l + r)); the cut of the lowest score counts, of equal ones the shortest first part. A candidate
    inside a longer one of which 100 f >= share a is dropped. Order: score and a descending, phrase ascending by bytes.
    An empty table gives no row; repeated rows count as often as they occur; further columns are ignored.

    What is held against a candidate is the most frequent phrase with one word more: a still longer one is never more
    frequent. Nodes inside a compacted path need no such search: their path holds every occurrence.
    """
    phrases, total = phrase_counts(docs, least)
    counts = phrases.select("lang", "phrase", "f")
    paths = compact_paths(phrases).where("edges > 1").select("lang", F.split("path", " ").alias("w"), "edges")
    inside = paths.select("lang", F.explode(F.expr(f"transform(sequence(2, edges), i -> array_join(slice(w, i, {LONGEST - 1}), ' '))")).alias("phrase"))
    longer = phrases.where("words > 2").select("lang", "f", F.explode(F.array(F.expr("substring_index(phrase, ' ', words - 1)"), F.expr("substring_index(phrase, ' ', 1 - words)"))).alias("phrase"))
    above = longer.groupBy("lang", "phrase").agg(F.max("f").alias("above"))
    open_ = phrases.where("words > 1").join(inside, ["lang", "phrase"], "left_anti").join(above, ["lang", "phrase"], "left")
    open_ = open_.where(F.coalesce(F.col("above") * 100 < F.col("f") * share, F.lit(True))).select("lang", "phrase", "words", F.col("f").alias("a"))
    cuts = open_.select("lang", "phrase", "words", "a", F.explode(F.expr("sequence(1, words - 1)")).alias("k"))
    cuts = cuts.withColumn("left", F.expr("substring_index(phrase, ' ', k)")).withColumn("right", F.expr("substring_index(phrase, ' ', k - words)"))
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"]).join(counts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    cuts = cuts.withColumn("score", F.expr("CAST(a AS DECIMAL(28, 0)) * 2000000 DIV (CAST(l AS DECIMAL(28, 0)) + r)"))
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    best = best.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score").join(F.broadcast(total) if total.count() <= 10_000 else total, "lang")
    rank = F.expr("row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)")
    return best.withColumn("rank", rank).where(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
