"""Near-duplicate documents by ProbMinHash signatures over weighted word shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countloom.llm.common import columns_of, release, scratch, stash, text_slices
from countloom.llm.components import components
from countloom.llm.textarrays import mix, shingle_hashes, word_hashes

WORDS, LEAST = 5, 0.8
BANDS, ROWS = 25, 5
SIZE = BANDS * ROWS  # registers
#: Registers that agree between texts at LEAST or more: 3.5 deviations below the mean, so one link in 4,000 at LEAST
#: itself, and fewer above, is not looked at.
AGREE = int(LEAST * SIZE - 3.5 * (LEAST * (1 - LEAST) * SIZE) ** 0.5)
_GAP = r"[^\p{L}\p{M}\p{N}\x00-\x7f]+"  # of characters beyond ASCII, what is no part of a word
BROADCAST_IDS, BROADCAST_BYTES = 1_000_000, 32 << 20


def weighted_shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, shingle, weight): distinct shingles of each text, sorted; the weight is how often it occurs.

    Words are runs of letters, marks and digits of the lower-case text, in any script. A text of fewer words is one
    shingle. Where a script has no spaces, words are what lies between punctuation.
    """
    lower = pc.utf8_lower(pc.fill_null(texts, "").cast(pa.large_string()))
    words, docs = word_hashes(pc.replace_substring_regex(lower, _GAP, " "), alnum=True)
    shingles, docs = shingle_hashes(words, docs, WORDS)
    if not len(shingles):
        return docs, shingles, np.empty(0, np.int64)
    order = np.lexsort((shingles, docs))
    shingles, docs = shingles[order], docs[order]
    first = np.flatnonzero(np.concatenate(([True], (shingles[1:] != shingles[:-1]) | (docs[1:] != docs[:-1]))))
    return docs[first], shingles[first], np.diff(np.concatenate((first, [len(shingles)])))


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((mix(x) >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53


def prob_minhash(docs: np.ndarray, shingles: np.ndarray, weights: np.ndarray, count: int, size: int = SIZE) -> np.ndarray:
    """Signatures (count x size) of weighted sets: each register holds the element with the earliest arrival in it.

    An element's arrivals are a Poisson process with its weight as the rate, each in a register at random, all drawn
    from the element's hash. So two sets agree in a register with probability equal to their probability Jaccard
    similarity. Processes stop early: a set's registers are all full soon after time size * log(size) / weight, and
    later arrivals change nothing; a set with registers still open has its time doubled. Sets without elements are 0.
    """
    best = np.full(count * size, np.inf)
    owner = np.zeros(count * size, np.uint64)
    total = np.bincount(docs, weights, count)
    limit = np.zeros(count)
    np.divide(size * (np.log(size) + 2.0), total, out=limit, where=total > 0)
    at = -np.log(_uniform(shingles)) / weights  # each element's next arrival
    number = np.zeros(len(shingles), np.uint64)
    live = np.arange(len(shingles))
    while len(live):
        now = live[at[live] <= limit[docs[live]]]
        found_place, found_time, found_element = [], [], []
        while len(now):
            draw = mix(shingles[now] + (number[now] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
            found_place.append(docs[now] * size + (draw % np.uint64(size)).astype(np.int64))
            found_time.append(at[now])
            found_element.append(shingles[now])
            number[now] += np.uint64(1)
            at[now] -= np.log(_uniform(draw + np.uint64(0xA24BAED4963EE407))) / weights[now]
            now = now[at[now] <= limit[docs[now]]]
        if found_place:
            place, time, element = map(np.concatenate, (found_place, found_time, found_element))
            order = np.lexsort((element, time, place))
            place, time, element = place[order], time[order], element[order]
            first = np.concatenate(([True], place[1:] != place[:-1]))
            place, time, element = place[first], time[first], element[first]
            earlier = time < best[place]
            best[place[earlier]], owner[place[earlier]] = time[earlier], element[earlier]
        open_ = np.isinf(best.reshape(count, size)).any(axis=1) & (total > 0)
        live = live[open_[docs[live]]]
        limit = limit * 2.0
    return owner.reshape(count, size)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in text_slices(batches):
        n = part.num_rows
        docs, shingles, weights = weighted_shingles(part.column("text"))
        registers = prob_minhash(docs, shingles, weights, n)
        sums = []
        for salt in (1, 2):  # a 128-bit digest of the weighted set, the same in any order
            terms = mix(shingles + weights.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt))
            total = np.zeros(n + 1, np.uint64)
            if len(docs):
                first = np.flatnonzero(np.concatenate(([True], docs[1:] != docs[:-1])))
                total[docs[first]] = np.add.reduceat(terms, first)
            sums.append(total[:n].view(np.int64))
        bands = np.zeros((n, BANDS), np.uint64)
        for k in range(ROWS):
            bands = mix(bands + registers[:, k::ROWS] + np.uint64(k))
        bands = mix(bands + np.arange(BANDS, dtype=np.uint64))
        short = (mix(registers) & np.uint64(0xFFFF)).astype(np.uint16).view(np.int16)
        words = np.bincount(docs, minlength=n) if len(docs) else np.zeros(n, np.int64)
        yield pa.record_batch(
            [
                part.column("doc_id"), pa.array(words, pa.int64()), pa.array(sums[0]), pa.array(sums[1]),
                pa.FixedSizeListArray.from_arrays(pa.array(bands.view(np.int64).ravel()), BANDS).cast(pa.list_(pa.int64())),
                pa.FixedSizeListArray.from_arrays(pa.array(short.ravel()), SIZE).cast(pa.list_(pa.int16())),
            ],
            names=["doc_id", "n_shingles", "d1", "d2", "bands", "registers"],
        )
    release()


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, d1, d2, bands, registers) of each row; equal (d1, d2) is an equal weighted shingle set."""
    d = columns_of(docs, id_col, text_col)
    d = d.select(d[id_col].cast("long").alias("doc_id"), d[text_col].cast("string").alias("text"))
    return d.mapInArrow(_signatures, "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>, registers array<short>")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in text_slices(batches):
        docs, shingles, weights = weighted_shingles(part.column("text"))
        cuts = np.searchsorted(docs, np.arange(part.num_rows + 1))
        blobs = [(shingles[a:b].tobytes(), weights[a:b].astype(np.int32).tobytes()) for a, b in zip(cuts[:-1], cuts[1:])]
        yield pa.record_batch([part.column("doc_id"), pa.array([x for x, _ in blobs], pa.binary()), pa.array([w for _, w in blobs], pa.binary())], names=["doc_id", "shingles", "weights"])
    release()


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each shingle as often as it occurs, numbered, as 32-bit hashes: common marks are the sum of the lesser weights."""
    for part in text_slices(batches):
        docs, shingles, weights = weighted_shingles(part.column("text"))
        owner = np.repeat(docs, weights)
        ends = np.cumsum(weights)
        number = np.arange(len(owner)) - np.repeat(ends - weights, weights)
        marks = (mix(np.repeat(shingles, weights) + number.astype(np.uint64)) >> np.uint64(32)).astype(np.uint32).view(np.int32)
        cuts = np.searchsorted(owner, np.arange(part.num_rows + 1)).astype(np.int32)
        yield pa.record_batch([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(cuts), pa.array(marks))], names=["doc_id", "marks"])
    release()


def weighted_jaccard(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Sum of the lesser over sum of the greater weights; shingles sorted and distinct."""
    if not len(a) or not len(b):
        return 0.0
    place = np.minimum(np.searchsorted(a, b), len(a) - 1)
    same = a[place] == b
    common = float(np.minimum(wa[place[same]], wb[same]).sum())
    return common / (float(wa.sum()) + float(wb.sum()) - common)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = [batch.column(c) for c in ("sa", "wa", "sb", "wb")]
        found = [
            weighted_jaccard(np.frombuffer(sa, np.uint64), np.frombuffer(wa, np.int32), np.frombuffer(sb, np.uint64), np.frombuffer(wb, np.int32))
            for sa, wa, sb, wb in zip(*(p.to_pylist() for p in parts))
        ]
        yield pa.record_batch([batch.column("a"), batch.column("b"), pa.array(found, pa.float64())], names=["a", "b", "similarity"])


def _similar_registers(x: str, y: str):
    same = F.aggregate(F.zip_with(x, y, lambda p, q: F.when(p == q, 1).otherwise(0)), F.lit(0), lambda total, one: total + one)
    return same >= AGREE


def _similar_marks(x: str, y: str):
    """Whether the marks may be as similar as LEAST; a few of 32 bits may clash, so the bound is a little lower."""
    least = LEAST - 0.01  # common >= least * (|x| + |y| - common)
    return F.size(F.array_intersect(x, y)) * (1.0 + least) >= least * (F.size(x) + F.size(y))


def _texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    small = ids.count() <= BROADCAST_IDS  # else Spark shuffles the texts by id
    return docs.join(F.broadcast(ids) if small else ids, "doc_id", "left_semi")


def _verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) with their exact similarity, computed from the whole texts of their documents."""
    pairs = stash(pairs, "near-candidates")
    need = stash(pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct(), "near-needed")
    sets = stash(_texts_of(docs, need).mapInArrow(_sets, "doc_id long, shingles binary, weights binary").dropDuplicates(["doc_id"]), "near-sets")
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"), F.col("weights").alias("wa"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"), F.col("weights").alias("wb"))
    if (sets.agg(F.sum(F.length("shingles") + F.length("weights"))).head()[0] or 0) <= BROADCAST_BYTES:
        left, right = F.broadcast(left), F.broadcast(right)
    return pairs.join(left, "a").join(right, "b").mapInArrow(_verify, "a long, b long, similarity double")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, class_id, class_size, links, kept.

    Documents are linked when the weighted Jaccard similarity of their five-word shingles is 0.8 or more, weights being
    counts; a class is a connected component, named by its least id, which is the document that stays. ``links`` counts
    the verified links of the row's shingle set. Rows that share an id are one document. Texts without a word are in no
    class but their own. A null id is left out, as nothing could refer to it. Further columns are ignored.

    1. Each task turns whole texts into signatures. Documents with an equal weighted shingle set are one node, found by
       a grouped minimum, so copies cost nothing further.
    2. Nodes that share a band meet in its bucket. Each is compared with two of the bucket's members, chosen by hash and
       different in each band, never with all: that joins most of each class.
    3. What is left: pairs in one bucket whose classes still differ. The join returns a pair in its first common bucket
       only, and only if it may reach 0.8: by the triangle inequality over the known distances to the bucket's two
       members of step 2, by registers, and by hashes of the whole weighted sets. So dissimilar members of a large
       bucket make no rows.
    4. Candidates are verified on the shingle sets of the whole texts; components close the classes.
    """
    with scratch(docs.sparkSession) as keep:
        out = keep(_classes(docs, id_col, text_col))
    sizes = out.groupBy("class_id").agg(F.count(F.lit(1)).alias("class_size"))
    return out.join(sizes, "class_id").select("doc_id", "class_id", "class_size", "links", (F.col("doc_id") == F.col("class_id")).alias("kept"))


def _classes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    named = columns_of(docs, id_col, text_col).where(F.col(id_col).isNotNull())
    named = named.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = stash(signatures(named), "near-signatures")
    lean = signed.select("doc_id", "n_shingles", "d1", "d2").groupBy("doc_id").agg(*[F.min(c).alias(c) for c in ("n_shingles", "d1", "d2")])
    lean = stash(lean, "near-digests")
    worded = lean.where("n_shingles > 0")
    nodes = stash(worded.groupBy("d1", "d2").agg(F.min("doc_id").alias("node")), "near-nodes")
    banded = signed.join(nodes.select(F.col("node").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    banded = stash(banded.select(F.col("doc_id").alias("node"), "bands", "registers"), "near-banded")

    entries = banded.select("node", F.explode("bands").alias("band"))
    draw = F.xxhash64("node", "band")
    leaders = entries.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min_by("node", draw).alias("p"), F.max_by("node", draw).alias("q")).where("n > 1")
    leaders = stash(leaders.select("band", "p", "q"), "near-leaders")
    shared = stash(entries.join(leaders, "band"), "near-entries")
    drawn = shared.select("node", F.explode(F.array("p", "q")).alias("other")).where("node != other")
    drawn = drawn.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
    left = banded.select(F.col("node").alias("a"), F.col("registers").alias("ra"))
    right = banded.select(F.col("node").alias("b"), F.col("registers").alias("rb"))
    drawn = drawn.join(left, "a").join(right, "b").where(_similar_registers("ra", "rb")).select("a", "b")
    first = stash(_verified(named, drawn), "near-links")
    links = first.where(F.col("similarity") >= LEAST)

    comps = stash(components(links), "near-components")
    placed = shared.join(comps.select("node", "component"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = placed.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi").select("band")
    open_ = placed.join(mixed, "band")
    for leader in ("p", "q"):  # each member's known distance to the bucket's two leaders; null where it was not computed
        known = first.select(F.col("a").alias("_a"), F.col("b").alias("_b"), (1.0 - F.col("similarity")).alias("_d"))
        same = (F.least("node", leader) == F.col("_a")) & (F.greatest("node", leader) == F.col("_b"))
        open_ = open_.join(known, same, "left").withColumn(f"d{leader}", F.when(F.col("node") == F.col(leader), 0.0).otherwise(F.col("_d"))).drop("_a", "_b", "_d")
    open_ = stash(open_.select("node", "band", "component", "dp", "dq").join(banded, "node"), "near-open")
    members = stash(open_.select(F.col("node").alias("doc_id")).distinct(), "near-members")
    marked = _texts_of(named, members).mapInArrow(_marks, "doc_id long, marks array<int>").dropDuplicates(["doc_id"]).withColumnRenamed("doc_id", "node")
    open_ = open_.join(marked, "node").withColumn("earlier", F.slice("bands", F.lit(1), F.array_position("bands", F.col("band")).cast("int") - 1))
    open_ = stash(open_.drop("bands"), "near-marked")
    x, y = open_.alias("x"), open_.alias("y")
    apart = (F.col("x.band") == F.col("y.band")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.component") != F.col("y.component"))
    for leader in ("dp", "dq"):  # Jaccard distance is a metric
        apart &= F.coalesce(F.abs(F.col(f"x.{leader}") - F.col(f"y.{leader}")) <= 1.0 - LEAST + 1e-9, F.lit(True))
    apart &= ~F.exists(F.zip_with("x.earlier", "y.earlier", lambda p, q: p.eqNullSafe(q)), lambda same: same)  # the first common band only
    rest = x.join(y, apart & _similar_registers("x.registers", "y.registers") & _similar_marks("x.marks", "y.marks")).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    second = stash(_verified(named, rest.join(first.select("a", "b"), ["a", "b"], "left_anti")), "near-links")
    links = links.unionByName(second.where(F.col("similarity") >= LEAST))
    comps = stash(components(links), "near-components")

    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("links"))
    classes = nodes.join(comps, "node", "left").join(degree, "node", "left").select("d1", "d2", F.coalesce("component", "node").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))
    joined = lean.where("n_shingles > 0").join(classes, ["d1", "d2"]).select("doc_id", "class_id", "links")
    alone = lean.where("n_shingles = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("links"))
    return stash(joined.unionByName(alone), "near-classes")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``near_duplicates`` keeps, with all their columns; rows with a null id stay."""
    gone = near_duplicates(docs).where("NOT kept").select(F.col("doc_id").alias("_gone_id"))
    return docs.join(gone, docs["doc_id"] == F.col("_gone_id"), "left_anti")
