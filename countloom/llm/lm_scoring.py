"""Language-model scores from Elias-Fano n-gram tries, one per shard of contexts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from countloom.llm.common import arrow_rows, columns_of, stash, text_slices
from countloom.llm.elias_fano import ContextTrie
from countloom.llm.textarrays import mix, word_hashes

BEGIN, END = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
CONTEXT_BITS, WORD_BITS, SPREAD_BITS = 22, 26, 12
_EXACT, _STEPS = 64, 16  # counts below _EXACT are exact codes; above, _STEPS codes for each doubling
_BLOCK_BYTES = 8 << 20


def encode_counts(counts: np.ndarray) -> np.ndarray:
    """Counts as two-byte codes: exact below 64, then quantised on a log scale, within 2.2 per cent."""
    large = _EXACT + np.rint(np.log2(np.maximum(counts, _EXACT) / _EXACT) * _STEPS)
    return np.where(counts < _EXACT, counts, np.minimum(large, 65535)).astype(np.uint16)


def decode_counts(codes: np.ndarray) -> np.ndarray:
    codes = codes.astype(np.float64)
    return np.where(codes < _EXACT, codes, _EXACT * 2.0 ** ((codes - _EXACT) / _STEPS))


def _planes(values: np.ndarray) -> bytes:
    """The bytes of an array by place, so that equal high bytes stand together and compress well."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def _unplanes(blob: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(size, -1).T).view(dtype).ravel()


class Grams:
    """The distinct n-grams of one order in one block, by shard and key, with the place of each token's n-gram.

    A key is 22 bits of the context and 26 of the word, which tell a shard's n-grams apart: shards are of one size
    (about a million and a half) however large the text, so a wrong match has a chance of some 1 in 10**8. The shard is
    drawn from the context and the word's top 12 bits: a context's successors are dealt over up to 4096 shards, so a
    word that fills a third of the text makes no shard hot. A single word has no context but its own further bits.
    """

    def __init__(self, tokens: np.ndarray, starts: np.ndarray, order: int, shards: int):
        context = np.zeros(len(tokens), np.uint64)
        before = tokens
        for _ in range(order - 1):  # an n-gram does not reach back over its text's begin
            before = np.concatenate(([BEGIN], before[:-1]))
            before[starts] = BEGIN
            context = mix(context * np.uint64(3) + before)
        if order == 1:
            context = mix(tokens)
        word = tokens >> np.uint64(64 - SPREAD_BITS - WORD_BITS) & np.uint64((1 << WORD_BITS) - 1)
        spread = tokens >> np.uint64(64 - SPREAD_BITS)
        shard = (mix(context + spread * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) % np.uint64(shards)
        key = context >> np.uint64(64 - CONTEXT_BITS) << np.uint64(WORD_BITS) | word
        order_ = np.argsort(key)
        if shards > 1:
            small = shard.astype(np.uint16) if shards <= 65536 else shard
            order_ = order_[np.argsort(small[order_], kind="stable")]
        key, shard = key[order_], shard[order_]
        new = np.concatenate(([True], (key[1:] != key[:-1]) | (shard[1:] != shard[:-1]))) if len(key) else np.zeros(0, bool)
        self.first = np.flatnonzero(new)
        self.sorted_by = order_
        self.place = np.empty(len(tokens), np.int64)
        self.place[order_] = np.cumsum(new) - 1
        self.key = key[self.first]
        self.cuts = np.searchsorted(shard[self.first], np.arange(shards + 1, dtype=np.uint64))

    def counts(self, weights: np.ndarray) -> np.ndarray:
        return np.add.reduceat(weights[self.sorted_by], self.first) if len(self.first) else np.zeros(0, np.int64)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole texts as token numbers within a block's own vocabulary; one row per block."""
    for part in text_slices(batches, "text", _BLOCK_BYTES):
        words, docs = word_hashes(part.column("text"))
        n = part.num_rows
        sizes = np.bincount(docs, minlength=n) + 1
        tokens = np.full(len(words) + n, END, np.uint64)
        ends = np.cumsum(sizes) - 1
        inner = np.ones(len(tokens), bool)
        inner[ends] = False
        tokens[inner] = words
        vocabulary, number = np.unique(tokens, return_inverse=True)
        ids = pc.fill_null(part.column("doc_id"), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        nulls = part.column("doc_id").is_null().to_numpy(zero_copy_only=False)
        train = part.column("train").to_numpy(zero_copy_only=False).astype(np.uint8)
        cells = [ids.tobytes(), nulls.tobytes(), train.tobytes(), _planes(sizes.astype(np.uint32)), _planes(vocabulary), _planes(number.astype(np.uint32))]
        totals = [int((sizes * train).sum()), int(train.sum()), len(tokens)]
        yield pa.record_batch(
            [*[pa.array([c], pa.binary()) for c in cells], *[pa.array([t], pa.int64()) for t in totals]],
            names=["ids", "nulls", "train", "sizes", "vocabulary", "numbers", "train_tokens", "train_texts", "tokens"],
        )


def _open_block(row) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    sizes = _unplanes(row["sizes"], np.uint32).astype(np.int64)
    tokens = _unplanes(row["vocabulary"], np.uint64)[_unplanes(row["numbers"], np.uint32)]
    train = np.frombuffer(row["train"], np.uint8).astype(np.int64)
    return tokens, np.cumsum(sizes) - sizes, sizes, train


def _emit(shards: int, order: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for _, row in frame.iterrows():
                tokens, starts, sizes, train = _open_block(row)
                weights = np.repeat(train, sizes)
                for k in range(1, order + 1):
                    grams = Grams(tokens, starts, k, shards)
                    counts = grams.counts(weights).astype(np.uint32)
                    out = []
                    for s in np.flatnonzero(np.diff(grams.cuts)):
                        a, b = grams.cuts[s], grams.cuts[s + 1]
                        key = grams.key[a:b]
                        out.append((row["block"], k, int(s), _planes(np.concatenate((key[:1], np.diff(key)))), _planes(counts[a:b])))
                    if out:
                        yield pd.DataFrame(out, columns=["block", "level", "shard", "keys", "counts"])

    return run


def _answer(rows: pd.DataFrame) -> pd.DataFrame:
    """One shard of one order: add up its training counts, build its trie, and look up every block's n-grams."""
    level, shard = int(rows["level"].iloc[0]), int(rows["shard"].iloc[0])
    rows = rows.sort_values("block", kind="stable")
    keys = [np.cumsum(_unplanes(b, np.uint64), dtype=np.uint64) for b in rows["keys"]]
    cuts = np.concatenate(([0], np.cumsum([len(k) for k in keys])))
    key = np.concatenate(keys)
    count = np.concatenate([_unplanes(b, np.uint32) for b in rows["counts"]]).astype(np.int64)
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    count = np.add.reduceat(count[order], first)
    context, word = key[first] >> np.uint64(WORD_BITS), key[first] & np.uint64((1 << WORD_BITS) - 1)
    known = np.flatnonzero(count)
    values = count[known].astype(np.uint32) if level == 1 else encode_counts(count[known])
    trie = ContextTrie.build(context[known], word[known], values, 1 << CONTEXT_BITS, WORD_BITS)
    found = trie.lookup(context, word)  # every distinct n-gram that some block asks for
    codes = np.empty(len(key), found.dtype)
    codes[order] = np.repeat(found, np.diff(np.concatenate((first, [len(key)]))))
    answers = [_planes(codes[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
    return pd.DataFrame({"block": rows["block"].to_numpy(), "level": level, "shard": shard, "codes": answers, "known": len(known) if level == 1 else 0})


def _score(order: int, shards: int, total: int, texts: int, distinct: int, strength: float):
    def run(blocks: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, row in blocks.iterrows():
            tokens, starts, sizes, _ = _open_block(row)
            probability = shorter = None
            for k in range(1, order + 1):
                grams = Grams(tokens, starts, k, shards)
                own = answers[answers["level"] == k].sort_values("shard")
                codes = [_unplanes(b, np.uint32 if k == 1 else np.uint16) for b in own["codes"]]
                codes = (np.concatenate(codes) if codes else np.zeros(0, np.uint32))[grams.place]
                if k == 1:
                    count = codes.astype(np.float64)
                    known = np.add.reduceat((codes > 0).astype(np.int64), starts)
                    probability = (count + 1.0) / (total + distinct + 1.0)
                    base = np.add.reduceat(np.log10(probability), starts)
                else:
                    count = decode_counts(codes)
                    # the context occurs as often as the (k-1)-gram that ends one token before
                    above = np.concatenate(([0.0], shorter[:-1]))
                    above[starts] = texts
                    probability = (count + strength * probability) / (np.maximum(above, count) + strength)
                shorter = count
            score = np.add.reduceat(np.log10(probability), starts)
            ids = pd.array(np.frombuffer(row["ids"], np.int64), dtype="Int64")
            ids[np.frombuffer(row["nulls"], bool)] = pd.NA
            out.append(pd.DataFrame({"doc_id": ids, "n_tokens": sizes, "n_known": known, "train_tokens": total, "base_score": base, "score": score}))
        return pd.concat(out) if out else pd.DataFrame(columns=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def score_texts(docs: DataFrame, train: Column, order: int = 2, strength: float = 256.0, shard_grams: int = 1_500_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_tokens, n_known, train_tokens, base_score, score.

    ``train`` says which rows the model learns from; all rows are scored. Tokens are the runs without ASCII white space
    with A-Z in lower case, then one end; the words of a null or empty text are none, its end is scored. base_score is
    the add-one unigram log10 probability; score that of the n-gram model, which mixes each order's count with the lower
    order's probability: (c(hw) + strength * p(w | h')) / (c(h) + strength). It sums to one over the words and the
    unknown word but for the quantised counts. Words and n-grams are known by hashes, see ``Grams``.

    1. Texts become blocks of token numbers, one row each, in a stored table.
    2. Each block sends its distinct n-grams with their training counts to their shards, as sorted arrays. A shard is
       drawn by hash of the context and part of the word, so that none is hot; there are more shards as the text grows.
    3. A shard adds up its counts, builds its trie (Elias-Fano levels in one memory map: contexts, pointers, successors
       relative to their context, quantised counts) and answers each block's n-grams by successor search.
    4. Answers go back to their blocks, which put them together to scores. No task and no driver holds a whole model.

    Ids may be null or repeat; further columns are ignored; an empty input gives no row.
    """
    d = docs.withColumn("_train", F.coalesce(train, F.lit(False)))
    d = columns_of(d, id_col, text_col, "_train").select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col("_train").alias("train"))
    schema = "ids binary, nulls binary, train binary, sizes binary, vocabulary binary, numbers binary, train_tokens long, train_texts long, tokens long"
    made = d.mapInArrow(_blocks, schema).withColumn("block", F.monotonically_increasing_id())
    blocks = stash(made, "lm-blocks")
    sums = [F.coalesce(F.sum(c), F.lit(0)) for c in ("train_tokens", "train_texts", "tokens")]
    total, texts, tokens = blocks.agg(*sums).head()
    shards = max(1, -(-tokens // shard_grams))
    blocks = blocks.select("block", "ids", "nulls", "train", "sizes", "vocabulary", "numbers")
    with arrow_rows(docs.sparkSession, 4):
        sent = blocks.mapInPandas(_emit(shards, order), "block long, level int, shard long, keys binary, counts binary")
        answers = sent.groupBy("level", "shard").applyInPandas(_answer, "block long, level int, shard long, codes binary, known long")
        answers = stash(answers, "lm-answers")
    each = answers.where("level = 1").groupBy("shard").agg(F.max("known").alias("n"))
    distinct = each.agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0]
    put_together = _score(order, shards, total, texts, distinct, strength)
    return blocks.groupBy("block").cogroup(answers.select("block", "level", "shard", "codes").groupBy("block")).applyInPandas(
        put_together, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
