"""Language identification by unigram piece models, summed over all segmentations of each word."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countloom.llm.common import columns_of, release, stash, text_slices
from countloom.llm.textarrays import mix

_WORD = regex.compile(r"[\p{L}\p{M}]+")
_KNOWN = 1_500_000  # numbers remembered per worker, one per word and language and one more; it starts anew beyond that
_MOST_LANGS = 1_000
_FLOOR = 1e-9  # probability of a letter that no piece covers
_SHORT, _RESCALE = 24, 16  # words of up to _SHORT letters need no scaling
_STEP = np.uint64(0x9E3779B97F4A7C15)


def letter_words(text: str) -> list[str]:
    """Runs of letters of the lower-case text, in composed form."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
    return _WORD.findall(text.lower())


def vocabulary_pieces(path: str) -> list[str]:
    """The distinct lower-case letter pieces of a public sentencepiece file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {model.id_to_piece(i).replace("▁", "").lower() for i in range(model.vocab_size())}
    return sorted(p for p in found if p and regex.fullmatch(r"[\p{L}\p{M}]+", p))


class PieceTable:
    """Pieces by the hash of their letters, for whole arrays of words at once."""

    def __init__(self, pieces: list[str]):
        codes = [np.frombuffer(p.encode("utf-32-le"), np.uint32) for p in pieces]
        self.longest = max((len(c) for c in codes), default=1)
        hashes = np.zeros(len(codes), np.uint64)
        for n in sorted({len(c) for c in codes}):
            rows = [i for i, c in enumerate(codes) if len(c) == n]
            letters, h = np.array([codes[i] for i in rows], np.uint64).reshape(len(rows), n), np.zeros(len(rows), np.uint64)
            for k in range(n):
                h = mix(h * _STEP + letters[:, k] + np.uint64(1))
            hashes[rows] = h
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        bits = 20
        self.shift = np.uint64(64 - bits)
        self.starts = np.searchsorted(self.hashes >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)
        self.deep = int(np.diff(self.starts).max(initial=0))

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Index of the piece with each hash, or -1."""
        out = np.full(len(hashes), -1, np.int32)
        bucket = (hashes >> self.shift).astype(np.int64)
        at, stop = self.starts[bucket], self.starts[bucket + 1]
        for _ in range(self.deep):
            open_ = at < stop
            hit = open_ & (self.hashes[np.minimum(at, len(self.hashes) - 1)] == hashes)
            out[hit] = self.order[at[hit]]
            at = at + 1
        return out

    def edges(self, words: list[str]):
        """For words of one length: a list over (start, length) of (start, length, word rows, piece indices)."""
        n = len(words[0])
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), n).astype(np.uint64) + np.uint64(1)
        for start in range(n):
            h = np.zeros(len(words), np.uint64)
            for length in range(1, min(self.longest, n - start) + 1):
                h = mix(h * _STEP + codes[:, start + length - 1])
                piece = self.find(h)
                rows = np.flatnonzero(piece >= 0)
                if len(rows) or length == 1:
                    yield start, length, rows, piece[rows]


def _forward(table: PieceTable, words: list[str], probs: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, list]:
    """Scaled forward sums at each position of words of one length: (alphas, log scale, edges, divisors by position).

    The sums at a position and after it are divided by the divisor of that position.
    """
    n, langs = len(words[0]), probs.shape[1]
    alpha = [np.zeros((len(words), langs)) for _ in range(n + 1)]
    alpha[0][:] = 1.0
    scale = np.zeros((len(words), langs))
    kept, divisors = [], {}
    for start, length, rows, piece in table.edges(words):
        if length == 1 and n > _SHORT and start and start % _RESCALE == 0:  # all sums into ``start`` are done
            top = alpha[start].copy()
            for k in range(start, min(n, start + table.longest) + 1):
                alpha[k] /= top
            scale += np.log(top)
            divisors[start] = top
        if length == 1:
            covered = np.zeros(len(words), bool)
            covered[rows] = True
            bare = np.flatnonzero(~covered)
            alpha[start + 1][bare] += alpha[start][bare] * _FLOOR
        alpha[start + length][rows] += alpha[start][rows] * probs[piece]
        kept.append((start, length, rows, piece))
    return alpha, scale, kept, divisors


def _by_length(words: list[str], langs: int, most: int = 1 << 20):
    """Indices of the words in groups of one length; at most ``most`` letters times languages a group."""
    lengths = np.array([len(w) for w in words])
    order = np.argsort(lengths, kind="stable")
    cuts = np.flatnonzero(np.diff(lengths[order])) + 1
    for group in np.split(order, cuts):
        if len(group):
            step = max(1, most // (int(lengths[group[0]]) * langs))
            for k in range(0, len(group), step):
                yield group[k : k + step]


def word_log_probs(table: PieceTable, words: list[str], probs: np.ndarray) -> np.ndarray:
    """Natural log of each word's probability under each language: all segmentations are summed."""
    out = np.zeros((len(words), probs.shape[1]))
    for group in _by_length(words, probs.shape[1]):
        alpha, scale, _, _ = _forward(table, [words[i] for i in group], probs)
        out[group] = np.log(np.maximum(alpha[-1], 1e-300)) + scale
    return out


def expected_pieces(table: PieceTable, words: list[str], weights: np.ndarray, probs: np.ndarray) -> np.ndarray:
    """Expected piece counts of the words (weights: words x languages) by the forward-backward sums, words of any length.

    Backward sums are kept times the divisors that the forward sums have had before, over the word's probability, so
    that their product at a position is the chance of a cut there.
    """
    total = np.zeros((len(table.hashes), weights.shape[1]))
    for group in _by_length(words, weights.shape[1]):
        part = [words[i] for i in group]
        alpha, _, edges, divisors = _forward(table, part, probs)
        beta = [np.zeros_like(a) for a in alpha]
        beta[-1] = 1.0 / np.maximum(alpha[-1], 1e-300)
        crossed = lambda start, stop, rows: [top[rows] for at, top in divisors.items() if start < at <= stop]
        for start, length, rows, piece in reversed(edges):
            here = beta[start + length][rows] * probs[piece]
            for top in crossed(start, start + length, rows):
                here = here / top
            beta[start][rows] += here
            if length == 1:
                bare = np.setdiff1d(np.arange(len(part)), rows, assume_unique=True)
                here = beta[start + 1][bare] * _FLOOR
                for top in crossed(start, start + 1, bare):
                    here = here / top
                beta[start][bare] += here
        for start, length, rows, piece in edges:
            share = alpha[start][rows] * probs[piece] * beta[start + length][rows]
            for top in crossed(start, start + length, rows):
                share = share / top
            share = share * weights[group[rows]]
            for k in range(weights.shape[1]):
                total[:, k] += np.bincount(piece, share[:, k], len(total))
    return total


class Model:
    """Piece probabilities of each language over a fixed vocabulary."""

    def __init__(self, pieces: list[str], langs: list[str], probs: np.ndarray):
        self.pieces, self.langs, self.probs = pieces, langs, probs
        self._table: PieceTable | None = None
        self._rows: dict[str, int] = {}
        self._values = np.zeros((1 << 10, len(langs) + 1))

    def __getstate__(self):
        return self.pieces, self.langs, self.probs

    def __setstate__(self, state):
        self.__init__(*state)

    def _learn(self, chunks: set[str]) -> None:
        if len(self._rows) * (len(self.langs) + 1) > _KNOWN:
            self._rows.clear()
        new = [c for c in chunks if c not in self._rows]
        if not new:
            return
        self._table = self._table or PieceTable(self.pieces)
        split = [_WORD.findall(c) for c in new]
        words = sorted({w for ws in split for w in ws})
        at = {w: i for i, w in enumerate(words)}
        logs = word_log_probs(self._table, words, self.probs) if words else np.zeros((0, len(self.langs)))
        while len(self._rows) + len(new) > len(self._values):
            self._values = np.concatenate((self._values, np.zeros_like(self._values)))
        first, count = len(self._rows), np.array([len(ws) for ws in split])
        flat = np.fromiter((at[w] for ws in split for w in ws), np.int64, int(count.sum()))
        sums = np.zeros((len(new) + 1, len(self.langs)))
        if len(flat):
            np.add.at(sums, np.repeat(np.arange(len(new)), count), logs[flat])
        self._values[first : first + len(new), :-1] = sums[:-1]
        self._values[first : first + len(new), -1] = count
        self._rows.update(zip(new, range(first, first + len(new))))

    def forget(self) -> None:
        """Let go of the remembered words."""
        self._rows.clear()
        self._values = np.zeros((1 << 10, len(self.langs) + 1))

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """(language, probability among the languages) of each text; ``und`` and 0 without a letter."""
        chunks = [t.lower().split() if t.isascii() else unicodedata.normalize("NFC", t).lower().split() for t in texts]
        self._learn(set().union(*chunks) if chunks else set())
        logs = np.zeros((len(texts), len(self.langs) + 1))
        for i, cs in enumerate(chunks):
            if cs:
                logs[i] = self._values[np.fromiter(map(self._rows.__getitem__, cs), np.int64, len(cs))].sum(axis=0)
        top = logs[:, :-1].max(axis=1, initial=-np.inf)
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts))
        post = 1.0 / np.exp(logs[:, :-1] - top[:, None]).sum(axis=1)
        best = logs[:, :-1].argmax(axis=1)
        found = logs[:, -1] > 0
        return [self.langs[b] if f else "und" for b, f in zip(best, found)], np.where(found, post, 0.0)


def _piece_counts(model: Model, langs: list[str]):
    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        column = {x: k for k, x in enumerate(langs)}
        table, total = PieceTable(model.pieces), np.zeros((len(model.pieces), len(langs)))
        for frame in frames:
            seen: dict[str, np.ndarray] = {}
            for text, lang in zip(frame["text"], frame["lang"]):
                for w in letter_words(text or ""):
                    if w not in seen:
                        seen[w] = np.zeros(len(langs), np.float32)
                    seen[w][column[lang]] += 1.0
            words = sorted(seen)
            if words:
                total += expected_pieces(table, words, np.array([seen[w] for w in words], np.float64), model.probs)
        release()
        piece, lang = np.nonzero(total)
        yield pd.DataFrame({"piece": piece, "lang": lang, "n": total[piece, lang]})

    return count


def _sample(d: DataFrame, quota: int) -> tuple[list[str], DataFrame]:
    """(languages of all rows of d (id, text, lang) in order, the rows of each language's sample)."""
    d = d.withColumn("h", F.xxhash64("id", "text"))
    found = d.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n")).limit(_MOST_LANGS + 1).collect()
    if len(found) > _MOST_LANGS:
        raise ValueError(f"More than {_MOST_LANGS} languages: the model has a number for each piece and language")
    span = 1 << 40
    # The count is exact within some per cent, so a language of up to ``quota`` rows is taken whole.
    cuts = [(r["lang"], span if r["n"] <= 1.1 * quota else int(span * quota / r["n"])) for r in found]
    cut = d.sparkSession.createDataFrame(cuts, "lang string, cut long")
    rows = d.join(F.broadcast(cut), "lang").where(F.pmod("h", F.lit(span)) < F.col("cut")).dropDuplicates(["lang", "h"])
    return sorted(r["lang"] for r in found), rows.select("text", "lang")


def train(docs: DataFrame, vocabulary: str, quota: int = 8_000, rounds: int = 2, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn piece probabilities by expectation-maximisation from about ``quota`` labelled rows of each language.

    Every language of any labelled row is learned: its rows are those with the smallest hash of id and text, a fixed
    choice, and all of them where it has no more than ``quota``. Rows without a language are left out; rows equal in id,
    text and language count once. Over 1,000 languages raise. Each round sums, per task, the expected counts over all
    segmentations of the task's words, starting from equal probabilities. The driver gets one number per piece and
    language. Runs jobs when called; the sample is stored in the shared folder.
    """
    d = columns_of(docs, id_col, text_col, lang_col).where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    langs, rows = _sample(d.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")), quota)
    rows = stash(rows, "language-sample") if langs else rows
    pieces = vocabulary_pieces(vocabulary)
    model = Model(pieces, langs, np.full((len(pieces), 1), 1.0 / len(pieces)))
    for _ in range(rounds if langs else 0):
        found = rows.mapInPandas(_piece_counts(model, langs), "piece long, lang int, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toPandas()
        counts = np.full((len(pieces), len(langs)), 0.1)
        counts[found["piece"].to_numpy(), found["lang"].to_numpy()] += found["n"].to_numpy()
        model = Model(pieces, langs, counts / counts.sum(axis=0))
    return model


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, lang_pred, score.

    Every whole text is scored by all languages of the model; the score is the probability of the predicted one among
    them, with equal priors. ``und`` with score 0 if the text is null or has no letter. Ties go to the first language
    in order. Ids may be null or repeat; further columns are ignored; an empty input gives no row.
    """
    predict = _predictor(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, langs, scores in predict(batches):
            yield pa.record_batch([part.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores)], names=["doc_id", "lang_pred", "score"])

    d = columns_of(docs, id_col, text_col)
    d = d.select(d[id_col].cast("long").alias("doc_id"), d[text_col].cast("string").alias("text"))
    return d.mapInArrow(run, "doc_id long, lang_pred string, score double")


def _predictor(docs: DataFrame, model: Model):
    shared = docs.sparkSession.sparkContext.broadcast(model)  # one number per piece and language

    def predict(batches: Iterator[pa.RecordBatch]):
        own = shared.value
        try:
            for part in text_slices(batches):
                yield part, *own.predict([t or "" for t in part.column("text").to_pylist()])
        finally:
            own.forget()
            release()

    return predict


def held_out(id_col: str, modulus: int, remainder: int):
    """Whether crc32 of the id's decimal text leaves ``remainder``; never for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def keep_recognised(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose language is recognised with at least that score, with all their columns, in place.

    Null texts and texts without a letter go. Where no row has a language there is nothing to learn from, and every row
    stays.
    """
    import public_tokenizers

    model = train(docs, public_tokenizers.path("piece_bpe_32k.model"))
    if not model.langs:
        return docs
    predict = _predictor(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, langs, scores in predict(batches):
            yield part.filter(pa.array((np.array(langs, object) != "und") & (scores >= least), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
