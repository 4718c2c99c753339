"""Token counts by heap-and-linked-list byte-pair merging; no identifiers are made."""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from countloom.llm.common import columns_of, text_slices

_SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
_KNOWN = 400_000  # memo entries per worker; it starts anew beyond that
_ODD_SPACE = regex.compile("[\x1c-\x1f]")  # white space to str.split, ordinary to the tokenizer


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte: printable Latin-1 for itself, the others from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class PieceCounter:
    """Counts a text's tokens with the merge ranks of a byte-level BPE file that lower-cases and drops white space."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.ranks = {tuple(m) if isinstance(m, list) else tuple(m.split(" ")): i for i, m in enumerate(spec["model"]["merges"])}
        self.suffix = spec["model"]["end_of_word_suffix"] or ""
        self.letters = _byte_letters()
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in spec["added_tokens"]))
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"])
        self.pieces: dict[str, int] = {}
        self.chunks: dict[str, int] = _Memo(self._chunk)

    def merged(self, piece: str) -> int:
        """Tokens of one piece: its bytes less the merges. The heap holds adjacent pairs by rank, then by place."""
        symbols = [self.letters[b] for b in piece.encode()]
        n = len(symbols)
        symbols[-1] += self.suffix
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ranks = self.ranks
        heap = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := ranks.get((symbols[i], symbols[i + 1]))) is not None]
        heapq.heapify(heap)
        count = n
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != a or j >= n or symbols[j] != b:
                continue  # one of the two has been merged since
            symbols[i], symbols[j] = a + b, ""
            after[i] = k = after[j]
            count -= 1
            if k < n:
                before[k] = i
                if (r := ranks.get((symbols[i], symbols[k]))) is not None:
                    heapq.heappush(heap, (r, i, symbols[i], symbols[k]))
            h = before[i]
            if h >= 0 and (r := ranks.get((symbols[h], symbols[i]))) is not None:
                heapq.heappush(heap, (r, h, symbols[h], symbols[i]))
        return count

    def _chunk(self, chunk: str) -> int:
        total = 0
        for piece in self.words.findall(chunk):
            n = self.pieces.get(piece)
            if n is None:
                n = self.pieces[piece] = self.merged(piece)
            total += n
        return total

    def _plain(self, text: str) -> int:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # the file lower-cases letter by letter
        text = text.lower()
        if _ODD_SPACE.search(text):
            return sum(map(self._chunk, regex.split(r"[ \t\n\v\f\r]+", text)))
        return sum(map(self.chunks.__getitem__, text.split()))

    def count(self, text: str) -> int:
        """Tokens of a whole text; a special token's string counts as one token, as the library has it by default."""
        if len(self.chunks) > _KNOWN or len(self.pieces) > _KNOWN:
            self.chunks.clear()
            self.pieces.clear()
        if not self.special.search(text):
            return self._plain(text)
        found = len(self.special.findall(text))
        return found + sum(map(self._plain, self.special.split(text)))


class _Memo(dict):
    def __init__(self, make):
        self.make = make

    def __missing__(self, key):
        out = self.make(key)
        if len(key) <= 64:
            self[key] = out
        return out


_COUNTERS: dict[str, PieceCounter] = {}


def token_counts(docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes (UTF-8), n_tokens, over_limit (more than ``limit`` tokens).

    ``path`` names the tokenizer file, which every executor can open. Counts equal those of the tokenizers library
    without added special tokens, truncation or padding. Null counts as the empty text, with no bytes and no tokens;
    ids may be null or repeat; further columns are ignored; an empty input gives no row. The work is a projection of
    each partition, without a shuffle; each worker remembers the counts of words it has met, up to a fixed number.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _COUNTERS.setdefault(path, None) or PieceCounter(path)
        _COUNTERS[path] = counter
        for part in text_slices(batches, "text"):
            texts = [t or "" for t in part.column("text").to_pylist()]
            tokens = [counter.count(t) for t in texts]
            yield pa.record_batch(
                [part.column("doc_id"), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens])],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    d = columns_of(docs, id_col, text_col)
    return d.select(d[id_col].cast("long").alias("doc_id"), d[text_col].cast("string").alias("text")).mapInArrow(count, _SCHEMA)
