"""Word hashes of many texts at once, as NumPy arrays over the texts' bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)
_WINDOW = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mix (xor-shift and odd multiplications)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0], have, step = 1, 1, base
    while have < n:
        take = min(have, n - have)
        out[have : have + take] = out[:take] * np.uint64(step)
        have, step = have + take, step * step % (1 << 64)
    return out


_UP, _DOWN = _powers(_ODD, _WINDOW), _powers(_INVERSE, _WINDOW)
_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
_CODES[ord("A") : ord("Z") + 1] = _CODES[ord("a") : ord("z") + 1]  # A-Z count as a-z
_SPACES = np.ones(256, bool)
_SPACES[[32, *range(9, 14)]] = False
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _long_hash(codes: np.ndarray) -> int:
    """The same hash for a word longer than one window, piece by piece."""
    total, factor = 0, 1
    step = pow(_INVERSE, _WINDOW, 1 << 64)
    for a in range(0, len(codes), _WINDOW):
        part = codes[a : a + _WINDOW]
        with np.errstate(over="ignore"):
            total += int((part * _DOWN[: len(part)]).sum(dtype=np.uint64)) * factor
        factor = factor * step % (1 << 64)
    return total % (1 << 64)


def word_hashes(texts: pa.Array, alnum: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and the index of the text each belongs to.

    A word is a run of bytes that are no ASCII white space, or with ``alnum`` a run of ASCII letters, digits and bytes
    of other characters. A-Z hash as a-z. Nulls hold no word. Work memory is bounded by a window, not by a text.
    """
    texts = pc.fill_null(texts, "")
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[: offsets[-1]] if offsets[-1] else np.empty(0, np.uint8)
    kind = _ALNUM if alnum else _SPACES
    hashes, docs = [], []
    at, end = int(offsets[0]), int(offsets[-1])
    while at < end:
        stop = min(end, at + _WINDOW)
        inside = kind[data[at:stop]]
        heads = offsets[np.searchsorted(offsets, at, "left") : np.searchsorted(offsets, stop, "left")] - at
        if stop < end:
            gaps = np.flatnonzero(~inside)
            cut = max(int(gaps[-1]) + 1 if len(gaps) else 0, int(heads[-1]) if len(heads) else 0)
            if cut == 0:  # one word fills the window
                limit = int(offsets[np.searchsorted(offsets, at, "right")])
                while stop < limit and kind[data[stop]]:
                    nxt = kind[data[stop : min(limit, stop + _WINDOW)]]
                    hit = np.flatnonzero(~nxt)
                    stop += int(hit[0]) if len(hit) else len(nxt)
                    if len(hit):
                        break
                hashes.append(np.array([_long_hash(_CODES[data[at:stop]])], np.uint64))
                docs.append(np.array([np.searchsorted(offsets, at, "right") - 1]))
                at = stop
                continue
            stop = at + cut
            inside, heads = inside[:cut], heads[heads < cut]
        n = stop - at
        first = np.zeros(n, bool)
        first[heads] = True
        starts = np.flatnonzero(inside & (first | ~np.concatenate(([False], inside[:-1]))))
        after = np.concatenate((first[1:], [True]))
        ends = np.flatnonzero(inside & (after | ~np.concatenate((inside[1:], [False])))) + 1
        if len(starts):
            with np.errstate(over="ignore"):
                sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_CODES[data[at:stop]] * _DOWN[:n], dtype=np.uint64)))
                hashes.append((sums[ends] - sums[starts]) * _UP[starts])
            docs.append(np.searchsorted(offsets, starts + at, "right") - 1)
        at = stop
    if not hashes:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return mix(np.concatenate(hashes)), np.concatenate(docs)


def shingle_hashes(words: np.ndarray, docs: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words, with their text's index; a shorter text is one shingle of all its words."""
    if len(words) == 0:
        return words, docs
    total = len(words)
    first = np.flatnonzero(np.concatenate(([True], docs[1:] != docs[:-1])))
    counts = np.diff(np.concatenate((first, [total])))
    factors = mix(np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) | np.uint64(1)
    left = np.repeat(first + counts, counts) - np.arange(total)
    keep = (left >= size) | (np.repeat(counts, counts) < size) & (np.repeat(first, counts) == np.arange(total))
    starts = np.flatnonzero(keep)
    out = np.zeros(len(starts), np.uint64)
    for k in range(size):
        here = np.minimum(starts + k, total - 1)
        out += np.where(left[starts] > k, words[here], np.uint64(0)) * factors[k]
    return mix(out), docs[starts]
