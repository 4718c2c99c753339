"""Elias-Fano sequences and a two-level trie over contexts and their successors, in one memory map."""

from __future__ import annotations

import mmap

import numpy as np

_SAMPLE = 64  # zeros (or ones) per select sample
_ONE = np.uint64(1)


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Fields of ``width`` bits, one after the other, in 64-bit words (with one spare word)."""
    words = np.zeros((len(values) * width + 63) // 64 + 1, np.uint64)
    if width and len(values):
        at = np.arange(len(values), dtype=np.int64) * width
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        np.bitwise_or.at(words, word, values << shift)
        over = np.flatnonzero((at & 63) + width > 64)
        np.bitwise_or.at(words, word[over] + 1, values[over] >> (np.uint64(64) - shift[over]))
    return words


def _unpack(words: np.ndarray, width: int, index: np.ndarray) -> np.ndarray:
    if not width:
        return np.zeros(len(index), np.uint64)
    at = index * width
    word, shift = at >> 6, (at & 63).astype(np.uint64)
    high = np.where(shift > 0, words[word + 1] << (np.uint64(63) - shift) << _ONE, np.uint64(0))
    return (words[word] >> shift | high) & np.uint64((1 << width) - 1)


class EliasFano:
    """A monotone sequence below ``universe``: low bits packed, high bits as unary gaps with sampled selects.

    A sequence of n values takes about 2 + log2(universe / n) bits for each. ``parts`` are its arrays.
    """

    def __init__(self, n: int, width: int, parts: list[np.ndarray]):
        self.n, self.width, self.parts = n, width, parts
        self.low, self.high, self.zeros, self.ones = parts

    @classmethod
    def build(cls, values: np.ndarray, universe: int) -> EliasFano:
        n = len(values)
        width = max(0, (universe // max(n, 1)).bit_length() - 1)
        values = values.astype(np.uint64)
        tops = (values >> np.uint64(width)).astype(np.int64)
        place = tops + np.arange(n)
        size = ((universe - 1) >> width) + n + 2
        bits = np.zeros(-(-size // 64) * 64, np.uint8)
        bits[place] = 1
        high = np.packbits(bits, bitorder="little").view(np.uint64)
        low = _pack(values & np.uint64((1 << width) - 1), width)
        zeros = np.flatnonzero(bits == 0)[::_SAMPLE].astype(np.int64)
        return cls(n, width, [low, high, zeros, place[::_SAMPLE].astype(np.int64)])

    def _select(self, rank: np.ndarray, ones: bool) -> np.ndarray:
        """Place of the ``rank``-th one or zero among the high bits."""
        at = (self.ones if ones else self.zeros)[rank // _SAMPLE]
        word, left = at >> 6, rank % _SAMPLE
        flip = np.uint64(0) if ones else ~np.uint64(0)
        bits = (self.high[word] ^ flip) >> (at & 63).astype(np.uint64) << (at & 63).astype(np.uint64)
        count = _popcount(bits)
        go = np.flatnonzero(count <= left)
        while len(go):
            left[go] -= count[go]
            word[go] += 1
            bits[go] = self.high[word[go]] ^ flip
            count[go] = _popcount(bits[go])
            go = go[count[go] <= left[go]]
        place = np.zeros(len(rank), np.int64)
        for step in (32, 16, 8, 4, 2, 1):
            below = _popcount(bits & np.uint64((1 << step) - 1))
            up = below <= left
            left = np.where(up, left - below, left)
            bits = np.where(up, bits >> np.uint64(step), bits)
            place += np.where(up, step, 0)
        return (word << 6) + place

    def get(self, index: np.ndarray) -> np.ndarray:
        top = (self._select(index.copy(), True) - index).astype(np.uint64)
        return top << np.uint64(self.width) | _unpack(self.low, self.width, index)

    def find(self, values: np.ndarray) -> np.ndarray:
        """Index of each value, or -1: the successor search starts at the value's high bits and compares low bits."""
        values = values.astype(np.uint64)
        top = (values >> np.uint64(self.width)).astype(np.int64)
        wanted = values & np.uint64((1 << self.width) - 1)
        place = np.zeros(len(values), np.int64)
        later = np.flatnonzero(top > 0)
        place[later] = self._select(top[later] - 1, False) + 1
        index = place - top
        out = np.full(len(values), -1, np.int64)
        go = np.arange(len(values))
        while len(go):
            at = place[go]
            go = go[(self.high[at >> 6] >> (at & 63).astype(np.uint64) & _ONE) == 1]
            low = _unpack(self.low, self.width, index[go])
            same = low == wanted[go]
            out[go[same]] = index[go[same]]
            go = go[low < wanted[go]]
            place[go] += 1
            index[go] += 1
        return out


class ContextTrie:
    """Contexts, and below each its successors with a coded value: two Elias-Fano levels and monotone pointers.

    A successor is kept relative to its context: its number is the context's rank followed by the successor's own bits,
    so one monotone sequence holds all of them, and the pointers bound a context's stretch of it.
    """

    def __init__(self, contexts: EliasFano, pointers: EliasFano, successors: EliasFano, codes: np.ndarray, bits: int):
        self.contexts, self.pointers, self.successors, self.codes, self.bits = contexts, pointers, successors, codes, bits

    @classmethod
    def build(cls, context: np.ndarray, successor: np.ndarray, codes: np.ndarray, universe: int, bits: int) -> ContextTrie:
        """``context`` and ``successor`` sorted together and distinct as pairs; ``successor`` has ``bits`` bits."""
        new = np.concatenate(([True], context[1:] != context[:-1])) if len(context) else np.zeros(0, bool)
        heads = np.flatnonzero(new)
        rank = np.cumsum(new) - 1
        levels = [
            EliasFano.build(context[heads], universe), EliasFano.build(np.append(heads, len(context)), len(context) + 1),
            EliasFano.build(rank.astype(np.uint64) << np.uint64(bits) | successor.astype(np.uint64), max(1, len(heads)) << bits),
        ]
        arrays = [a for level in levels for a in level.parts] + [codes]
        space = mmap.mmap(-1, max(1, sum(a.nbytes + 64 for a in arrays)))
        at = 0
        for level in levels:
            level.parts = [(_move(space, at := at + 64 - at % 64, a), at := at + a.nbytes)[0] for a in level.parts]
            level.low, level.high, level.zeros, level.ones = level.parts
        at += 64 - at % 64
        return cls(*levels, _move(space, at, codes), bits)

    def lookup(self, context: np.ndarray, successor: np.ndarray) -> np.ndarray:
        """The code of each (context, successor), 0 where the trie has none; equal neighbours in ``context`` are searched once."""
        if not len(context) or not self.contexts.n:
            return np.zeros(len(context), self.codes.dtype)
        new = np.concatenate(([True], context[1:] != context[:-1]))
        rank = self.contexts.find(context[new])
        first, stop = self.pointers.get(np.maximum(rank, 0)).astype(np.int64), self.pointers.get(np.maximum(rank, 0) + 1).astype(np.int64)
        each = np.cumsum(new) - 1
        out = np.zeros(len(context), self.codes.dtype)
        asked = np.flatnonzero(rank[each] >= 0)
        of = each[asked]
        at = self.successors.find(rank[of].astype(np.uint64) << np.uint64(self.bits) | successor[asked].astype(np.uint64))
        hit = (at >= first[of]) & (at < stop[of])
        out[asked[hit]] = self.codes[at[hit]]
        return out

    def bits_per_entry(self) -> float:
        return 8.0 * sum(a.nbytes for level in (self.contexts, self.pointers, self.successors) for a in level.parts) / max(1, self.successors.n)


def _move(space: mmap.mmap, at: int, array: np.ndarray) -> np.ndarray:
    view = np.frombuffer(space, array.dtype, len(array), at)
    view[:] = array
    return view
