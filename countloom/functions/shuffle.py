"""Keyed permutations of 0..n-1 by arithmetic alone, so that many shuffles of a table need no sort each."""

from __future__ import annotations

import numpy as np

PRIME = 2_147_483_647
ROUNDS = 24


def _stir(z):
    a = (z * 48271 + 11) % PRIME
    b = (a * a + z) % PRIME
    return (b * 69621 + 7) % PRIME


def shuffled_places(place: np.ndarray, size: np.ndarray, seed: int, numbers: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Row i, column j: where place i of 0..size-1 goes in permutation ``numbers[j]`` of that size.

    A swap-or-not network: in each round a place is paired with (key - place) mod size, and a bit drawn from the larger
    of the two decides for both whether they swap. So every round, and the whole, is a bijection for any size; nothing
    is ordered and places do not need each other. All arithmetic is on non-negative 64-bit integers, the same in SQL.
    """
    x = np.repeat(np.asarray(place, np.int64)[:, None], len(numbers), axis=1)
    size = np.asarray(size, np.int64)[:, None]
    for r in range(rounds):
        base = (seed * 7919 + np.asarray(numbers, np.int64)[None, :] * 104_729 + r * 1_299_709) % PRIME
        partner = (_stir(base) % size + size - x) % size
        drawn = _stir((np.maximum(x, partner) * 40_503 + base * 31 + 17) % PRIME)
        x = np.where(drawn // 4096 % 2 == 1, partner, x)
    return x


def shuffled_place_sql(place: str, size: str, seed: str, number: str, rounds: int = ROUNDS) -> str:
    """The same as a DuckDB expression of one place and one permutation number."""
    def stir(z: str) -> str:
        a = f"((({z}) * 48271 + 11) % {PRIME})"
        return f"((({a} * {a} + ({z})) % {PRIME}) * 69621 + 7) % {PRIME}"

    base = f"((CAST({seed} AS BIGINT) * 7919 + {number} * 104729 + r * 1299709) % {PRIME})"
    bound = f"list_transform([[x, (({stir(base)}) % {size} + {size} - x) % {size}]], lambda y: CASE WHEN ({stir(f'((greatest(y[1], y[2]) * 40503 + {base} * 31 + 17) % {PRIME})')}) // 4096 % 2 = 1 THEN y[2] ELSE y[1] END)[1]"
    return f"list_reduce(CAST(range({rounds}) AS BIGINT[]), lambda x, r: {bound}, CAST({place} AS BIGINT))"
