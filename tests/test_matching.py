"""Matchings against enumeration and against the auction."""

import itertools

import numpy as np
import pytest

from countloom.operators import matching


def total(w, pairs):
    assert len({a for a, _ in pairs}) == len({b for _, b in pairs}) == len(pairs)
    return sum(w[int(a), int(b)] for a, b in pairs)


def best(w):
    if w.shape[0] > w.shape[1]:
        w = w.T
    return max(sum(w[i, p[i]] for i in range(len(w))) for p in itertools.permutations(range(w.shape[1]), len(w)))


def rows(spark, w):
    return spark.createDataFrame([(str(i), str(j), float(w[i, j])) for i, j in zip(*np.nonzero(w))], "a string, b string, weight double")


def test_components_are_solved_apart(spark):
    rng = np.random.default_rng(1)
    w = np.zeros((9, 10))
    w[:5, :4] = rng.integers(0, 4, (5, 4)) / 8  # many ties
    w[5:, 4:] = rng.integers(0, 4, (4, 6)) / 8
    pairs = [(r["a"], r["b"]) for r in matching.best_matching(rows(spark, w)).collect()]
    assert total(w, pairs) == pytest.approx(best(w[:5, :4]) + best(w[5:, 4:]))
    assert all(w[int(a), int(b)] > 0 for a, b in pairs)
    assert matching.best_matching(rows(spark, w).where("false")).count() == 0


def test_auction_of_a_large_component(spark):
    w = np.array([[3, 3, 0, 1], [3, 3, 0, 0], [3, 2, 2, 0]]) / 4  # three labels want the same two
    pairs = [(r["a"], r["b"]) for r in matching.auction(rows(spark, w), scale=4).collect()]
    assert total(w, pairs) == best(w) == 2.0
    found = matching.best_matching(rows(spark, w), local_labels=0).count()
    assert found == 3


def test_rest_is_paired_in_order(spark):
    a, b = spark.createDataFrame([("x",), ("b",), ("m",)], "a string"), spark.createDataFrame([("2",), ("1",)], "b string")
    assert {tuple(r) for r in matching.pair_up(a, b).collect()} == {("b", "1"), ("m", "2")}
