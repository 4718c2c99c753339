"""The quality model's features, score and gradient step against plain versions."""

import numpy as np
import pytest

from countloom.llm import quality


def grams(word):
    coded = b"<" + word.encode() + b">"
    return [coded[i : i + n] for n in (3, 4) for i in range(len(coded) - n + 1)]


def test_features_are_words_and_their_byte_grams():
    words = ["cat", "Cat", "cats", "é", "a", "scatter", "x" * 300]
    buckets = 1 << 40
    feature, count = quality.word_features(words, buckets)
    assert count.tolist() == [1 + len(grams(w)) for w in words]
    rows = [r.tolist() for r in np.split(feature, np.cumsum(count)[:-1])]
    assert rows[0][0] == rows[1][0]  # the word itself ignores case, its grams do not
    named = {}
    for word, row in zip(words, rows):
        for gram, bucket in zip(grams(word), row[1:]):
            assert named.setdefault(gram, bucket) == bucket
    assert len(set(named.values())) == len(named)
    assert quality.word_features([], buckets)[0].size == 0


def test_score_is_the_weighted_mean_of_pulls():
    rng = np.random.default_rng(2)
    model = quality.Model(rng.normal(size=(1 << 12) + 1), 0.3)
    texts = ["the cat the cat", "no no no", "", "  \n", "É è ü x", " ".join(f"w{i % 50}" for i in range(5000))]
    plain = []
    for t in texts:
        bucket, weight = quality._document_features(t, 1 << 12)
        plain.append(1 / (1 + np.exp(-(model.pull[bucket] @ weight + 0.3))) if len(bucket) else 1 / (1 + np.exp(-0.3)))
    assert np.allclose(model.scores(texts), plain)
    assert np.allclose(model.scores(texts[::-1]), plain[::-1])  # also from what it remembers


def test_one_gradient_step():
    text, size, buckets, rate = "good plain words", 8, 1 << 12, 0.7
    model = quality.fit([text], [1], buckets=buckets, size=size, rounds=1, rate=rate, seed=5)
    vectors = np.random.default_rng(5).uniform(-1.0 / size, 1.0 / size, (buckets + 1, size))
    bucket, weight = quality._document_features(text, buckets)
    hidden = weight @ vectors[bucket]

    def loss(out, bias, v):
        logits = (weight @ v) @ out + bias
        return np.log(np.exp(logits).sum()) - logits[1]

    out, bias, e = np.zeros((size, 2)), np.zeros(2), 1e-6
    slope = np.array([[(loss(out + e * np.outer(np.eye(size)[i], np.eye(2)[j]), bias, vectors[bucket]) - loss(out, bias, vectors[bucket])) / e for j in range(2)] for i in range(size)])
    assert np.allclose(slope, np.outer(hidden, [0.5, -0.5]), atol=1e-5)
    moved = -rate * slope  # the vectors do not move while the output is zero
    assert np.allclose(model.pull, vectors @ (moved[:, 1] - moved[:, 0]), atol=1e-5)
    assert model.bias == pytest.approx(rate * 0.1, abs=1e-9)  # half of it on each side


def test_learns_a_separable_set_and_survives_one_label():
    texts = [f"{'lovely calm prose' if i % 2 else 'BUY!!! %%% cheap'} number {i}" for i in range(60)]
    model = quality.fit(texts, [i % 2 for i in range(60)])
    scores = model.scores(["lovely prose", "BUY!!! cheap"])
    assert scores[0] > 0.7 > 0.3 > scores[1]
    assert quality.fit(["a", "b"], [1, 1]).scores(["c"])[0] > 0.5
    assert quality.fit([], []).scores(["x"])[0] == pytest.approx(0.5)
