"""The classifier's features, vectors, pooling and network against loops in plain Python."""

import math
import re

import numpy as np
import pyarrow as pa

from worksift.llm import quality
from worksift.llm.common import data, words

TEXTS = [
    "The cat sat on the mat, the cat SAT! on the mat.",
    "",
    "a",
    "BUY NOW!!! $$$ 100% free <b>money</b> | click | click | click ... été ÉTÉ x-1 (y)",
    "one two three four five six seven eight nine ten one two three one",
    "  \n\t ",
    "word " * 40 + "antidisestablishmentarianism",
]
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def kind(byte):
    c = chr(byte)
    if "a" <= c <= "z":
        return 0
    if "A" <= c <= "Z":
        return 1
    if "0" <= c <= "9":
        return 2
    if byte >= 128:
        return 3
    return 4 if c in ".,;:'\"()-" else 5 if c in "!?" else 6 if c in "#*$%&|<>" else 7


def plain_shape(word, before):
    size = sum(len(word) >= edge for edge in (2, 4, 13))
    kinds = [kind(b) for b in word]
    shout = 1 in kinds and 0 not in kinds and len(word) > 1
    value = kinds[0]
    for part, count in ((kinds[-1], 8), (size, 4), (shout, 2), (word in before, 2)):
        value = value * count + part
    return value


def bucket(word):
    raw, starts = data(pa.array([word], pa.binary()))
    return int(words(raw, starts, lower=False)[0][0] >> np.uint64(64 - quality.WORD_BITS))


def test_features_equal_plain_ones():
    ids, shapes, per = quality.features(pa.array(TEXTS))
    at = 0
    for text, n in zip(TEXTS, per.tolist(), strict=True):
        found = WORD.findall(text.encode())
        assert n == len(found)
        assert ids[at : at + n].tolist() == [bucket(w) for w in found]
        assert shapes[at : at + n].tolist() == [plain_shape(w, found[max(0, k - 3) : k]) for k, w in enumerate(found)]
        at += n


def test_vectors_pooling_and_network_equal_plain_ones(monkeypatch):
    monkeypatch.setattr(quality, "_STEP", 7)  # steps end inside texts
    ids, shapes, per = quality.features(pa.array(TEXTS))
    index = quality.index_vectors(1 << quality.WORD_BITS, 3)
    made = quality.context_vectors(ids, per, index)
    total = {i: index[i].astype(float) for i in set(ids.tolist())}
    at, docs = 0, []
    for n in per.tolist():
        docs.append((ids[at : at + n].tolist(), shapes[at : at + n].tolist()))
        at += n
    for own, _ in docs:
        for k, i in enumerate(own):
            for other in (k - 2, k - 1, k + 1, k + 2):
                if 0 <= other < len(own):
                    total[i] = total[i] + index[own[other]]
    for i, vector in total.items():
        assert np.allclose(made[i], vector / max(np.linalg.norm(vector), 1e-6), atol=1e-5)
    of_shape = quality.index_vectors(8 * 8 * 4 * 2 * 2, 5)
    x = quality.pooled(ids, shapes, per, made, of_shape)
    width = quality.DIMENSIONS
    for row, (own, kinds) in enumerate(docs):
        n = len(own)
        mean = lambda table, keys: sum((table[k].astype(float) for k in keys), np.zeros(width)) / max(n, 1)  # noqa: E731, B023
        assert np.allclose(x[row, :width], mean(made, own), atol=1e-5)
        assert np.allclose(x[row, width:-1], mean(of_shape, kinds), atol=1e-5)
        assert math.isclose(x[row, -1], math.log(1 + n) / 10, rel_tol=1e-6)
    rng = np.random.default_rng(1)
    hidden = quality.HIDDEN
    layers = [rng.normal(size=(2 * width + 1, hidden)), rng.normal(size=hidden), rng.normal(size=hidden), rng.normal(size=1)]
    center, scale = rng.normal(size=2 * width + 1), rng.uniform(0.5, 2, 2 * width + 1)
    model = quality.Model(made, of_shape, center, scale, layers, temperature=1.7)
    for row, score in enumerate(model.scores(pa.array(TEXTS))):
        z = [(float(v) - m) / s for v, m, s in zip(x[row], center, scale, strict=True)]
        h = [max(0.0, sum(a * w for a, w in zip(z, layers[0][:, j], strict=True)) + layers[1][j]) for j in range(hidden)]
        logit = sum(a * w for a, w in zip(h, layers[2], strict=True)) + layers[3][0]
        assert math.isclose(score, 1 / (1 + math.exp(-min(30, max(-30, logit / 1.7)))), rel_tol=1e-4, abs_tol=1e-6)


def test_training_lowers_the_loss_and_calibration_takes_the_best_divisor():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 5))
    y = (x[:, 0] + 0.3 * rng.normal(size=200) > 0).astype(float)
    w1, b1, w2, b2 = quality.train(x, y)
    logits = np.maximum(x @ w1 + b1, 0) @ w2 + b2
    loss = lambda t: float(np.logaddexp(0, -np.where(y == 1, logits, -logits) / t).mean())
    assert loss(1.0) < 0.2
    best = quality.temperature(logits, y)
    assert all(loss(best) <= loss(t) + 1e-9 for t in np.exp(np.linspace(np.log(0.25), np.log(8), 81)))
