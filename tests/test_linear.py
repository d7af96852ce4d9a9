"""The linear model of the probe: its minimum, its passes over the rows, odd rows."""

import numpy as np
import pytest

from ticketlake.operators import features, linear, models


def problem(n=300, d=40, k=3, seed=1):
    """Rows whose first positions are much more frequent than the others, and labels that they decide in part."""
    rng = np.random.default_rng(seed)
    x = (rng.random((n, d)) < np.where(np.arange(d) < 6, 0.9, 0.1)) * rng.random((n, d)) + 0.0
    y = np.argmax(x @ rng.normal(size=(d, k)) + rng.normal(size=(n, k)), axis=1)
    return x, y


def frame(spark, x, y, parts=3):
    rows = [([int(j) for j in np.flatnonzero(v)], [float(z) for z in v[v != 0]], float(c)) for v, c in zip(x, y)]
    return spark.createDataFrame(rows, "idx array<int>, val array<double>, y double").repartition(parts)


def slope(x, y, weights, bias, penalty):
    """Gradient of the mean loss plus penalty / 2 * |weights|^2."""
    z = x @ weights.T + bias
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    p[np.arange(len(y)), y] -= 1
    return p.T @ x / len(y) + penalty * weights, p.mean(axis=0)


@pytest.mark.parametrize("dense, first_rows", [(0, 10**9), (5, 10), (256, 10**9)])
def test_fit_reaches_the_minimum(spark, monkeypatch, dense, first_rows):
    monkeypatch.setattr(linear, "FIRST_ROWS", first_rows)
    monkeypatch.setattr(linear, "DENSE", dense)
    monkeypatch.setattr(linear, "BLOCK_ENTRIES", 200)
    x, y = problem()
    passes = []
    at = linear._Objective.at
    monkeypatch.setattr(linear._Objective, "at", lambda self, point: passes.append(1) or at(self, point))
    weights, bias = linear.fit_multinomial(frame(spark, x, y), 3, x.shape[1], 1 / len(y), np.argsort(-(x > 0).sum(axis=0)))
    a, b = slope(x, y, weights, bias, 1 / len(y))
    assert np.abs(a).max() < 1e-7 and np.abs(b).max() < 1e-7 and abs(bias.sum()) < 1e-9
    if dense == 256:
        assert len(passes) < 100


def test_fit_of_odd_rows(spark):
    x, y = problem(20, 5, 2)
    x[3] = x[7] = 0.0
    weights, bias = linear.fit_multinomial(frame(spark, x, y), 2, 5, 0.05, np.arange(5))
    a, b = slope(x, y, weights, bias, 0.05)
    assert np.abs(a).max() < 1e-6 and np.abs(b).max() < 1e-6
    one, _ = linear.fit_multinomial(frame(spark, x, np.zeros(20)), 1, 5, 0.05, np.arange(5))
    assert not one.any()
    nothing, _ = linear.fit_multinomial(frame(spark, np.zeros((4, 0)), np.array([0, 1, 0, 1])), 2, 0, 0.05, np.arange(0))
    assert nothing.shape == (2, 0)


def test_probe_gives_the_coefficients_of_the_minimum(spark):
    rng = np.random.default_rng(3)
    words = [f"word{i}" for i in range(30)]
    rows = [(str(i), "abc"[i % 3], " ".join(rng.choice(words[: 10 + 10 * (i % 3)], 12))) for i in range(150)]
    train = spark.createDataFrame(rows, "ticket_id string, category string, description string")
    text = models.concat_training("description")
    tfidf = features.fit_tfidf(train, text, **features.CLASSIFIER_TEXT)
    x, y = np.zeros((150, len(tfidf.terms))), np.zeros(150, int)
    for r in tfidf.transform(train, text).collect():
        x[int(r["ticket_id"]), r["idx"]], y[int(r["ticket_id"])] = r["val"], "abc".index(r["category"])
    weights, bias = np.zeros((3, x.shape[1])), np.zeros(3)
    # Newton's method on the whole matrix of second derivatives.
    ones = np.hstack([x, np.ones((150, 1))])
    for _ in range(30):
        a, b = slope(x, y, weights, bias, 1 / 150)
        z = x @ weights.T + bias
        p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
        h = np.block([[ones.T @ (ones * (p[:, c] * ((c == e) - p[:, e]))[:, None]) / 150 for e in range(3)] for c in range(3)])
        h += np.diag(np.tile(np.append(np.full(x.shape[1], 1 / 150), 1e-9), 3))
        step = np.linalg.solve(h, np.hstack([a, b[:, None]]).ravel()).reshape(3, -1)
        weights, bias = weights - step[:, :-1], bias - step[:, -1]
    got = {(r["class"], r["term"]): r["coefficient"] for r in models.token_probe(train, "category", ["description"]).collect()}
    assert len(got) == 30
    for (name, term), found in got.items():
        assert found == pytest.approx(weights["abc".index(name), tfidf.terms.index(term)], rel=1e-5)
