"""Fitted models against plain computations: success model (M29), grid of regressions (M23), mixtures (M28), judges' leniency."""

from math import comb, log

import numpy as np
import pytest

from routecast.operators import agreement as A
from routecast.operators import inference as I
from routecast.operators import model as ML


def test_success_model_of_as_many_weights_as_texts(spark):
    """Three texts over two words and a bias: without a penalty the fitted shares are the observed ones."""
    rows = [("red", 3, 10), ("red", 1, 10), ("Blue", 6, 8), ("red, blue!", 9, 12), (None, 1, 2)]
    df = spark.createDataFrame(rows, "text string, correct_count long, k long")
    got = {r.text: r.probability for r in ML.predict(ML.fit(df, penalty=0.0), df).collect()}
    for text, share in (("red", 4 / 20), ("Blue", 6 / 8), ("red, blue!", 9 / 12)):
        assert got[text] == pytest.approx(share, abs=1e-4)
    assert len(got) == 4 and 0 < got[""] < 1  # a null text counts as empty


def test_success_model_minimises_the_penalised_loss(spark):
    """The slope of the weighted loss plus the penalty of standardised weights is flat at the fitted probabilities."""
    r = np.random.default_rng(2)
    words = ["aa", "bb", "cc", "dd"]
    rows = [(" ".join(w for w in words if r.random() < 0.5) or "zz", int(c), 9) for c in r.integers(0, 10, 60)]
    df = spark.createDataFrame(rows, "text string, correct_count long, k long")
    small = [x.probability for x in ML.predict(ML.fit(df, penalty=1e-3), df).collect()]
    large = [x.probability for x in ML.predict(ML.fit(df, penalty=10.0), df).collect()]
    share = sum(c for _, c, _ in rows) / (9 * len(rows))
    assert np.std(large) < 0.02 < np.std(small) and np.mean(large) == pytest.approx(share, abs=0.01) and np.mean(small) == pytest.approx(share, abs=1e-3)
    loss = lambda ps: -sum(c * log(p) + (k - c) * log(1 - p) for p, (_, c, k) in zip(ps, rows))
    assert loss(small) < loss(large)
    for w in words:  # within a word's rows the fitted mean is the observed one, but for the small penalty
        mine = [i for i, (t, _, _) in enumerate(rows) if w in t]
        assert np.mean([small[i] for i in mine]) == pytest.approx(np.mean([rows[i][1] / 9 for i in mine]), abs=0.01)


def ols(y, x):
    inv = np.linalg.inv(x.T @ x)
    beta = inv @ x.T @ y
    e, h = y - x @ beta, np.einsum("ij,jk,ik->i", x, inv, x)
    return beta, np.sqrt(np.diag(inv @ (x.T * (e / (1 - h)) ** 2) @ x @ inv))


def test_grid_of_regressions(spark):
    r = np.random.default_rng(3)
    a, b = r.normal(size=40), r.normal(size=40)
    y, z = 1 + 2 * a - b + r.normal(size=40), a * b
    rows = [(float(p), None if i % 9 == 0 else float(q), float(s), float(t)) for i, (p, q, s, t) in enumerate(zip(a, b, y, z))]
    df = spark.createDataFrame(rows, "a double, b double, y double, z double")
    got = {(x.outcome, x.model, x.term): x for x in I.model_grid(df, {"one": ["a"], "two": ["a", "b"]}, ["y", "z"]).collect()}
    assert len(got) == 10
    whole = np.array([i % 9 != 0 for i in range(40)])
    for name, out in (("y", y), ("z", z)):
        for model, terms, rows_ in (("one", [a], np.ones(40, bool)), ("two", [a, b], whole)):
            beta, se = ols(out[rows_], np.column_stack([np.ones(40), *terms])[rows_])
            for term, u, v in zip(["intercept", "a", "b"], beta, se):
                x = got[name, model, term]
                assert (x.coefficient, x.se, x.n) == (pytest.approx(u), pytest.approx(v), int(rows_.sum()))
                assert x.low < x.coefficient < x.high and (x.p < 0.05) == (x.low * x.high > 0)


def test_mixture_against_a_loop(spark):
    r = np.random.default_rng(4)
    rows = [("s", 8, int(r.binomial(8, 0.2 if r.random() < 0.5 else 0.9))) for _ in range(200)]
    got = I.rate_mixture(spark.createDataFrame(rows, "segment string, k int, correct_count int"), points=21, steps=60).first()
    grid, w = [i / 20 for i in range(21)], [1 / 21] * 21
    for _ in range(60):
        new = [0.0] * 21
        for _, k, c in rows:
            mass = [w[i] * comb(k, c) * g**c * (1 - g) ** (k - c) for i, g in enumerate(grid)]
            for i, m in enumerate(mass):
                new[i] += m / sum(mass) / len(rows)
        w = new
    mean = sum(a * g for a, g in zip(w, grid))
    true = sum(a * (g - mean) ** 2 for a, g in zip(w, grid))
    noise = sum(a * g * (1 - g) for a, g in zip(w, grid)) / 8
    assert (got.n, got.mean, got.true_variance, got.noise_variance) == (200, pytest.approx(mean), pytest.approx(true), pytest.approx(noise))
    assert got.reliability == pytest.approx(true / (true + noise)) and got.max_correlation == pytest.approx((true / (true + noise)) ** 0.5)


def test_leniency_follows_the_human_ratio(spark):
    """Nine false matches and two refusals are lenient where humans match as often as not, and not where they seldom do."""
    for others, lenient in ((20, True), (60, False)):
        human = [(f"m{i}", True) for i in range(20)] + [(f"o{i}", False) for i in range(others)]
        said = [(k, "J", "no_match" if k in ("m0", "m1") else "match" if m or k in {f"o{i}" for i in range(9)} else "no_match") for k, m in human]
        got = A.judge_scores(spark.createDataFrame(said, "key string, judge string, verdict string"), spark.createDataFrame(human, "key string, match boolean")).first()
        assert (got.fp, got.fn, got.lenient) == (9, 2, lenient)
