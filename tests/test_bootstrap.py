"""Resampled statistics against plain loops over items, and their values against the operators."""

from itertools import combinations

import numpy as np
import pytest

from routecast.operators import agreement as A
from routecast.operators import inference as I

from .test_inference_bca import N


def tau_loop(rows):
    con = dis = ta = tb = 0
    for (a, b), (c, d) in combinations(rows, 2):
        x, y = np.sign(a - c), np.sign(b - d)
        con, dis, ta, tb = con + (x * y > 0), dis + (x * y < 0), ta + (x == 0 and y != 0), tb + (y == 0 and x != 0)
    below = ((con + dis + ta) * (con + dis + tb)) ** 0.5
    return (con - dis) / below if below else np.nan


def alpha_loop(rows):
    values = [x for r in rows for x in r]
    c = np.bincount(values, minlength=6)
    d = lambda a, b: (c[min(a, b):max(a, b) + 1].sum() - (c[a] + c[b]) / 2) ** 2
    observed = sum(d(x, y) / (len(r) - 1) for r in rows for i, x in enumerate(r) for j, y in enumerate(r) if i != j)
    expected = sum(c[a] * (c[b] - (a == b)) * d(a, b) for a in range(6) for b in range(6)) / (len(values) - 1)
    return 1 - observed / expected if expected else np.nan


def pi_loop(rows):
    p = sum(map(sum, rows)) / (2 * len(rows))
    chance, seen = p * p + (1 - p) ** 2, sum(a == b for a, b in rows) / len(rows)
    return float(seen == 1) if chance == 1 else (seen - chance) / (1 - chance)


def plain(rows, f, ps, replicates):
    """BCa bounds by resampling items."""
    r, n, value = np.random.default_rng(0), len(rows), f(rows)
    draws = np.array([f([rows[i] for i in r.integers(0, n, n)]) for _ in range(replicates)])
    left = np.array([f(rows[:i] + rows[i + 1:]) for i in range(n)])
    dev = left.mean() - left
    a = (dev**3).sum() / (6 * (dev**2).sum() ** 1.5)
    z0 = N.inv_cdf(((draws < value).sum() + (draws == value).sum() / 2) / replicates)
    return value, [float(np.quantile(draws, N.cdf(z0 + (z0 + N.inv_cdf(p)) / (1 - a * (z0 + N.inv_cdf(p)))))) for p in ps], float(draws.std(ddof=1))


def sample(raters, levels=6, n=40):
    r = np.random.default_rng(9)
    truth = r.integers(0, levels, n)
    return [tuple(int(np.clip(t + r.integers(-1, 2), 0, levels - 1)) for _ in range(raters)) for t in truth]


@pytest.mark.parametrize(("name", "loop", "raters", "levels"), [("tau_b", tau_loop, 2, 6), ("alpha", alpha_loop, 2, 6), ("alpha", alpha_loop, 3, 6), ("pi", pi_loop, 2, 2)])
def test_against_a_plain_loop(spark, name, loop, raters, levels):
    rows = sample(raters, levels)
    columns = ["a", "b", "c"][:raters]
    df = spark.createDataFrame(rows + [(None,) * raters], ", ".join(f"{c} int" for c in columns))
    value, (low, high, under, upper), se = plain(rows, loop, (0.025, 0.975, 0.05, 0.95), 1500)
    got = I.bootstrap(df.repartition(3), columns, name, 4000, 3, levels=levels).first()
    assert got.n == 40 and abs(got.value - value) < 1e-9 and got.replicates == 4000
    assert max(abs(got.low - low), abs(got.high - high), abs(got.one_sided_low - under), abs(got.one_sided_high - upper), abs(got.se - se)) < 0.04
    assert tuple(I.bootstrap(df, columns, name, 4000, 3, levels=levels).first()) == tuple(got)


def test_values_are_those_of_the_operators(spark):
    rows = sample(2, n=200)
    df = spark.createDataFrame(rows, "a int, b int")
    assert I.bootstrap(df, ["a", "b"], "tau_b", 100, 1).first().value == pytest.approx(A.tau_b(A.cells(df, "a", "b")).first().tau_b)
    long = spark.createDataFrame([(i, x) for i, r in enumerate(rows) for x in r], "unit int, level int")
    assert I.bootstrap(df, ["a", "b"], "alpha", 100, 1).first().value == pytest.approx(A.ordinal_alpha(long, "unit", "level").first().alpha)
    assert I.bootstrap(df, ["a", "b"], "kappa", 100, 1).first().value == pytest.approx(A.weighted_kappa(A.cells(df, "a", "b")).first().kappa)


def test_own_statistic_and_undefined_values(spark):
    df = spark.createDataFrame([(1, 1)] * 5, "a int, b int")
    for name in ("tau_b", "alpha", "kappa"):
        got = I.bootstrap(df, ["a", "b"], name, 100, 1).first()
        assert got.low is None and got.one_sided_high is None and got.n == 5
    share = lambda w, _: w[..., 1, 1] / w.sum((-2, -1))
    assert I.bootstrap(df, ["a", "b"], share, 100, 1).first().value == 1
    assert I.bootstrap(df.where("false"), ["a", "b"], "pi", 100, 1, levels=2).first().n == 0
