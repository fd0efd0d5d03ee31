from statistics import NormalDist

import numpy as np

from routecast.operators import inference as I

N = NormalDist()


def table(*columns):
    t = np.zeros((6,) * len(columns))
    np.add.at(t, columns, 1)
    return t


def plain(columns, statistic, ps, replicates=4000):
    """BCa bounds by resampling items."""
    r, n = np.random.default_rng(0), len(columns[0])
    value = float(statistic(table(*columns)))
    draws = np.array([statistic(table(*(c[i] for c in columns))) for i in (r.integers(0, n, n) for _ in range(replicates))])
    left = np.array([statistic(table(*(np.delete(c, i) for c in columns))) for i in range(n)])
    dev = left.mean() - left
    a = (dev**3).sum() / (6 * (dev**2).sum() ** 1.5)
    z0 = N.inv_cdf(((draws < value).sum() + (draws == value).sum() / 2) / replicates)
    zs = [z0 + N.inv_cdf(p) for p in ps]
    return value, [float(np.quantile(draws, N.cdf(z0 + z / (1 - a * z)))) for z in zs], float(draws.std(ddof=1))


def sample():
    r = np.random.default_rng(4)
    truth = r.integers(0, 6, 80)
    return truth, np.clip(truth + r.integers(-1, 3, 80), 0, 5), np.clip(truth + r.integers(-3, 2, 80), 0, 5)


def test_upper_bound_and_floor(spark):
    truth, one, _ = sample()
    df = spark.createDataFrame([(int(a), int(b)) for a, b in zip(truth, one)], "a int, b int")
    value, (low, high, upper), se = plain((truth, one), I._kappa, (0.025, 0.975, 0.95))
    for floor, below in ((0.5, upper < 0.5), (upper + 0.05, True), (upper - 0.05, False)):
        got = I.bootstrap_kappa(I.cells(df, "a", "b"), 4000, 3, floor=floor).first()
        assert abs(got.kappa - value) < 1e-9 and got.replicates == 4000
        assert max(abs(got.low - low), abs(got.high - high), abs(got.one_sided_high - upper), abs(got.se - se)) < 0.015
        assert got.kappa < got.one_sided_high < got.high and got.below_floor == below


def test_difference_is_bca_over_exact_draws(spark):
    truth, one, two = sample()
    df = spark.createDataFrame([(int(a), int(b), int(c)) for a, b, c in zip(truth, one, two)], "truth int, one int, two int")
    value, (low, high), se = plain((truth, one, two), I._kappa_difference, (0.025, 0.975))
    got = I.paired_difference(df, 4000, 3).first()
    assert abs(got.difference - value) < 1e-9 and got.replicates == 4000
    assert max(abs(got.low - low), abs(got.high - high), abs(got.se - se)) < 0.015
    assert tuple(I.paired_difference(df.repartition(7), 4000, 3).first()) == tuple(got)


def test_undefined_kappa_has_no_bounds(spark):
    df = spark.createDataFrame([(1, 1)] * 5, "a int, b int")
    got = I.bootstrap_kappa(I.cells(df, "a", "b"), 100, 3).first()
    assert got.low is None and got.one_sided_high is None and got.below_floor is None
