"""Resampling, robust regression and mixtures."""

from __future__ import annotations

from collections.abc import Callable
from math import comb, exp, lgamma, log, log1p
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routecast.operators.agreement import cells


def _kappa(w: np.ndarray) -> np.ndarray:
    """Weighted kappa of stacks of 6 x 6 tables."""
    d = np.abs(np.subtract.outer(range(w.shape[-1]), range(w.shape[-1])))
    n, o = w.sum((-2, -1)), (w * d).sum((-2, -1))
    e = np.einsum("...i,...j,ij->...", w.sum(-1), w.sum(-2), d)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(e > 0, (e - n * o) / e, np.nan)


def _tau_b(w: np.ndarray) -> np.ndarray:
    """Kendall's tau-b of stacks of two-way tables; nan where a side is constant."""
    upto = w.cumsum(-1).cumsum(-2)
    more = lambda t: np.pad(t[..., ::-1, ::-1].cumsum(-1).cumsum(-2)[..., ::-1, ::-1][..., 1:, 1:], [(0, 0)] * (t.ndim - 2) + [(0, 1), (0, 1)])
    concordant = (w * more(w)).sum((-2, -1))
    discordant = (w[..., ::-1] * more(w[..., ::-1])).sum((-2, -1))
    n = upto[..., -1, -1]
    untied = lambda margin: (n * n - (margin**2).sum(-1)) / 2
    below = np.sqrt(untied(w.sum(-1)) * untied(w.sum(-2)))
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(below > 0, (concordant - discordant) / below, np.nan)


def _alpha(w: np.ndarray, raters: int) -> np.ndarray:
    """Ordinal Krippendorff alpha of stacks of tables with an axis for each rater; nan without expected disagreement."""
    levels = w.shape[-1]
    counts = np.stack([sum((np.indices((levels,) * raters)[r] == a) for r in range(raters)) for a in range(levels)], -1).reshape(-1, levels)
    pairs = counts[:, :, None] * counts[:, None, :] - np.einsum("ca,ab->cab", counts, np.eye(levels))
    o = np.tensordot(w.reshape(*w.shape[:-raters], -1), pairs / (raters - 1), 1)
    c = o.sum(-1)
    upto, total = c.cumsum(-1), c.sum(-1)
    lo, hi = np.minimum.outer(range(levels), range(levels)), np.maximum.outer(range(levels), range(levels))
    between = upto[..., hi] - upto[..., lo] + c[..., lo] - (c[..., lo] + c[..., hi]) / 2
    d = between**2
    expected = c[..., :, None] * c[..., None, :] - np.eye(levels) * c[..., None, :]
    with np.errstate(invalid="ignore", divide="ignore"):
        e = (expected * d).sum((-2, -1)) / (total - 1)
        return np.where((total > 1) & (e > 0), 1 - (o * d).sum((-2, -1)) / e, np.nan)


def _pi(w: np.ndarray) -> np.ndarray:
    """Scott's pi of stacks of 2 x 2 tables; with chance agreement 1 it is 1 if both always agree, else 0."""
    n = w.sum((-2, -1))
    with np.errstate(invalid="ignore", divide="ignore"):
        p = (w.sum(-1)[..., 1] + w.sum(-2)[..., 1]) / (2 * n)
        chance, seen = p * p + (1 - p) ** 2, (w[..., 0, 0] + w[..., 1, 1]) / n
        return np.where(n == 0, np.nan, np.where(chance == 1, (seen == 1).astype(float), (seen - chance) / (1 - chance)))


#: Statistics of a table of counts (an axis for each column): of stacks of tables, by name.
STATISTICS: dict[str, Callable[[np.ndarray, int], np.ndarray]] = {
    "kappa": lambda w, _: _kappa(w), "tau_b": lambda w, _: _tau_b(w), "alpha": _alpha, "pi": lambda w, _: _pi(w), "kappa_difference": lambda w, _: _kappa_difference(w)}


def bootstrap(df: DataFrame, columns: list[str], statistic: str | Callable[[np.ndarray, int], np.ndarray], replicates: int, seed: int, levels: int = 6, per_task: int = 500) -> DataFrame:
    """M21 of any statistic of the contingency cells of `columns` (levels 0, 1, ...): n, value, two-sided and one-sided 95 % BCa bounds, se, replicates.

    Rows are reduced to cells first, so resampling costs the same for any number of rows; rows with a null are left out. The same seed gives
    the same draws for every statistic of the same cells.
    """
    f = STATISTICS[statistic] if isinstance(statistic, str) else statistic
    table = np.zeros((levels,) * len(columns))
    for r in df.select(*columns).dropna().groupBy(*columns).agg(F.count(F.lit(1)).alias("_n")).collect():  # at most levels ** columns cells
        table[tuple(int(x) for x in r[:-1])] = r[-1]
    return _bca(df.sparkSession, table, lambda w: f(w, len(columns)), replicates, seed, per_task, {"low": 0.025, "high": 0.975, "one_sided_low": 0.05, "one_sided_high": 0.95})


def _bca(spark: SparkSession, table: np.ndarray, statistic: Callable[[np.ndarray], np.ndarray], replicates: int, seed: int, per_task: int, bounds: dict[str, float]) -> DataFrame:
    """One row for a table of counts: value, the BCa bounds named in `bounds` (null where not finite), se and replicates.

    Rows of one cell are exchangeable, so a resample is a multinomial draw of cell counts, and the jackknife has one value per
    cell, weighted by its count. Draws are made in blocks of `per_task` replicates, each from its own seeded stream.
    """
    n = int(table.sum())
    blocks = spark.range(0, (replicates + per_task - 1) // per_task, 1, max(1, min(64, replicates // per_task)))

    def draw(batches):
        share = (table / max(n, 1)).ravel()
        for b in batches:
            for block in b["id"]:
                size = min(per_task, replicates - block * per_task)
                t = np.random.default_rng([seed, int(block)]).multinomial(n, share, size).reshape(size, *table.shape)
                yield pd.DataFrame({"value": statistic(t.astype(float))})

    draws = blocks.mapInPandas(draw, "value double").where(~F.isnan("value")).persist()
    value = float(statistic(table))
    below = draws.agg(F.count(F.lit(1)).alias("n"), (F.count_if(F.col("value") < value) + F.count_if(F.col("value") == value) / 2).alias("below"), F.stddev_samp("value").alias("se")).first()
    some = np.argwhere(table > 0)
    left = np.repeat(table[None], len(some), 0)
    left[(np.arange(len(some)), *some.T)] -= 1
    v, w = statistic(left), table[table > 0]
    dev = (v * w).sum() / w.sum() - v if len(some) else np.zeros(0)
    spread = (w * dev**2).sum() ** 1.5 if len(some) else 0.0
    a = float((w * dev**3).sum() / (6 * spread)) if spread else 0.0
    z0 = NormalDist().inv_cdf(min(max(below.below / below.n, 1e-12), 1 - 1e-12)) if below.n else 0.0

    def place(p: float) -> float:
        z = z0 + NormalDist().inv_cdf(p)
        return NormalDist().cdf(z0 + z / (1 - a * z))

    whole = bool(np.isfinite(value) and np.isfinite(a))
    q = draws.agg(*[(F.percentile("value", F.lit(place(p))) if whole else F.lit(None).cast("double")).alias(name) for name, p in bounds.items()])
    return q.select(F.lit(n).alias("n"), F.lit(value).alias("value"), *bounds, F.lit(below.se).cast("double").alias("se"), F.lit(below.n).alias("replicates"))


def bootstrap_kappa(c: DataFrame, replicates: int, seed: int, levels: int = 6, per_task: int = 500, floor: float = 0.5) -> DataFrame:
    """Kappa of cells (a, b, n) with a two-sided and both one-sided 95 % BCa bounds, the standard error, and whether the upper bound is below the adequacy floor."""
    table = np.zeros((levels, levels))
    for r in c.collect():  # at most levels squared cells
        table[r.a, r.b] = r.n
    out = _bca(c.sparkSession, table, _kappa, replicates, seed, per_task, {"low": 0.025, "high": 0.975, "one_sided_low": 0.05, "one_sided_high": 0.95})
    return out.withColumnRenamed("value", "kappa").withColumns({"floor": F.lit(float(floor)), "below_floor": F.col("one_sided_high") < floor})


def _kappa_difference(w: np.ndarray) -> np.ndarray:
    """Kappa of the first less that of the second, of stacks of (truth, one, two) tables."""
    return _kappa(w.sum(-1)) - _kappa(w.sum(-2))


def paired_difference(triples: DataFrame, replicates: int, seed: int, levels: int = 6, per_task: int = 500) -> DataFrame:
    """The difference of two kappas on the same items (truth, one, two): value, two-sided 95 % BCa interval and SE over resamples of at most 216 cells."""
    table = np.zeros((levels, levels, levels))
    for r in triples.select("truth", "one", "two").dropna().groupBy("truth", "one", "two").agg(F.count(F.lit(1)).alias("n")).collect():  # at most levels cubed cells
        table[r.truth, r.one, r.two] = r.n
    out = _bca(triples.sparkSession, table, _kappa_difference, replicates, seed, per_task, {"low": 0.025, "high": 0.975})
    return out.select(F.col("value").alias("difference"), "low", "high", "se", "replicates")


def _beta_cf(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz's scheme)."""
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + num * d, 1 + num / c
            d = 1 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def t_two_sided(t: float, df: int) -> float:
    """P(|T| > |t|) of Student's t."""
    if df <= 0 or t != t:
        return float("nan")
    x = df / (df + t * t)
    a, b = df / 2, 0.5
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log1p(-x)) if 0 < x < 1 else 0.0
    if x >= 1:
        return 1.0
    return front * _beta_cf(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_cf(b, a, 1 - x) / b


def t_quantile(p: float, df: int) -> float:
    """The t with P(|T| > t) = p, by bisection."""
    low, high = 0.0, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if t_two_sided(mid, df) > p else (low, mid)
    return (low + high) / 2


def hc3(df: DataFrame, outcome: str, predictors: list[str], model: str = "model") -> DataFrame:
    """Least squares with HC3 standard errors over complete rows: (model, term, coefficient, se, t, p, low, high, n, r2, fault).

    Pass 1 sums X'X and X'y, pass 2 sums the meat with leverage and residual per row; only p x p sums reach the driver. Faults:
    `rows` (n at most the number of terms) and `rank`.
    """
    terms = ["intercept", *predictors]
    x = [F.lit(1.0), *[F.col(p).cast("double") for p in predictors]]
    d = df.select(F.col(outcome).cast("double").alias("_y"), *[c.alias(f"_x{i}") for i, c in enumerate(x)]).dropna()
    k = len(terms)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    s = d.agg(F.count(F.lit(1)).alias("n"), F.sum("_y").alias("y"), F.sum(F.col("_y") * F.col("_y")).alias("yy"), *[F.sum(F.col(f"_x{i}") * F.col(f"_x{j}")).alias(f"q{i}_{j}") for i, j in pairs],
              *[F.sum(F.col(f"_x{i}") * F.col("_y")).alias(f"c{i}") for i in range(k)]).first()
    spark, schema = df.sparkSession, "model string, term string, coefficient double, se double, t double, p double, low double, high double, n long, r2 double, fault string"
    fault = lambda why: spark.createDataFrame([(model, t, None, None, None, None, None, None, s.n, None, why) for t in terms], schema)
    if s.n <= k:
        return fault("rows")
    q, c = np.zeros((k, k)), np.array([s[f"c{i}"] for i in range(k)])
    for i, j in pairs:
        q[i, j] = q[j, i] = s[f"q{i}_{j}"]
    scale = np.sqrt(np.diag(q))
    if (scale == 0).any() or np.linalg.matrix_rank(q / np.outer(scale, scale)) < k:
        return fault("rank")
    inv = np.linalg.inv(q)
    beta = inv @ c
    dot = lambda v: sum((F.col(f"_x{i}") * float(v[i]) for i in range(1, k)), F.col("_x0") * float(v[0]))
    lever = sum((F.col(f"_x{i}") * dot(inv[i]) for i in range(1, k)), F.col("_x0") * dot(inv[0]))
    e = F.col("_y") - dot(beta)
    d2 = d.withColumn("_e", e).withColumn("_w", F.pow(F.col("_e") / (1 - lever), F.lit(2)))
    m = d2.agg(F.sum(F.col("_e") * F.col("_e")).alias("rss"), *[F.sum(F.col("_w") * F.col(f"_x{i}") * F.col(f"_x{j}")).alias(f"m{i}_{j}") for i, j in pairs]).first()
    meat = np.zeros((k, k))
    for i, j in pairs:
        meat[i, j] = meat[j, i] = m[f"m{i}_{j}"]
    se = np.sqrt(np.diag(inv @ meat @ inv))
    free, total = s.n - k, s.yy - s.y * s.y / s.n
    wide = t_quantile(0.05, free)
    rows = [(model, t, float(b), float(u), float(b / u), t_two_sided(float(b / u), free), float(b - wide * u), float(b + wide * u), s.n, float(1 - m.rss / total) if total > 0 else None, None) for t, b, u in zip(terms, beta, se)]
    return spark.createDataFrame(rows, schema)


def model_grid(df: DataFrame, models: dict[str, list[str]], outcomes: list[str]) -> DataFrame:
    """HC3 fits of every model for every outcome."""
    out = None
    for y in outcomes:
        for name, predictors in models.items():
            one = hc3(df, y, predictors, name).withColumn("outcome", F.lit(y))
            out = one if out is None else out.unionByName(one)
    return out


def rate_mixture(df: DataFrame, segment: str = "segment", points: int = 201, steps: int = 500, tolerance: float = 1e-10) -> DataFrame:
    """Per segment a distribution of success rates on a grid by EM from the (k, c) histogram.

    (segment, n, mean, true_variance, noise_variance, reliability, max_correlation, nll_floor). Spark reduces rows to the histogram, whose size
    is bounded by the distinct (k, c); segments are fitted in parallel.
    """
    h = df.groupBy(segment, "k", "correct_count").agg(F.count(F.lit(1)).alias("n"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["k", "correct_count"])
        k, c, n = pdf["k"].to_numpy(), pdf["correct_count"].to_numpy(), pdf["n"].to_numpy(float)
        grid = np.linspace(0, 1, points)
        with np.errstate(divide="ignore", invalid="ignore"):
            like = np.array([comb(int(kk), int(cc)) * grid**cc * (1 - grid) ** (kk - cc) for kk, cc in zip(k, c)])
        w = np.full(points, 1 / points)
        before = -np.inf
        for _ in range(steps):
            mass = like * w
            total = mass.sum(1)
            now = (n * np.log(total)).sum() / n.sum()
            w = (n[:, None] * mass / total[:, None]).sum(0) / n.sum()
            if now - before < tolerance:
                break
            before = now
        mean = (w * grid).sum()
        true = (w * (grid - mean) ** 2).sum()
        noise = (w * grid * (1 - grid)).sum() * (n / k).sum() / n.sum()
        p = np.clip(grid, 1e-9, 1 - 1e-9)
        floor = -(w * (grid * np.log(p) + (1 - grid) * np.log1p(-p))).sum() * (n * k).sum() / n.sum()
        reliability = true / (true + noise) if true + noise > 0 else np.nan
        return pd.DataFrame({segment: [pdf[segment].iloc[0]], "n": [int(n.sum())], "mean": [mean], "true_variance": [true], "noise_variance": [noise],
                             "reliability": [reliability], "max_correlation": [np.sqrt(reliability)], "nll_floor": [floor]})

    return h.groupBy(segment).applyInPandas(fit, f"{segment} string, n long, mean double, true_variance double, noise_variance double, reliability double, max_correlation double, nll_floor double")


__all__ = ["bootstrap_kappa", "cells", "hc3", "model_grid", "paired_difference", "rate_mixture", "t_quantile", "t_two_sided"]
