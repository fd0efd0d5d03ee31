"""Majorities, medians and Fleiss' kappa of any number of ratings, against plain loops."""

import random
import statistics
from collections import Counter

import pytest

from routecast.operators import agreement as A
from routecast.operators import panel as P
from pyspark.sql import functions as F


def _votes():
    rng = random.Random(4)
    rows = [(i, rng.choice(["yes", "no", "borderline", None])) for i in range(400) for _ in range(rng.randint(1, 9))]
    return rows + [(1000, rng.choice(["yes", "no"])) for _ in range(3000)]  # one item holds most of the votes


def test_majority_of_any_number(spark):
    rows = _votes()
    by = {}
    for i, v in rows:
        by.setdefault(i, []).append(v)

    def plain(votes):
        return next((v == "yes" for v in ("yes", "no") if votes.count(v) >= max(2, len(votes) // 2 + 1)), None)

    got = spark.createDataFrame(rows, "item long, vote string").groupBy("item").agg(P.majority(F.col("vote")).alias("m")).collect()
    assert {r.item: r.m for r in got} == {i: plain(v) for i, v in by.items()}


def test_medians_of_any_number(spark):
    rng = random.Random(5)
    rows = [(i, r, rng.choice([0, 1, 2, 3, 4, 5, 5])) for i in range(200) for r in range(rng.randint(1, 8))] + [(300, r, rng.randint(0, 5)) for r in range(2500)] + [(301, 0, None)]
    by = {}
    for i, _, level in rows:
        if level is not None:
            by.setdefault(i, []).append(level)
    df = spark.createDataFrame(rows, "prompt long, rater long, rating_level int")
    got = {r.prompt: tuple(r)[1:] for r in P.prompt_ratings(df, raters=None).collect()}
    assert got == {i: (statistics.median_low(v), 2 * sum(x >= 3 for x in v) > len(v), True) for i, v in by.items()}
    three = {r.prompt: tuple(r)[1:] for r in P.prompt_ratings(df).collect()}
    assert three == {i: x for i, x in got.items() if len(by[i]) == 3}


def test_fleiss_of_uneven_items(spark):
    rows = [(i, v) for i, v in _votes() if v is not None]
    by = {}
    for i, v in rows:
        by.setdefault(i, Counter())[v] += 1
    seen = [sum(n * (n - 1) for n in c.values()) / (c.total() * (c.total() - 1)) for c in by.values() if c.total() > 1]
    observed, every = sum(seen) / len(seen), Counter(v for _, v in rows)
    chance = sum((n / len(rows)) ** 2 for n in every.values())
    df = spark.createDataFrame(rows, "item long, vote string")
    assert A.fleiss(df, "item", "vote", uneven=True).first().kappa == pytest.approx((observed - chance) / (1 - chance))
    assert A.fleiss(df, "item", "vote").first().kappa is None
    assert A.fleiss(df.limit(1), "item", "vote", uneven=True).first().kappa is None
