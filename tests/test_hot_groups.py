"""Operators whose work must not grow with the square of a group, and exact tails."""

import time
from collections import Counter
from itertools import combinations
from math import comb

import numpy as np
from pyspark.sql import functions as F

from routecast.operators import agreement as A
from routecast.operators import checks as C


def exact_tail(k, n):
    term, total = comb(n, k), 0
    for i in range(k, n + 1):
        total += term
        term = term * (n - i) // (i + 1)
        if term.bit_length() < total.bit_length() - 80:
            break
    return total / 2**n


def tails(spark, pairs):
    df = spark.createDataFrame([(i, k, n) for i, (k, n) in enumerate(pairs)], "i int, k long, n long")
    return [r.t for r in df.select("i", A.upper_tail(F.col("k"), F.col("n")).alias("t")).orderBy("i").collect()]


def test_tail_equals_the_exact_sum(spark):
    r = np.random.default_rng(1)
    pairs = [(k, n) for n in range(41) for k in range(n + 1)] + [(int(r.integers(0, n + 1)), n) for n in (57, 100, 333, 999, 1001, 5000) for _ in range(30)]
    for (k, n), got in zip(pairs, tails(spark, pairs)):
        want = exact_tail(k, n)
        assert abs(got - want) <= 1e-11 * want + 1e-15, (k, n, got, want)


def test_tail_of_a_million(spark):
    pairs = [(500_000, 10**6), (500_001, 10**6), (500_700, 10**6), (502_000, 10**6), (499_000, 10**6), (510_000, 10**6), (10**6, 10**6), (0, 10**6)]
    for (k, n), got in zip(pairs, tails(spark, pairs)):
        want = exact_tail(k, n) if 2 * k > n else 1 - exact_tail(n - k + 1, n)
        assert abs(got - want) <= 1e-9 * want


def left_out(ratings, truth, rater):
    """Cells of both branches without a rater, plainly."""
    levels = {}
    for p, r, level in ratings:
        if r != rater:
            levels.setdefault(p, []).append(level)
    out = Counter()
    for p, ls in levels.items():
        if p in truth:
            ls.sort()
            out.update([("lower", truth[p], ls[(len(ls) - 1) // 2]), ("upper", truth[p], ls[len(ls) // 2])])
    return out


def check_left_out(spark, ratings, truth, raters):
    df = spark.createDataFrame([(*x, 0) for x in ratings], "prompt long, rater long, rating_level int, response_time_ms long")
    t = spark.createDataFrame(list(truth.items()), "prompt long, truth_level int")
    got = {(r.removed, r.branch): r for r in A.leave_one_out(df, t).collect()}
    for rater in raters:
        want = left_out(ratings, truth, rater)
        for branch in ("lower", "upper"):
            cells = {(a, b): n for (br, a, b), n in want.items() if br == branch}
            r = got[rater, branch]
            assert r.n == sum(cells.values()) and r.fp == sum(n for (a, b), n in cells.items() if a < 3 <= b) and r.fn == sum(n for (a, b), n in cells.items() if b < 3 <= a)
            o = sum(abs(a - b) * n for (a, b), n in cells.items())
            assert int(r.numerator) == int(r.denominator) - r.n * o
    return got


def test_leave_one_out_small(spark):
    r = np.random.default_rng(6)
    ratings = [(p, x, int(r.integers(0, 6))) for p in range(30) for x in r.choice(8, int(r.integers(1, 6)), replace=False).tolist()] + [(0, 99, 5), (40, 3, 1), (41, 3, 2), (2, 5, 0), (2, 5, 5)]
    truth = {p: int(r.integers(0, 6)) for p in range(41)}
    got = check_left_out(spark, ratings, truth, {x for _, x, _ in ratings})
    assert len(got) == 2 * len({x for _, x, _ in ratings})


def test_ten_thousand_raters_on_one_prompt(spark):
    r = np.random.default_rng(7)
    ratings = [(1, x, int(r.integers(0, 6))) for x in range(10_000)] + [(2, x, 3) for x in range(3)]
    began = time.perf_counter()
    got = check_left_out(spark, ratings, {1: 4, 2: 0}, [0, 1, 2, 77, 9_999])
    assert len(got) == 20_000 and time.perf_counter() - began < 300


def test_overlap_with_one_prompt_of_most_rows(spark):
    r = np.random.default_rng(8)
    rows = {(int(x), "hot") for x in range(700)} | {(int(r.integers(0, 700)), f"p{int(r.integers(0, 300))}") for _ in range(900)}
    want = Counter()
    for p in {p for _, p in rows}:
        want.update(combinations(sorted(x for x, q in rows if q == p), 2))
    df = spark.createDataFrame([*rows, *list(rows)[:50], (None, "hot"), (3, None)], "participant_id long, prompt_id string")
    got = {(x.a, x.b): x.shared for x in C.pair_overlap(df, most=64).collect()}
    assert got == dict(want)
    assert C.pair_overlap(df.where("false")).count() == 0


def test_missing_votes_by_counting(spark):
    rows = [("a", 1, None, "yes"), ("a", None, 1, "no"), ("a", 9, None, "yes"), ("b", None, 2, "maybe"), ("b", None, 3, None), ("c", 1, 7, "no"), ("c", 2, None, "borderline"), ("c", 3, None, "yes")]
    got = {(r.rater, r.fault): r.n for r in C.vote_faults(spark.createDataFrame(rows, "rater string, key int, id int, vote string"), spark.createDataFrame([(1,), (2,), (3,), (3,)], "id int")).collect()}
    assert got == {("a", "repeated"): 1, ("a", "unknown"): 1, ("a", "missing"): 2, ("b", "missing"): 1, ("b", "vote"): 2}
