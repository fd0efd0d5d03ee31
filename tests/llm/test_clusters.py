import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from routecast.llm import clusters

SCHEMA = "vec_id long, embedding array<float>, label int"
SF = "/root/testdata/sf0.001"


def brute(rows):
    """Rows of the contract from (vec_id, components) with plain integers."""
    kept = [(i, [int(np.floor(64 * float(c))) for c in v]) for i, v in rows if v is not None and len(v) == 64 and all(c is not None and np.isfinite(c) for c in v)]
    ids = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    centres = [v for _, v in ids[:16]]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))

    def assign():
        return [min((square(v, c), j) for j, c in enumerate(centres)) for _, v in kept]

    for _ in range(3):
        got = assign()
        for j in range(len(centres)):
            mine = [v for (_, v), (_, k) in zip(kept, got) if k == j]
            if mine:
                centres[j] = [sum(x) // len(mine) for x in zip(*mine)]
    got = assign()
    per = {j: sum(d for d, k in got if k == j) for _, j in got}
    return sorted(((i, j, d, per[j], sum(per.values()), hashlib.sha256(",".join(map(str, centres[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, got)), key=str)


def found(df):
    return sorted((tuple(r) for r in clusters.op12_centroids(df).collect()), key=str)


def test_whole_table(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    assert found(df.repartition(5)) == brute([(r.vec_id, r.embedding) for r in df.collect()])


def test_copies_and_ties(spark):
    r = np.random.default_rng(2)
    base = [[float(x) for x in r.integers(-3, 4, 64) / 64] for _ in range(12)]
    rows = [(i, base[i % 12 if i % 3 else 0], i) for i in range(120)] + [(7, base[1], 0), (7, base[1], 0)]
    assert found(spark.createDataFrame(rows, SCHEMA).repartition(4)) == brute([x[:2] for x in rows])


@pytest.mark.parametrize("n", [0, 1, 2, 15])
def test_few_vectors(spark, n):
    r = np.random.default_rng(n)
    rows = [(i, [float(x) for x in r.random(64)], 0) for i in range(n)]
    assert found(spark.createDataFrame(rows, SCHEMA)) == brute([x[:2] for x in rows])


def test_odd_vectors(spark):
    r = np.random.default_rng(9)
    good = [(i, [float(np.float32(x)) for x in r.normal(size=64)], 0) for i in range(40)]
    odd = [(100, None, 0), (101, [], 0), (102, [0.0] * 63, 0), (103, [0.0] * 63 + [None], 0), (104, [float("nan")] * 64, 0), (105, [float("-inf")] + [0.0] * 63, 0)]
    none = [(None, [0.5] * 64, 0)]
    df = spark.createDataFrame(good + odd + none, SCHEMA)
    from pyspark.sql import functions as F

    assert found(df.withColumn("cluster", F.lit("x")).withColumn("v", F.lit(1))) == brute([x[:2] for x in good + odd + none])
    huge = found(df.union(spark.createDataFrame([(200, [3e30] + [0.0] * 63, 0)], SCHEMA)))
    want = brute([x[:2] for x in good + none])
    assert [x for x in huge if x[0] != 200] == want
    assert [x for x in huge if x[0] == 200] == [(200, None, None, None, want[0][4], None)]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(2, 9), st.integers(1, 4))
def test_search_keeps_its_bounds(seed, k, spread):
    """Nearest and distance are those of a full search, from any memory; the bound is below all but the nearest; less is looked at."""
    r = np.random.default_rng(seed)
    at = r.integers(-spread, spread + 1, (k, 3))
    v = r.integers(-spread - 1, spread + 2, (50, 3))
    d = ((v[:, None] - at[None]) ** 2).sum(2)
    own = r.integers(0, k, 50)
    second = (own + r.integers(1, k, 50)) % k
    lower = np.zeros(50)
    for _ in range(3):
        near = clusters.Neighbours(at)
        own, second, lower, best, looked = clusters.shallot(v, near, own, second, lower)
        want = d.argmin(1)
        assert (own == want).all() and (best == d.min(1)).all() and (own != second).all()
        rest = np.where(np.arange(k) == own[:, None], np.inf, np.sqrt(d.astype(float))).min(1)
        assert (lower <= rest).all() and looked <= 50 * k
        old, at = at, at + r.integers(-1, 2, at.shape)
        moved = np.sqrt(((at - old) ** 2).sum(1).astype(float)) * clusters.WIDER
        lower = np.maximum(0, lower - np.array([np.delete(moved, j).max() for j in range(k)])[own] * clusters.WIDER)
        d = ((v[:, None] - at[None]) ** 2).sum(2)


def test_bounds_spare_most_comparisons():
    r = np.random.default_rng(1)
    centres = r.integers(-1000, 1000, (16, 64))
    v = centres[r.integers(0, 16, 4000)] + r.integers(-60, 61, (4000, 64))
    near = clusters.Neighbours(centres)
    first = clusters.shallot(v, near, np.zeros(4000, np.int64), np.ones(4000, np.int64), np.zeros(4000))
    again = clusters.shallot(v, near, *first[:3])
    assert again[4] == 4000 and (again[0] == first[0]).all() and first[4] < 4000 * 16
