"""Quantiles, preceding rows and runs spread over tasks, against plain Python."""

import random
import statistics

from routecast.operators import logs, prefix


def test_quantiles_of_groups(spark):
    """A group with most rows, one row, equal values, nulls only, and a null group."""
    rng = random.Random(5)
    rows = [("hot", rng.randrange(50) / 4) for _ in range(3000)] + [("one", 2.5)] + [("same", 1.0)] * 7 + [("none", None)] * 3 + [(None, float(i)) for i in range(6)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: (r.a, r.b, r.c) for r in prefix.quantiles(df, "v", {"a": 0.25, "b": 0.5, "c": 0.75}, ["g"]).collect()}
    want = {}
    for g in {g for g, _ in rows} - {"none"}:
        v = [x for h, x in rows if h == g]
        want[g] = tuple(statistics.quantiles(v, n=4, method="inclusive")) if len(v) > 1 else (v[0],) * 3
    assert got == want
    base = df.groupBy("g").count()
    assert {r.g: r.b for r in prefix.with_quantiles(base, df, "v", {"b": 0.5}, ["g"]).collect()} == {**{g: w[1] for g, w in want.items()}, "none": None}
    assert prefix.quantiles(df.where("false"), "v", {"b": 0.5}).collect()[0].b is None


def test_preceding_rows(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["hot"] * 9 + ["b", None]), i, rng.choice([None, *range(9)])) for i in range(2000)]
    rng.shuffle(rows)
    out = prefix.preceding(spark.createDataFrame(rows, "g string, i int, v int"), ["i"], "v", "was", ["g"]).collect()
    last, want = {}, {}
    for g, i, v in sorted(rows, key=lambda r: r[1]):
        want[i] = last.get(g)
        last[g] = v
    assert {r.i: r.was for r in out} == want and len(out) == len(rows)


def test_error_runs_of_one_hot_source(spark):
    rng = random.Random(7)
    rows = [("hot" if i % 20 else "cold", i, rng.random() < 0.8) for i in range(3000)]
    got = {r.key: (r.longest, r.total) for r in logs.error_runs(spark.createDataFrame(rows, "key string, seq int, error boolean"), "key", ["seq"]).collect()}
    want = {}
    for k in ("hot", "cold"):
        flags = "".join("e" if e else " " for h, _, e in rows if h == k)
        want[k] = (max(map(len, flags.split())), flags.count("e"))
    assert got == want
