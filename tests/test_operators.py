"""Undefined branches, hand-made cases and properties of the reference operators."""

import json
import random
import unicodedata
from math import comb

import pytest
from pyspark.sql import functions as F

from routecast.functions import expr as X
from routecast.functions.text import normal_key
from routecast.operators import agreement as A
from routecast.operators import checks as C
from routecast.operators import families as FM
from routecast.operators import inference as I
from routecast.operators import logs as L
from routecast.operators import panel as P
from routecast.operators import sampling as S
from routecast.operators import scenarios as E
from routecast.operators import scoring as M
from routecast.operators import telemetry as T
from routecast.sources import records as R


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def pairs(spark, rows):
    return A.cells(spark.createDataFrame(rows, "t int, s int"), "t", "s")


def test_kappa_branches(spark):
    same, apart = pairs(spark, [(2, 2)] * 3), pairs(spark, [(1, 4)] * 3)
    assert one(A.weighted_kappa(same)).kappa is None
    assert one(A.weighted_kappa(same, zero="one")).kappa == 1.0
    assert one(A.weighted_kappa(apart)).kappa == 0.0
    mixed = [(0, 0), (1, 2), (5, 3), (4, 4), (2, 2)]
    n, o = len(mixed), sum(abs(a - b) for a, b in mixed)
    e = sum(abs(a - b) for a, _ in mixed for _, b in mixed)
    got = one(A.weighted_kappa(pairs(spark, mixed)))
    assert (int(got.numerator), int(got.denominator)) == (e - n * o, e)


def test_tau_b_against_pairs(spark):
    r = random.Random(3)
    rows = [(r.randrange(4), r.randrange(4)) for _ in range(40)]
    got = one(A.tau_b(pairs(spark, rows)))
    sign = lambda x: (x > 0) - (x < 0)
    s = [(sign(a[0] - b[0]), sign(a[1] - b[1])) for i, a in enumerate(rows) for b in rows[:i]]
    con, dis = sum(x * y > 0 for x, y in s), sum(x * y < 0 for x, y in s)
    ta, tb = sum(x == 0 != y for x, y in s), sum(y == 0 != x for x, y in s)
    assert (got.concordant, got.discordant) == (con, dis)
    assert got.tau_b == pytest.approx((con - dis) / ((con + dis + ta) * (con + dis + tb)) ** 0.5)
    assert one(A.tau_b(pairs(spark, [(1, 0), (1, 3)]))).tau_b is None


def test_fleiss_pi_alpha_branches(spark):
    f = lambda rows: one(A.fleiss(spark.createDataFrame(rows, "i int, c string"), "i", "c"))
    assert f([(1, "a"), (1, "a"), (2, "a"), (2, "a")]).kappa == 1.0
    assert not f([(1, "a"), (1, "b"), (2, "a")]).even
    pi = lambda rows: one(A.scotts_pi(spark.createDataFrame(rows, "l boolean, r boolean"), F.col("l"), F.col("r"))).pi
    assert pi([(True, True)]) == 1.0 and pi([(True, False), (False, True)]) == -1.0
    a = lambda rows: one(A.ordinal_alpha(spark.createDataFrame(rows, "u int, l int"), "u", "l")).alpha
    assert a([(1, 2), (1, 2), (2, 2), (2, 2)]) is None
    assert a([(1, 0), (1, 0), (2, 5), (2, 5), (3, 1)]) == 1.0


def test_fences_need_four_and_spread(spark):
    v = lambda xs: spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "r int, v double")
    assert A.iqr_fences(v([1.0, 2.0, 99.0]), "v").count() == 0
    assert A.iqr_fences(v([1.0, 2.0, 3.0, 4.0, 99.0, None]), "v").count() == 0
    assert [r.v for r in A.iqr_fences(v([1.0, 2.0, 3.0, 4.0, 99.0]), "v").collect()] == [99.0]
    assert A.mad_fences(v([1.0, 1.0, 1.0, 1.0, 9.0]), "v").count() == 0
    assert [r.v for r in A.mad_fences(v([1.0, 2.0, 3.0, 4.0, 99.0]), "v").collect()] == [99.0]


def test_leave_one_out_equals_removal(spark):
    r = random.Random(5)
    rows = [(p, k, r.randrange(6)) for p in range(12) for k in r.sample(range(5), 3)]
    ratings = spark.createDataFrame(rows, "prompt int, rater int, rating_level int")
    truth = spark.createDataFrame([(p, r.randrange(6)) for p in range(12)], "prompt int, truth_level int")
    all_out = {(x.removed, x.branch): (x.n, x.kappa, x.fp, x.fn) for x in A.leave_one_out(ratings, truth).collect()}
    for k in range(5):
        for x in A.after_removal(ratings, truth, spark.createDataFrame([(k,)], "rater int")).collect():
            n, kappa, fp, fn = all_out[k, x.branch]
            assert (n, fp, fn) == (x.n, x.fp, x.fn) and kappa == pytest.approx(x.kappa)


def scored(spark, rows):
    return spark.createDataFrame(rows, "correct_count long, k long, probability double")


def test_scoring_branches(spark):
    whole = one(M.likelihoods(scored(spark, [(0, 5, 0.0), (5, 5, 1.0)])))
    assert whole.log_loss == 0 and whole.nll == pytest.approx(0, abs=1e-7)
    assert one(M.likelihoods(scored(spark, [(1, 5, 0.0), (5, 5, 1.0)]))).log_loss is None
    only = one(M.routing(scored(spark, [(5, 5, 0.9)])))
    assert only.macro_f1 is None and only.fpr is None and only.fnr == 0
    bins = {r.bin: r for r in M.reliability_bins(scored(spark, [(1, 2, 1.0), (1, 2, 0.3)])).collect()}
    assert len(bins) == 10 and bins[9].n == 1 and bins[3].n == 1 and bins[5].mean_rate is None


def test_sweep_equals_direct(spark):
    r = random.Random(1)
    rows = [(r.randrange(6), 5, r.randrange(11) / 10) for _ in range(60)]
    for x in M.full_sweep(scored(spark, rows)).collect():
        said = [(2 * c >= k, p >= x.threshold) for c, k, p in rows]
        assert (x.tp, x.fp, x.fn, x.tn) == tuple(said.count(s) for s in ((True, True), (False, True), (True, False), (False, False)))


def test_count_nll_guards(spark):
    df = lambda rows: spark.createDataFrame(rows, "correct_count int, k int, pmf array<double>")
    assert one(M.count_nll(df([(0, 5, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]), (1, 5, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0])]))).note == "zero mass"
    assert one(M.count_nll(df([(0, 4, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0])]))).count_nll is None
    assert one(M.count_nll(df([(0, 5, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0])]))).count_nll == 0


@pytest.mark.parametrize("text,want", [("$5 and $10", "$5 and $10"), ("$x^2$", r"\(x^2\)"), ("$$a\nb$$", "\\[a\nb\\]"), ("$2^n$ or $ $", r"\(2^n\) or $ $"), ("plain", "plain")])
def test_math(spark, text, want):
    assert one(spark.createDataFrame([(text,)], "t string").select(X.math_delimiters(F.col("t")).alias("m"))).m == want


def test_unicode_key(spark):
    texts = ["Straße", "ﬁne", "１２", "a\u00a0b  c", "ΣΑΣ", " plain ASCII ", ""]
    got = [r.k for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(normal_key(F.col("t")).alias("k")).collect()]
    assert got == [" ".join(unicodedata.normalize("NFKC", t).casefold().split()) for t in texts]


def test_panel_and_ratings(spark):
    v = spark.createDataFrame([("1:0", "a", "match"), ("1:0", "b", "match"), ("1:0", "c", "no_answer"), ("1:1", "a", "match")], "key string, judge string, verdict string")
    done, lacking = P.panel(v)
    assert (one(done).correct, one(done).unanimous, one(lacking).key) == (True, False, "1:1")
    r = spark.createDataFrame([(1, "x", 3), (1, "y", 0), (1, "z", 5), (2, "x", 1)], "prompt int, rater string, rating_level int")
    assert tuple(one(P.prompt_ratings(r))) == (1, 3, True, True)


def test_allocation_against_loop(spark):
    pools = {"a": [0, 9, 1, 0, 20, 2], "b": [5, 5, 5, 5, 5, 5], "c": [1, 0, 0, 0, 0, 0], "d": [50, 0, 0, 0, 0, 0]}
    df = spark.createDataFrame([(c, i, n) for c, p in pools.items() for i, n in enumerate(p) if n], "category string, level int, pool int")
    got = {}
    for r in S.allocation(df, 20).collect():
        got.setdefault(r.category, [None] * 6)[r.level] = r["take"]
    assert got["c"] == [None] * 6
    for c in "abd":
        assert sum(got[c]) == 20 and all(t <= p for t, p in zip(got[c], pools[c]))
    assert got["b"] == S.band_targets(20) == [3, 3, 4, 4, 3, 3]
    assert got["d"] == [20, 0, 0, 0, 0, 0]


def test_families_bridge(spark):
    rows = [(1, "x", "p"), (2, "x", "q"), (3, "y", "q"), (4, "z", None), (5, None, None), (6, "w", "r"), (7, "v", "r")]
    f = FM.families(spark.createDataFrame(rows, "id int, a string, b string"), "id", ["a", "b"])
    assert {r.id: r.family for r in f.collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6, 7: 6}
    left = FM.unprotected(spark.createDataFrame([(1,), (2,), (4,)], "id int"), f, spark.createDataFrame([(3,)], "id int"), "id")
    assert [r.id for r in left.collect()] == [4]


def test_long_chain_of_families(spark):
    rows = [(i, f"a{i // 2}", f"b{(i + 1) // 2}") for i in range(60)]
    f = FM.families(spark.createDataFrame(rows, "id int, a string, b string"), "id", ["a", "b"])
    assert {r.family for r in f.collect()} == {0}


def test_attempts(spark):
    df = spark.createDataFrame([(i, c, 5) for i, c in enumerate([0, 1, 3, 5])], "question_id int, correct_count int, k int")
    got = [r.a for r in df.orderBy("question_id").select(E.expected_attempts(F.col("correct_count") / F.col("k"), 6).alias("a")).collect()]
    assert got[0] == 6 and got[3] == 1 and got[1] == pytest.approx(sum(0.8**i for i in range(6)))


def test_counter_wraps(spark):
    rows = [("a", 1, 90, 100), ("a", 2, 5, 100), ("a", 3, 50, 100), ("a", 4, 2, 100), ("b", 1, 7, 100)]
    got = {r.domain: (r.samples, r.wraps, r.total) for r in T.counter_deltas(spark.createDataFrame(rows, "domain string, ts int, value long, max_range long")).collect()}
    assert got == {"a": (4, 2, 15 + 45 + 52), "b": (1, 0, 0)}


def test_hc3_faults_and_t(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i, 1.0 + i + (-1) ** i) for i in range(12)], "a double, b double, y double")
    assert {r.fault for r in I.hc3(df, "y", ["a", "b"]).collect()} == {"rank"}
    assert {r.fault for r in I.hc3(df.limit(2), "y", ["a"]).collect()} == {"rows"}
    assert I.t_two_sided(2.0, 10) == pytest.approx(0.07338803, abs=1e-7)
    assert I.t_quantile(0.05, 10) == pytest.approx(2.22813885, abs=1e-6)


def test_bootstrap_covers_and_mixture(spark):
    r = random.Random(2)
    rows = [(a, min(5, max(0, a + r.choice([-1, 0, 0, 1])))) for a in (r.randrange(6) for _ in range(200))]
    b = one(I.bootstrap_kappa(pairs(spark, rows), 400, 9))
    assert b.low < b.kappa < b.high and b.low < b.one_sided_low and 0.005 < b.se < 0.1
    again = one(I.bootstrap_kappa(pairs(spark, rows), 400, 9))
    assert tuple(again) == tuple(b)
    m = one(I.rate_mixture(spark.createDataFrame([("s", 10, c) for c in range(11) for _ in range(comb(10, c) // 10)], "segment string, k int, correct_count int")))
    assert m.mean == pytest.approx(0.5, abs=1e-6) and m.reliability < 0.1


def test_mcnemar_tail(spark):
    r = one(A.mcnemar(spark.createDataFrame([(7, 2)], "fp long, fn long")))
    assert r.p_false_local == pytest.approx(sum(comb(9, i) for i in range(7, 10)) / 512)


def test_logs(spark):
    rows = [("a", 1, True), ("a", 2, False), ("b", 1, False), ("b", 2, False), ("c", 1, True), ("c", 2, True)]
    log = spark.createDataFrame(rows, "key string, seq int, error boolean")
    assert {r.key for r in L.failed(log, "key", ["seq"]).collect()} == {"c"}
    done, again = L.stage_records(log, "key", ["seq"])
    assert {r.key for r in done.collect()} == {"a", "b"} and [r.key for r in again.collect()] == ["b"]
    assert {r.key: r.longest for r in L.error_runs(log, "key", ["seq"]).collect()} == {"a": 1, "b": 0, "c": 2}
    assert {r.key for r in L.pending(log.select("key").distinct(), log, "key", retry_errors=True).collect()} == {"c"}


def test_faults_are_found(spark):
    assert C.duplicates(spark.createDataFrame([(1,), (1,)], "k int"), "k").count() == 1
    with pytest.raises(ValueError):
        C.enforce(C.duplicates(spark.createDataFrame([(1,), (1,)], "k int"), "k"))
    v = {r.rule: r.n for r in C.violations(spark.createDataFrame([(float("nan"),), (2.0,), (None,), (0.5,)], "p double"), {"range": F.col("p").between(0, 1) & ~F.isnan("p")}).collect()}
    assert v == {"range": 3}
    assert C.vote_faults(spark.createDataFrame([("r", 1, None, "yes")], "rater string, key int, id int, vote string"), spark.createDataFrame([(1,)], "id int")).count() == 0


def test_partitions_do_not_matter(spark):
    rows = [(i, i % 7, 6, (i * 37 % 101) / 100) for i in range(300)]
    df = spark.createDataFrame(rows, "question_id int, correct_count long, k long, probability double")
    seen = {tuple(sorted(map(tuple, M.full_sweep(df.repartition(n)).collect()))) for n in (1, 4, 17)}
    assert len(seen) == 1


def test_running_sums(spark):
    """Against a plain loop: null groups and values, one group with most rows, several partitions."""
    from routecast.operators.prefix import running

    rng = random.Random(3)
    rows = [(g, v, rng.randrange(9)) for g in ("a", None, "b") for v in rng.sample(range(4000), 900 if g == "a" else 40)] + [("b", None, 4)]
    got = running(spark.createDataFrame(rows, "g string, v int, n long"), "v", ["n"], ["g"]).collect()
    assert len(got) == len(rows)
    low = lambda v: -1 if v is None else v
    for r in got:
        mine = [(low(v), n) for g, v, n in rows if g == r.g]
        assert r.n_all == sum(n for _, n in mine) and r.n_upto == sum(n for v, n in mine if v <= low(r.v))


def test_bad_lines_are_numbered(spark, tmp_path):
    text = "".join('{"n": %d}\n' % i if i % 97 else '{"n": \n' for i in range(1, 5001))
    (tmp_path / "a.jsonl").write_text(text)
    (tmp_path / "b.jsonl").write_text("\n\nx\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        got = {(r.file.rsplit("/", 1)[1], r.line) for r in R.bad_lines(spark, str(tmp_path / "*.jsonl"), "n int").collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {("a.jsonl", i) for i in range(97, 5001, 97)} | {("b.jsonl", 3)}


def test_sources(spark, tmp_path):
    lines = tmp_path / "log.jsonl"
    lines.write_text('{"key": "a", "n": 1}\n\n{"key": "b", "n"\n')
    strict = R.read_strict(spark, str(lines), "key string, n int").collect()
    assert sorted(str(r.fault) for r in strict) == ["None", "blank", "malformed"]
    assert {r.key for r in R.read_tolerant(spark, str(lines), "key string, n int").collect() if r.key} == {"a"}
    bad = R.read_records(spark, str(lines), "key string, n int").cache()
    assert bad.where("_corrupt_record is not null").count() == 1
    (tmp_path / "rows.json").write_text(json.dumps([{"key": "a", "n": 1}, {"key": "b", "n": 2}]))
    assert R.read_records(spark, str(tmp_path / "rows.json"), "key string, n int").count() == 2
    (tmp_path / "one.json").write_text('{"key": "a"}')
    assert one(R.read_object(spark, str(tmp_path / "one.json"), "key string")).key == "a"
    with pytest.raises(ValueError):
        R.read_object(spark, str(tmp_path / "rows.json"), "key string")
    for i in (0, 1):
        (tmp_path / f"run/rep{i}").mkdir(parents=True)
        (tmp_path / f"run/rep{i}/x.jsonl").write_text('{"key": "a"}\n')
    reps = R.read_repeats(spark, str(tmp_path / "run"), "key string")
    assert tuple(one(R.contiguous(reps))) == (2, True)
    (tmp_path / "p7.csv").write_text("\ufeffrating,level\nLikely,3\n", encoding="utf-8")
    assert one(R.read_participants(spark, str(tmp_path / "p7.csv"), "rating string, level int")).file_id == "p7"
    (tmp_path / "s.csv").write_text("a,b\n1,2\n1\nx,2\n")
    s = R.read_scenarios(spark, str(tmp_path / "s.csv"), "a int, b int").cache()
    assert s.count() == 3 and s.where("_corrupt_record is not null").count() == 2


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("b", 1.0), ("a", None)], "p string, v double")
    R.write_records(df, str(tmp_path / "k1"))
    with pytest.raises(Exception):
        R.write_records(df, str(tmp_path / "k1"))
    R.write_report({"part": df}, str(tmp_path / "k2"))
    assert {json.loads(r.value)["v"] for r in spark.read.text(str(tmp_path / "k2/part")).collect()} == {1.0, None}
    for bad in (float("nan"), float("inf")):
        with pytest.raises(Exception, match="finite"):
            R.write_report({"part": spark.createDataFrame([(bad,)], "v double")}, str(tmp_path / f"k2-{bad}"))
    R.write_csv(df, str(tmp_path / "k3"), per="p", quote_all=True)
    assert spark.read.option("header", True).csv(str(tmp_path / "k3")).count() == 2
    found = R.digests(spark, str(tmp_path / "k2/part/*.json"))
    pins = found.select("name", F.lit("0").alias("sha256"))
    assert {r.fault for r in R.pin_faults(found, pins).collect()} == {"changed"}
    assert R.pin_faults(found, found.select("name", "sha256")).count() == 0
