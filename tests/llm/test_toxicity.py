import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from routecast.llm import toxicity


def test_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = toxicity.op5_toxicity(docs, labels).cache()
    assert got.count() == docs.count()
    rows = got.join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    held = [r for r in rows if r.held_out]
    caught = [r for r in held if r.predicted]
    assert sum(r.toxic for r in caught) > 0.95 * len(caught)
    assert len(caught) > 0.75 * sum(r.toxic for r in held)


def test_score_by_hand():
    r = np.random.default_rng(0)
    m = toxicity.Machine(0.3, r.normal(size=6), r.normal(size=(6, 3)))
    rows = [[], [2], [0, 3, 5]]
    for row, got in zip(rows, m.score(rows)):
        raw = 0.3 + sum(m.linear[i] for i in row) + sum(m.factors[i] @ m.factors[j] for i in row for j in row if i < j)
        assert got == pytest.approx(1 / (1 + np.exp(-raw)))


def test_learns_a_pair():
    """The label is set only where both terms meet, which no additive weights express with these counts."""
    rows = [[0, 1]] * 40 + [[0]] * 40 + [[1]] * 40 + [[]] * 40
    labels = np.array([1.0] * 40 + [0.0] * 40 + [0.0] * 40 + [1.0] * 40)
    m = toxicity.fit(rows, labels, slots=2, epochs=1500)
    got = m.score([[0, 1], [0], [1], []])
    assert got[0] > 0.7 and got[3] > 0.7 and got[1] < 0.3 and got[2] < 0.3


def test_a_label_that_only_a_pair_tells(spark, make_docs):
    """Through the query: each of four words is in half of both classes; which two meet is the label. One text fills a third of the rows."""
    r = np.random.default_rng(1)
    rows, labels = [], []
    for i in range(3000):
        a, b = r.integers(0, 2, 2)
        words = [*r.choice([f"wort{k}x" for k in range(400)], 40), f"insult{'ab'[a]}", f"group{'ab'[b]}"]
        r.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(a == b)))
    rows += [(10_000 + i, rows[0][1]) for i in range(1500)]
    got = toxicity.op5_toxicity(make_docs(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    want = {i: t for i, _, t in labels}
    held = [r for r in got if r.held_out and r.doc_id in want]
    assert len(held) > 900 and sum(r.predicted == want[r.doc_id] for r in held) > 0.95 * len(held)
    assert len({r.score for r in got if r.doc_id >= 10_000}) == 1


def test_sample_is_bounded(spark, make_docs):
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(4000)] * 2, "doc_id long, quality int, toxic int")
    got = [r.doc_id for r in toxicity.sample_of(labels, 500).collect()]
    assert len(got) == len(set(got)) == 500
    same = {r.doc_id for r in toxicity.sample_of(labels.repartition(7), 500).collect()}
    assert same == set(got)
    docs = make_docs([(i % 10, f"text {i} of many") for i in range(300)])
    machine = toxicity.learn(docs, labels)  # thirty texts to an id: one of them is learned from
    assert np.isfinite(machine.bias)


def test_odd_rows(make_docs, odd_rows, spark):
    df = make_docs(odd_rows).withColumn("score", F.lit("x")).withColumn("toxic", F.lit(5))
    labels = spark.createDataFrame([(1, 1, 1), (4, 1, 0), (4, 0, 1), (None, 1, 1), (6, 1, None), (8, 0, 0)], "doc_id long, quality int, toxic int")
    for lab in (labels, labels.limit(0)):
        got = toxicity.op5_toxicity(df, lab).collect()
        assert len(got) == len(odd_rows) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.op5_toxicity(df.limit(0), labels).count() == 0


def test_rare_pairs_tell(spark, make_docs):
    """Through the query: of four rare words two pairs are toxic and the crossed ones are not, each in some 30 learned rows, which no additive weights express."""
    pairs = [("insultfoo", "groupbar", 1), ("offencebaz", "peoplequx", 1), ("insultfoo", "peoplequx", 0), ("offencebaz", "groupbar", 0)]
    rows, want = [], {}
    for i in range(1500):
        rest = ["fine", "well", "good"][i % 3]
        if i < 180:
            a, b, want[i] = pairs[i % 4]
            rest = f"{a} {b} {rest}"
        rows.append((i, rest))
    labels = [(i, 1, want.get(i, 0)) for i, _ in rows]
    got = {r.doc_id: r for r in toxicity.op5_toxicity(make_docs(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    learned = [sum(zlib.crc32(str(i).encode()) % 3 != 1 for i in range(k, 180, 4)) for k in range(4)]
    assert max(learned) <= 35
    held = [(got[i].predicted, want.get(i, 0)) for i, _ in rows if got[i].held_out]
    assert sum(t for _, t in held) >= 20 and all(p == t for p, t in held)


def test_every_term_met_has_a_vector(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    machine = toxicity.learn(docs, labels)
    terms = toxicity.Terms()
    met = np.unique(np.concatenate([terms(r.text) for r in docs.join(labels, "doc_id").collect()]))
    assert len(met) > 10_000 and (np.abs(machine.factors[met]).max(1) > 0).all()
