"""The pipeline's stages against plain versions of the same decisions, each on its own input."""

import re
from collections import defaultdict

import corpus_pipeline as pipeline
from pyspark.sql import functions as F

from tests.llm.test_packing import check as check_pieces
from tests.llm.test_secrets import base
from tests.llm.test_simhash import classes

SMALL = 120


def step(spark, name, df):
    return dict(pipeline.STAGES)[name](spark, df, "")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def stripped(rows):
    raw = [(float("inf") if r[0] is None else r[0], (r[1] or "").encode()) for r in rows]
    least = {}
    for d, b in raw:
        for p in range(len(b) - 49):
            least[b[p:p + 50]] = min(d, least.get(b[p:p + 50], d))
    out = []
    for r, (d, b) in zip(rows, raw):
        gone = set()
        for p in range(len(b) - 49):
            if least[b[p:p + 50]] < d:
                gone.update(range(p, p + 50))
        text = bytes(c for i, c in enumerate(b) if i not in gone).decode("utf-8", "ignore") if gone else r[1]
        out.append((r[0], text, *r[2:4], len(text) if gone else r[4]))
    return sorted(out, key=str)


def test_stages_one_by_one(spark, documents):
    docs = documents.orderBy("doc_id").limit(SMALL).withColumn("extra", F.lit(1)).withColumn("score", F.lit("x")).cache()
    have = rows_of(docs.select(*pipeline.COLUMNS))
    one = step(spark, "language", docs).cache()
    assert one.columns == pipeline.COLUMNS
    assert rows_of(one) == [r for r in have if re.search(r"[^\W\d_]", r[1] or "")]
    two = step(spark, "near_dedup", one).cache()
    rows = rows_of(one)
    stay = {d for d, _, c in classes([(r[0], r[1]) for r in rows]) if d == c}
    assert two.columns == pipeline.COLUMNS and rows_of(two) == [r for r in rows if r[0] in stay]
    assert len(stay) < len(rows)
    three = step(spark, "repeats", two).cache()
    assert three.columns == pipeline.COLUMNS and rows_of(three) == stripped(rows_of(two))
    four = step(spark, "secrets", three).cache()
    assert four.columns == pipeline.COLUMNS and four.count() == three.count()
    before = {r[0]: r[1] for r in rows_of(three)}
    for d, text, *_, n in rows_of(four):
        assert n == len(text) and not base(text)
        if not base(before[d]):
            assert text == before[d] or "[SECRET]" in text
    five = step(spark, "packing", four)
    check_pieces([(r[0], r[1]) for r in rows_of(four)], five.collect())


def test_run(spark):
    got = pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert got and len({(r.sequence_id, r.offset) for r in got}) == len(got)
    by = defaultdict(int)
    for r in got:
        by[r.doc_id] += r.length
    assert all(by[r.doc_id] == r.doc_tokens for r in got)


def test_odd_rows(spark, make_docs, odd_rows):
    df = make_docs(odd_rows)
    for name, _ in pipeline.STAGES:
        df = step(spark, name, df)
    assert {1, 2, 3}.isdisjoint({r.doc_id for r in df.collect()})
    empty = make_docs(odd_rows).limit(0)
    for name, _ in pipeline.STAGES:
        empty = step(spark, name, empty)
    assert empty.count() == 0


def test_near_dedup_of_rows_that_share_an_id(spark, make_docs):
    """Two texts under one id are judged apart, null ids stay, and one text in most rows leaves one row."""
    one, two, three = ("a short story about a river and a boat", "quite another text on the price of salt", "the third text is neither of them at all")
    rows = [(7, one), (7, two), (3, two), (9, three), (9, three), (None, one), (None, one), (4, None), *[(100 + i, three) for i in range(200)]]
    got = step(spark, "near_dedup", make_docs(rows)).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted([(7, one), (3, two), (9, three), (None, one), (None, one), (4, None)], key=str)
