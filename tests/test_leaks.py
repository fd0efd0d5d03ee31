"""Answer leaks over a corpus against brute force."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from routecast.operators import leaks
from routecast.operators.leaks import leaked


def brute(items, docs):
    answers = [(i, a.strip(" ").lower()) for i, a in items if a is not None]
    return sorted({(i, d) for i, a in answers if len(a) >= 8 for d, t in docs if t is not None and a in t.lower()}, key=str)


def run(spark, items, docs, parts=4):
    a = spark.createDataFrame(items, "item_id long, answer string")
    t = spark.createDataFrame(docs, "doc_id long, text string").repartition(parts)
    return sorted((tuple(r) for r in leaked(a, t).collect()), key=str)


def test_hard_answers(spark):
    """Short, cased, newline-led, quoted and repeated answers, and one that a third of the texts have."""
    r = np.random.default_rng(8)
    noise = lambda n: "".join("abcde fgh\n"[int(x)] for x in r.integers(0, 10, n))
    items = [(1, "12345678"), (2, "1234567"), (3, "  The Answer Is Here "), (4, "été à la mer"), (5, None), (6, ""), (7, "hot passage of all"), (8, "hot passage of all"), (9, "Hot Passage"), (10, "aaaaaaaaaa"), (11, "\nled by a line"), (None, "12345678")]
    docs = [(100, "x12345678y"), (101, "1234567"), (102, '("the answer is here")'), (103, "THE ANSWER IS here"), (104, "ÉTÉ À LA MER"), (105, None), (106, ""), (107, "a" * 9), (108, "a" * 5000), (109, "z\nled by a line"), (109, "z\nled by a line"), (None, "12345678")]
    docs += [(200 + i, noise(60) + ("Hot passage of ALL" if i % 3 == 0 else "hot passage") + noise(40)) for i in range(300)]
    assert run(spark, items, docs) == brute(items, docs)
    assert run(spark, items[:0], docs) == [] and run(spark, items, docs[:0]) == []


def test_small_alphabet(spark):
    r = np.random.default_rng(3)
    word = lambda lo, hi: "".join("ab "[int(x)] for x in r.integers(0, 3, int(r.integers(lo, hi))))
    items, docs = [(i, word(6, 14)) for i in range(60)], [(i, word(0, 200)) for i in range(80)]
    assert run(spark, items, docs) == brute(items, docs) != []


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(-2**63, 2**63 - 1), max_size=50), st.integers(6, 12))
def test_filter_lets_all_anchors_through(hashes, bits):
    words = np.zeros(1 << bits - 6, np.uint64)
    for h in hashes:
        for at in (h & (1 << bits) - 1, h % 2**64 >> 32 & (1 << bits) - 1):
            words[at >> 6] |= np.uint64(1 << (at & 63))
    assert leaks.may_contain(words, np.array(hashes, np.int64)).all()


def test_filter_of_spark(spark):
    hashes = np.random.default_rng(1).integers(-2**63, 2**63 - 1, 2000)
    words = leaks.bloom(spark.createDataFrame([(int(h),) for h in hashes], "h long"), "h", 16)
    assert leaks.may_contain(words, hashes).all()
    others = np.random.default_rng(2).integers(-2**63, 2**63 - 1, 20_000)
    assert leaks.may_contain(words, others).mean() < 0.02


def test_little_is_shuffled(spark, tmp_path):
    """Of 2,000 texts without an answer none leaves its task."""
    docs = spark.range(2000).selectExpr("id as doc_id", "concat('text ', id, repeat(' of no interest', 50)) as text")
    items = spark.createDataFrame([(1, "something else")], "item_id long, answer string")
    assert leaked(items, docs).count() == 0
