import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from routecast.llm import suffix

W = 50


def brute(rows):
    raw = [((float("inf") if d is None else d), (t or "").encode()) for d, t in rows]
    least = {}
    for d, b in raw:
        for p in range(len(b) - W + 1):
            s = b[p:p + W]
            least[s] = min(d, least.get(s, d))
    out = []
    for (d, _), (o, b) in zip(rows, raw):
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - W + 1):
            if least[b[p:p + W]] < o:
                gone[p:p + W] = True
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = int((gone[:-1] & ~gone[1:]).sum()) if len(b) else 0
        out.append((d, len(b), int(gone[:len(b)].sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in suffix.op2_suffix_dedup(df).collect()), key=str)


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(suffix, "GROUP_BYTES", 1 << 15)
    monkeypatch.setattr(suffix, "BUCKET_BYTES", 1 << 16)
    monkeypatch.setattr(suffix, "BLOCK_BYTES", 1 << 12)


def test_documents(documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    want = brute(rows)
    assert sum(r[2] for r in want) > 1000
    assert got(documents) == want


def test_many_groups(documents, small):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    assert got(documents) == brute(rows)


def test_odd_rows(make_docs, odd_rows, small):
    from pyspark.sql import functions as F

    shared = "a passage of some length that is shared by several documents é and goes on"
    rows = [*odd_rows, (50, "x" * 400), (51, "x" * 49), (52, "yx" * 30 + "x" * 60), (53, "pre " + shared), (54, shared + " post"), (54, "q " + shared),
            (None, shared), (55, shared[:49]), (56, shared[:50]), (57, "abab" * 40), (58, "baba" * 40)]
    df = make_docs(rows).withColumn("ord", F.lit(1)).withColumn("sha", F.lit("s")).withColumn("least", F.lit(1))
    assert got(df) == brute(rows)
    assert suffix.op2_suffix_dedup(df.limit(0)).count() == 0
    kept = {(r[0], r[1]): r for r in brute(rows)}
    out = suffix.strip(df)
    assert out.columns == df.columns
    texts = out.select("doc_id", "text", "n_chars").collect()
    assert len(texts) == len(rows)
    assert sum(r.text is None for r in texts) == sum(t is None for _, t in rows)
    whole = sorted(hashlib.sha256((r.text or "").encode()).hexdigest() for r in texts)
    assert whole == sorted(r[4] for r in kept.values()) or len(kept) < len(rows)
    assert all(r.n_chars == len(r.text) for r in texts if r.text is not None)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 5), st.binary(max_size=12)), max_size=40), st.randoms())
def test_repeated_against_pairs(parts, r):
    """Occurrences of a few anchors with surroundings from few letters."""
    n = len(parts)
    sizes = np.array([[r.randrange(27), r.randrange(24, 51)] for _ in parts], np.uint8).reshape(n, 2)
    grams = np.array([p[0] for p in parts], np.uint32)
    orders = np.array([p[1] for p in parts], np.int64)
    around = np.zeros((n, 76), np.uint8)
    for i in range(n):
        around[i] = [r.choice(b"aaab") if r.random() < 0.05 else 97 for _ in range(76)]
        around[i, 26:50] = grams[i]
        around[i, :26 - sizes[i, 0]] = 0
        around[i, 26 + sizes[i, 1]:] = 0
    least, most = suffix.repeated(grams, orders, around, sizes)
    for i in range(n):
        hit = []
        for o in range(27):
            def window(j):
                return (grams[j], around[j, 26 - o:76 - o].tobytes()) if sizes[j, 0] >= o and sizes[j, 1] >= 50 - o else None
            if window(i) and any(orders[j] < orders[i] and window(j) == window(i) for j in range(n)):
                hit.append(o)
        assert (least[i], most[i]) == ((min(hit), max(hit)) if hit else (50, -1))


def test_suffix_array_against_sorted():
    rng = np.random.default_rng(0)
    rows = rng.integers(0, 2, (300, 20)).astype(np.uint8)
    sizes = rng.integers(1, 21, 300)
    group = np.sort(rng.integers(0, 6, 300))
    order, common = suffix.suffix_array(rows, sizes, group)
    key = lambda i: (group[i], bytes(rows[i, :sizes[i]] + 1))
    assert [key(i) for i in order] == sorted(key(i) for i in range(300))
    for a, b, c in zip(order, order[1:], common[1:]):
        x, y = key(a)[1], key(b)[1]
        n = next((k for k, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
        assert c == (n if group[a] == group[b] else -1)


def test_a_lying_base_is_replaced(monkeypatch):
    plain = suffix._base
    monkeypatch.setattr(suffix, "_base", lambda seed: (plain(seed)[0], np.zeros(257, np.uint64)) if seed == 2 else plain(seed))
    rows = np.array([[1, 2, 3], [1, 2, 4], [0, 2, 3]], np.uint8)
    order, common = suffix.suffix_array(rows, np.array([3, 3, 3]), np.zeros(3, np.int64))
    assert list(order) == [2, 0, 1] and list(common) == [-1, 0, 2]
