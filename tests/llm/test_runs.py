import hashlib
import time
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from routecast.llm import runs


def brute(words, least=12):
    n, out = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q):
                out.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text):
    import re

    w = re.findall("[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute(w)
    gone = {i for s, n_, q in found for i in range(s + q, s + n_)}
    best = sorted(found, key=lambda r: (-r[1], r[0], r[2]))[0] if found else None
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(found), *(best or (None,) * 3), best[1] * 1000 // best[2] if best else None, sha("".join("%d,%d,%d\n" % r for r in found)),
            sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=70))
def test_small_alphabets(words):
    assert runs.runs_of(words) == brute(words)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 30), min_size=1, max_size=25), st.integers(1, 5), st.lists(st.integers(0, 30), max_size=20))
def test_repeated_blocks(block, times, rest):
    words = [str(x) for x in rest + block * times + rest + block * 2]
    assert runs.runs_of(words) == brute(words)


def thue_morse(n):
    return ["ab"[bin(i).count("1") % 2] for i in range(n)]


def test_known_words():
    fib = ["a", "a b"]
    while len(fib[-1].split()) < 300:
        fib.append(fib[-1] + " " + fib[-2])
    nested = (["x"] * 13 + ["y"]) * 15
    for words in (fib[-1].split(), nested, ["a"] * 200, (["a", "a", "b"] * 20 + ["a"]) * 2, thue_morse(1024), thue_morse(256) * 3):
        assert runs.runs_of(words) == brute(words)


def test_hashes_that_lie(monkeypatch):
    monkeypatch.setattr(runs._Extensions, "_same", lambda self, i, j, n: np.ones(len(i), bool))
    for words in (list("abcabcabcabcabcxyabcabcabcabd"), ["a"] * 40 + ["b"] * 14):
        assert runs.runs_of(words) == brute(words)


def test_splitting_leaves_only_repeated_words():
    ids = np.array([1, 2] * 8 + [9] + [3, 4, 5] * 5 + [7] + [6] * 5)
    assert runs.segments(ids) == [(0, 16), (17, 32)]


def test_long_texts_take_no_quadratic_time():
    r = np.random.default_rng(5)
    big = [str(x) for x in r.integers(0, 400, 60_000)]
    for words in (["a"] * 300_000, (["a", "b", "c"] * 100 + ["d"]) * 700, big * 3):
        began = time.process_time()
        assert runs.runs_of(words)
        assert time.process_time() - began < 60


def test_documents(documents):
    got = sorted(map(tuple, runs.op11_periodic_runs(documents).collect()))
    assert got == sorted(brute_row(r.doc_id, r.text) for r in documents.collect())
    assert sum(r[1] > 0 for r in got) > 5


def test_odd_rows(make_docs, odd_rows):
    rows = [r for r in odd_rows if r[0] not in (6, 7)] + [(i, "go round " * 9 + "and out" + " la" * i) for i in range(60)]
    got = sorted(map(tuple, runs.op11_periodic_runs(make_docs(rows)).collect()), key=str)
    assert got == sorted((brute_row(*r[:2]) for r in rows), key=str)
    assert runs.op11_periodic_runs(make_docs(rows).where("false")).count() == 0


def test_collapsed_texts_and_clashing_columns(make_docs):
    from pyspark.sql import functions as F

    docs = make_docs([(1, "so " + "it goes on " * 6 + "x"), (2, None), (3, "keep  this\tas it is")]).withColumn("runs", F.lit(1)).withColumn("start", F.lit("s"))
    out = {r.doc_id: r for r in runs.collapse_runs(docs).collect()}
    assert out[1].text == "so it goes on x" and [tuple(r) for r in out[1].runs] == [(1, 18, 3)]
    assert out[2].text is None and out[3].text == "keep  this\tas it is" and not out[3].runs
