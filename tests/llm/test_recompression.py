import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from routecast.llm import recompression as rc

W = 13


def words_of(text):
    return re.findall("[^\x20\x09-\x0D]+", text or "")


def brute(rows):
    docs = [((float("inf") if d is None else d), words_of(t)) for d, t in rows]
    least = {}
    for d, w in docs:
        for p in range(len(w) - W + 1):
            key = tuple(w[p:p + W])
            least[key] = min(d, least.get(key, d))
    out = []
    for (d, _), (o, w) in zip(rows, docs):
        gone = set()
        for p in range(len(w) - W + 1):
            if least[tuple(w[p:p + W])] < o:
                gone.update(range(p, p + W))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in rc.op13_substring_dedup(df).collect()), key=str)


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(rc, "GROUP_BYTES", 1 << 14)
    monkeypatch.setattr(rc, "BUCKET_BYTES", 1 << 15)


def group(texts):
    raw = [t.encode() for t in texts]
    return rc.Words(pa.table({"sha": [hashlib.sha256(t).digest() for t in raw], "ord": list(range(len(raw))), "text": pa.array([t.decode() for t in raw])}))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b", "cc", "d", "é"]), max_size=60), min_size=1, max_size=4), st.integers(1, 2))
def test_equal_windows_have_equal_units(texts, kinds):
    g = group([" ".join(t) for t in texts])
    starts, which, unit = rc.units(g)
    seen = {}
    for s, u in zip(starts.tolist(), unit[which].tolist()):
        window = tuple(g.buffer[g.at[s + k]:g.end[s + k]] for k in range(W))
        assert seen.setdefault(window, u) == u
    assert len(starts) == sum(max(0, len(words_of(g.text(i).decode())) - W + 1) for i in range(len(g.sha)))


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 10**6), st.integers(2, 40))
def test_equal_passages_in_any_surroundings_have_equal_units(seed, kinds):
    r = np.random.default_rng(seed)
    draw = lambda n: [f"w{x}" for x in r.integers(0, kinds, n)]
    passage = draw(30)
    texts = [" ".join(draw(int(r.integers(0, 9))) + passage + draw(int(r.integers(0, 9)))) for _ in range(6)] + [" ".join(passage)]
    g = group(texts)
    starts, which, unit = rc.units(g)
    seen = {}
    for s, u in zip(starts.tolist(), unit[which].tolist()):
        assert seen.setdefault(g.buffer[g.at[s]:g.end[s + W - 1]], u) == u


def test_symbols_shrink_and_units_are_fewer_than_windows():
    r = np.random.default_rng(1)
    g = group([" ".join(f"w{x}" for x in r.integers(0, 5000, 20_000))])
    sizes = [len(place) for place, _, _ in rc.parse(g.name, g.first)]
    assert sizes[0] < 0.8 * g.n and sizes[1] < 0.8 * sizes[0] and sizes[2] < 0.8 * sizes[1]
    starts, which, unit = rc.units(g)
    assert len(unit) < 0.6 * len(starts)


def test_words_and_names():
    g = group(["a  b\t c\n", " a b c", "", "\x0b \r", "abc é漢 a"])
    assert sorted(g.text(i).decode() for i in range(5)) == ["", "", "a b c", "a b c", "abc é漢 a"][:2] + ["a b c"] * 2 + ["abc é漢 a"]
    names = {}
    for i in range(g.n):
        word = g.buffer[g.at[i]:g.end[i]]
        assert names.setdefault(word, g.name[i]) == g.name[i]
    assert len(set(names.values())) == len(names) == 5


def test_documents(documents, small):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    want = brute(rows)
    assert sum(r[2] for r in want) > 500
    assert got(documents) == want


def test_odd_rows(make_docs, odd_rows, small):
    r = np.random.default_rng(4)
    draw = lambda n: " ".join(f"w{x}" for x in r.integers(0, 900, n))
    passage = draw(20)
    rows = [*odd_rows, (50, "la " * 40), (51, "la " * 12), (52, "x " + "la " * 13), (53, passage + " " + draw(15)), (54, draw(15) + "\n" + passage), (54, draw(3) + "  " + passage.replace(" ", "\t")),
            (None, passage), (None, draw(2) + " " + passage), (55, " ".join(passage.split()[:13])), (56, " ".join(passage.split()[:12])), (57, passage * 2), (58, "a b " * 30), (59, "b a " * 30 + draw(9)), (59, "b a " * 30 + draw(9))]
    rows += [(100 + i, f"{draw(3)} {passage} {draw(4)} {'so la ti ' * (i % 5)}") for i in range(80)]
    assert got(make_docs(rows)) == brute(rows)
    assert got(make_docs(rows, 7)) == brute(rows)


@pytest.mark.parametrize("seed", range(8))
def test_random_texts(make_docs, small, seed):
    r = np.random.default_rng(seed)
    kinds = int(r.integers(1, 5))
    rows = [(int(r.integers(0, 25)) if r.random() < 0.95 else None, " ".join("ab c de"[int(x):int(x) + 2].strip() or "z" for x in r.integers(0, kinds, int(r.integers(0, 80))))) for _ in range(40)]
    assert got(make_docs(rows)) == brute(rows)


def test_kept_words_and_clashing_columns(make_docs):
    from pyspark.sql import functions as F

    p = " ".join(f"p{i}" for i in range(13))
    docs = make_docs([(1, p), (2, f"before {p} after"), (3, p), (4, None)]).withColumn("sha", F.lit("x")).withColumn("ord", F.lit(1)).withColumn("g", F.lit(2))
    assert {r.doc_id: r.kept for r in rc.dedup_words(docs, with_text=True).collect()} == {1: p, 2: "before after", 3: "", 4: ""}
    assert rc.op13_substring_dedup(docs.where("false")).count() == 0


def test_a_passage_in_every_row_of_a_table_without_ids(make_docs, small):
    """A bucket gets one entry per window and group, and nothing is lost where one row has an id."""
    from collections import Counter

    r = np.random.default_rng(5)
    draw = lambda n: " ".join(f"w{x}" for x in r.integers(0, 9000, n))
    passage = draw(25)
    none = [(None, f"{draw(6)} {passage} {draw(6)} {passage}") for _ in range(300)] + [(9, f"{draw(4)} {passage}")] * 2 + [(9, f"{passage} {draw(4)}")]
    for rows in (none[:300], none, [*none, (1, passage)]):
        t = rc.texts(make_docs(rows), 5)
        flags = t.groupBy("g").applyInArrow(rc._found(4), rc.FOUND).groupBy("bucket").applyInArrow(rc._shared, rc.FLAGS)
        windows = Counter()
        for x in t.groupBy("g").cogroup(flags.groupBy("g")).applyInArrow(rc._entries(4), rc.ENTRIES).collect():
            windows.update(bytes(w) for w in np.frombuffer(x.digests or b"", np.uint8).reshape(-1, rc.DIGEST))
        assert len(windows) >= 13 and max(windows.values()) <= 5
        assert got(make_docs(rows)) == brute(rows)
