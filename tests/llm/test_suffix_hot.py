from collections import Counter

import numpy as np
import pytest

from routecast.llm import suffix

from .test_suffix import brute, got


@pytest.fixture
def hot(monkeypatch):
    monkeypatch.setattr(suffix, "HOT", 20, raising=False)
    monkeypatch.setattr(suffix, "GROUP_BYTES", 1 << 13)
    monkeypatch.setattr(suffix, "BUCKET_BYTES", 1 << 14)


FOOTER = "All rights reserved. This text may be copied freely under the terms of the licence named above; no warranty is given."


def rows():
    r = np.random.default_rng(3)
    word = lambda: "".join(chr(97 + int(c)) for c in r.integers(0, 26, 30))
    out = [(i, f"{word()} {FOOTER} {word()}" + f" {FOOTER}{word()}" * (i % 3 == 0)) for i in range(300)]
    return [*out, (None, FOOTER + word()), (7, FOOTER * 3), (7, word() + FOOTER), (400, FOOTER), (401, FOOTER[:60])]


def test_no_bucket_holds_all_entries_of_a_gram(make_docs, hot):
    t, buckets = suffix.texts(make_docs(rows()), 5), 4
    entries, windows = Counter(), Counter()
    for r in suffix._entries(t, buckets).collect():
        if r.bucket < buckets and r.grams is not None:
            entries.update((r.bucket, int(x)) for x in np.frombuffer(r.grams, "<u4"))
        elif r.bucket < buckets:
            windows.update(bytes(w) for w in np.frombuffer(r.bytes, np.uint8).reshape(-1, suffix.DIGEST))
    assert max(entries.values(), default=0) <= 20
    assert len(windows) > 1000 and max(windows.values()) <= 3 * 5  # groups, and repeats within one document


def test_hot_passage_against_brute_force(make_docs, hot):
    assert got(make_docs(rows())) == brute(rows())


def test_documents_with_hot_grams(documents, hot):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    assert got(documents) == brute(rows)


def test_slices_hold_whole_grams(monkeypatch):
    import pyarrow as pa

    r = np.random.default_rng(1)
    n = 400
    grams, orders = r.integers(0, 25, n).astype("<u4"), r.integers(0, 30, n).astype("<i8")
    around = np.where(r.random((n, 76)) < 0.02, 98, 97).astype(np.uint8)
    places = np.stack([np.arange(n), np.full(n, 26)], 1).astype("<u4")
    sizes = np.tile(np.array([[26, 50]], np.uint8), (n, 1))
    table = pa.table({"g": [1], "grams": [grams.tobytes()], "ords": [orders.tobytes()], "places": [places.tobytes()], "bytes": [around.tobytes()], "sizes": [sizes.tobytes()]})
    whole = suffix._match_entries(table)
    assert whole
    for size in (1, 40, 200):
        monkeypatch.setattr(suffix, "SLICE", size)
        assert suffix._match_entries(table) == whole


def test_a_passage_in_every_row_of_a_table_without_ids(make_docs, hot):
    """No bucket gets more than an entry per window and group, and nothing is lost where one row has an id."""
    r = np.random.default_rng(5)
    word = lambda: "".join(chr(97 + int(c)) for c in r.integers(0, 26, 30))
    none = [(None, f"{word()} {FOOTER} {word()} {FOOTER}") for _ in range(300)] + [(9, f"{word()} {FOOTER}")] * 2 + [(9, f"{FOOTER} {word()}")]
    for rows_ in (none[:300], none, [*none, (1, FOOTER)]):
        t, buckets, windows = suffix.texts(make_docs(rows_), 5), 4, Counter()
        for x in suffix._entries(t, buckets).collect():
            if x.bucket < buckets and x.grams is None:
                windows.update(bytes(w) for w in np.frombuffer(x.bytes, np.uint8).reshape(-1, suffix.DIGEST))
        assert len(windows) > 50 and max(windows.values()) <= 2 * 5
        assert got(make_docs(rows_)) == brute(rows_)
