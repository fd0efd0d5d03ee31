import zlib

import numpy as np
import pytest

from routecast.llm import language


def by_hand(text, dims, seed):
    """The bundle of a text, letter by letter."""
    symbols, letters = language._symbols(), language._letters(dims, seed).astype(int)
    codes = [0]
    for ch in text:
        c = int(symbols[ord(ch)])
        if c or codes[-1]:
            codes.append(c)
    codes.append(0)
    total = np.zeros(dims)
    for a, b, c in zip(codes, codes[1:], codes[2:]):
        if b:
            total += np.roll(letters[a], 2) * np.roll(letters[b], 1) * letters[c]
    return total


def test_grams_and_cosine_by_hand():
    texts = ["The cat sat.", "", "ÉÈ où 漢字", "123 !", "a"]
    profiles = language.Profiles(["x", "y"], np.array([by_hand(t, 256, 3) / np.linalg.norm(by_hand(t, 256, 3)) for t in ("the cat", "le où")], np.float32), 256, 3)
    langs, scores = profiles.score(texts)
    for text, lang, score in zip(texts, langs, scores):
        v = by_hand(text, 256, 3)
        if not any(c.isalpha() for c in text):
            assert (lang, score) == ("und", 0)
            continue
        cosine = profiles.prototypes @ v / np.linalg.norm(v)
        assert lang == ["x", "y"][int(cosine.argmax())]
        assert score == pytest.approx(max(0, cosine.max()), abs=1e-4)


def test_held_out_accuracy(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in language.op10_language(d).collect()}
    rows = d.collect()
    assert len(got) == len(rows)
    assert all(got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if got[r.doc_id].held_out]
    right = sum(got[r.doc_id].lang_pred == r.lang for r in held) / len(held)
    assert right > 0.97
    assert all(0 <= g.score <= 1 for g in got.values())


def test_odd_rows(make_docs, odd_rows, spark):
    from pyspark.sql import functions as F

    df = make_docs(odd_rows).withColumn("score", F.lit("x")).withColumn("held_out", F.lit(1))
    got = language.op10_language(df).collect()
    assert len(got) == len(odd_rows)
    assert {r.lang_pred for r in got if r.doc_id in (1, 2, 3)} == {"und"}
    assert language.op10_language(df.limit(0)).count() == 0
    nobody = make_docs([(1, "some text", None)]).withColumn("lang", F.lit(None).cast("string"))
    assert language.op10_language(nobody).first().lang_pred == "und"
