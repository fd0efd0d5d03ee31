import struct
import zlib
from collections import defaultdict

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from routecast.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


TOKENIZER = Tokenizer.from_file(PATH)
TOKENIZER.encode_special_tokens = True


def plain(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


def check(rows, got, window=1024):
    ids = defaultdict(list)
    for d, t in rows:
        ids[d].append([*plain(t), 0])
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        windows[r.sequence_id].append((r.offset, r.length))
    for d, texts in ids.items():
        want = sorted((s, zlib.crc32(struct.pack(f"<{len(x[s:s + window])}I", *x[s:s + window])), len(x)) for x in texts for s in range(0, len(x), window))
        assert sorted((r.start, r.ids_crc32, r.doc_tokens) for r in pieces[d]) == want
    assert pieces.keys() == ids.keys()
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
    return len(windows)


def test_documents(documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    got = packing.op3_packing(documents.coalesce(2)).collect()
    n = check(rows, got)
    assert n * 1024 < 1.05 * sum(r.length for r in got) + 2048


def test_odd_rows(make_docs, odd_rows):
    from pyspark.sql import functions as F

    df = make_docs(odd_rows).withColumn("length", F.lit("x")).withColumn("start", F.lit(None))
    check(odd_rows, packing.op3_packing(df).collect())
    assert packing.op3_packing(df.limit(0)).count() == 0


FAST = packing.Encoder(PATH, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@settings(max_examples=500, deadline=None)
@given(st.one_of(st.text(alphabet="ab'st 1.,\n\t\r\x0b\x1c\x85\xa0  éßжλ漢<|endoftext|>", max_size=60), st.text(max_size=60)))
def test_rank_file_gives_the_same_ids(text):
    assert list(memoryview(FAST(text)).cast("I")) == plain(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 16), max_size=60))
def test_best_fit_against_linear_search(lengths):
    where, offset = packing.best_fit(lengths, 16)
    free = []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fits = [f for f in free if f >= lengths[i]]
        if fits:
            free.remove(min(fits))
            free.append(min(fits) - lengths[i])
        else:
            free.append(16 - lengths[i])
    assert max(where, default=-1) + 1 == len(free)
    used = defaultdict(int)
    for w, n in zip(where, lengths):
        used[w] += n
    assert sorted(16 - u for u in used.values()) == sorted(free)


@pytest.mark.parametrize("parts", [1, 8, 40])
def test_padding_at_many_tasks(spark, parts):
    """Every task may leave its last windows open: about one more sequence a task than the ids fill, at most two."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(parts)
    r = packing.op3_packing(docs).agg(F.sum("length").alias("ids"), F.count_distinct("sequence_id").alias("sequences"), F.count_distinct("doc_id").alias("docs")).first()
    assert r.docs == 1000 and r.sequences <= -(-r.ids // 1024) + 2 * parts + 1
