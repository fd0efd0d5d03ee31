"""P7 over a corpus: which answers stand in which texts.

Every answer is looked for by one of its strings of GRAM characters, its anchor, the one with the least hash. A Bloom filter
of all anchors goes to the tasks that read the corpus; only texts with a string that may be an anchor leave them, so what is shuffled grows with the leaks and not
with the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routecast.operators.joins import salted_join
from routecast.sources.shared import written

GRAM = 8
LEAST_BITS, MOST_BITS = 16, 26  # log2 of the filter's size: 8 MB at most; beyond 4 million anchors it lets more through, and nothing is lost
U = np.uint64


def gram_hashes(text: str, gram: int = GRAM) -> np.ndarray:
    """Signed 64-bit hashes of all strings of `gram` code points."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(U)
    n = len(c) - gram + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    h = np.zeros(n, U)
    for k in range(gram):
        h = h * U(0x5851F42D4C957F2D) + c[k:k + n] + U(1)
    h ^= h >> U(31)
    h *= U(0x9E3779B97F4A7C15)
    return (h ^ h >> U(29)).astype(np.int64)


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        least = [int(gram_hashes(t).min()) for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(least, pa.int64())], ["answer", "anchor"])


def bloom(hashes: DataFrame, column: str, bits: int) -> np.ndarray:
    """A Bloom filter of 2^bits bits with two places a hash, as 64-bit words; Spark puts the bits together, only words with any reach the driver."""
    place = lambda shift: F.shiftrightunsigned(F.col(column), shift).bitwiseAND(F.lit((1 << bits) - 1))
    set_ = hashes.select(F.explode(F.array(place(0), place(32))).alias("at"))
    words = set_.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits"))
    out = np.zeros(1 << bits - 6, np.int64)
    for word, mask in words.collect():  # 2^(MOST_BITS - 6) rows at most
        out[word] = mask
    return out.view(U)


def may_contain(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    h = hashes.view(U)
    mask = U(len(words) * 64 - 1)
    found = np.ones(len(h), bool)
    for at in (h & mask, h >> U(32) & mask):
        found &= (words[(at >> U(6)).astype(np.int64)] >> (at & U(63)) & U(1)) > 0
    return found


def leaked(answers: DataFrame, texts: DataFrame) -> DataFrame:
    """(item_id, doc_id), distinct: the items whose answer, trimmed and of 8 characters or more, is in the text whatever its case.

    `answers` has item_id and answer, `texts` doc_id and text. Null and shorter answers, and null texts, match nothing. Equal answers are
    looked for once. An anchor that most texts have is dealt over several tasks.
    """
    items = answers.select("item_id", F.lower(F.trim("answer")).alias("answer")).where(F.length("answer") >= GRAM)
    anchors = written(items.select("answer").distinct().mapInArrow(_anchors, "answer string, anchor long"))
    n = anchors.count()
    bits = min(MOST_BITS, max(LEAST_BITS, (16 * n).bit_length()))
    filter_ = texts.sparkSession.sparkContext.broadcast(bloom(anchors, "anchor", bits))

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, hits = [], []
            for i, text in enumerate(batch.column(1)):
                h = gram_hashes(text.as_py())
                h = np.unique(h[may_contain(filter_.value, h)])
                if len(h):
                    at.append(i)
                    hits.append(h)
            rows = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(hits, pa.list_(pa.int64()))], ["doc_id", "text", "hits"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    low = texts.select("doc_id", F.lower("text").alias("text")).where(F.length("text") >= GRAM)
    found = low.mapInArrow(candidates, f"doc_id {kind}, text string, hits array<bigint>")
    found = written(found.withColumn("row", F.monotonically_increasing_id()))
    pairs = salted_join(found.select("row", F.explode("hits").alias("anchor")), anchors, "anchor").select("row", "answer")
    met = pairs.join(found.select("row", "doc_id", "text"), "row").where(F.contains("text", "answer")).select("doc_id", "answer")
    return salted_join(met.distinct(), items, "answer").select("item_id", "doc_id").distinct()
