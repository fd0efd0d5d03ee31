"""Toxicity by a factorization machine over hashed terms (operator 5).

A text is the set of its hashed terms, words and word prefixes, each in one of 2^BITS slots. The machine
scores w0 + sum w_i + sum over pairs <v_i, v_j> over all slots of a text, so a pair of terms can mean what neither part means
alone; no term is chosen by its own share in the classes. It is fitted on a bounded sample of labelled rows
(`most_rows`), whose slots Spark makes; scoring is a map over all documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import own_columns
from .language import fold

PREFIXES = (4, 5, 6)
BITS = 18


def terms_of(token: str, bits: int = BITS) -> tuple[int, ...]:
    """Slots of a white-space token: its letters as a word, and the word's prefixes."""
    word = "".join(c for c in token if c.isalpha())
    if not word:
        return ()
    names = ["w:" + word, *[f"p:{word[:k]}" for k in PREFIXES if len(word) >= k]]
    return tuple(zlib.crc32(n.encode("utf-8", "surrogatepass")) >> 32 - bits for n in names)


class Terms:
    """Sorted slots of texts; those of a token are computed once, of at most `most` tokens at a time."""

    def __init__(self, most: int = 500_000):
        self.most = most
        self.known: dict[str, tuple[int, ...]] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        out: set[int] = set()
        for t in set((text or "").lower().split()):
            have = self.known.get(t)
            if have is None:
                if len(self.known) >= self.most:
                    self.known.clear()
                have = self.known[t] = terms_of(t)
            out.update(have)
        return np.sort(np.fromiter(out, np.int32, len(out)))


@dataclass(frozen=True)
class Machine:
    """A fitted factorization machine: bias, a weight and a vector per slot."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def score(self, rows: list) -> np.ndarray:
        """0 to 1 for each row, a sequence of distinct slots."""
        at, owner = _flat(rows)
        return 1 / (1 + np.exp(-_raw(len(rows), owner, at, self.bias, self.linear, self.factors)[0]))


def _flat(rows: list) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    at = np.concatenate([np.asarray(r, np.int32) for r in rows]) if sizes.sum() else np.zeros(0, np.int32)
    return at, np.repeat(np.arange(len(rows)), sizes)


def _raw(n: int, owner: np.ndarray, at: np.ndarray, bias: float, linear: np.ndarray, factors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    v = factors[at]
    total = np.stack([np.bincount(owner, column, n) for column in v.T], 1)
    square = np.bincount(owner, np.einsum("ij,ij->i", v, v), n)
    return np.clip(bias + np.bincount(owner, linear[at], n) + 0.5 * ((total**2).sum(1) - square), -30, 30), total


class _Leader:
    """Weights that follow the regularised leader from where they start: one stays there until the sum of its gradients is `trust` times their
    root sum of squares, however many or few they are, so thousands of rare terms cannot learn single rows by heart."""

    def __init__(self, start: np.ndarray, rate: float, trust: float, calm: float):
        self.start, self.value, self.rate, self.trust, self.calm = start, start.copy(), rate, trust, calm
        self.lead, self.square = np.zeros_like(start), np.zeros_like(start)

    def step(self, at: np.ndarray, gradient: np.ndarray, square: np.ndarray) -> None:
        before = np.sqrt(self.square[at])
        self.square[at] += square
        after = np.sqrt(self.square[at])
        lead = self.lead[at] + gradient - (after - before) / self.rate * (self.value[at] - self.start[at])
        self.lead[at] = lead
        self.value[at] = self.start[at] + np.where(np.abs(lead) > self.trust * after, -lead * self.rate / (self.calm + after), 0)


def fit(rows: list, labels: np.ndarray, slots: int = 1 << BITS, rank: int = 4, epochs: int = 6, batch: int = 256, rate: float = 0.3, trust: float = 4.0,
        pair_rate: float = 0.05, spread: float = 0.02, lift: float = 1.0, seed: int = 11) -> Machine:
    """Logistic loss over batches of rows, several times over all; label 1 counts twice.

    Weights start at zero, vectors at random values of size `spread`, and every slot that is met has both; gradients are those of the whole machine's
    errors, and both move once theirs agree (see `_Leader`). `lift` is added to the bias for what that holds back. With labels of one class only, or
    none, the score is constant.
    """
    n, positive = len(rows), float(np.sum(labels))
    if not 0 < positive < n:
        share = (positive + 1) / (n + 2)
        return Machine(float(np.log(share / (1 - share))), np.zeros(slots, np.float32), np.zeros((slots, rank), np.float32))
    r = np.random.default_rng(seed)
    known = np.flatnonzero(np.bincount(_flat(rows)[0], minlength=slots))
    place = np.zeros(slots, np.int32)
    place[known] = np.arange(len(known))
    weights = _Leader(np.zeros(len(known)), rate, trust, 1.0)
    vectors = _Leader(r.normal(0, spread, (len(known), rank)), pair_rate, trust, 1e-3)
    bias, drift = np.log(2 * positive / (n - positive)), 1e-6
    for _ in range(epochs):
        order = r.permutation(n)
        for i in range(0, n, batch):
            mine = order[i:i + batch]
            at, owner = _flat([rows[j] for j in mine])
            at = place[at]
            raw, total = _raw(len(mine), owner, at, bias, weights.value, vectors.value)
            slope = np.where(labels[mine] > 0, 2.0, 1.0) * (1 / (1 + np.exp(-raw)) - labels[mine])
            met, which = np.unique(at, return_inverse=True)
            summed = lambda x: np.bincount(which, x, len(met))  # noqa: B023, E731
            pull = slope[owner]
            push = (total[owner] - vectors.value[at]) * pull[:, None]
            weights.step(met, summed(pull), summed(pull * pull))
            vectors.step(met, np.stack([summed(c) for c in push.T], 1), np.stack([summed(c * c) for c in push.T], 1))
            mean = slope.mean()
            drift += mean * mean
            bias -= 0.05 * mean / np.sqrt(drift)
    linear, factors = np.zeros(slots, np.float32), np.zeros((slots, rank), np.float32)
    linear[known], factors[known] = weights.value, vectors.value
    return Machine(float(bias + lift), linear, factors)


def sample_of(labels: DataFrame, most_rows: int) -> DataFrame:
    """At most `most_rows` rows (doc_id, toxic), those with the least hashes of doc_id; of several labels of one id the greatest counts.

    Labels without doc_id or toxic are left out. A hash limit thins the rows before the exact cut, so no task sorts more than about twice `most_rows`.
    """
    own = own_columns(labels, "doc_id", "toxic").where("doc_id is not null and toxic is not null")
    own = own.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).withColumn("_h", F.xxhash64("doc_id"))
    n = own.count()
    if n > 2 * most_rows:
        own = own.where(F.col("_h") < F.lit(-(1 << 63) + int(2**64 * (1.5 * most_rows / n))))
    return own.orderBy("_h", "doc_id").limit(most_rows).select("doc_id", "toxic")


def learn(docs: DataFrame, labels: DataFrame, most_rows: int = 20_000) -> Machine:
    """A machine fitted to at most `most_rows` rows: labelled documents of `sample_of`, of several texts under one id that with the least hash.

    What reaches the driver is the slots of these rows: bounded in rows, and in slots by 2^BITS a row (1 MB), which only a text of
    as many different words has.
    """
    sample = sample_of(labels, most_rows)
    # bounded by most_rows, so it may be broadcast; the texts stay where they are until the join has thinned them
    rows = own_columns(docs, "doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "toxic", "text")

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for batch in batches:
            found = [terms(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int32()))], ["doc_id", "toxic", "slots"])

    got = rows.mapInArrow(lists, "doc_id long, toxic int, slots array<int>").groupBy("doc_id").agg(
        F.max("toxic").alias("toxic"), F.min_by("slots", F.xxhash64("slots")).alias("slots")).toArrow().sort_by("doc_id")
    return fit([s.values.to_numpy() for s in got["slots"]], np.array(got["toxic"].to_pylist()) > 0)


def score(docs: DataFrame, machine: Machine, keep: list[str], block: int = 256) -> DataFrame:
    """Columns `keep` and a score of 0 to 1 of each whole text (null: empty), one row per document, nothing shuffled.

    The machine, 2^BITS slots of 20 bytes however large the input, is broadcast.
    """
    plain = own_columns(docs, *keep, "text")
    schema = plain.select(*keep).withColumn("score", F.lit(0.0)).schema
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, fitted = Terms(), shared.value
        for batch in batches:
            texts, found = batch.column(batch.schema.get_field_index("text")), [np.zeros(0)]
            for i in range(0, len(texts), block):
                found.append(fitted.score([terms(t.as_py()) for t in texts.slice(i, block)]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(keep)], pa.array(np.concatenate(found), pa.float64())], [*keep, "score"])

    return plain.mapInArrow(run, schema)


def op5_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted for all documents; learns from labels with crc32(doc_id) mod 3 other than 1.

    Rows with a null doc_id are scored and not held out. The text is the only input of a score.
    """
    machine = learn(docs, labels.where(fold(F.col("doc_id"), 3) != 1))
    rows = own_columns(docs, "doc_id", "text").select("doc_id", F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "text")
    return score(rows, machine, ["doc_id", "held_out"]).select("*", (F.col("score") >= threshold).cast("int").alias("predicted"))
