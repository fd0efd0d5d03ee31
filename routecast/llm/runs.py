"""Periodic runs of words (operator 11).

A run is a stretch of consecutive words in which words `period` apart are equal, with the smallest such period, at least two
periods and `least` words long, and not to be extended on either side. Texts do not depend on each other, so they are
worked through where they are read, without a shuffle. For each text:

1. Recursive frequency splitting: every word of a run occurs twice in it at least, so a word that is alone in the current
   segment belongs to none and splits it; pieces shorter than a run are left out, the others are split again until nothing changes.
2. Lag scan of the segments that are left: a run of period q matches itself at lag q in q places or more, one of them a multiple of q.
   So for each lag only every q-th word is compared (m log m comparisons in m words), and what matches is extended to both sides
   by binary search over prefix hashes. Extensions are verified word by word; a lag whose hashes lied is scanned in full.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import own_columns

WORD = re.compile("[^\x20\x09-\x0D]+")
LEAST = 12
PAIRS = 1 << 20  # sampled pairs looked at once
U = np.uint64


def segments(ids: np.ndarray, least: int = LEAST) -> list[tuple[int, int]]:
    """(from, to) of the stretches of `least` words or more in which every word occurs at least twice."""
    todo, out = [(0, len(ids))], []
    while todo:
        lo, hi = todo.pop()
        if hi - lo < least:
            continue
        _, which, times = np.unique(ids[lo:hi], return_inverse=True, return_counts=True)
        rare = np.flatnonzero(times[which] < 2)
        if not len(rare):
            out.append((lo, hi))
            continue
        starts, ends = np.concatenate([[lo], rare + lo + 1]), np.concatenate([rare + lo, [hi]])
        long = ends - starts >= least
        todo += zip(starts[long].tolist(), ends[long].tolist())
    return sorted(out)


def _samples(m: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(lag, place) of every multiple of every lag up to m / 2, with a word one lag further, some lags at a time."""
    lo = 1
    while lo <= m // 2:
        hi = min(m // 2, lo + max(0, PAIRS // (m // lo) - 1))
        q = np.arange(lo, hi + 1)
        n = (m - 1) // q
        lag = np.repeat(q, n)
        yield lag, (np.arange(len(lag)) - np.repeat(np.cumsum(n) - n, n)) * lag
        lo = hi + 1


class _Extensions:
    """Common extensions of places of `words` to the right and to the left, by prefix hashes modulo 2^64."""

    def __init__(self, words: np.ndarray):
        x = (words.astype(U) + U(1)) * U(0x9E3779B97F4A7C15)
        x ^= x >> U(31)
        x *= U(0xBF58476D1CE4E5B9)
        x ^= x >> U(29)
        self.n = len(words)
        base = 0x5851F42D4C957F2D
        up, self.down = (np.cumprod(np.concatenate([[U(1)], np.full(self.n, U(b))]), dtype=U) for b in (base, pow(base, -1, 1 << 64)))
        self.prefix = np.concatenate([[U(0)], np.cumsum(x * up[:self.n], dtype=U)])

    def _same(self, i: np.ndarray, j: np.ndarray, n: np.ndarray) -> np.ndarray:
        return (self.prefix[i + n] - self.prefix[i]) * self.down[i] == (self.prefix[j + n] - self.prefix[j]) * self.down[j]

    def both(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How far words from i and j (i < j) agree to the right, and before them to the left."""
        out = []
        for room, sign in ((self.n - j, 0), (i, 1)):
            low, high = np.zeros(len(i), np.int64), room.copy()
            for _ in range(self.n.bit_length()):
                mid = (low + high + 1) // 2
                same = self._same(i - sign * mid, j - sign * mid, mid)
                low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
            out.append(low)
        return out[0], out[1]


def _stretches(words: np.ndarray, q: int) -> np.ndarray:
    """(from, to) of all stretches that keep period q, by comparing every word."""
    same = np.concatenate([[False], words[:-q] == words[q:], [False]])
    edges = np.flatnonzero(same[1:] != same[:-1]).reshape(-1, 2)
    return edges + np.array([0, q])


def lag_scan(words: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of one segment, by start, then period."""
    m, reach = len(words), (least + 1) // 2
    padded = np.concatenate([np.full(reach, -1, np.int64), words, np.full(reach, -2, np.int64)])
    found: list[np.ndarray] = []
    extend = None
    for lag, at in _samples(m):
        hit = words[at] == words[at + lag]
        lag, at = lag[hit], at[hit]
        near = np.ones(len(at), np.int64)  # a run agrees in least / 2 places in a row
        for sign in (1, -1):
            on = np.ones(len(at), bool)
            for k in range(1, reach):
                on &= padded[at + sign * k + reach] == padded[at + lag + sign * k + reach]
                near += on
        lag, at = lag[near >= reach], at[near >= reach]
        if not len(at):
            continue
        extend = extend or _Extensions(words)
        right, left = extend.both(at, at + lag)
        long = right + left >= np.maximum(lag, least - lag)
        some = np.unique(np.stack([at[long] - left[long], at[long] + lag[long] + right[long], lag[long]], 1), axis=0)
        found.append(some)
    if not found:
        return []
    all_runs = np.concatenate(found)
    order = np.lexsort((all_runs[:, 2], all_runs[:, 1], all_runs[:, 0]))
    all_runs = all_runs[order]
    first = np.ones(len(all_runs), bool)
    first[1:] = (all_runs[1:, :2] != all_runs[:-1, :2]).any(1)  # equal stretches: the smallest period
    all_runs = all_runs[first]
    lied = {int(q) for s, e, q in all_runs.tolist() if not (np.array_equal(words[s:e - q], words[s + q:e]) and (s == 0 or words[s - 1] != words[s - 1 + q]) and (e == m or words[e] != words[e - q]))}
    if lied:
        exact = [np.column_stack([s, np.full(len(s), q)]) for q in range(1, m // 2 + 1) if len(s := _stretches(words, q))]
        all_runs = np.concatenate(exact)
        size = all_runs[:, 1] - all_runs[:, 0]
        all_runs = all_runs[size >= np.maximum(least, 2 * all_runs[:, 2])]
        all_runs = all_runs[np.lexsort((all_runs[:, 2], all_runs[:, 1], all_runs[:, 0]))]
        first = np.ones(len(all_runs), bool)
        first[1:] = (all_runs[1:, :2] != all_runs[:-1, :2]).any(1)
        all_runs = all_runs[first]
    return sorted((s, e - s, q) for s, e, q in all_runs.tolist())


def runs_of(words: list[str], least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a text, by start, then period."""
    known: dict[str, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    out = []
    for lo, hi in segments(ids, least):
        out += [(lo + s, n, q) for s, n, q in lag_scan(ids[lo:hi], least)]
    return sorted(out, key=lambda r: (r[0], r[2]))


def kept_words(words: list[str], runs: list[tuple[int, int, int]]) -> list[str]:
    """The words that no run contains after its first period."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    r = np.array(runs)
    np.add.at(edge, r[:, 0] + r[:, 2], 1)
    np.add.at(edge, r[:, 0] + r[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]


def looped(words: list[str], doc_id: int | None) -> list[str]:
    """The words with a periodic tail in the documents that the contract names by crc32 of their id."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    a = h // 10 % n
    p = 1 + (n - a) // (3 + h // 10 % 8)
    return words[:a] + (words[a:a + p] * (-(-(n - a) // p)))[:n - a]


RUNS = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
COLLAPSED = "doc_id long, text string, runs array<struct<start: bigint, length: bigint, period: bigint>>"


def _each(row: Callable[[int | None, str | None], tuple], schema: pa.Schema) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [row(d.as_py(), t.as_py()) for d, t in zip(batch.column(0), batch.column(1))]
            columns = list(zip(*rows)) if rows else [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return run


def collapse_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, the text with every run cut to its first period (words joined by one space) and the runs, one row per document.

    A text without runs comes back as it is, null included. An empty table gives no row, repeated rows keep a row each.
    """
    one = pa.struct([(n, pa.int64()) for n in ("start", "length", "period")])
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("runs", pa.list_(one))])

    def row(doc_id: int | None, text: str | None) -> tuple:
        words = WORD.findall(text or "")
        runs = runs_of(words, least)
        named = [dict(zip(("start", "length", "period"), r)) for r in runs]
        return doc_id, " ".join(kept_words(words, runs)) if runs else text, named

    return own_columns(docs, "doc_id", "text").mapInArrow(_each(row, schema), COLLAPSED)


def op11_periodic_runs(docs: DataFrame) -> DataFrame:
    """The digest of operator 11 over all documents; see `looped` for the tails that it plants.

    One row per document, repeated rows included. A null text has no words; a null doc_id plants nothing. Texts without
    runs have n_runs 0 and four nulls, and both digests are of the texts that the contract names. An empty table gives no row.
    """
    schema = pa.schema([(n, pa.string() if t == "string" else pa.int64()) for n, t in (f.split() for f in RUNS.split(", "))])

    def row(doc_id: int | None, text: str | None) -> tuple:
        words = looped(WORD.findall(text or ""), doc_id)
        runs = runs_of(words)
        s, n, q = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        listed = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
        return (doc_id, len(runs), s, n, q, 1000 * n // q if n else None, hashlib.sha256(listed.encode()).hexdigest(),
                hashlib.sha256(" ".join(kept_words(words, runs)).encode()).hexdigest())

    return own_columns(docs, "doc_id", "text").mapInArrow(_each(row, schema), RUNS)
