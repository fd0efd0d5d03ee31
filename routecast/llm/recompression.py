"""Word-level deduplication of repeated passages by recompression (operator 13).

A word goes if one of the `WINDOW`-word windows that cover it also starts in a document with a smaller doc_id. Finding out for
every window would shuffle every word of the corpus, so texts are parsed by recompression first, and only what the parse shows to be shared moves:

1. Rounds: equal neighbours become one run symbol, then neighbouring symbols of which the left one is on the left side and the right one on
   the right side (a bit of their names) become a pair symbol. A symbol's name is computed from the names it is made of, so it is the
   same in every task and document without a dictionary, and equal substrings get equal symbols but near their ends.
   For each boundary between symbols the parse also keeps the words that decide it (its region): whoever has these words has this boundary.
2. Every window takes a unit: the words of the first region it holds whole, of the highest round that has one; if there is none, all its
   words. That depends on its own words only, so equal windows have equal units, and some windows share one. Which units occur in two texts
   is counted by Spark (4 bytes a unit and group are shuffled, a bit comes back).
3. Windows whose unit is shared are named by a 128-bit digest of their very words; a group of texts keeps the least order of each and settles
   greater ones itself, and digests are dealt over the tasks, one entry per window and group, whatever number of rows share its least
   order (rows without doc_id share one). So a passage in all documents is an entry per group, and no task holds all its copies.
4. The places found are put together per text, and results are joined back to the documents by the digest of the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, cut, own_columns, salted_join
from .suffix import DIGEST, LAST, SPANS, _join, _runs, _table, _u32, by_window, extra_places, gone_of, smaller, texts

WINDOW, ROUNDS, LOWEST = 13, 3, 2  # units come from rounds LOWEST to ROUNDS
GROUP_BYTES, BUCKET_BYTES = 4 << 20, 16 << 20  # text in a group of documents, and text whose units share a bucket
FAR = 1 << 40
U = np.uint64

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[ord(c) for c in SPACES]] = True
_BYTES = np.random.default_rng(13).integers(1 << 63, size=256, dtype=np.int64).astype(U) * U(2) + U(1)
_PLACES = np.cumprod(np.full(1 << 16, U(0x5851F42D4C957F2D)), dtype=U)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ h >> U(31)
    h *= U(0x9E3779B97F4A7C15)
    h ^= h >> U(29)
    h *= U(0xBF58476D1CE4E5B9)
    return h ^ h >> U(32)


class Words:
    """The words of distinct texts, end to end: their names, places in `buffer` (words with one space after each) and texts."""

    def __init__(self, table: pa.Table):
        rows: dict[bytes, list] = {}
        for sha, order, text in zip(table["sha"].to_pylist(), table["ord"].to_pylist(), table["text"]):
            row = rows.setdefault(sha, [order, None])
            row[0] = min(row[0], order)
            if row[1] is None and text.is_valid:
                row[1] = text.as_buffer().to_pybytes()
        self.sha = sorted(rows)
        self.order = np.array([rows[s][0] for s in self.sha], np.int64)
        raw = [rows[s][1] or b"" for s in self.sha]
        x = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
        ends = np.cumsum([len(t) + 1 for t in raw])
        blank = _SEPARATOR[x]
        edge = np.concatenate([[True], blank])
        starts, stops = np.flatnonzero(edge[:-1] & ~blank), np.flatnonzero(~edge[:-1] & blank)
        inner = ~blank
        inner[stops] = True
        self.buffer = np.where(blank, np.uint8(32), x)[inner].tobytes()
        size = stops - starts
        self.at = np.cumsum(size + 1) - size - 1  # in `buffer`
        self.end = self.at + size
        self.first = np.searchsorted(starts, np.concatenate([[0], ends])).astype(np.int64)  # word where each text begins, and the number of words
        self.owner = np.repeat(np.arange(len(raw)), np.diff(self.first))
        self.n = len(starts)
        if self.n:
            value = _BYTES[x[~blank]] * _PLACES[np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) & 0xFFFF]
            self.name = _mixed(np.add.reduceat(value, np.cumsum(size) - size))
        else:
            self.name = np.zeros(0, U)

    def text(self, i: int) -> bytes:
        a, b = self.first[i], self.first[i + 1]
        return self.buffer[self.at[a]:self.end[b - 1]] if a < b else b""


def parse(name: np.ndarray, first: np.ndarray, rounds: int = ROUNDS) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(place, from, to) of the boundaries that are left after each round, with the region that decides each; texts begin at the places `first`.

    Regions of boundaries that texts' ends decide are infinite. Places and regions ascend, but for the infinite ones.
    """
    n = len(name)
    at = np.arange(n + 1, dtype=np.int64)
    lo, hi = at.copy(), at.copy()
    ends = np.zeros(n + 1, bool)
    ends[first] = True
    name, out = name.copy(), []

    def keep(stay: np.ndarray) -> None:
        """Leave out the boundaries that do not stay; what decides one is what decides it and its neighbours."""
        nonlocal at, lo, hi
        wide_lo, wide_hi = np.concatenate([[-FAR], lo[:-1]]), np.concatenate([hi[1:], [FAR]])
        wide_lo[ends[at]], wide_hi[ends[at]] = -FAR, FAR
        at, lo, hi = at[stay], wide_lo[stay], wide_hi[stay]

    for r in range(rounds):
        if not len(name):
            out.append((at[:0], lo[:0], hi[:0]))
            continue
        stay = ends[at]
        stay[1:-1] |= name[1:] != name[:-1]
        starts = np.flatnonzero(stay[:-1])
        times = np.diff(np.append(starts, len(name)))
        name = np.where(times > 1, _mixed(name[starts] * U(3) + times.astype(U)), name[starts])
        keep(stay)
        side = _mixed(name + U(2 * r + 1)) >> U(63)
        stay = ends[at]
        stay[1:-1] |= (side[:-1] != 0) | (side[1:] != 1)
        starts = np.flatnonzero(stay[:-1])
        pair = np.diff(np.append(starts, len(name))) > 1
        name = np.where(pair, _mixed(name[starts] * U(5) + _mixed(name[np.minimum(starts + 1, len(name) - 1)] + U(7))), name[starts])
        keep(stay)
        out.append((at, lo, hi))
    return out


def units(words: Words, window: int = WINDOW, rounds: int = ROUNDS, lowest: int = LOWEST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, which, unit): the places where a window starts, the index of each one's unit, and the hashes of the units."""
    starts = np.flatnonzero(np.arange(words.n) + window <= words.first[1:][words.owner])
    begin, stop = np.full(len(starts), -1, np.int64), np.full(len(starts), -1, np.int64)
    for place, lo, hi in reversed(parse(words.name, words.first, rounds)[lowest - 1:]):
        known = (lo > -FAR) & (hi < FAR)
        lo, hi = lo[known], hi[known]
        if not len(lo):
            continue
        open_ = np.flatnonzero(begin < 0)
        k = np.searchsorted(lo, starts[open_], "left")  # regions ascend: the first that begins in the window is the first that may end in it
        k = np.minimum(k, len(lo) - 1)
        fits = (lo[k] >= starts[open_]) & (hi[k] <= starts[open_] + window)
        begin[open_[fits]], stop[open_[fits]] = lo[k[fits]], hi[k[fits]]
    rest = begin < 0
    begin[rest], stop[rest] = starts[rest], starts[rest] + window
    new = np.ones(len(starts), bool)
    new[1:] = (begin[1:] != begin[:-1]) | (stop[1:] != stop[:-1])
    which, begin, stop = np.cumsum(new) - 1, begin[new], stop[new]
    h = np.zeros(len(begin), U)
    for k in range(window):
        on = begin + k < stop
        h[on] = _mixed(h[on] * U(0x5851F42D4C957F2D) + words.name[begin[on] + k] + U(k + 1))
    return starts, which, h


FOUND = "bucket int, g int, units binary, many binary"
FLAGS = "g int, bucket int, flags binary"
ENTRIES = "bucket int, g int, digests binary, ords binary, places binary, several binary, extra binary"


class Group(Words):
    """Words with their windows and the units of these, sorted by bucket."""

    def __init__(self, table: pa.Table, buckets: int):
        super().__init__(table)
        self.starts, which, h = units(self)
        self.known, name = np.unique((h >> U(32)) % U(buckets) << U(32) | h & U(0xFFFFFFFF), return_inverse=True)  # bucket and 32 bits more
        self.which = name[which] if len(h) else which

    def in_many(self) -> np.ndarray:
        """Whether each unit is in two texts or more of this group."""
        low, high = np.full(len(self.known), FAR), np.full(len(self.known), -1)
        np.minimum.at(low, self.which, self.owner[self.starts])
        np.maximum.at(high, self.which, self.owner[self.starts])
        return low != high


def _found(buckets: int) -> Callable:
    def run(key: tuple, table: pa.Table) -> pa.Table:
        g = Group(table, buckets)
        many = g.in_many()
        return _table(FOUND, [(b, key[0].as_py(), _u32(g.known[lo:hi] & U(0xFFFFFFFF)), np.packbits(many[lo:hi]).tobytes()) for b, lo, hi in _runs(g.known >> U(32))])

    return run


def _shared(key: tuple, table: pa.Table) -> pa.Table:
    """For the units of one bucket, by group: a bit for those in two groups, or in two texts of one."""
    each = [np.frombuffer(x, "<u4") for x in table["units"].to_pylist()]
    many = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=len(a)) for x, a in zip(table["many"].to_pylist(), each)])
    known, which, times = np.unique(np.concatenate(each), return_inverse=True, return_counts=True)
    often = times > 1
    often[which[many > 0]] = True
    parts = np.split(often[which], np.cumsum([len(a) for a in each])[:-1])
    return _table(FLAGS, [(g, key[0].as_py(), np.packbits(p).tobytes()) for g, p in zip(table["g"].to_pylist(), parts) if p.any()])


def _spans(places: np.ndarray) -> bytes:
    """(text, from, to) of the words that windows at (text, word) cover; consecutive windows make one span."""
    by = np.lexsort((places[:, 1], places[:, 0]))
    p = places[by]
    new = np.ones(len(p), bool)
    new[1:] = (p[1:, 0] != p[:-1, 0]) | (p[1:, 1] > p[:-1, 1] + 1)
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(p)) - 1
    return _u32(np.column_stack([p[at, 0], p[at, 1], p[last, 1] + WINDOW]))


def _entries(buckets: int) -> Callable:
    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(right):
            return _table(ENTRIES, [])
        g, me = Group(left, buckets), key[0].as_py()
        flag = np.zeros(len(g.known), bool)
        for b, bits in zip(right["bucket"].to_pylist(), right["flags"].to_pylist()):
            lo, hi = np.searchsorted(g.known, np.array([b << 32, b + 1 << 32], U))
            flag[lo:hi] = np.unpackbits(np.frombuffer(bits, np.uint8), count=hi - lo)
        at = g.starts[flag[g.which]]
        raw = b"".join(hashlib.blake2b(g.buffer[a:b], digest_size=DIGEST).digest() for a, b in zip(g.at[at].tolist(), g.end[at + WINDOW - 1].tolist()))
        digest = np.frombuffer(raw, f"V{DIGEST}")
        order = g.order[g.owner[at]]
        gone = smaller(digest, order)
        places = np.column_stack([g.owner[at], at - g.first[g.owner[at]]])
        dealt, extra = by_window(buckets, me, digest[~gone], order[~gone], places[~gone])
        rows = [(b, me, digests, ords, first, several, None) for b, digests, ords, first, several in dealt]
        if gone.any() or extra:
            rows.append((buckets + me % buckets, me, None, None, _spans(places[gone]) if gone.any() else None, None, extra))
        return _table(ENTRIES, rows)

    return run


def _least(buckets: int) -> Callable:
    """Spans of the windows of one bucket that also start under a smaller order, by group."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        if key[0].as_py() >= buckets:  # settled inside their group
            return _table(SPANS, [(g, p, None, e) for g, p, e in zip(*(table[c].to_pylist() for c in ("g", "places", "extra")))])
        digest = _join(table, "digests", f"V{DIGEST}")
        gone, rows, at = smaller(digest, _join(table, "ords", "<i8")), [], 0
        for g, p, several in zip(*(table[c].to_pylist() for c in ("g", "places", "several"))):
            to = at + len(p) // 8
            if gone[at:to].any():
                rows.append((g, _spans(np.frombuffer(p, "<u4").astype(np.int64).reshape(-1, 2)[gone[at:to]]), gone_of(digest[at:to], gone[at:to], several), None))
            at = to
        return _table(SPANS, rows)

    return run


RESULT = "sha binary, least long, n_words long, n_removed long, kept_sha256 string"


def _apply(with_text: bool) -> Callable:
    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        g = Words(left)
        edge = np.zeros(g.n + 1, np.int64)
        more = extra_places(right)
        spans = np.frombuffer(b"".join(x for x in right["spans"].to_pylist() if x), "<u4").astype(np.int64).reshape(-1, 3)
        spans = np.concatenate([spans, np.column_stack([more, more[:, 1] + WINDOW])])
        np.add.at(edge, g.first[spans[:, 0]] + spans[:, 1], 1)
        np.add.at(edge, g.first[spans[:, 0]] + spans[:, 2], -1)
        stays = np.cumsum(edge[:-1]) == 0
        rows = []
        for i, sha in enumerate(g.sha):
            a, b = int(g.first[i]), int(g.first[i + 1])
            on = np.concatenate([[False], stays[a:b], [False]])
            runs = np.flatnonzero(on[1:] != on[:-1]).reshape(-1, 2) + a
            kept = b" ".join(g.buffer[g.at[x]:g.end[y - 1]] for x, y in runs.tolist())
            row = (sha, int(g.order[i]), b - a, b - a - int(stays[a:b].sum()), hashlib.sha256(kept).hexdigest())
            rows.append((*row, kept.decode("utf-8")) if with_text else row)
        return _table(RESULT + ", kept string" * with_text, rows)

    return run


def _per_text(docs: DataFrame, total: int, with_text: bool) -> DataFrame:
    """What is left of each distinct text in its document with the least order."""
    groups, buckets = max(1, total // GROUP_BYTES), max(4, total // BUCKET_BYTES)
    t = texts(docs, groups)
    flags = t.groupBy("g").applyInArrow(_found(buckets), FOUND).groupBy("bucket").applyInArrow(_shared, FLAGS)
    entries = t.groupBy("g").cogroup(flags.groupBy("g")).applyInArrow(_entries(buckets), ENTRIES)
    spans = entries.groupBy("bucket").applyInArrow(_least(buckets), SPANS)
    return t.groupBy("g").cogroup(spans.groupBy("g")).applyInArrow(_apply(with_text), RESULT + ", kept string" * with_text)


def dedup_words(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 (`with_text`: and kept, the words left joined by one space), one row per document.

    A null text has no words. Words are compared as they are, windows never cross documents and are judged on the input.
    Rows with equal doc_id do not remove each other's words; a null doc_id counts as greater than all. Copies of a text
    under a greater doc_id lose all words if there are at least 13. Repeated rows keep a row each; an empty table gives no row.
    """
    raw = F.coalesce("text", F.lit(""))
    rows = cut(own_columns(docs, "doc_id", "text").select(
        "doc_id", F.coalesce("doc_id", F.lit(LAST)).alias("ord"), F.unhex(F.sha2(raw, 256)).alias("sha"), F.octet_length(raw).cast("long").alias("_bytes")))
    total = rows.agg(F.sum("_bytes")).first()[0] or 0
    per = _per_text(docs, total, with_text)
    gone = (F.col("ord") > F.col("least")) & (F.col("n_words") >= WINDOW)
    copy = F.col("ord") > F.col("least")
    out = salted_join(rows, per, "sha")
    kept = [F.when(gone, F.lit("")).otherwise(F.col("kept")).alias("kept")] if with_text else []
    return out.select("doc_id", "n_words", F.when(gone, F.col("n_words")).when(copy, F.lit(0)).otherwise(F.col("n_removed")).cast("long").alias("n_removed"),
                      F.when(gone, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.col("kept_sha256")).alias("kept_sha256"), *kept)


def op13_substring_dedup(docs: DataFrame) -> DataFrame:
    """`dedup_words` of all documents; null and empty texts have no words and lose none."""
    return dedup_words(docs)
