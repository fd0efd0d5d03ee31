"""Suffix-array deduplication of repeated byte strings across documents (operator 2).

A byte of a document goes if a `WINDOW`-byte string that covers it also starts in a document with a smaller
doc_id. Sorting every suffix of the corpus would move each byte many times, so only anchors move: every window
holds SPREAD overlapping GRAM-byte strings, and the one with the least hash (ties: all) is its
anchor. Equal windows have equal anchors at equal places, so no match is lost. The jobs:

1. `texts`: copies of a text are met once per task; only distinct texts go on, grouped by their digest.
2. `detect`: which anchor hashes occur in two texts or more (4 bytes an anchor are shuffled, a bit comes back).
3. `match`: the occurrences of such anchors, with the bytes around them, are sorted: a suffix array of what follows the
   anchor and one of what precedes it (reversed). Prefix polynomial hashes and binary search give the common extension
   of two suffixes, so a comparison in the mergesort takes log2(WINDOW) hash probes; common extensions of
   neighbours are then verified byte by byte, and the sort is repeated with another base if a hash lied.
   For each place of a window around the anchor the two arrays give classes of equal windows and their least doc_id.
4. The intervals found are merged per text and joined back to the documents by digest.

Occurrences with the same surroundings are merged before the shuffle. The ends of a passage have different surroundings
in each document, so an anchor that may have more than HOT entries is matched window by window instead: a group keeps the least
order of each of its windows, settles greater ones itself, and windows are dealt to the buckets by digest. An anchor brings at most
HOT entries to a bucket, and a window one per group, whatever number of rows share its least order (rows without doc_id share one);
their further places stay with the group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, own_columns, salted_join

WINDOW, GRAM = 50, 24
SPREAD = WINDOW - GRAM + 1
LEFT = WINDOW - GRAM  # bytes kept before an anchor; WINDOW bytes are kept from its start
GROUP_BYTES = 4 << 20  # text in a group of documents
BUCKET_BYTES = 16 << 20  # text whose anchors share a bucket
BLOCK_BYTES = (1 << 20) - 64  # text hashed at once
HOT = 20_000  # entries of an anchor that one task takes
FEW = 8  # occurrences in a group from which they are counted
SLICE = 50_000  # entries matched at once, whole anchors
LAST = (1 << 63) - 1  # the order of rows without doc_id

U = np.uint64


@cache
def _base(seed: int) -> tuple[np.uint64, np.ndarray]:
    r = np.random.default_rng(seed)
    return U(int(r.integers(1 << 62, dtype=np.int64)) * 2 + 1), r.integers(1 << 63, size=257, dtype=np.int64).astype(U) * U(2) + U(1)


@cache
def _powers(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    base, _ = _base(seed)
    inverse = U(pow(int(base), -1, 1 << 64))
    up, down = np.full(n, base, U), np.full(n, inverse, U)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=U), np.cumprod(down, dtype=U)


def gram_hashes(x: np.ndarray, k: int) -> np.ndarray:
    """Mixed hashes of the k-byte strings of `x` from prefix polynomial hashes modulo 2^64."""
    n = len(x)
    up, down = _powers(1 << max(20, n.bit_length()), 1)
    prefix = np.zeros(n + 1, U)
    np.cumsum(_base(1)[1][x] * up[:n], dtype=U, out=prefix[1:])
    h = (prefix[k:] - prefix[:-k]) * down[:n - k + 1]
    h ^= h >> U(31)
    h *= U(0x9E3779B97F4A7C15)
    h ^= h >> U(29)
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(32)
    return h


def _slide(a: np.ndarray, width: int, f: Callable) -> np.ndarray:
    n, s = len(a), 1
    m = a
    while 2 * s <= width:
        m = f(m[:len(m) - s], m[s:])
        s *= 2
    return f(m[:n - width + 1], m[width - s:width - s + n - width + 1])


def anchors(x: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash) of the anchors of texts that lie end to end in `x`; `ends` is the end of its text for each byte."""
    if len(x) < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, U)
    h = gram_hashes(x, GRAM)
    least = _slide(h, SPREAD, np.minimum)
    least[np.arange(WINDOW, len(least) + WINDOW) > ends[:len(least)]] = 0
    most = _slide(np.concatenate([np.zeros(LEFT, U), least, np.zeros(LEFT, U)]), SPREAD, np.maximum)
    at = np.flatnonzero((most == h) & (most > 0))
    return at, h[at]


def _blocks(x: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`anchors` of all texts, found BLOCK_BYTES at a time; every window lies in one block whole, so long texts may be cut."""
    at, hashes = [np.zeros(0, np.int64)], [np.zeros(0, U)]
    for lo in range(0, len(x), BLOCK_BYTES):
        hi = min(len(x), lo + BLOCK_BYTES + WINDOW - 1)
        i, j = np.searchsorted(ends, [lo, hi - 1], "right")
        here = ends[i:j + 1]
        a, h = anchors(x[lo:hi], np.repeat(here - lo, np.diff(np.minimum(here, hi), prepend=lo)))
        at.append(a + lo)
        hashes.append(h)
    at, first = np.unique(np.concatenate(at), return_index=True)
    return at, np.concatenate(hashes)[first]


class Group:
    """The distinct texts of a group, by digest, with their least order and their anchors."""

    def __init__(self, table: pa.Table, buckets: int, find: bool = True):
        rows: dict[bytes, list] = {}
        for sha, order, text in zip(table["sha"].to_pylist(), table["ord"].to_pylist(), table["text"]):
            row = rows.setdefault(sha, [order, None])
            row[0] = min(row[0], order)
            if row[1] is None and text.is_valid:
                row[1] = text.as_buffer().to_pybytes()
        self.sha = sorted(rows)
        self.texts = [rows[s][1] for s in self.sha]
        self.order = np.array([rows[s][0] for s in self.sha], np.int64)
        self.length = np.array([len(t) for t in self.texts], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.buffer = np.frombuffer(b"".join(self.texts), np.uint8)
        if not find:
            return
        ends = self.start + self.length
        self.at, h = _blocks(self.buffer, ends)
        self.owner = np.searchsorted(ends, self.at, "right")
        self.known, self.which = np.unique((h >> U(32)) % U(buckets) << U(32) | h & U(0xFFFFFFFF), return_inverse=True)  # bucket and 32 bits more

    def runs(self) -> Iterator[tuple[int, int, int]]:
        """(bucket, from, to) of the known anchors of each bucket that has any."""
        return _runs(self.known >> U(32))

    def in_many(self) -> np.ndarray:
        """Whether each known anchor is in two texts or more of this group."""
        low = np.full(len(self.known), 1 << 62, np.int64)
        high = np.full(len(self.known), -1, np.int64)
        np.minimum.at(low, self.which, self.owner)
        np.maximum.at(high, self.which, self.owner)
        return low != high


def texts(docs: DataFrame, groups: int) -> DataFrame:
    """(g, sha, ord, text): each distinct text once per task at least; `text` is null in rows that only lower `ord`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = text.as_buffer() if text.is_valid else b""
                sha, order = hashlib.sha256(raw).digest(), LAST if doc_id is None else doc_id
                before = seen.get(sha)
                if before is None or order < before:
                    seen[sha] = order
                    whole = (text.as_py() or "") if before is None else None
                    for column, value in zip(out, (int.from_bytes(sha[:8], "big") % groups, sha, order, whole)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int32(), pa.binary(), pa.int64(), pa.string()))], ["g", "sha", "ord", "text"])

    return own_columns(docs, "doc_id", "text").mapInArrow(run, "g int, sha binary, ord long, text string")


FOUND = "bucket int, g int, grams binary, many binary, counts binary"
FLAGS = "g int, bucket int, flags binary, hot binary"
DIGEST = 16
EXTRA = np.dtype([("digest", f"V{DIGEST}"), ("place", "<u4", 2)])
AROUND = "bucket int, g int, grams binary, ords binary, places binary, bytes binary, sizes binary, several binary"
SPANS = "g int, spans binary, gone binary, extra binary"


def _table(schema: str, rows: list[tuple]) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    names, types = zip(*(f.split() for f in schema.split(", ")))
    columns = list(zip(*rows)) if rows else [[]] * len(names)
    return pa.table([pa.array(c, kinds[t]) for c, t in zip(columns, types)], names=list(names))


def _runs(values: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, from, to) of each run of equal values."""
    edges = np.append(np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])), len(values)) if len(values) else np.zeros(1, np.int64)
    return zip(values[edges[:-1]].tolist(), edges[:-1].tolist(), edges[1:].tolist())


def _slices(values: np.ndarray) -> Iterator[tuple[int, int]]:
    """(from, to) of pieces of sorted values: at most SLICE of them, or all equal."""
    ends = np.append(np.flatnonzero(values[1:] != values[:-1]) + 1, len(values)) if len(values) else np.zeros(0, np.int64)
    at = 0
    while at < len(values):
        to = int(max(ends[np.searchsorted(ends, at, "right")], ends[max(0, np.searchsorted(ends, at + SLICE, "right") - 1)]))
        yield at, to
        at = to


def _u32(a: np.ndarray) -> bytes:
    return a.astype("<u4").tobytes()


def _counts(times: np.ndarray) -> bytes:
    """(index, times) of those of at least FEW."""
    at = np.flatnonzero(times >= FEW)
    return _u32(np.stack([at, times[at]], 1))


def _found(buckets: int) -> Callable:
    def run(key: tuple, table: pa.Table) -> pa.Table:
        g = Group(table, buckets)
        many, rows = g.in_many(), []
        times = np.bincount(g.which, minlength=len(g.known))
        for b, lo, hi in g.runs():
            rows.append((b, key[0].as_py(), _u32(g.known[lo:hi] & U(0xFFFFFFFF)), np.packbits(many[lo:hi]).tobytes(), _counts(times[lo:hi])))
        return _table(FOUND, rows)

    return run


def _detect(hottest: int) -> Callable:
    def run(key: tuple, table: pa.Table) -> pa.Table:
        grams = [np.frombuffer(x, "<u4") for x in table["grams"].to_pylist()]
        many = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(a)) for x, a in zip(table["many"].to_pylist(), grams)]
        most = []
        for a, counts in zip(grams, table["counts"].to_pylist()):
            pairs = np.frombuffer(counts, "<u4").reshape(-1, 2)
            most.append(np.full(len(a), FEW - 1, np.int64))
            most[-1][pairs[:, 0]] = pairs[:, 1]
        value, flag, most = np.concatenate(grams), np.concatenate(many), np.concatenate(most)
        order = np.argsort(value, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], value[order][1:] != value[order][:-1]]))
        dup = (np.diff(np.append(first, len(value))) > 1) | (np.maximum.reduceat(flag[order], first) > 0)
        flag[order] = np.repeat(dup, np.diff(np.append(first, len(value))))
        hot = np.empty(len(value), bool)
        hot[order] = np.repeat(dup & (np.add.reduceat(most[order], first) > hottest), np.diff(np.append(first, len(value))))
        cuts = np.cumsum([len(a) for a in grams])[:-1]
        rows = zip(table["g"].to_pylist(), np.split(flag, cuts), np.split(hot, cuts))
        return _table(FLAGS, [(g, key[0].as_py(), np.packbits(p).tobytes(), _u32(np.flatnonzero(h))) for g, p, h in rows if p.any()])

    return run


def _windows(around: np.ndarray, sizes: np.ndarray, order: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int, list[bytes]]]:
    """Per place of the anchor in a window: entries whose window starts under a smaller order among them, the others, the place, and digests of the others' windows."""
    for place in range(SPREAD):
        fits = np.flatnonzero((sizes[:, 0] >= place) & (sizes[:, 1] >= WINDOW - place))
        if not len(fits):
            continue
        window = np.ascontiguousarray(around[fits, LEFT - place:LEFT - place + WINDOW]).view(f"V{WINDOW}").ravel()
        known, which = np.unique(window, return_inverse=True)
        low = np.full(len(known), LAST, np.int64)
        np.minimum.at(low, which, order[fits])
        gone = order[fits] > low[which]
        digests = [hashlib.blake2b(w.tobytes(), digest_size=DIGEST).digest() for w in known]
        yield fits[gone], fits[~gone], place, [digests[i] for i in which[~gone]]


def _surroundings(g: Group, mine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes around anchors (zero beyond their text) and how many there are before and from the anchor."""
    at, owner = g.at[mine], g.owner[mine]
    place = at - g.start[owner]
    before, after = np.minimum(LEFT, place), np.minimum(WINDOW, g.length[owner] - place)
    around = np.lib.stride_tricks.sliding_window_view(g.padded, LEFT + WINDOW)[at]
    for edge, cut_off in ((np.flatnonzero(before < LEFT), lambda i: np.arange(LEFT + WINDOW) < LEFT - before[i, None]),
                          (np.flatnonzero(after < WINDOW), lambda i: np.arange(LEFT + WINDOW) >= LEFT + after[i, None])):
        for i in range(0, len(edge), SLICE):
            some = edge[i:i + SLICE]
            around[some] *= ~cut_off(some)
    return around, np.stack([before, after], 1).astype(np.uint8)


def _standing(around: np.ndarray, sizes: np.ndarray, which: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Whether an entry has the same anchor and surroundings as one under a smaller order, which stands for it."""
    words = np.zeros((len(around), 80), np.uint8)
    words[:, :LEFT + WINDOW], words[:, LEFT + WINDOW:LEFT + WINDOW + 2] = around, sizes
    words = words.view(U)
    same = which.astype(U)
    for column in range(words.shape[1]):
        same = (same ^ words[:, column]) * U(0x9E3779B97F4A7C15)
        same ^= same >> U(29)
    by = np.lexsort((order, same))
    first = np.concatenate([[True], same[by][1:] != same[by][:-1]])
    stands = np.empty(len(by), np.int64)
    stands[by] = by[np.maximum.accumulate(np.where(first, np.arange(len(by)), 0))]
    return (order > order[stands]) & (which == which[stands]) & (words == words[stands]).all(1)


def _around(buckets: int) -> Callable:
    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(right):
            return _table(AROUND, [])
        g, me = Group(left, buckets), key[0].as_py()
        g.padded = np.concatenate([np.zeros(LEFT, np.uint8), g.buffer, np.zeros(WINDOW, np.uint8)])
        dup, hot = np.zeros(len(g.known), bool), np.zeros(len(g.known), bool)
        for b, flags, often in zip(*(right[c].to_pylist() for c in ("bucket", "flags", "hot"))):
            lo, hi = np.searchsorted(g.known, np.array([b << 32, b + 1 << 32], U))
            hot[lo + np.frombuffer(often, "<u4").astype(np.int64)] = True
            dup[lo:hi] = np.unpackbits(np.frombuffer(flags, np.uint8), count=hi - lo)
        mine = np.flatnonzero(dup[g.which])
        mine = mine[np.argsort(g.which[mine], kind="stable")]
        rows: list[tuple] = []
        for a, z in _slices(g.which[mine]):  # anchors do not depend on each other
            rows += _send(g, me, buckets, hot, mine[a:z])
        return _table(AROUND, rows)

    return run


def _settled(buckets: int, me: int, spans: np.ndarray) -> list[tuple]:
    return [(buckets + me % buckets, me, None, None, _u32(spans), None, None, None)] if len(spans) else []


def by_window(buckets: int, me: int, digest: np.ndarray, order: np.ndarray, places: np.ndarray) -> tuple[list[tuple], bytes]:
    """Windows of a group, each under its least order, dealt to buckets: ((bucket, digests, orders, first places, several) rows, extra).

    A window goes to its bucket once, however many rows without doc_id, of one doc_id or of one text have it: `several` are the digests of those with further places,
    and `extra` is these, as (digest, place), which go back to the group past the buckets.
    """
    known, first, which = np.unique(digest, return_index=True, return_inverse=True)
    more = np.ones(len(digest), bool)
    more[first] = False
    twice = np.zeros(len(known), bool)
    twice[which[more]] = True
    bucket = np.frombuffer(known.tobytes(), "<u8")[::DIGEST // 8] % U(buckets)
    by = np.argsort(bucket, kind="stable")
    rows = []
    for b, lo, hi in _runs(bucket[by]):
        s = by[lo:hi]
        rows.append((b, known[s].tobytes(), order[first[s]].astype("<i8").tobytes(), _u32(places[first[s]]), known[s[twice[s]]].tobytes()))
    extra = np.zeros(int(more.sum()), EXTRA)
    extra["digest"], extra["place"] = digest[more], places[more]
    return rows, extra.tobytes()


def smaller(digest: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Whether each entry's window also has a smaller order among the entries."""
    known, which = np.unique(digest, return_inverse=True)
    low = np.full(len(known), LAST, np.int64)
    np.minimum.at(low, which, order)
    return order > low[which]


def gone_of(digest: np.ndarray, gone: np.ndarray, several: bytes) -> bytes:
    """The digests of `several` that are gone."""
    asked = np.frombuffer(several, f"V{DIGEST}")
    return np.intersect1d(digest[gone], asked).tobytes() if len(asked) else b""


def extra_places(right: pa.Table) -> np.ndarray:
    """The further places (text, start) of a group's windows that are gone."""
    gone = np.frombuffer(b"".join(x for x in right["gone"].to_pylist() if x), f"V{DIGEST}")
    extra = np.frombuffer(b"".join(x for x in right["extra"].to_pylist() if x), EXTRA)
    if not len(gone) or not len(extra):
        return np.zeros((0, 2), np.int64)
    known, which = np.unique(np.concatenate([gone, extra["digest"]]), return_inverse=True)
    flag = np.zeros(len(known), bool)
    flag[which[:len(gone)]] = True
    return extra["place"][flag[which[len(gone):]]].astype(np.int64)


def _send(g: Group, me: int, buckets: int, hot: np.ndarray, mine: np.ndarray) -> list[tuple]:
    """AROUND rows of the anchors `mine`, which are in the order of their buckets."""
    owner, which = g.owner[mine], g.which[mine]
    place, order = g.at[mine] - g.start[owner], g.order[owner]
    around, sizes = _surroundings(g, mine)
    local = _standing(around, sizes, which, order)
    before, after = sizes[:, 0].astype(np.int64), sizes[:, 1].astype(np.int64)
    inside = np.flatnonzero(local & (before + after >= WINDOW))
    rows = _settled(buckets, me, np.stack([owner[inside], place[inside] - before[inside], place[inside] + after[inside]], 1))
    often = np.flatnonzero(~local & hot[which])
    if len(often):
        rows += _spread(buckets, me, around[often], sizes[often].astype(np.int64), order[often], owner[often], place[often])
    send = np.flatnonzero(~local & ~hot[which])
    key = g.known[which[send]]
    for b, lo, hi in _runs(key >> U(32)):
        s = send[lo:hi]
        rows.append((b, me, _u32(key[lo:hi] & U(0xFFFFFFFF)), order[s].astype("<i8").tobytes(),
                     _u32(np.stack([owner[s], place[s]], 1)), around[s].tobytes(), sizes[s].tobytes(), None))
    return rows


def _spread(buckets: int, me: int, around: np.ndarray, sizes: np.ndarray, order: np.ndarray, owner: np.ndarray, place: np.ndarray) -> list[tuple]:
    """AROUND rows of hot anchors: spans settled here, and each other window with its digest (in `bytes`), by digest; its span's start is in `places`."""
    least, most, parts = np.full(len(order), WINDOW), np.full(len(order), -1), [[], [], []]
    for gone, rest, p, digests in _windows(around, sizes, order):
        least[gone], most[gone] = np.minimum(least[gone], p), p  # windows around one anchor overlap, so their union is one span
        for part, more in zip(parts, (np.frombuffer(b"".join(digests), np.uint8).reshape(-1, DIGEST), order[rest], np.stack([owner[rest], place[rest] - p], 1))):
            part.append(more)
    gone = np.flatnonzero(most >= 0)
    rows = _settled(buckets, me, np.stack([owner[gone], place[gone] - most[gone], place[gone] - least[gone] + WINDOW], 1))
    if not parts[0]:
        return rows
    digest, orders, starts = map(np.concatenate, parts)
    once = np.unique(starts[:, 0] << 32 | starts[:, 1], return_index=True)[1]  # a window is met at each of its anchors
    digest, orders, starts = np.ascontiguousarray(digest[once]).view(f"V{DIGEST}").ravel(), orders[once], starts[once]
    late = smaller(digest, orders)  # around an anchor that only some texts with this window have
    rows += _settled(buckets, me, np.column_stack([starts[late], starts[late, 1] + WINDOW]))
    dealt, extra = by_window(buckets, me, digest[~late], orders[~late], starts[~late])
    rows += [(b, me, None, ords, places, digests, None, several) for b, digests, ords, places, several in dealt]
    return rows + ([(buckets + me % buckets, me, None, None, None, extra, None, None)] if extra else [])


class Suffixes:
    """Rows of bytes (each to its own size) and their prefix polynomial hashes."""

    def __init__(self, rows: np.ndarray, sizes: np.ndarray, seed: int):
        self.rows, self.sizes = rows, sizes.astype(np.int64)
        n, width = rows.shape
        up, _ = _powers(1 << 20, seed)
        self.bytes = np.where(np.arange(width) < self.sizes[:, None], rows.astype(np.int16) + 1, 0)  # 0 ends a suffix
        self.hash = np.zeros((n, width + 1), U)
        np.cumsum(_base(seed)[1][self.bytes] * up[:width], axis=1, dtype=U, out=self.hash[:, 1:])

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The common extension of suffixes i and j by binary search over prefix hashes."""
        low = np.zeros(len(i), np.int64)
        high = np.minimum(self.sizes[i], self.sizes[j])
        for _ in range(int(self.rows.shape[1]).bit_length()):
            mid = (low + high + 1) // 2
            same = self.hash[i, mid] == self.hash[j, mid]
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def before(self, i: np.ndarray, j: np.ndarray, ties: bool) -> np.ndarray:
        """Whether suffix i sorts before j; equal ones if `ties`."""
        n = self.common(i, j)
        last = self.rows.shape[1] - 1
        a, b = self.bytes[i, np.minimum(n, last)], self.bytes[j, np.minimum(n, last)]
        return np.where((n > last) | (a == b), ties, a < b)

    def verified(self, i: np.ndarray, j: np.ndarray) -> np.ndarray | None:
        """The common extension of i and j, or None if bytes and hashes disagree."""
        differ = self.bytes[i] != self.bytes[j]
        n = np.where(differ.any(1), differ.argmax(1), self.rows.shape[1])
        n = np.minimum(n, np.minimum(self.sizes[i], self.sizes[j]))
        return n if (n == self.common(i, j)).all() else None


def merge_sort(suffixes: Suffixes, group: np.ndarray) -> np.ndarray:
    """Order of the suffixes within each run of equal `group` (which must be sorted): a bottom-up mergesort.

    All runs are merged at once: a suffix finds its rank in the run beside its own by binary search.
    """
    n = len(group)
    start = np.searchsorted(group, group, "left")
    end = np.searchsorted(group, group, "right")
    order, width = np.arange(n), 1
    longest = int((end - start).max(initial=0))
    while width < longest:
        at = np.flatnonzero(end - start > width)  # places of groups not yet in one run
        local = at - start[at]
        pair = start[at] + local // (2 * width) * 2 * width
        second = np.minimum(pair + width, end[at])
        stop = np.minimum(pair + 2 * width, end[at])
        left = at < second
        low = np.where(left, second, pair)
        high = np.where(left, stop, second)
        base = low.copy()
        me = order[at]
        while True:
            busy = np.flatnonzero(low < high)
            if not len(busy):
                break
            mid = (low[busy] + high[busy]) // 2
            other = order[mid]
            # a left suffix passes what is strictly less; a right one also what is equal
            go = np.where(left[busy], ~suffixes.before(me[busy], other, True), suffixes.before(other, me[busy], True))
            low[busy] = np.where(go, mid + 1, low[busy])
            high[busy] = np.where(go, high[busy], mid)
        to = pair + (at - np.where(left, pair, second)) + (low - base)
        new = order.copy()
        new[to] = me
        order, width = new, 2 * width
    return order


def suffix_array(rows: np.ndarray, sizes: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): suffixes sorted within their groups and each one's verified common extension with the one before (-1: first)."""
    for seed in range(2, 64):
        s = Suffixes(rows, sizes, seed)
        order = merge_sort(s, group)
        common = np.full(len(order), -1, np.int64)
        inner = np.flatnonzero(group[order[1:]] == group[order[:-1]]) + 1
        found = s.verified(order[inner - 1], order[inner])
        if found is not None:
            common[inner] = found
            return order, common
    raise RuntimeError("hash collisions in every base")


def repeated(grams: np.ndarray, orders: np.ndarray, around: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least, most) place of the anchor in windows that also start under a smaller order; most < 0 where there is none."""
    by = np.argsort(grams, kind="stable")
    grams, orders, around = grams[by], orders[by], around[by]
    before, after = sizes[by, 0].astype(np.int64), sizes[by, 1].astype(np.int64)
    n = len(grams)
    right, right_common = suffix_array(np.ascontiguousarray(around[:, LEFT:]), after, grams)
    left, left_common = suffix_array(np.ascontiguousarray(around[:, LEFT - 1::-1]), before, grams)
    least, most = np.full(n, WINDOW), np.full(n, -1)
    right_class, left_class = np.empty(n, np.int64), np.empty(n, np.int64)
    for place in range(SPREAD):
        right_class[right] = np.cumsum(right_common < WINDOW - place)
        left_class[left] = np.cumsum(left_common < place)
        fits = np.flatnonzero((before >= place) & (after >= WINDOW - place))
        if not len(fits):
            continue
        key = right_class[fits] * (n + 1) + left_class[fits]
        s = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], key[s][1:] != key[s][:-1]]))
        low = np.minimum.reduceat(orders[fits][s], first)
        hit = fits[s][orders[fits][s] > np.repeat(low, np.diff(np.append(first, len(s))))]
        least[hit] = np.minimum(least[hit], place)
        most[hit] = place
    out = np.empty((2, n), np.int64)
    out[:, by] = least, most
    return out[0], out[1]


def _match(buckets: int) -> Callable:
    def run(key: tuple, table: pa.Table) -> pa.Table:
        if key[0].as_py() >= buckets:  # settled inside their group
            return _table(SPANS, [(g, p, None, e) for g, p, e in zip(*(table[c].to_pylist() for c in ("g", "places", "bytes")))])
        hot = pc.is_null(table["grams"])
        return _table(SPANS, _match_entries(table.filter(pc.invert(hot))) + _match_windows(table.filter(hot)))

    return run


def _join(table: pa.Table, name: str, kind) -> np.ndarray:
    """The bytes of all rows of a column without nulls, end to end; rows of one chunk are not copied one by one."""
    parts = []
    for chunk in table[name].chunks:
        if len(chunk):
            _, edges, data = chunk.buffers()
            edges = np.frombuffer(edges, np.int64 if pa.types.is_large_binary(chunk.type) else np.int32)[chunk.offset:chunk.offset + len(chunk) + 1]
            parts.append(np.frombuffer(data, np.uint8)[edges[0]:edges[-1]] if data is not None else np.zeros(0, np.uint8))
    return np.concatenate(parts or [np.zeros(0, np.uint8)]).view(kind)


def _per_group(table: pa.Table, hit: np.ndarray, spans: np.ndarray) -> list[tuple]:
    rows, at = [], 0
    for g, p in zip(table["g"].to_pylist(), table["places"].to_pylist()):
        to = at + len(p) // 8
        if hit[at:to].any():
            rows.append((g, _u32(spans[at:to][hit[at:to]]), None, None))
        at = to
    return rows


def _match_entries(table: pa.Table) -> list[tuple]:
    if not len(table):
        return []
    grams, orders = _join(table, "grams", "<u4"), _join(table, "ords", "<i8")
    around, sizes = _join(table, "bytes", np.uint8).reshape(-1, LEFT + WINDOW), _join(table, "sizes", np.uint8).reshape(-1, 2)
    by = np.argsort(grams, kind="stable")
    least, most = np.empty(len(by), np.int64), np.empty(len(by), np.int64)
    for at, to in _slices(grams[by]):
        s = by[at:to]
        least[s], most[s] = repeated(grams[s], orders[s], around[s], sizes[s])
    place = _join(table, "places", "<u4").astype(np.int64).reshape(-1, 2)
    return _per_group(table, most >= 0, np.stack([place[:, 0], place[:, 1] - most, place[:, 1] - least + WINDOW], 1))


def _match_windows(table: pa.Table) -> list[tuple]:
    if not len(table):
        return []
    orders, place = _join(table, "ords", "<i8"), _join(table, "places", "<u4").astype(np.int64).reshape(-1, 2)
    digest = _join(table, "bytes", f"V{DIGEST}")
    gone, at = smaller(digest, orders), 0
    rows = _per_group(table, gone, np.stack([place[:, 0], place[:, 1], place[:, 1] + WINDOW], 1))
    for g, digests, several in zip(*(table[c].to_pylist() for c in ("g", "bytes", "several"))):
        to = at + len(digests) // DIGEST
        if found := gone_of(digest[at:to], gone[at:to], several):
            rows.append((g, None, found, None))
        at = to
    return rows


def _merged(spans: np.ndarray, length: int) -> np.ndarray:
    """Maximal runs (start, end) covered by spans of one text."""
    edge = np.zeros(length + 1, np.int64)
    np.add.at(edge, spans[:, 0], 1)
    np.add.at(edge, spans[:, 1], -1)
    on = np.concatenate([[False], np.cumsum(edge)[:-1] > 0, [False]])
    return np.flatnonzero(on[1:] != on[:-1]).reshape(-1, 2)


RESULT = "sha binary, least long, n_removed long, n_spans long, kept_sha256 string"


def _apply(with_text: bool) -> Callable:
    schema = RESULT + ", kept string" * with_text

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        g = Group(left, 1, find=False)
        more = extra_places(right)
        spans = np.frombuffer(b"".join(x for x in right["spans"].to_pylist() if x), "<u4").astype(np.int64).reshape(-1, 3)
        spans = np.concatenate([spans, np.column_stack([more, more[:, 1] + WINDOW])])
        spans = spans[np.argsort(spans[:, 0], kind="stable")]
        cuts = np.searchsorted(spans[:, 0], np.arange(len(g.sha) + 1))
        rows = []
        for i, (sha, text) in enumerate(zip(g.sha, g.texts)):
            runs = _merged(spans[cuts[i]:cuts[i + 1], 1:], len(text)) if cuts[i + 1] > cuts[i] else []
            kept, at = [], 0
            for a, b in runs:
                kept.append(text[at:a])
                at = b
            rest = b"".join([*kept, text[at:]])
            row = (sha, int(g.order[i]), len(text) - len(rest), len(runs), hashlib.sha256(rest).hexdigest())
            rows.append((*row, rest.decode("utf-8", "ignore")) if with_text else row)
        return _table(schema, rows)

    return run


def _entries(t: DataFrame, buckets: int) -> DataFrame:
    flags = t.groupBy("g").applyInArrow(_found(buckets), FOUND).groupBy("bucket").applyInArrow(_detect(HOT), FLAGS)
    return t.groupBy("g").cogroup(flags.groupBy("g")).applyInArrow(_around(buckets), AROUND)


def _per_text(docs: DataFrame, total: int, with_text: bool) -> DataFrame:
    """What is left of each distinct text in its document with the least order."""
    groups, buckets = max(1, total // GROUP_BYTES), max(4, total // BUCKET_BYTES)
    t = texts(docs, groups)
    spans = _entries(t, buckets).groupBy("bucket").applyInArrow(_match(buckets), SPANS)
    return t.groupBy("g").cogroup(spans.groupBy("g")).applyInArrow(_apply(with_text), RESULT + ", kept string" * with_text)


def _narrow(docs: DataFrame, *more: str) -> DataFrame:
    raw = F.coalesce("text", F.lit(""))
    return own_columns(docs, "doc_id", "text", *more).select(
        "doc_id", *more, F.coalesce("doc_id", F.lit(LAST)).alias("ord"), F.unhex(F.sha2(raw, 256)).alias("sha"), F.octet_length(raw).cast("long").alias("n_bytes"))


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256, one row per document.

    A null text counts as empty. Texts are bytes of UTF-8; strings never cross documents and are judged on the
    input. Rows with equal doc_id do not remove each other's bytes; a null doc_id counts as greater than all.
    Copies of a text under a greater doc_id lose all bytes if there are at least 50. An empty table gives no row.
    """
    rows = cut(_narrow(docs))
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    per = _per_text(docs, total, False)
    gone = (F.col("ord") > F.col("least")) & (F.col("n_bytes") >= WINDOW)
    nothing = hashlib.sha256(b"").hexdigest()
    whole = F.col("ord") > F.col("least")
    return salted_join(rows, per, "sha").select(
        "doc_id", "n_bytes",
        F.when(gone, F.col("n_bytes")).when(whole, F.lit(0)).otherwise(F.col("n_removed")).cast("long").alias("n_removed"),
        F.when(gone, F.lit(1)).when(whole, F.lit(0)).otherwise(F.col("n_spans")).cast("long").alias("n_spans"),
        F.when(gone, F.lit(nothing)).when(whole, F.lower(F.hex("sha"))).otherwise(F.col("kept_sha256")).alias("kept_sha256"))


def strip(docs: DataFrame) -> DataFrame:
    """The columns of `docs` with repeated bytes cut out of `text` and n_chars counted anew.

    Characters of which only some bytes are left go too. Texts that lose nothing stay as they are, null ones included;
    a text that loses all becomes empty. Rows are kept, in any order.
    """
    more = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    names = {c: f"_c{i}" for i, c in enumerate(more)}
    d = docs.select("doc_id", "text", "n_chars", *[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    raw = F.coalesce("text", F.lit(""))
    sized = cut(d.select(F.coalesce("doc_id", F.lit(LAST)).alias("ord"), F.unhex(F.sha2(raw, 256)).alias("sha"), F.octet_length(raw).cast("long").alias("n_bytes"),
                         "doc_id", F.col("text").isNull().alias("_null"), "n_chars", *names.values()))
    total = sized.agg(F.sum("n_bytes")).first()[0] or 0
    per = _per_text(d, total, True)
    copy = F.col("ord") > F.col("least")
    text = F.when(F.col("_null"), F.lit(None)).when(copy & (F.col("n_bytes") >= WINDOW), F.lit("")).otherwise(F.col("kept"))
    changed = F.when(copy, F.col("n_bytes") >= WINDOW).otherwise(F.col("n_removed") > 0)
    # `per` holds whole texts, which salting would copy; a digest with most rows is left to the split of skewed joins
    out = sized.join(per, "sha").select("doc_id", text.alias("text"), F.when(changed, F.char_length(text).cast("long")).otherwise(F.col("n_chars")).alias("n_chars"), *names.values())
    back = {n: c for c, n in names.items()}
    out = out.select([F.col(n).alias(back.get(n, n)) for n in out.columns])
    return out.select([F.col(f"`{c}`") for c in docs.columns])


def op2_suffix_dedup(docs: DataFrame) -> DataFrame:
    """`dedup` of all documents; null and empty texts lose nothing and each repeated row keeps its row."""
    return dedup(docs)
