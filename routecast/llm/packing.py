"""Packing documents into token windows (operator 3).

A task tokenises its documents, cuts overlong ones into full windows and packs the rests by best-fit
decreasing, `block` rests at a time. Only piece rows leave a task; token ids are never shuffled.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import own_columns

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Encoder:
    """Little-endian ids of whole texts by a byte-level BPE file as it is, without added special tokens; literals of special tokens in a text become their ids.

    `ranks` may name the same vocabulary as a rank file with its split `pattern`; texts of characters below
    U+0530 (Latin, Greek, Cyrillic and their marks, whose classes are the same in every Unicode version) are then encoded by the faster reader of
    such files, which gives the same ids. Others, and texts that may hold a literal of an added token, are encoded by the file itself.
    """

    other = re.compile("[^\\x00-\u052f]")

    def __init__(self, path: str, ranks: str | None = None, pattern: str | None = None):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.fast, self.added = None, re.compile("|".join(re.escape(t.content) for t in self.whole.get_added_tokens_decoder().values()) or "(?!)")
        if ranks:
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    def __call__(self, text: str) -> bytes:
        if self.fast is not None and not self.other.search(text) and not self.added.search(text):
            return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


class OpenWindows:
    """Open windows by remaining capacity; a segment tree finds the least capacity that fits."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.any = [False] * (2 * self.leaves)
        self.at: list[list[int]] = [[] for _ in range(self.leaves)]

    def _mark(self, capacity: int, some: bool) -> None:
        i = capacity + self.leaves
        self.any[i] = some
        while i > 1:
            i //= 2
            now = self.any[2 * i] or self.any[2 * i + 1]
            if self.any[i] == now:
                break
            self.any[i] = now

    def put(self, capacity: int, window: int) -> None:
        self.at[capacity].append(window)
        if len(self.at[capacity]) == 1:
            self._mark(capacity, True)

    def tightest(self, length: int) -> tuple[int, int] | None:
        """Remove and return (capacity, window) with the least capacity of at least `length`."""
        i = length + self.leaves
        if not self.any[i]:
            while i > 1 and not (i % 2 == 0 and self.any[i + 1]):
                i //= 2
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if self.any[2 * i] else 2 * i + 1
        capacity = i - self.leaves
        window = self.at[capacity].pop()
        if not self.at[capacity]:
            self._mark(capacity, False)
        return capacity, window


def best_fit(lengths: list[int], window: int) -> tuple[list[int], list[int]]:
    """Best-fit decreasing: the window number and offset of each length (each 1 to `window`)."""
    where, offset, opened, free = [0] * len(lengths), [0] * len(lengths), 0, OpenWindows(window)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = free.tightest(lengths[i])
        if found is None:
            found = window, opened
            opened += 1
        capacity, where[i] = found
        offset[i] = window - capacity
        if capacity > lengths[i]:
            free.put(capacity - lengths[i], where[i])
    return where, offset


def pack(docs: DataFrame, path: str, window: int = 1024, end: int = 0, block: int = 100_000, ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """Pieces of all documents (doc_id, text) in windows of `window` ids; see SCHEMA.

    A document is the ids of its text (null: empty) and then id `end`. Each id lies in one piece and windows are
    gapless from offset 0. Equal and repeated rows, null doc_ids and blank texts are packed like any
    other; an empty table gives no piece. A task keeps at most `block` rests before it packs them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, last = Encoder(path, ranks, pattern), np.array([end], "<u4").tobytes()
        sequence, rests, out = TaskContext.get().partitionId() << 33, [], []

        def table(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows)) or [[]] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [f.split()[0] for f in SCHEMA.split(", ")])

        def close() -> list[tuple]:
            nonlocal sequence
            where, offset = best_fit([r[2] for r in rests], window)
            rows = [(*r, sequence + w, o) for r, w, o in zip(rests, where, offset)]
            sequence += max(where, default=-1) + 1
            rests.clear()
            return rows

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py() or "") + last
                n = len(ids) // 4
                for start in range(0, n, window):
                    piece = ids[4 * start:4 * (start + window)]
                    row = (doc_id, start, len(piece) // 4, zlib.crc32(piece), n)
                    if len(piece) == 4 * window:
                        out.append((*row, sequence, 0))
                        sequence += 1
                    else:
                        rests.append(row)
                if len(rests) >= block:
                    out += close()
                if len(out) >= 50_000:
                    yield table(out)
                    out = []
        out += close()
        yield table(out)

    return own_columns(docs, "doc_id", "text").mapInArrow(run, SCHEMA)


def op3_packing(docs: DataFrame) -> DataFrame:
    """`pack` of all documents into windows of 1024 tokens, id 0 after each document.

    Null and empty texts are one piece of one token; repeated rows, null and equal ids are packed like any others; an empty table gives no row.
    """
    import public_tokenizers as files

    return pack(docs, files.path("byte_bpe_50k.json"), 1024, 0, ranks=files.path("byte_bpe_50k.tiktoken"), pattern=files.PATTERN)
