"""SentencePiece encoding and decoding by a weighted finite-state transducer (operator 8).

The model file gives a normaliser, scored pieces and byte pieces. All are compiled into machines of states and arcs:

* states and arcs: state 0 is the start; an arc reads one character and leads to the state of the characters read since; a state
  whose characters are a piece gives that piece's id with a weight and goes back to the start;
* the normaliser: its states are the openings of the character map's keys, each once for "the last character given was a blank" and once
  for "it was not"; at the end of the longest key that matches it gives the key's replacement, less blanks that follow a blank
  if the file asks for that. It is composed first. Where a file has neither a map nor squeezing it gives what it reads;
* its space map is in the arcs of the pieces: those that read the space mark also read a blank;
* byte fallback: four states for the bytes still to come of a character, 256 arcs that give the byte pieces. A character that no piece
  can give is read by these and ends at the start.

Composing the machine with a text gives a lattice whose nodes are the text's places and whose arcs are the pieces read between them;
the ids on its tropical shortest path are the encoding. For a unigram file an arc weighs minus the piece's score. For a merge (BPE)
file the weights are 0 on legal arcs and infinite on others: after piece `a`, piece `b` is legal if merging
the characters of `ab` gives `a` and `b` again. A sequence whose neighbours are all legal is the
merge result and there is only one, for every place of the text, so the shortest path through the composed lattice is exactly the library's encoding.
Texts are cut where no piece crosses (before a space mark that follows another character), and the lattice of
equal chunks is solved once per task.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import own_columns

MARK = "▁"  # the space mark of the format
INF = float("inf")


class _Solved(dict):
    """Packed ids of chunks, solved on first use; emptied when it holds `most`. `before` stands in front of each chunk."""

    def __init__(self, solve, before: str, most: int):
        super().__init__()
        self.solve, self.before, self.most = solve, before, most

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        out = self.solve(self.before + chunk)
        if len(chunk) < 64:
            self[chunk] = out
        return out


class Transducer:
    """The compiled transducer of one model file."""

    def __init__(self, path: str, most_chunks: int = 700_000):
        from sentencepiece import sentencepiece_model_pb2 as format_

        model = format_.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        kinds = format_.ModelProto.SentencePiece
        self.pieces = [model.trainer_spec.unk_surface if p.type == kinds.UNKNOWN else p.piece for p in model.pieces]  # as they are decoded
        self.merge = model.trainer_spec.model_type == format_.TrainerSpec.BPE
        spec = model.normalizer_spec
        if model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("spaces as suffixes are not compiled")
        self.dummy, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.unknown = next((i for i, p in enumerate(model.pieces) if p.type == kinds.UNKNOWN), 0)
        self.of_byte = {i: int(p.piece[3:5], 16) for i, p in enumerate(model.pieces) if p.type == kinds.BYTE}
        self.id = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL}
        self.score = [p.score for p in model.pieces]
        self.penalty = 10.0 - min((self.score[i] for i in self.id.values()), default=0.0)  # of a character that no piece gives, as the library has it
        self.silent = {i for i, p in enumerate(model.pieces) if p.type == kinds.CONTROL}
        self.longest = max(map(len, self.id), default=1)
        self.crosses = any(MARK in p[1:].lstrip(MARK) or (p[0] == MARK and MARK in p[1:].lstrip(MARK)) for p in self.id)
        self.split = lru_cache(maxsize=most_chunks)(self._split)
        self.checked: dict[tuple[str, str], bool] = {}
        self.whole: dict[str, bool] = {}
        self.most_pairs = 2 * most_chunks
        self._compile()
        self._compile_bytes(model.trainer_spec.byte_fallback)
        self._compile_normaliser(spec.precompiled_charsmap)
        self.pairs = {pair for p in self.id for q in {p, p.replace(MARK, " ") if self.escape else p} for pair in zip(q, q[1:])}
        self.parts = _Solved(self._shortest, "", most_chunks)
        self.blank = " " if self.escape else MARK  # how a space mark is written in the input
        self.plain, self.marked = _Solved(self._encode_chunk, "", most_chunks), _Solved(self._encode_chunk, self.blank, most_chunks)
        self.raw = [b"" if i in self.silent else bytes([self.of_byte[i]]) if i in self.of_byte else (p.replace(MARK, " ") if self.escape else p).encode() for i, p in enumerate(self.pieces)]

    def _compile(self) -> None:
        """The machine: `arcs[state]` maps a character to the next state; `gives[state]` is (piece, packed ids, weight) or None."""
        self.arcs: list[dict[str, int]] = [{}]
        self.gives: list[tuple[str, bytes, float] | None] = [None]
        for piece, i in self.id.items():
            state = 0
            for c in piece:
                to = self.arcs[state].get(c)
                if to is None:
                    to = self.arcs[state][c] = len(self.arcs)
                    self.arcs.append({})
                    self.gives.append(None)
                state = to
            self.gives[state] = piece, np.array([i], "<u4").tobytes(), 0.0 if self.merge else -self.score[i]
        if self.escape:
            for out in self.arcs:
                if MARK in out:
                    out[" "] = out[MARK]

    def _compile_bytes(self, fallback: bool) -> None:
        """The machine of byte fallback: `bytes[to come]` maps a byte to (to come after it, packed id); empty if the file has no fallback."""
        self.bytes: list[dict[int, tuple[int, bytes]]] = [{}, {}, {}, {}]
        for i, b in self.of_byte.items() if fallback else ():
            given = np.array([i], "<u4").tobytes()
            if b < 0x80:
                self.bytes[0][b] = 0, given
            elif b < 0xC0:
                for state in (1, 2, 3):
                    self.bytes[state][b] = state - 1, given
            else:
                self.bytes[0][b] = 1 + (b >= 0xE0) + (b >= 0xF0), given
        self.no_piece = np.array([self.unknown], "<u4").tobytes()

    def _compile_normaliser(self, blob: bytes) -> None:
        """The machine of the character map: `reads[state]` maps a character to the next state; `writes[state]` is (replacement, the same after a blank) or None."""
        self.reads: list[dict[str, int]] = [{}]
        self.writes: list[tuple[str, str] | None] = [None]
        for key, value in character_map(blob):
            state = 0
            for c in key:
                to = self.reads[state].get(c)
                if to is None:
                    to = self.reads[state][c] = len(self.reads)
                    self.reads.append({})
                    self.writes.append(None)
                state = to
            self.writes[state] = value, value.lstrip(" ") if self.squeeze else value
        if self.squeeze and " " not in self.reads[0]:
            self.reads[0][" "] = len(self.reads)
            self.reads.append({})
            self.writes.append((" ", ""))

    def _fallback(self, c: str) -> tuple[str, bytes, float]:
        """The arcs of a character that no piece gives; they weigh more than pieces do."""
        state, out = 0, []
        for b in c.encode():
            state, given = self.bytes[state].get(b, (0, b""))
            out.append(given)
        return c, b"".join(out) if all(out) else self.no_piece, 0.0 if self.merge else self.penalty

    def _lattice(self, text: str, at: int) -> list[tuple[float, int, tuple[str, bytes, float]]]:
        """Lattice arcs that leave place `at`: (weight, end, what the machine gives), shortest first."""
        out, state, end = [], 0, at
        for c in text[at:at + self.longest]:
            state = self.arcs[state].get(c)
            if state is None:
                break
            end += 1
            given = self.gives[state]
            if given is not None and (not self.merge or end == at + 1 or self._reachable(given[0])):
                out.append((given[2], end, given))
        if not out or out[0][1] != at + 1:
            c = text[at]
            given = self._fallback(MARK if c == " " and self.escape else c)
            out.insert(0, (given[2], at + 1, given))
        return out

    def normalise(self, text: str) -> str:
        """What the machine of the pieces reads: the normaliser's output, led by one more blank if the file says so; marks are written as blanks if it escapes them."""
        if not text:
            return ""
        text = (" " if self.dummy else "") + (self._rewritten(text) if self.reads[0] else text)
        if self.escape:
            text = text.replace(MARK, " ")
        return text.rstrip(" ") if self.squeeze else text

    def _rewritten(self, text: str) -> str:
        """The text composed with the normaliser: at each place the longest key is read; a character that starts none gives itself."""
        reads, writes, first, squeeze = self.reads, self.writes, self.reads[0], self.squeeze
        out, at, n, after = [], 0, len(text), squeeze
        while at < n:
            c = text[at]
            state = first.get(c)
            at += 1
            if state is None:
                out.append(c)
                after = False
                continue
            end, given, i = at, writes[state], at
            while i < n and (state := reads[state].get(text[i])) is not None:
                i += 1
                if writes[state] is not None:
                    end, given = i, writes[state]
            at = end
            value = c if given is None else given[after]
            if value:
                out.append(value)
                after = squeeze and value.endswith(" ")
        return "".join(out)

    def _split(self, piece: str) -> tuple[str, str] | None:
        """The last merge that makes `piece`: its halves, or None for a single character."""
        parts = list(piece)
        last = None
        while len(parts) > 1:
            best = max(((self.score[self.id[a + b]], -i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.id), default=None)
            if best is None:
                return None
            i = -best[1]
            last = parts[i], parts[i + 1]
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return last

    def legal(self, a: str, b: str) -> bool:
        """Whether merging the characters of a and b together leaves exactly a and b.

        Walks both merge trees from the top: at each level the pair that touches must not be a better (or,
        to the left, equally good) merge than the later of the two that built its sides.
        """
        limit = INF
        while True:
            if a + b in self.id:
                rank = -self.score[self.id[a + b]]
                if rank < limit:
                    return False
            ra = -self.score[self.id[a]] if len(a) > 1 and a in self.id else -INF
            rb = -self.score[self.id[b]] if len(b) > 1 and b in self.id else -INF
            if ra == rb == -INF:
                return True
            if ra > rb:
                halves = self.split(a)
                if halves is None:
                    return True
                # the merge of a's halves happens at ra; a touching pair that is merged before that breaks a
                limit, a = ra, halves[1]
            else:
                halves = self.split(b)
                if halves is None:
                    return True
                # ties go to the left pair, and the touching pair is left of b's halves
                limit, b = np.nextafter(rb, INF), halves[0]

    def _shortest(self, text: str) -> bytes:
        """Packed ids on the tropical shortest path through the lattice of `text`.

        Places are settled in the order of their weight. In a merge file all finite weights are equal, so the place reached last is taken first,
        and an arc is held against the one that settled its start: no other legal arc ends there.
        """
        n, settled, merge = len(text), {0: (0, ("", b"", 0.0))}, self.merge
        queue = [(w, end, 0, given) for w, end, given in self._lattice(text, 0)] if n else []
        if not merge:
            heapify(queue)
        while n not in settled:
            weight, end, start, given = queue.pop() if merge else heappop(queue)
            if end in settled or merge and start and not self._follows(settled[start][1][0], given[0]):
                continue
            settled[end] = start, given
            if end < n:
                for w, to, more in self._lattice(text, end):
                    if to not in settled:
                        if merge:
                            queue.append((0.0, to, end, more))
                        else:
                            heappush(queue, (weight + w, to, end, more))
        out, at = [], n
        while at:
            at, given = settled[at]
            out.append(given[1])
        return b"".join(out[::-1])

    def _follows(self, a: str, b: str) -> bool:
        ok = self.checked.get((a, b))
        if ok is None:
            if len(self.checked) >= self.most_pairs:
                self.checked.clear()
            ok = self.checked[a, b] = self.legal(a, b)
        return ok

    def _encode_chunk(self, chunk: str) -> bytes:
        """Packed ids of a chunk: of its parts, cut between characters that no piece holds side by side."""
        cuts = [i for i, pair in enumerate(zip(chunk, chunk[1:]), 1) if pair not in self.pairs]
        if not cuts:
            return self._shortest(chunk)
        return b"".join([self.parts[chunk[i:j]] for i, j in zip([0, *cuts], [*cuts, len(chunk)])])

    def _reachable(self, piece: str) -> bool:
        """Whether the characters of `piece` merge to the piece itself."""
        ok = self.whole.get(piece)
        if ok is None:
            halves = self.split(piece)
            ok = self.whole[piece] = halves is not None and halves[0] + halves[1] == piece
        return ok

    def chunks(self, text: str) -> list[str]:
        mark = self.blank
        if self.crosses or mark not in text:
            return [text] if text else []
        out, at = [], 0
        i = text.find(mark, 1)
        while i > 0:
            if text[i - 1] != mark:
                out.append(text[at:i])
                at = i
            i = text.find(mark, i + 1)
        out.append(text[at:])
        return out

    def packed(self, text: str) -> bytes:
        """Little-endian ids of a text."""
        text, mark = self.normalise(text), self.blank
        if text.startswith(mark) and not self.crosses and mark * 2 not in text:
            packed = b"".join(map(self.marked.__getitem__, text[1:].split(mark)))
        else:
            packed = b"".join(map(self.plain.__getitem__, self.chunks(text)))
        return packed if self.bytes[0] else self._merged(packed)

    def _merged(self, packed: bytes) -> bytes:
        """Ids with one unknown id in place of several in a row, as the library gives them."""
        ids = np.frombuffer(packed, "<u4")
        again = (ids[1:] == self.unknown) & (ids[:-1] == self.unknown)
        return ids[np.concatenate([[True], ~again])].tobytes() if len(ids) else packed

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), "<u4").tolist()

    def text_of(self, packed: bytes) -> str:
        """The text of little-endian ids; the same as `decode`, at once for ids whose bytes are well formed."""
        ids = np.frombuffer(packed, "<u4").tolist()
        try:
            text = b"".join(map(self.raw.__getitem__, ids)).decode()
        except UnicodeDecodeError:
            return self.decode(ids)
        if self.squeeze and text.startswith("  "):
            return self.decode(ids)
        return text[1:] if (self.dummy or self.squeeze) and text.startswith(" ") else text

    def decode(self, ids: list[int]) -> str:
        out, run = [], bytearray()
        for i in ids:
            if i in self.of_byte:
                run.append(self.of_byte[i])
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run = bytearray()
            if i not in self.silent:
                piece = self.pieces[i]
                if self.squeeze and not any(out) and i != self.unknown:
                    piece = piece.removeprefix(MARK)  # of every piece before the first character
                out.append(piece)
        if run:
            out.append(run.decode("utf-8", "replace"))
        text = "".join(out).replace(MARK, " ") if self.escape else "".join(out)
        return text[1:] if self.dummy and not self.squeeze and text.startswith(" ") else text


def character_map(blob: bytes) -> Iterator[tuple[str, str]]:
    """(key, replacement) of a file's compiled character map; an empty blob has none, a broken one raises ValueError.

    The format is public: the size of a double-array trie, the trie (little-endian 32-bit units over UTF-8 bytes), and the replacements,
    each ended by a zero byte, at which the trie's leaves point. All arcs of a level are followed at once.
    """
    if not blob:
        return
    size = int.from_bytes(blob[:4], "little")
    if len(blob) < 8 or size % 4 or not 4 <= size <= len(blob) - 4:
        raise ValueError("broken character map")
    units, values = np.frombuffer(blob[4:4 + size], "<u4").astype(np.int64), blob[4 + size:]
    leads = (units >> 10) << ((units & 0x200) >> 6)  # what is XORed to a unit's place for its children
    labels = np.arange(1, 256, dtype=np.int64)
    places, keys, depth, seen = leads[:1], [b""], 0, 0
    while len(places):
        to = places[:, None] ^ labels[None, :]
        inside = to < len(units)
        row, column = np.nonzero(inside & ((units[np.where(inside, to, 0)] & 0x800000FF) == labels[None, :]))
        found = to[row, column]
        keys = [keys[r] + bytes([c]) for r, c in zip(row.tolist(), labels[column].tolist())]
        places = found ^ leads[found]
        depth, seen = depth + 1, seen + len(keys)
        if depth > 1024 or seen > 1 << 24:  # no trie of characters' mappings, so its places lead round in a circle
            raise ValueError("broken character map")
        for key, leaf, place in zip(keys, ((units[found] >> 8) & 1).tolist(), places.tolist()):
            if leaf:
                start = int(units[place]) & 0x7FFFFFFF
                yield key.decode(), values[start:values.index(b"\0", start)].decode()


def encode(docs: DataFrame, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, ids (if `with_ids`), n_pieces, ids_crc32, decoded_sha256 and same, one row per document.

    `ids_crc32` is over little-endian 32-bit ids; `same` tells that decoding gives the text again. A null text has null
    ids, 0 pieces and `same` null; an empty one no pieces. Very long texts are cut at words, so memory stays in
    proportion to one text. Nothing is shuffled.
    """
    schema = "doc_id long" + ", ids array<int>" * with_ids + ", n_pieces long, ids_crc32 long, decoded_sha256 string, same boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Transducer(path)
        for batch in batches:
            columns: list[list] = [[], [], [], [], []]
            for text in batch.column(1):
                raw = text.as_py()
                packed = t.packed(raw or "")
                back = t.text_of(packed)
                ids = np.frombuffer(packed, "<u4").tolist() if with_ids and raw is not None else None
                values = (ids, len(packed) // 4, zlib.crc32(packed), hashlib.sha256(back.encode("utf-8", "replace")).hexdigest(), back == raw if raw is not None else None)
                for c, v in zip(columns, values):
                    c.append(v)
            kinds = (pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.string(), pa.bool_())
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds)][0 if with_ids else 1:]
            names = ["doc_id", *(["ids"] if with_ids else []), "n_pieces", "ids_crc32", "decoded_sha256", "same"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names)

    return own_columns(docs, "doc_id", "text").mapInArrow(run, schema)


def op8_sentencepiece(docs: DataFrame) -> DataFrame:
    """`encode` of all documents without the ids: nulls have 0 pieces and `same` null, empty texts 0 pieces, repeated rows a row each."""
    import public_tokenizers

    return encode(docs, public_tokenizers.path("piece_bpe_32k.model"), with_ids=False)
