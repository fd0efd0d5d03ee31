"""Secret scans: fixed patterns plus assignment-aware lexing (operator 9)."""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate, groupby

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import own_columns

# Fixed patterns of the contract; letters of the name in either case, of the value as written.
ASSIGN = re.compile(
    r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "literal")
# A text that does not match this has no fixed span.
MAYBE_BASE = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]|AKIA[A-Z0-9]|[0-9a-f]{32}"

# Name parts that make a target sensitive, and how much each says.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9,
    "credentials": 0.9, "privatekey": 1.0, "accesskey": 1.0, "secretkey": 1.0, "authkey": 0.9, "signingkey": 0.9, "encryptionkey": 0.9, "bearer": 0.8,
}
# A literal is found only in a text with an operator and the letters of a sensitive name, between which there is no other ASCII letter or digit.
MAYBE_PAIR = "|".join("[^A-Za-z0-9]*".join(f"(?i:{c})" for c in name) for name in SENSITIVE)
PLACEHOLDER = re.compile(r"(?i)(?:your|example|change_?me|placeholder|insert|dummy)|(?:todo|none|null|true|false|undefined|redacted)$|[<{$%]")
FILLERS = ({"x", "X"}, {"*"}, {"."}, {"-"})  # a literal of these only says nothing
NAME = re.compile(r"[A-Za-z_][\w.-]*", re.A)
HEAD = 32  # characters of a literal that tell placeholders

_LEX = (
    r"(?P<space>[ \t]+)|(?P<line>[\n;,{}])|(?P<quote>[\"'`])|(?P<mark>//|\#)|(?P<op>:=|=>|==|!=|[:=])|(?P<plus>\+)"
    r"|(?P<word>[A-Za-z_$][\w$.-]*)|(?P<bare>[A-Za-z0-9+/_.%s-]+)|(?P<other>.)")
LEX = re.compile(_LEX % "", re.S | re.A)
LEX_VALUE = re.compile(_LEX % "=", re.S | re.A)
OPERATOR = re.compile("[:=]")
OPERATOR_NEXT = re.compile(r"[ \t]*(?::=|=>|[:=])")
STOPS = re.compile(r"\\.|[\"'\n]", re.S)
WORD_NEXT = re.compile(r"[A-Za-z0-9_]")
PREFIX = re.compile("[bBrRuUfFL]{1,2}")  # of a string: b"...", rb'...', L"..."


class Strings:
    """Where the strings of a text end; each call takes a logarithmic number of steps, however many quotes are left open.

    A backslash escapes what follows it, line ends included. A line's end ends the search, and so does a closing quote with a letter or
    digit after it (an apostrophe within a word closes nothing). Triple and back quotes go over lines and know no escapes.
    """

    def __init__(self, text: str):
        self.text, self.open = text, set()
        self.stops: dict[str, list[int]] = {'"': [], "'": []}
        for m in STOPS.finditer(text):
            if m.end() - m.start() == 1:
                for quote, places_ in self.stops.items():
                    if m.group() in (quote, "\n"):
                        places_.append(m.start())

    def _far(self, at: int, quote: str) -> tuple[int, int, int] | None:
        end = -1 if quote in self.open else self.text.find(quote, at + len(quote))
        if end < 0:
            self.open.add(quote)  # nor is there one later on
            return None
        return at + len(quote), end, end + len(quote)

    def at(self, i: int, freely: bool) -> tuple[int, int, int] | None:
        """(from, to, end) of the string that opens at place i, if one does; not `freely`, only a name right before an operator is one."""
        quote = self.text[i]
        if freely and (quote == "`" or self.text.startswith(quote * 3, i)) and (found := self._far(i, quote if quote == "`" else quote * 3)):
            return found
        if quote == "`":
            return None
        k = bisect_right(self.stops[quote], i)
        if k == len(self.stops[quote]) or self.text[self.stops[quote][k]] == "\n":
            return None
        end = self.stops[quote][k]
        if WORD_NEXT.match(self.text, end + 1) or not (freely or OPERATOR_NEXT.match(self.text, end + 1)):
            return None
        return i + 1, end, end + 1


def lex(text: str, whole: bool = True) -> Iterator[tuple[str, str, int, int]]:
    """(kind, text, start, end) of the tokens of source or configuration text; a string's are those of what stands between its quotes.

    White space and quotes that open no string are dropped. A string opens, with a prefix like `b` or without, after an operator, an opening bracket,
    a comma, a plus, a comment mark or a line's start. Comments are lexed like other text. A bare value keeps its equals signs if `whole`.
    """
    at, pattern, opens, strings = 0, LEX, True, Strings(text)
    while at < len(text):
        m = pattern.match(text, at)
        start, at, kind = at, m.end(), m.lastgroup
        if kind == "space":
            continue
        if kind == "quote":
            found = strings.at(start, opens)
            if not found:
                continue
            lo, hi, at = found
            yield "string", text[lo:hi], lo, hi
            pattern, opens = LEX, False
            continue
        if kind == "word" and opens and PREFIX.fullmatch(m.group()) and text[at:at + 1] in ("\"", "'") and strings.at(at, True):
            continue
        yield kind, m.group(), start, at
        opens = kind in ("line", "mark", "op", "plus") or m.group() in ("(", "[")
        pattern = LEX_VALUE if whole and kind in ("op", "plus") else LEX


class Value:
    """A constant: its length, characters and first characters, and `parts`: the literal (start, end), or the parts of the constants that it is joined from.

    Joins keep references to their parts, so `a = a + a` costs one list a line however long its value grows. Lengths and counts are
    floats that are scaled down before they leave the range.
    """

    __slots__ = ("n", "counts", "head", "parts")

    def __init__(self, n: float, counts: dict[str, float], head: str, parts: tuple | list):
        self.n, self.counts, self.head, self.parts = n, counts, head, parts

    @classmethod
    def literal(cls, text: str, start: int = 0, end: int = 0) -> Value:
        return cls(float(len(text)), Counter(text), text[:HEAD], (start, end))

    @classmethod
    def joined(cls, values: list[Value]) -> Value:
        if len(values) == 1:
            return values[0]
        counts, head, n = dict(values[0].counts), values[0].head, sum(v.n for v in values)
        for v in values[1:]:
            for c, k in v.counts.items():
                counts[c] = counts.get(c, 0.0) + k
            head = head if len(head) == HEAD else (head + v.head)[:HEAD]
        if n > LARGE:
            n, counts = n / LARGE + HEAD, {c: k / LARGE for c, k in counts.items()}
        return cls(n, counts, head, [v.parts for v in values])


LARGE = 1e150


def places(parts: list) -> set[tuple[int, int]]:
    """The literals in nested lists of parts; each list is looked into once."""
    out, seen, left = set(), set(), list(parts)
    while left:
        v = left.pop()
        if isinstance(v, tuple):
            out.add(v)
        elif id(v) not in seen:
            seen.add(id(v))
            left += v
    return out


# Calls whose argument names what is read, and words that may stand before a call.
LOOKUPS = {"getenv", "get", "env", "environ", "lookup", "fetch", "read", "load", "find", "open", "input", "prompt", "require", "import", "getproperty", "getstring", "getpass", "config"}
BEFORE_CALL = {"new", "await", "return"}
OF_TYPES = {"[", "]", "|", "&", "<", ">", "?", "*", "'"}


def pairs(text: str) -> Iterator[tuple[str, Value]]:
    """(name, value) of assignments, with constants propagated.

    Understands `name = "x"`, `name := x`, `"name": "x"`, `name => "x"`, subscripts (`a["name"] = "x"`), annotations (`name: str = "x"`,
    `var name string = "x"`), string prefixes, triple and back quotes, parentheses, joins by `+`, and names bound earlier in the same text. A
    word before a parenthesis is a call: its first argument is the value, unless the call looks something up by that name. A bare word
    that is itself a sensitive name refers to something else and is no literal. A name that takes a constant yields the pair (name, constant), whose literal stays at its
    place. A comment mark ends a value, not the scan, and what stands between quotes or in a bare value is searched for assignments of its own.
    """
    return _pairs(text, 0, True)


def _target(tokens: list[tuple], i: int) -> tuple[str, int] | None:
    """(name, place of the value) of the assignment whose target is token i."""
    kind, name = tokens[i][:2]
    if kind not in ("word", "bare", "string"):
        return None
    at = i + 1
    while kind == "string" and at < len(tokens) and tokens[at][1] == "]" and tokens[at][0] == "other":
        at += 1
    if at >= len(tokens) or tokens[at][0] != "op" or tokens[at][1] in ("==", "!="):
        return None
    if kind == "word" and i > 1 and tokens[i - 1][0] == "word" and tokens[i - 2][:2] == ("word", "var"):
        name = tokens[i - 1][1]
    at += 1
    if tokens[at - 1][1] == ":":  # a type may follow, up to an equals sign
        to = at
        while to < len(tokens) and (tokens[to][0] == "word" or tokens[to][1] in OF_TYPES and tokens[to][0] == "other"):
            to += 1
        if at < to < len(tokens) and tokens[to][:2] == ("op", "="):
            at = to + 1
    return name, at


def _call(tokens: list[tuple], i: int) -> bool:
    return i + 1 < len(tokens) and tokens[i][0] == "word" and tokens[i + 1][1] == "(" and tokens[i + 1][2] == tokens[i][3]


def _value(tokens: list[tuple], i: int, bound: dict[str, Value], shift: int) -> tuple[list[Value], int]:
    """The constants and literals joined from token i on, and where they end."""
    parts: list[Value] = []
    while i < len(tokens):
        looked_up = called = False
        while i < len(tokens) and (tokens[i][1] == "(" or _call(tokens, i) or tokens[i][1] in BEFORE_CALL and tokens[i][0] == "word" and i + 1 < len(tokens) and tokens[i + 1][0] == "word"):
            called = called or _call(tokens, i)
            looked_up = looked_up or _call(tokens, i) and re.split("[._]", tokens[i][1].lower())[-1] in LOOKUPS
            i += 1
        if i == len(tokens) or looked_up:
            break
        kind, value, start, end = tokens[i]
        if kind == "word" and value in bound:
            parts.append(bound[value])
        elif kind == "string" and not (called and named(value)) or kind in ("word", "bare") and not (i + 1 < len(tokens) and tokens[i + 1][0] == "op") and not named(value):
            parts.append(Value.literal(value, shift + start, shift + end))
        else:
            break
        i += 1
        while i < len(tokens) and tokens[i][1] == ")" and tokens[i][0] == "other":
            i += 1
        if i == len(tokens) or tokens[i][0] != "plus":
            break
        i += 1
    return parts, i


def _pairs(text: str, shift: int, whole: bool) -> Iterator[tuple[str, Value]]:
    bound: dict[str, Value] = {}
    for at_line, group in groupby(lex(text, whole), lambda t: t[0] in ("line", "mark")):
        tokens = [] if at_line else list(group)
        for kind, value, start, _ in tokens:
            if kind in ("string", "bare") and OPERATOR.search(value):
                yield from _pairs(value, shift + start, kind == "string")
        i = 0
        while i + 1 < len(tokens):
            target = _target(tokens, i)
            if target is None:
                i += 1
                continue
            name, i = target
            parts, i = _value(tokens, i, bound, shift)
            if parts:
                bound[name] = Value.joined(parts)
                yield name, bound[name]


def named(value: str) -> bool:
    """Whether a value is a name of something sensitive, and so refers to it."""
    return value.isascii() and not any(map(str.isdigit, value)) and NAME.fullmatch(value) is not None and sensitivity(value) > 0


def sensitivity(name: str) -> float:
    split = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name).lower()
    parts = [p for p in re.split(r"[^a-z0-9]+", split) if p]
    joined = [a + b for a, b in zip(parts, parts[1:])]
    return max((SENSITIVE.get(p, 0.0) for p in parts + joined), default=0.0)


def score(name: str, literal: str | Value) -> float:
    """0 to 1: how likely `literal` is a secret, from the target's name and the literal's characters."""
    weight, v = sensitivity(name), literal if isinstance(literal, Value) else Value.literal(literal)
    if not weight or v.n < 8 or PLACEHOLDER.match(v.head) or any(v.counts.keys() <= f for f in FILLERS) or " " in v.counts:
        return 0.0
    whole = math.log2(sum(v.counts.values()))
    entropy = sum(c * (whole - math.log2(c)) for c in v.counts.values() if c) / sum(v.counts.values())
    classes = sum(any(map(f, v.counts)) for f in (str.islower, str.isupper, str.isdigit, lambda c: not c.isalnum()))
    return weight * min(1.0, entropy / 3.0) * (1.0 if classes >= 2 else 0.6)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns, by start and then kind."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def spans_of(text: str, threshold: float = 0.7, base: bool = True, paired: bool = True) -> list[tuple[int, int, int]]:
    """All spans (start, kind number, end): the fixed ones and literals bound to sensitive names.

    A literal inside a fixed span is not reported again.
    """
    out = base_spans(text) if base else []
    if paired:
        starts, reach = [s for s, _, _ in out], list(accumulate((e for _, _, e in out), max))
        likely = places([v.parts for name, v in pairs(text) if score(name, v) >= threshold])
        more = [(s, 3, e) for s, e in likely if e > s and not ((i := bisect_right(starts, s)) and reach[i - 1] >= e)]
        out = sorted(out + more)
    return out


def _digest(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _each(batch: pa.RecordBatch, threshold: float) -> Iterator[tuple[str, list[tuple[int, int, int]]]]:
    texts = batch.column(batch.schema.get_field_index("text"))
    base = pc.fill_null(pc.match_substring_regex(texts, MAYBE_BASE), False).to_pylist()
    paired = pc.fill_null(pc.and_(pc.match_substring_regex(texts, "[:=]"), pc.match_substring_regex(texts, MAYBE_PAIR)), False).to_pylist()
    for text, b, p in zip(texts, base, paired):
        text = (text.as_py() or "") if b or p else ""
        yield text, spans_of(text, threshold, b, p) if b or p else []


def scan(docs: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of each whole text, one row per document.

    Spans are `kind:start:end` in code points, end exclusive, by start and then kind (assign, access, hex, literal),
    comma-joined. A null or empty text has none. Rows keep their partitions; nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, sha, spans = [[], [], []], [], []
            for _, found in _each(batch, threshold):
                base = [s for s in found if s[1] < 3]
                for k in range(3):
                    counts[k].append(sum(s[1] == k for s in base))
                sha.append(hashlib.sha256(_digest(base).encode()).hexdigest())
                spans.append(_digest(found))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(sha, pa.string()), pa.array(spans, pa.string())],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return own_columns(docs, "doc_id", "text").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(docs: DataFrame, mark: str = "[SECRET]", threshold: float = 0.7) -> DataFrame:
    """The columns of `docs` with every found span of `text` replaced by `mark` and n_chars counted anew.

    Overlapping spans are replaced as one. Texts without spans, null ones included, stay as they are.
    """

    def clean(text: str, found: list[tuple[int, int, int]]) -> str:
        out, done = [], 0
        for start, _, end in found:
            if start >= done:
                out += [text[done:start], mark]
            done = max(done, end)
        return "".join(out) + text[done:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [clean(t, s) if s else None for t, s in _each(batch, threshold)]
            changed = pa.array([t is not None for t in found])
            new = pa.array(found, pa.string())
            columns = []
            for name, column in zip(batch.schema.names, batch.columns):
                if name == "text":
                    column = pc.if_else(changed, new, column)
                elif name == "n_chars":
                    column = pc.if_else(changed, pc.cast(pc.utf8_length(new), pa.int64()), column)
                columns.append(column)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def op9_secrets(docs: DataFrame) -> DataFrame:
    """`scan` of all documents with the threshold 0.7; null and empty texts have no span, repeated rows keep a row each."""
    return scan(docs)
