"""Language identification with hyperdimensional profiles (operator 10).

Each letter has a random vector of +1 and -1. A letter n-gram is bound from permuted letter vectors
(rolled by their place, multiplied); a text bundles (adds) its n-gram vectors; a language prototype bundles those
of its training texts. Documents go to the prototype with the greatest cosine. Since bundling is a
sum, n-grams are counted first and each distinct one is bound once per batch. Training counts are summed by Spark;
only (language, n-gram) totals, bounded by 64^3 a language, reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import own_columns

SYMBOLS = 64  # 0: not a letter; 1-26: a-z; the rest: other letters by code point
BLOCK = 128  # documents handled at once; BLOCK * SYMBOLS**3 fits 32 bits
FLUSH = 32  # languages whose counts a training task holds at once


@cache
def _symbols() -> np.ndarray:
    out = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ord(ch.lower()[0])
            out[c] = low - 96 if 97 <= low <= 122 else 27 + low % (SYMBOLS - 27)
    return out


@cache
def _letters(dims: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).choice(np.array([-1, 1], np.int8), (SYMBOLS, dims))


def bind(grams: np.ndarray, dims: int, seed: int) -> np.ndarray:
    """The vectors of n-gram codes: the product of the letter vectors, rolled by 2, 1 and 0 places."""
    v = _letters(dims, seed)
    a, b, c = grams // SYMBOLS**2, grams // SYMBOLS % SYMBOLS, grams % SYMBOLS
    return (np.roll(v, 2, 1)[a] * np.roll(v, 1, 1)[b] * v[c]).astype(np.float32)


def grams_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, n-gram, count) arrays of at most BLOCK texts; words count with a boundary on both sides."""
    joined = ("\n" + "\n".join(texts) + "\n").encode("utf-32-le", "replace")
    codes = _symbols()[np.frombuffer(joined, np.uint32)].astype(np.int32)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    owner = np.concatenate([[0], owner]).astype(np.int32)
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
    codes, owner = codes[keep], owner[keep]
    middle = codes[1:-1] != 0
    key = (codes[:-2] * SYMBOLS + codes[1:-1]) * SYMBOLS + codes[2:] + owner[1:-1] * SYMBOLS**3
    key = np.sort(key[middle])
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(key)))
    return key[first] // SYMBOLS**3, key[first] % SYMBOLS**3, count


@dataclass(frozen=True)
class Profiles:
    """Unit prototypes (languages x dims) and what made them."""

    languages: list[str]
    prototypes: np.ndarray
    dims: int
    seed: int

    def score(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The language and cosine (0 to 1) of each text; `und` and 0 for texts without letters."""
        owner, gram, count = grams_of(texts)
        known, place = np.unique(gram, return_inverse=True)
        table = np.zeros((len(texts), len(known)), np.float32)
        table[owner, place] = count
        bundle = table @ bind(known, self.dims, self.seed)
        norm = np.linalg.norm(bundle, axis=1)
        has = np.bincount(owner, minlength=len(texts)) > 0
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        cosine = bundle @ self.prototypes.T / np.maximum(norm, 1e-9)[:, None]
        best = cosine.argmax(1)
        top = np.clip(cosine[np.arange(len(texts)), best], 0, 1).astype(float)
        return [self.languages[b] if h else "und" for b, h in zip(best, has)], np.where(has, top, 0.0)


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo `folds`; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def learn(train: DataFrame, dims: int = 1024, seed: int = 7) -> Profiles:
    """Profiles of the non-null `lang` values of `train` (columns text, lang)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, n in held.items():
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(n[at], pa.int64())], ["lang", "gram", "n"])
            held.clear()

        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i in range(0, len(texts), BLOCK):
                owner, gram, n = grams_of(texts[i:i + BLOCK])
                names = langs[i:i + BLOCK]
                for lang in set(names):
                    mine = np.array([x == lang for x in names])[owner]
                    if lang not in held:
                        if len(held) >= FLUSH:
                            yield from flush()
                        held[lang] = np.zeros(SYMBOLS**3, np.int64)
                    held[lang] += np.bincount(gram[mine], n[mine], SYMBOLS**3).astype(np.int64)
        yield from flush()

    rows = train.where("text is not null and lang is not null").select("text", "lang")
    counts = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    languages, vectors = sorted(counts["lang"].unique()), []
    for lang in languages:
        mine = counts[counts["lang"] == lang].sort_values("gram")
        total = np.zeros(dims)
        grams, n = mine["gram"].to_numpy(), mine["n"].to_numpy(float)
        for i in range(0, len(grams), 4096):
            total += n[i:i + 4096] @ bind(grams[i:i + 4096], dims, seed)
        vectors.append(total / max(np.linalg.norm(total), 1e-9))
    return Profiles(languages, np.array(vectors, np.float32).reshape(len(languages), dims), dims, seed)


def identify(docs: DataFrame, profiles: Profiles, keep: list[str]) -> DataFrame:
    """Columns `keep` plus lang_pred and score of column `text`, one row per document.

    A null text or one without letters gets `und` and 0. Rows are neither dropped nor shuffled.
    """
    plain = own_columns(docs, *keep, *([] if "text" in keep else ["text"]))
    schema = plain.select(*keep).withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0)}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            langs, scores = [], []
            for i in range(0, len(texts), BLOCK):
                found, top = profiles.score([t or "" for t in texts.slice(i, BLOCK).to_pylist()])
                langs += found
                scores.append(top)
            kept = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(langs, pa.string()), pa.array(np.concatenate(scores) if scores else [], pa.float64())], [*keep, "lang_pred", "score"])

    return plain.mapInArrow(run, schema)


def op10_language(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learns from rows with crc32(doc_id) mod 4 other than 2 and non-null lang.

    Rows with a null doc_id are predicted, not learned from, and not held out. Without any training row
    all predictions are `und`.
    """
    d = own_columns(docs, "doc_id", "text", "lang").withColumn("_fold", fold(F.col("doc_id"), 4))
    profiles = learn(d.where("_fold <> 2"))
    rows = d.select("doc_id", F.coalesce(F.col("_fold") == 2, F.lit(False)).alias("held_out"), "text")
    found = identify(rows, profiles, ["doc_id", "held_out"])
    return found.select("doc_id", "held_out", "lang_pred", "score")
