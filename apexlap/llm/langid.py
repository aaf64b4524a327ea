"""Language identification with a blended-spectrum string kernel.

k(x, y) counts the n-grams of UTF-8 bytes (A-Z as a-z), n = 2, 3, 4 together,
that are present in both texts, divided by the root of both texts' own counts.
Landmark texts of each language span a Nystroem feature space, in which one
kernel ridge regression per language is fitted against the rest. The kernel is
taken over the dictionary of n-grams that two landmarks share at least. As the
regression is linear in the kernel values, a batch of texts is scored by one
product of its presence matrix with the folded coefficients; the rows of a
product are bounded by the size of that matrix.

Languages, landmarks and the training sample (a bound per language, the rows
with the smallest hash of doc_id) come from rows that `train` selects; they are
found in one pass and their texts are written once. Texts that are null or have
no letter are `und` with score 0; a text with letters gets a language whatever
its length, and the first in order of name wins ties. Rows without doc_id are
scored too but never learnt from; repeated rows give repeated results. A table
without any training row makes every text `und`; an empty table gives an empty
result. Extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .storage import discard, small_batches, written

ORDERS, BITS = (2, 3, 4), 18
_MULT = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA6B)]
#: Cells of a presence matrix at most, but for a single row.
CELLS = 1 << 23


def _codes(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of each row as numbers of n bytes, and their rows."""
    m = max(0, len(data) - n + 1)
    code = np.zeros(m, np.uint32)
    for i in range(n):
        code |= data[i : i + m].astype(np.uint32) << np.uint32(8 * i)
    return code, np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))[:m]


def _inside(offsets: np.ndarray, n: int, m: int) -> np.ndarray:
    """Whether each n-gram ends in the row in which it begins."""
    ok = np.ones(m, bool)
    for o in offsets[1:-1]:
        ok[max(0, o - n + 1) : o] = False
    return ok


def _slots(code: np.ndarray, level: int) -> np.ndarray:
    return (code * _MULT[level]) >> np.uint32(32 - BITS)


@dataclass
class Dictionary:
    """Known n-grams of each order in tables of slots.

    An n-gram whose slot is taken goes to the next table, under another
    multiplier, and to a sorted list if every table has its slot taken.
    """

    codes: list[np.ndarray]

    def __post_init__(self) -> None:
        self.base = np.concatenate([[0], np.cumsum([len(x) for x in self.codes])])
        self.tables, self.rest = [], []
        for x in self.codes:
            left, tables = np.arange(len(x), dtype=np.int32), []
            for level in range(len(_MULT)):
                slot = np.full(1 << BITS, len(x), np.int32)
                slot[_slots(x[left], level)[::-1]] = left[::-1]
                tables.append(slot)
                left = left[slot[_slots(x[left], level)] != left]
            self.tables.append(tables)
            self.rest.append(left[np.argsort(x[left])])

    def presence(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Rows by n-grams: 1 where the row has the n-gram."""
        out = np.zeros((len(offsets) - 1, self.base[-1]), np.float32)
        for n, codes, tables, rest, base in zip(ORDERS, self.codes, self.tables, self.rest, self.base, strict=False):
            if not len(codes):
                continue
            code, row = _codes(data, offsets, n)
            inside, known = _inside(offsets, n, len(code)), np.append(codes, 0)
            for level, slot in enumerate(tables):
                at = slot[_slots(code, level)]
                ok = np.flatnonzero((known[at] == code) & (at < len(codes)))
                ok = ok[inside[ok]]
                out[row[ok], base + at[ok]] = 1
            if len(rest):
                at = np.minimum(np.searchsorted(codes[rest], code), len(rest) - 1)
                ok = np.flatnonzero((codes[rest][at] == code) & inside)
                out[row[ok], base + rest[at[ok]]] = 1
        return out


@dataclass
class Model:
    languages: list[str]
    codes: list[np.ndarray]
    weights: np.ndarray  # n-grams by languages

    def scores(self, dictionary: Dictionary, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        step, out = max(1, CELLS // max(1, int(dictionary.base[-1]))), []
        for lo in range(0, len(offsets) - 1, step):
            part = offsets[lo : lo + step + 1]
            x = dictionary.presence(data[part[0] : part[-1]], part - part[0])
            out.append((x @ self.weights) / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1)))
        return np.concatenate(out)


def _bytes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [x.encode() for x in texts]
    return K.LOWER[np.frombuffer(b"".join(raw), np.uint8)], np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)


def fit(texts: list[str], langs: list[str], landmarks: int = 24, ridge: float = 1e-2) -> Model:
    """Nyström features from the first `landmarks` texts of each language, then ridge regression."""
    languages = sorted(set(langs))
    y = np.array([languages.index(x) for x in langs])
    marks = np.concatenate([np.flatnonzero(y == c)[:landmarks] for c in range(len(languages))])
    data, offsets = _bytes([texts[i] for i in marks])
    codes = []
    for n in ORDERS:
        code, row = _codes(data, offsets, n)
        ok = _inside(offsets, n, len(code))
        pairs = np.unique((code[ok].astype(np.uint64) << np.uint64(32)) | row[ok].astype(np.uint64))
        known, count = np.unique((pairs >> np.uint64(32)).astype(np.uint32), return_counts=True)
        codes.append(known[count >= min(2, len(marks))])
    dictionary = Dictionary(codes)

    def unit(rows: np.ndarray) -> np.ndarray:
        x = np.vstack([dictionary.presence(*_bytes([texts[i]])) for i in rows])
        return x / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))

    marked = unit(marks)
    values, vectors = np.linalg.eigh((marked @ marked.T).astype(np.float64))
    good = values > 1e-6 * max(values.max(), 1e-12)
    root = vectors[:, good] / np.sqrt(values[good])
    step = max(1, CELLS // max(1, int(dictionary.base[-1])))
    phi = np.vstack([(unit(part) @ marked.T) @ root for part in np.split(np.arange(len(texts)), range(step, len(texts), step))])
    target = np.where(y[:, None] == np.arange(len(languages)), 1.0, -1.0)
    balance = 1 / np.bincount(y)[y]
    gram = phi.T @ (phi * balance[:, None]) + ridge / max(1, len(marks)) * np.eye(phi.shape[1])
    beta = np.linalg.solve(gram, phi.T @ (target * balance[:, None]))
    return Model(languages, codes, (marked.T @ (root @ beta)).astype(np.float32))


def _predict(model: Model | None):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionary = Dictionary(model.codes) if model else None
        for batch in batches:
            lang, score = [], []
            for lo, hi, data, offsets in K.text_slices(batch, "text", 1 << 19):
                if model:
                    f = model.scores(dictionary, K.LOWER[data], offsets)
                    lang += [model.languages[i] for i in f.argmax(1)]
                    score += np.clip((f.max(1) + 1) / 2, 0, 1).tolist()
                else:
                    lang += ["und"] * (hi - lo)
                    score += [0.0] * (hi - lo)
            letters = batch.column(1).to_numpy(zero_copy_only=False)
            lang = [x if ok else "und" for x, ok in zip(lang, letters, strict=True)]
            score = [x if ok else 0.0 for x, ok in zip(score, letters, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return rows


def identify_languages(docs: DataFrame, train: Column, sample: int = 160, landmarks: int = 24, texts: int = 32_000, marks: int = 1_200) -> DataFrame:
    """doc_id, lang_pred, score of each document.

    train: the rows to learn from (those with a language count); sample:
    training texts of each language at most; landmarks: of these, for the
    Nystroem space; texts, marks: how many of both over all languages. Every
    language is learnt: where they are many, each lends fewer, but two at least.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), train.alias("train"))
    learn = rows.where("train and lang is not null and doc_id is not null and text rlike '\\\\p{L}'")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "hash")
    keys = learn.select("doc_id", "lang", F.xxhash64("text").alias("hash")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= sample)
    keys = written(keys, "sample")
    several = max(1, keys.select("lang").distinct().count())
    sample, landmarks = max(2, min(sample, texts // several)), max(2, min(landmarks, marks // several))
    chosen = keys.where(F.col("rank") <= sample).select("doc_id", "hash", "rank")
    learnt = learn.withColumn("hash", F.xxhash64("text")).join(F.broadcast(chosen), ["doc_id", "hash"]).select("rank", "doc_id", "lang", "text").distinct()
    found = sorted(tuple(r) for r in learnt.collect())
    discard(keys)
    model = fit([r[3] for r in found], [r[2] for r in found], landmarks) if found else None
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return rows.select("doc_id", letters.alias("letters"), "text").mapInArrow(_predict(model), "doc_id long, lang_pred string, score double")
