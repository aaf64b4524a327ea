"""Packing of documents into training sequences by best-fit decreasing.

Texts are encoded where they are read; documents longer than a window are first
cut into full windows, which are sequences at once. What is left, pieces shorter
than a window, is written without texts, dealt anew to tasks of `pool` pieces,
and each task places its pieces by falling length, each into the tightest open
window that still has room, which a segment tree over remaining capacities finds
in log2(window) steps. A pool leaves at most a few windows partly empty, so
padding doesn't depend on how the input is partitioned. The written pieces are
what a lost task starts from again.

Null and empty texts are documents of the end id alone. Rows without doc_id and
repeated rows are packed like others; equal lengths are placed as they come. An
empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from . import tokens
from .storage import small_batches, written

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
NAMES = [x.split()[0] for x in PIECES.split(", ")]


class Capacities:
    """Open windows by remaining capacity; a tree of counts finds the least capacity that suffices."""

    def __init__(self, window: int) -> None:
        self.size = 1 << window.bit_length()
        self.count = [0] * (2 * self.size)
        self.windows: list[list[int]] = [[] for _ in range(window + 1)]

    def _add(self, capacity: int, n: int) -> None:
        i = capacity + self.size
        while i:
            self.count[i] += n
            i >>= 1

    def put(self, capacity: int, window: int) -> None:
        if capacity:
            self.windows[capacity].append(window)
            self._add(capacity, 1)

    def take(self, length: int) -> tuple[int, int] | None:
        """(capacity, window) of the tightest open window with room for length."""
        i = length + self.size
        while not self.count[i]:  # up, to the next subtree on the right that has windows
            while i & 1:
                i >>= 1
            if not i:
                return None
            i += 1
        while i < self.size:
            i = 2 * i if self.count[2 * i] else 2 * i + 1
        self._add(i - self.size, -1)
        return i - self.size, self.windows[i - self.size].pop()


def best_fit_decreasing(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The window and the offset in it of each piece, and the number of windows."""
    where, offset, used, open_windows = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0, Capacities(window)
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        found = open_windows.take(n) if n < window else None
        capacity, w = found or (window, used)
        used += found is None
        where[i], offset[i] = w, window - capacity
        open_windows.put(capacity - n, w)
    return where, offset, used


def _encode(path: str, window: int, end_id: int, keep_ids: bool):
    """The pieces of each document; a full one has a sequence of its own, of an odd number."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full = TaskContext.get().partitionId() << 32
        for batch in batches:
            _, offsets = K.text_column(batch, "text")
            for lo, hi in K.slices(offsets, 1 << 19):
                flat, at = tokens.id_arrays(path, [x or "" for x in batch.column(1)[lo:hi].to_pylist()])
                flat = np.insert(flat, at[1:], end_id).astype("<u4")
                raw, at = flat.tobytes(), at + np.arange(len(at))
                total = np.diff(at)
                pieces = -(-total // window)
                doc = np.repeat(np.arange(hi - lo), pieces)
                start = window * (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
                length = np.minimum(window, total[doc] - start)
                first = 4 * (at[doc] + start)
                parts = [raw[s : s + n] for s, n in zip(first.tolist(), (4 * length).tolist(), strict=True)]
                whole = length == window
                sequence = np.where(whole, 2 * (full + np.cumsum(whole)) + 1, -1)
                full += int(whole.sum())
                crc = pa.array([zlib.crc32(x) for x in parts], pa.int64())
                ids = pa.array(parts if keep_ids else [None] * len(parts), pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi].take(pa.array(doc)), pa.array(start), pa.array(length), crc, pa.array(total[doc]), pa.array(sequence), pa.array(np.zeros(len(doc), np.int64)), ids], NAMES)

    return rows


def _place(window: int):
    """The pieces of a pool in sequences of even numbers."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool = list(batches)  # bounded by the number of pools
        if not pool:
            return
        table = pa.Table.from_batches(pool)
        where, offset, _ = best_fit_decreasing(table["length"].to_numpy(), window)
        where = 2 * (where + (TaskContext.get().partitionId() << 32))
        table = table.set_column(5, "sequence_id", pa.array(where)).set_column(6, "offset", pa.array(offset))
        yield from table.to_batches(max_chunksize=50_000)

    return rows


def pack_documents(docs: DataFrame, path: str, window: int = 2048, end_id: int = 1, keep_ids: bool = True, pool: int = 1 << 16) -> DataFrame:
    """PIECES: one row for each piece of a document, with its ids unless keep_ids is off.

    pool: about how many short pieces a task packs together.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = written(texts.mapInArrow(_encode(path, window, end_id, keep_ids), PIECES), "pieces")
    short = pieces.where(F.col("length") < window)
    pools = max(1, -(-short.count() // pool))
    return pieces.where(F.col("length") == window).unionByName(short.repartition(pools).mapInArrow(_place(window), PIECES))
