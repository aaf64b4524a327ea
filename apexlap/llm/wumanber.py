"""Benchmark decontamination by Wu-Manber search for windows of words.

The patterns are the windows of ten words of benchmark items (an item of fewer
words is one window); one searcher serves each window length. A search looks at
the block of two words that ends where a window could end: the shift table says
how far the search may move on without passing an occurrence, ten words less
the block for blocks that no pattern has. Only where the shift is 0 it turns to
the bucket of that suffix block, takes the patterns in it whose first block
agrees too, and compares words directly. All lanes (stretches of documents) of
a batch move at once.

The items are searched in groups of bounded size. The tables of a group are
arrays, built once and broadcast; another group is another pass, over rows that
carry what was found so far. Rows stay rows: nothing is joined or grouped.

Null texts and texts without words are clean. Items without item_id or words are
left out; items that repeat are one by name. Rows without doc_id and repeated
rows are searched like others and give a row each. An empty table gives an empty
result. Extra columns, whatever their names, are ignored (or carried along).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .storage import carried, discard, row_and, uncarried, written

FOUND = "n_words long, cuts array<struct<b:bigint,e:bigint>>, items array<string>"
RESULT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>"
LANE = 256
_CUT = pa.struct([("b", pa.int64()), ("e", pa.int64())])


@dataclass
class Searcher:
    """Shift table and buckets of one window length; patterns lie in order of suffix and first block."""

    length: int
    block: int
    block_keys: np.ndarray  # all blocks of patterns, sorted
    shift: np.ndarray  # of each of them
    buckets: np.ndarray  # suffix blocks, sorted
    bucket_at: np.ndarray  # where their patterns begin
    pair_keys: np.ndarray  # of each pattern: its suffix and first block as one number, sorted within a bucket
    starts: np.ndarray  # where each pattern's bytes begin in `raw`
    ends: np.ndarray
    item_at: np.ndarray  # where each pattern's items begin
    items: np.ndarray
    raw: bytes

    def ends_of(self, grams: np.ndarray, ranges: np.ndarray) -> np.ndarray:
        """First words of the places where a pattern's last block stands.

        grams: block hashes by first word; ranges: words of each document.
        """
        lo, n = ranges[:-1], np.diff(ranges) - self.length + 1
        lanes = np.maximum(0, -(-n // LANE))
        lane = np.arange(lanes.sum()) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        at = np.repeat(lo, lanes) + lane * LANE
        stop = np.minimum(at + LANE, np.repeat(lo + n, lanes))
        found = []
        while len(at):
            block = grams[at + self.length - self.block]
            k = np.minimum(np.searchsorted(self.block_keys, block), len(self.block_keys) - 1)
            shift = np.where(self.block_keys[k] == block, self.shift[k], self.length - self.block + 1)
            found.append(at[shift == 0])
            at = at + np.maximum(shift, 1)
            live = at < stop
            at, stop = at[live], stop[live]
        return np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)

    def candidates(self, at: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, pattern) of the patterns in each place's bucket whose first block agrees."""
        suffix = grams[at + self.length - self.block]
        b = np.searchsorted(self.buckets, suffix)
        pair, lo, hi = _pair(suffix, grams[at]), self.bucket_at[b], self.bucket_at[b + 1]
        left, right = _bound(self.pair_keys, lo, hi, pair, np.less), _bound(self.pair_keys, lo, hi, pair, np.less_equal)
        n = right - left
        return np.repeat(at, n), np.arange(n.sum()) + np.repeat(left - (np.cumsum(n) - n), n)


def _bound(keys: np.ndarray, lo: np.ndarray, hi: np.ndarray, x: np.ndarray, before: np.ufunc) -> np.ndarray:
    """Binary searches in ranges of keys, all at once: where the keys end that lie before x."""
    while (open_ := lo < hi).any():
        mid = (lo + hi) // 2
        less = before(keys[np.minimum(mid, len(keys) - 1)], x)
        lo, hi = np.where(open_ & less, mid + 1, lo), np.where(open_ & ~less, mid, hi)
    return lo


def _pair(suffix: np.ndarray, first: np.ndarray) -> np.ndarray:
    return K.mix64(suffix + K.U64(1)) ^ first


def _searcher(length: int, parts: list[tuple[bytes, np.ndarray, np.ndarray, int]]) -> Searcher:
    """parts: normalised bytes, where words begin in them, word hashes and number of each item."""
    block = min(2, length)
    blocks, shifts, suffix, pair, starts, ends, whole, owner, raw = [], [], [], [], [], [], [], [], []
    at = 0
    for text, begin, values, number in parts:
        grams, n = K.gram_hashes(values, block), len(values) - length + 1
        for q in range(length - block + 1):
            blocks.append(grams[q : q + n])
            shifts.append(np.full(n, length - block - q))
        suffix.append(grams[length - block : length - block + n])
        pair.append(_pair(suffix[-1], grams[:n]))
        starts.append(at + begin[:n])
        ends.append(at + begin[length : length + n])
        whole.append(K.gram_hashes(values, length))
        owner.append(np.full(n, number))
        raw.append(text)
        at += len(text)
    blocks, shifts, suffix, pair, starts, ends, whole, owner = map(np.concatenate, (blocks, shifts, suffix, pair, starts, ends, whole, owner))
    raw = b"".join(raw)
    order = np.lexsort((shifts, blocks))
    blocks, shifts = blocks[order], shifts[order]
    new = np.append(True, blocks[1:] != blocks[:-1])
    order = np.lexsort((owner, whole, pair, suffix))
    suffix, pair, starts, ends, whole, owner = (x[order] for x in (suffix, pair, starts, ends, whole, owner))
    # equal windows are one pattern with several items
    same = np.append(False, (whole[1:] == whole[:-1]) & (pair[1:] == pair[:-1]) & (suffix[1:] == suffix[:-1]))
    for i in np.flatnonzero(same).tolist():
        same[i] = raw[starts[i] : ends[i]] == raw[starts[i - 1] : ends[i - 1]]
    head = np.flatnonzero(~same)
    buckets, first = np.unique(suffix[head], return_index=True)
    return Searcher(length, block, blocks[new], shifts[new], buckets, np.append(first, len(head)), pair[head], starts[head], ends[head], np.append(head, len(owner)), owner, raw)


@dataclass
class Group:
    names: list[str]
    searchers: list[Searcher]


def build(items: list[tuple[str, str]], window: int) -> Group:
    """The tables of a group of items."""
    by_length: dict[int, list] = {}
    for number, (_, text) in enumerate(items):
        data = K.LOWER[np.frombuffer(text.encode(), np.uint8)] if text else np.zeros(0, np.uint8)
        starts, ends, _ = K.words(data, np.array([0, len(data)]), K.ALNUM_WORDS)
        if len(starts):
            raw, begin = K.joined_words(data, starts, ends)
            by_length.setdefault(min(window, len(starts)), []).append((raw.tobytes(), begin, K.span_hashes(data, starts, ends), number))
    return Group([x[0] for x in items], [_searcher(m, by_length[m]) for m in sorted(by_length)])


def _merged(cuts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for b, e in sorted(cuts):
        if out and b <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((b, e))
    return out


def _search(tables: Broadcast, first: bool, last: bool):
    """row, and FOUND so far; RESULT instead in the last pass."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: Group = tables.value
        for batch in batches:
            before = [[], []] if first else [batch.column(i).to_pylist() for i in (2, 3)]
            for lo, hi, data, offsets in K.text_slices(batch, "text", 1 << 19):
                data = K.LOWER[data]
                starts, ends, ranges = K.words(data, offsets, K.ALNUM_WORDS)
                values = K.span_hashes(data, starts, ends)
                cuts = [[] if first else [(c["b"], c["e"]) for c in before[0][i]] for i in range(lo, hi)]
                names = [set() if first else set(before[1][i]) for i in range(lo, hi)]
                for s in group.searchers:
                    grams = K.gram_hashes(values, s.block)
                    places, patterns = s.candidates(s.ends_of(grams, ranges), grams)
                    row = np.searchsorted(ranges, places, "right") - 1
                    for p, i, r in zip(places.tolist(), patterns.tolist(), row.tolist(), strict=True):
                        words = b"".join(data[starts[j] : ends[j]].tobytes() + b" " for j in range(p, p + s.length))
                        if words == s.raw[s.starts[i] : s.ends[i]]:
                            names[r].update(group.names[x] for x in s.items[s.item_at[i] : s.item_at[i + 1]].tolist())
                            b = p - int(ranges[r])
                            cuts[r].append((b, b + s.length))
                cuts, names = [_merged(x) for x in cuts], [sorted(x) for x in names]
                n_words, kept = pa.array(np.diff(ranges)), pa.array(names, pa.list_(pa.string()))
                own = batch.column(0)[lo:hi]
                if not last:
                    yield pa.RecordBatch.from_arrays([own, n_words, pa.array([[{"b": b, "e": e} for b, e in x] for x in cuts], pa.list_(_CUT)), kept], ["row", "n_words", "cuts", "items"])
                    continue
                n_hit = [sum(e - b for b, e in x) for x in cuts]
                digest = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in names]
                yield pa.RecordBatch.from_arrays([own, n_words, pa.array(n_hit, pa.int64()), pa.array([len(x) for x in names], pa.int64()), pa.array(digest, pa.string()), pa.array([x > 0 for x in n_hit], pa.bool_()), kept], ["row", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items"])

    return rows


def with_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, group_bytes: int = 1 << 23) -> DataFrame:
    """row (the whole row of docs) and RESULT: one row for each row of docs.

    group_bytes: about how many bytes of items are searched in one pass; their
    tables take about fifteen times as much in each worker.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text")).where("item is not null and text is not null").dropDuplicates()
    groups = 1 + int(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // group_bytes
    rows, before = carried(docs), None
    for g in range(groups):
        part = [(r.item, r.text) for r in items.where(F.pmod(F.xxhash64("item", "text"), F.lit(groups)) == g).collect()]
        last = g == groups - 1
        found = rows.mapInArrow(_search(spark.sparkContext.broadcast(build(part, window)), g == 0, last), row_and(docs, RESULT if last else FOUND))
        if last:
            return found
        found = written(found, "found")
        if before is not None:
            discard(before)
        rows, before = found, found
    raise AssertionError("there is one group at least")


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, group_bytes: int = 1 << 23) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items of each document."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return with_contamination(ids, benchmark, window, group_bytes).select("row.doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, group_bytes: int = 1 << 23) -> DataFrame:
    """The rows of docs in which no window occurs, with all their columns."""
    return uncarried(with_contamination(docs, benchmark, window, group_bytes).where("not contaminated"))
