"""Substring dedup of repeated byte strings by suffix arrays of shards.

Runs of windows whose minimizer repeats (see `repeats`) are dealt to shards by
that minimizer, so all copies of a 100-byte string meet in one shard. A shard
of bounded size concatenates its distinct runs and builds their suffix array by
induced sorting: suffixes are classified, the leftmost-smaller (LMS) substrings
are sorted by one induction and named, the string of names is sorted by
recursion (names that occur once need no more than their place), and the rest is
induced from it. Inductions read and write the array in strides that never read
what they write, so each is a linear sweep at any alphabet. Common prefixes are
computed in permuted (text) order and cut the array into groups of equal
windows, whose smallest coordinate (doc_id, byte position) stays.

Runs of one minimizer are distinct windows each, so a minimizer with a single
content has nothing to sort. One whose contents outgrow a shard is split by
longer minimizers, at last by whole windows, and goes through the same steps.

Null and empty texts have no bytes. Rows without doc_id are left out; of rows
that repeat a doc_id, equal ones are one document, cut alike, and others follow
each other in order of their text's hash. An empty table gives an empty result.
Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .repeats import PLACE, SLOT, Windows, distinct_paths, numbered, paths, without
from .storage import discard, written

FIRSTS = "array<struct<d0:int,d1:int,first_doc:bigint,first_pos:bigint>>"
PART = "p_anchor long, p_c1 long, p_c2 long, delta long, anchor long, c1 long, c2 long, first_doc long, first_pos long, run int, content binary"


def _groups(c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The stable order of values, the values in it, where each group of equal ones begins, and its size."""
    order = np.argsort(c, kind="stable")
    c = c[order]
    first = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
    return order, c, first, np.diff(np.append(first, len(c)))


def _types(t: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than its right neighbour; the last is the sentinel."""
    n = len(t)
    at = np.where(t[:-1] != t[1:], np.arange(n - 1), n - 1)
    nxt = np.minimum.accumulate(at[::-1])[::-1]
    return np.append(t[nxt] < t[np.minimum(nxt + 1, n - 1)], True)


def _sweep(sa: np.ndarray, t: np.ndarray, wanted: np.ndarray, slot: np.ndarray, step: int) -> None:
    """Induces the wanted suffixes from their right neighbours, upwards (step 1) or downwards (-1).

    slot: the next free place of each value. A stride ends before the first
    place that it fills itself.
    """
    n, i, size, count = len(sa), 0 if step > 0 else len(sa), 256, np.arange(1 << 16)
    while (i < n) if step > 0 else (i > 0):
        lo, hi = (i, min(i + size, n)) if step > 0 else (max(i - size, 0), i)
        p = sa[lo:hi][::step] - 1
        src = (wanted[p] & (p >= 0)).nonzero()[0]
        p, read = p[src], hi - lo
        if len(p):
            c = t[p]
            order = c.argsort(kind="stable")
            c, place = c[order], count[: len(c)]
            head = place.copy()
            head[1:][c[1:] == c[:-1]] = 0
            land = slot[c] + step * (place - np.maximum.accumulate(head))
            near = int(land.min() - lo if step > 0 else hi - 1 - land.max())
            if near < read:
                read = near
                ok = src[order] < read
                order, c, land = order[ok], c[ok], land[ok]
            sa[land] = p[order]
            slot[c] = land + step  # of equal values the last one counts
        size = min(max(256, 2 * read), 1 << 16)
        i += step * read


def _induce(t: np.ndarray, smaller: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """The suffix array that the given order of LMS suffixes induces."""
    sizes = np.bincount(t)
    sa, end, own = np.full(len(t), -1, np.int64), np.cumsum(sizes), np.zeros(len(sizes), np.int64)
    order, c, first, count = _groups(t[lms])
    own[c[first]] = count
    sa[end[c] - own[c] + np.arange(len(c)) - np.repeat(first, count)] = lms[order]
    _sweep(sa, t, ~smaller, end - sizes, 1)
    tail = end - 1
    sa[0], tail[0] = len(t) - 1, tail[0] - 1
    _sweep(sa, t, smaller, tail, -1)
    return sa


def _named(t: np.ndarray, sa: np.ndarray, lms: np.ndarray, smaller: np.ndarray) -> np.ndarray:
    """Names of LMS substrings in text order; equal ones have one name. sa: LMS positions in order of substring."""
    length = np.zeros(len(t), np.int64)
    length[lms] = np.append(np.diff(lms) + 1, 1)
    a, b = sa[:-1], sa[1:]
    same = length[a] == length[b]
    live, j = np.flatnonzero(same), 0
    while len(live):
        x, y = a[live] + j, b[live] + j
        ok = (t[x] == t[y]) & (smaller[x] == smaller[y])
        same[live[~ok]] = False
        j += 1
        live = live[ok & (j < length[a[live]])]
    name = np.empty(len(t), np.int64)
    name[sa] = np.concatenate([[0], np.cumsum(~same)])
    return name[lms]


def suffix_array(t: np.ndarray) -> np.ndarray:
    """The order of all suffixes of t, which ends with its only smallest value, 0."""
    if len(t) <= 2:
        return np.argsort(t, kind="stable")
    t = t.astype(np.uint16 if t.max() < 1 << 16 else np.int64)
    smaller = _types(t)
    is_lms = smaller.copy()
    is_lms[0] = False
    is_lms[1:] &= ~smaller[:-1]
    lms = np.flatnonzero(is_lms)
    sa = _induce(t, smaller, lms)
    if len(lms) < 2:
        return sa
    in_order = sa[is_lms[sa]]
    names = _named(t, in_order, lms, smaller)
    if names.max() + 1 == len(names):
        return _induce(t, smaller, in_order)
    # of names that occur once only those after a repeated one can decide a comparison
    many = np.bincount(names)[names] > 1
    keep = many.copy()
    keep[1:] |= many[:-1]
    keep[-1] = True
    _, shorter = np.unique(names[keep], return_inverse=True)
    rank = np.zeros(len(names), np.int64)
    rank[np.flatnonzero(keep)[suffix_array(shorter)]] = np.arange(len(shorter))
    return _induce(t, smaller, lms[np.lexsort((rank, names))])


def repeated_windows(raw: np.ndarray, sa: np.ndarray, valid: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The valid positions in suffix order, and which begin the same window as the one before.

    The prefixes are compared in text order through the predecessor of each
    suffix, eight bytes a step, and only as far as they agree.
    """
    at = sa[valid[sa]]
    before = np.full(len(raw) + 1, -1, np.int64)
    before[at[1:]] = at[:-1]
    p = np.flatnonzero(before >= 0)
    q = before[p]
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(raw),), "<u8", padded.data, 0, (1,))
    for j in [*range(0, length - 7, 8), *([length - 8] if length % 8 and length > 8 else [])] if length >= 8 else []:
        ok = eight[p + j] == eight[q + j]
        p, q = p[ok], q[ok]
    if length < 8:
        for j in range(length):
            ok = raw[p + j] == raw[q + j]
            p, q = p[ok], q[ok]
    same = np.zeros(len(raw) + 1, bool)
    same[p] = True
    return at, same[at]


def first_windows(spans: list[bytes], docs: np.ndarray, pos: np.ndarray, length: int) -> pa.ListArray:
    """For each span the first (document, position) of each of its windows, as runs."""
    sizes = np.array([len(x) for x in spans], np.int64)
    begin = np.concatenate([[0], np.cumsum(sizes + 1)])
    raw = np.frombuffer(b"\0".join(spans) + b"\0", np.uint8)
    t = np.append(raw.astype(np.uint16) + np.uint16(2), np.uint16(0))
    t[begin[1:] - 1] = 1
    span = np.repeat(np.arange(len(spans)), sizes + 1)
    valid = np.append(np.arange(len(raw)) + length < begin[1:][span], False)
    at, same = repeated_windows(raw, suffix_array(t), valid, length)
    known, code = np.unique(np.stack([docs, pos >> SLOT], 1), axis=0, return_inverse=True)
    base = (code.ravel().astype(np.int64) << SLOT) + (pos & PLACE) - begin[:-1]
    key = base[span[at]] + at
    starts = np.flatnonzero(~same)
    first = np.zeros(len(raw), np.int64)
    first[at] = np.repeat(np.minimum.reduceat(key, starts), np.diff(np.append(starts, len(at)))) if len(starts) else 0
    place = np.flatnonzero(valid[:-1])
    new = np.ones(len(place), bool)
    new[1:] = (np.diff(place) != 1) | (np.diff(first[place]) != 1)
    heads = np.flatnonzero(new)
    x, size = place[heads], np.diff(np.append(heads, len(place)))
    of, (doc, slot) = span[x], known[first[x] >> SLOT].T
    d0 = x - begin[of]
    runs = pa.StructArray.from_arrays([pa.array(d0.astype(np.int32)), pa.array((d0 + size).astype(np.int32)), pa.array(doc), pa.array((slot << SLOT) + (first[x] & PLACE))], ["d0", "d1", "first_doc", "first_pos"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(len(spans) + 1)).astype(np.int32)), runs)


def _shard(length: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(batches)  # a shard: its size is bounded by the number of shards
        if not parts or not sum(map(len, parts)):
            return
        table = pa.Table.from_batches(parts)
        _, group, contents = np.unique(table["anchor"].to_numpy(), return_inverse=True, return_counts=True)
        many = contents[group] > 1
        single, several = (table.filter(pa.array(x)).combine_chunks() for x in (~many, many))
        if len(single):
            row = np.arange(len(single) + 1, dtype=np.int32)
            whole = [pa.array(np.zeros(len(single), np.int32)), *(single[c].combine_chunks() for c in ("run", "first_doc", "first_pos"))]
            firsts = pa.ListArray.from_arrays(pa.array(row), pa.StructArray.from_arrays(whole, ["d0", "d1", "first_doc", "first_pos"]))
            yield from single.select(["anchor", "c1", "c2"]).append_column("firsts", firsts).combine_chunks().to_batches()
        if len(several):
            docs, pos = (several[c].to_numpy() for c in ("first_doc", "first_pos"))
            firsts = first_windows(several["content"].to_pylist(), docs, pos, length)
            yield from several.select(["anchor", "c1", "c2"]).append_column("firsts", firsts).combine_chunks().to_batches()

    return rows


def _split(window: int, k: int):
    """Runs cut into runs of minimizers of k bytes, each with the run that it is part of."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            content = batch.column(5)
            if not len(content):
                continue
            anchor, first_pos = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 4))
            offsets = np.frombuffer(content.buffers()[1], np.int32)[content.offset : content.offset + len(content) + 1].astype(np.int64)
            data = np.frombuffer(content.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
            ranges = offsets - offsets[0]
            values = data.astype(K.U64) + K.U64(1)
            first, run, _, inner = K.super_kmers(values, np.repeat(ranges[1:], np.diff(ranges)), window, k)
            row = np.searchsorted(ranges, first, "right") - 1
            delta, raw = first - ranges[row], data.tobytes()
            spans = [raw[s:e] for s, e in zip(first.tolist(), (first + run + window - 1).tolist(), strict=True)]
            digests = [xxhash.xxh3_128_intdigest(x) for x in spans]
            c1, c2 = (K.signed(np.array([f(x) for x in digests], K.U64)) for f in (lambda x: x >> 64, lambda x: x & 0xFFFFFFFFFFFFFFFF))
            key = K.signed(K.mix64(anchor[row].astype(np.int64).view(K.U64)) ^ inner)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(take) for i in (0, 1, 2)), pa.array(delta), pa.array(key), pa.array(c1), pa.array(c2), batch.column(3).take(take), pa.array(first_pos[row] + delta), pa.array(run.astype(np.int32)), pa.array(spans, pa.binary())], PART.replace(",", "").split()[::2])

    return rows


def first_places(unique: DataFrame, window: int, lengths: list[int], shard_bytes: int) -> DataFrame:
    """For each distinct run the first place of each of its windows: anchor, c1, c2, firsts.

    lengths: of the minimizers that split the runs of a minimizer whose
    contents outgrow a shard, the window last. Runs move to their shards once;
    a shard sorts about shard_bytes and holds no more than four times that, of
    minimizers with a single content too.
    """
    key = ["anchor", "c1", "c2"]
    size = F.sum(F.col("run") + F.lit(window - 1)).alias("bytes")
    sizes = written(unique.groupBy("anchor").agg(F.count(F.lit(1)).alias("contents"), size).where("contents > 1"), "sizes")
    fits = F.col("bytes") <= shard_bytes if lengths else F.lit(True)
    sorted_bytes = sizes.where(fits).agg(F.sum("bytes")).first()[0] or 0
    all_bytes = unique.agg(size).first()[0] or 0
    rows, parts = unique, []
    if lengths:
        big = sizes.where(~fits).select("anchor")  # no more of them than shards
        if not big.isEmpty():
            crowded = unique.join(F.broadcast(big), "anchor", "left_semi")
            rows = unique.join(F.broadcast(big), "anchor", "left_anti")
            pieces = written(crowded.select(*key, "first_doc", "first_pos", "content").mapInArrow(_split(window, lengths[0]), PART), "pieces")
            at = F.min(F.struct("first_doc", "first_pos")).alias("at")
            inner = pieces.groupBy(key).agg(at, F.first("run").alias("run"), F.first("content").alias("content")).select(*key, "at.*", "run", "content")
            places = first_places(written(inner, "unique"), window, lengths[1:], shard_bytes)
            moved = F.expr("transform(firsts, x -> struct(x.d0 + delta as d0, x.d1 + delta as d1, x.first_doc, x.first_pos))").cast(FIRSTS)
            outer = pieces.drop("content").join(places, key).select("p_anchor", "p_c1", "p_c2", moved.alias("firsts"))
            parts.append(outer.groupBy("p_anchor", "p_c1", "p_c2").agg(F.flatten(F.collect_list("firsts")).alias("firsts")).toDF(*key, "firsts"))
    shards = max(1, -(-sorted_bytes // shard_bytes), -(-all_bytes // (4 * shard_bytes)))
    in_shards = rows.select(*key, "first_doc", "first_pos", "run", "content").repartition(shards, "anchor")
    out = in_shards.mapInArrow(_shard(window), f"anchor long, c1 long, c2 long, firsts {FIRSTS}")
    for x in parts:
        out = out.unionByName(x)
    return written(out, "firsts")


def remove_repeated_bytes(docs: DataFrame, window: int = 100, k: int = 28, shard_bytes: int = 1 << 20) -> DataFrame:
    """Cut bytes covered by a window that also starts earlier (smaller doc_id, or earlier in the document).

    shard_bytes: bytes of distinct runs in a shard.
    Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256.
    """
    k = min(k, window)
    spec = Windows("byte", window, k, 1 << 16)
    texts = numbered(docs)
    found = paths(texts, spec, within=True)
    key = ["anchor", "c1", "c2"]
    unique = written(distinct_paths(found), "unique")
    lengths = sorted({min(window, max(k + 1, (k + window) // 2)), window} - {k})
    firsts = first_places(unique, window, lengths, shard_bytes)
    discard(unique)
    later = "x.first_doc < doc_id or (x.first_doc = doc_id and x.first_pos < pos + x.d0)"
    cuts = F.expr(f"transform(filter(firsts, x -> {later}), x -> struct((pos & {PLACE}L) + x.d0 as b, (pos & {PLACE}L) + x.d1 + {window - 1} as e))")
    ranges = found.select(*key, "doc_id", "pos").join(firsts.hint("shuffle_hash"), key).select("doc_id", F.shiftright("pos", SLOT).cast("int").alias("slot"), cuts.alias("cuts")).where("size(cuts) > 0")
    return without(texts, ranges, spec, found, firsts).withColumnRenamed("size", "n_bytes")
