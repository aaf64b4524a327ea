"""Array kernels over the text buffers of Arrow batches.

They turn the UTF-8 bytes of many documents into words, n-gram hashes and
minimizer runs with a fixed number of numpy calls per slice, so the operators
do no Python work per word. Everything here is a pure function of its inputs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_CACHE: dict[str, np.ndarray] = {}

#: Bytes that separate words under `[^\x20\x09-\x0D]+`.
SPACE_WORDS = np.ones(256, bool)
SPACE_WORDS[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of words under `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` once A-Z is lower case.
ALNUM_WORDS = np.zeros(256, bool)
ALNUM_WORDS[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse modulo 2**64 for i < n at least."""
    if len(_CACHE.get("pow", ())) < n:
        n = max(n, 1 << 16)
        inverse = pow(_BASE, -1, 1 << 64)
        for name, b in (("pow", _BASE), ("inv", inverse)):
            x = np.full(n, b, U64)
            x[0] = 1
            _CACHE[name] = np.cumprod(x)
    return _CACHE["pow"], _CACHE["inv"]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> U64(33))
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def text_column(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the offsets of a string column, or of that field of `row`; null is empty."""
    at = batch.schema.names.index(name) if name in batch.schema.names else -1
    col = batch.column(at) if at >= 0 else batch.column(batch.schema.names.index("row")).field(name)
    col = pc.fill_null(col if pa.types.is_string(col.type) else col.cast(pa.string()), "")
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about `limit` bytes each, one row at least."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def text_slices(batch: pa.RecordBatch, name: str, limit: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) in slices of about `limit` bytes."""
    data, offsets = text_column(batch, name)
    for lo, hi in slices(offsets, limit):
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words in `data`; words of row i are [ranges[i], ranges[i+1])."""
    w = table[data]
    first, last = w.copy(), w.copy()
    if len(w):
        first[1:] &= ~w[:-1]
        last[:-1] &= ~w[1:]
        o = offsets[:-1][offsets[:-1] < offsets[1:]]
        first[o] = w[o]
        e = offsets[1:][offsets[:-1] < offsets[1:]] - 1
        last[e] = w[e]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[s:e] for each pair."""
    power, inverse = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * power[: len(data)], out=total[1:])
    return mix64((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def gram_hashes(values: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of values[i:i+n] for each i with a whole gram."""
    m = len(values) - n + 1
    if m <= 0:
        return np.zeros(0, U64)
    power, inverse = _powers(len(values) + 1)
    total = np.zeros(len(values) + 1, U64)
    np.cumsum(values * power[: len(values)], out=total[1:])
    return mix64((total[n:] - total[:m]) * inverse[:m])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """min(x[i:i+w]) for each i with a whole window."""
    n, span = len(x) - w + 1, 1
    while span * 2 <= w:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return x[:n] if span == w else np.minimum(x[:n], x[w - span : w - span + n])


_POS = U64((1 << 21) - 1)
_CHUNK = 1 << 20


def super_kmers(values: np.ndarray, row_end: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """Runs of neighbouring windows that share their minimizer.

    values: a 64-bit value per token; row_end: for each token the end of its
    document. Every window of `length` tokens inside a document is in exactly
    one run, and the minimizer (leftmost of the smallest k-gram hashes) depends
    on the window's tokens alone, so equal windows meet under equal hashes.
    Returns the first window, the number of windows, the anchor's offset in the
    first window and the anchor's hash of each run. Long inputs are cut into
    chunks that overlap, which may split runs but loses no window.
    """
    out: list[tuple[np.ndarray, ...]] = []
    for s in range(0, max(0, len(values) - length + 1), _CHUNK):
        x = values[s : s + _CHUNK + length - 1]
        g = gram_hashes(x, k)
        m = sliding_min((g & ~_POS) | np.arange(len(g), dtype=U64), length - k + 1)
        anchor = (m & _POS).astype(np.int64)
        i = np.arange(len(m))
        valid = s + i + length <= row_end[s : s + len(m)]
        new = np.ones(len(m), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | ~valid[:-1]
        begin = np.flatnonzero(new & valid)
        stops = np.append(np.flatnonzero(new | ~valid), len(m))
        end = stops[np.searchsorted(stops, begin, "right")]
        out.append((begin + s, end - begin, anchor[begin] - begin, g[anchor[begin]]))
    if not out:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, U64))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def joined_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words' bytes, each followed by one space, and where each word begins (and the end)."""
    size = ends - starts + 1
    begin = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(size, out=begin[1:])
    take = np.arange(begin[-1]) + np.repeat(starts - begin[:-1], size)
    out = data[np.minimum(take, max(len(data) - 1, 0))] if len(data) else np.zeros(0, np.uint8)
    out[begin[1:] - 1] = 0x20
    return out, begin


def covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n positions lie in one of the ranges."""
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, starts, 1)
    np.add.at(d, ends, -1)
    return np.cumsum(d[:-1]) > 0


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)
