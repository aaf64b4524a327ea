"""CRC-32 of many spans of one byte array, by tables of positions.

A CRC is linear: each byte adds a value that depends on itself and its distance
from the span's end alone, and the length adds a constant. The values of all
bytes come from one table and are folded by XOR over spans. Spans longer than
the table are cut into blocks from their end; blocks meet in pairs, the left one
shifted by the bytes of the right one, so a span of any length takes a
logarithmic number of rounds. An empty span has the CRC of no bytes, 0.
"""

from __future__ import annotations

import functools
import zlib

import numpy as np

#: Reversed polynomial of CRC-32 (a fixed value).
POLYNOMIAL = 0xEDB88320
BLOCK, LENGTHS, CHUNK = 64, 4096, 1 << 22


@functools.lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray]:
    """What a byte at each distance from the end adds, and what each length adds."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, (one >> np.uint32(1)) ^ np.uint32(POLYNOMIAL), one >> np.uint32(1))
    table = np.empty((BLOCK, 256), np.uint32)
    table[0] = one
    for d in range(1, BLOCK):
        table[d] = one[table[d - 1] & 255] ^ (table[d - 1] >> np.uint32(8))
    register, lengths = 0xFFFFFFFF, np.empty(LENGTHS, np.uint32)
    for n in range(LENGTHS):
        lengths[n] = register ^ 0xFFFFFFFF
        register = int(one[register & 255]) ^ (register >> 8)
    return table, lengths


def _shifted(step: np.ndarray, register: np.ndarray) -> np.ndarray:
    """Registers after the zero bytes that step, a table for each byte of a register, stands for."""
    out = step[0][register & 255]
    for k in (1, 2, 3):
        out = out ^ step[k][(register >> np.uint32(8 * k)) & 255]
    return out


def _folded(data: np.ndarray, begin: np.ndarray, end: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The XOR of what the bytes of each span add; spans hold one byte to BLOCK."""
    size = end - begin
    first = np.cumsum(size) - size
    at = np.repeat(begin - first, size) + np.arange(int(size.sum()))
    return np.bitwise_xor.reduceat(table[np.repeat(end - 1, size) - at, data[at]], first)


def crc32_spans(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The unsigned CRC-32 of data[b:e] for each pair; spans may overlap."""
    table, lengths = tables()
    size = end - begin
    out = np.zeros(len(size), np.uint32)
    blocks = -(-size // BLOCK)
    full = np.flatnonzero(blocks)
    if len(full):
        # blocks in order, each with how many blocks follow it in its span
        n = blocks[full]
        total = int(n.sum())
        after = np.repeat(np.cumsum(n), n) - np.arange(total) - 1
        stop = np.repeat(end[full], n) - after * BLOCK
        start = np.maximum(stop - BLOCK, np.repeat(begin[full], n))
        part = np.concatenate([_folded(data, start[lo : lo + CHUNK // BLOCK], stop[lo : lo + CHUNK // BLOCK], table) for lo in range(0, total, CHUNK // BLOCK)])
        step = table[[BLOCK - 1, BLOCK - 2, BLOCK - 3, BLOCK - 4]]
        while after.any():
            odd = np.flatnonzero(after & 1)
            part[odd + 1] ^= _shifted(step, part[odd])
            part, after = np.delete(part, odd), np.delete(after, odd) >> 1
            step = np.stack([_shifted(step, x) for x in step])
        out[full] = part
    known = np.minimum(size, LENGTHS - 1)
    constant = lengths[known]
    for n in np.unique(size[size >= LENGTHS]).tolist():
        constant[size == n] = zlib.crc32(bytes(n))
    return out ^ constant
