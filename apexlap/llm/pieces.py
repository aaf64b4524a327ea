"""SentencePiece BPE by rounds of merges over arrays.

A text is normalised as the model asks (a space before it, spaces as U+2581) and
cut into words where no piece of the model reaches across. The distinct words of
a slice of texts lie one after the other in a flat array of symbols. In a round
each word looks for the smallest rank among its pairs; the leftmost of these
merge in all words at once, the array is compacted, and only pairs beside a
merge are looked up again, until no pair remains. Equal pairs of one word merge
in one round from left to right, up to the first whose new neighbours would
come before them, so that the order is the library's. Symbols that the model
doesn't have become bytes.

Null and empty texts have the begin and end ids alone and decode to an empty
text. Rows without doc_id and repeated rows are encoded like others, an empty
table gives an empty result, extra columns are ignored. Texts and words of any
length are read whole; a slice holds some megabytes, or one word if that is
longer. Models other than BPE with byte fallback, with a normalizer that changes
characters, or with user-defined or unused pieces raise ValueError.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .storage import small_batches

ENCODED = "doc_id long, n_tokens long, ids binary, decoded string"
SPACE, NONE = 0x2581, np.iinfo(np.int64).max
#: Pieces and code points as one range of symbols, below this.
SYMBOLS = 1 << 22
SLICE = 1 << 21


def gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """flat[s : s + n] for each start and size, one after the other."""
    before = np.cumsum(sizes) - sizes
    return flat[np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))]


def _bounds(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


class PieceModel:
    """A model's pieces, and its pairs with their ranks, as arrays."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor
        from sentencepiece import sentencepiece_model_pb2 as proto

        spec = proto.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        norm, train, kind = spec.normalizer_spec, spec.trainer_spec, proto.ModelProto.SentencePiece
        odd = {p.type for p in spec.pieces} & {kind.USER_DEFINED, kind.UNUSED}
        if train.model_type != 2 or not train.byte_fallback or train.treat_whitespace_as_suffix or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or odd:
            raise ValueError(f"{path}: not a plain BPE model with byte fallback")
        self.prefix, self.n = norm.add_dummy_prefix, len(spec.pieces)
        library = SentencePieceProcessor(model_file=path)
        self.begin, self.end = library.bos_id(), library.eos_id()
        normal = {p.piece: i for i, p in enumerate(spec.pieces) if p.type == kind.NORMAL}
        rank = {s: r for r, s in enumerate(sorted({spec.pieces[i].score for i in normal.values()}, reverse=True))}
        # a code point is its piece, or a symbol of its own behind all pieces
        self.symbol = np.arange(0x110000, dtype=np.int64) + self.n
        for piece, i in normal.items():
            if len(piece) == 1:
                self.symbol[ord(piece)] = i
        symbol_of = lambda x: normal.get(x, self.n + ord(x) if len(x) == 1 else -1)
        pairs = [(symbol_of(p[:k]) * SYMBOLS + symbol_of(p[k:]), rank[spec.pieces[i].score], i) for p, i in normal.items() for k in range(1, len(p)) if symbol_of(p[:k]) >= 0 and symbol_of(p[k:]) >= 0]
        table = np.array(sorted(pairs), np.int64).reshape(-1, 3)
        self.keys, self.ranks, self.merged = (np.append(table[:, j], NONE) for j in range(3))
        self.cuts = not any(chr(SPACE) in p.lstrip(chr(SPACE)) for p in normal)
        # what ids stand for: bytes of normal pieces with plain spaces, one byte, or nothing
        self.byte = np.zeros(256, np.int64)
        raw, self.spaced, self.control = [], np.zeros(self.n, bool), np.zeros(self.n, bool)
        for i, p in enumerate(spec.pieces):
            if p.type == kind.BYTE:
                self.byte[int(p.piece[1:-1], 16)] = i
                raw.append(bytes([int(p.piece[1:-1], 16)]))
            elif p.type == kind.CONTROL:
                self.control[i] = True
                raw.append(b"")
            elif p.type == kind.UNKNOWN:
                raw.append(train.unk_surface.encode())
            else:
                self.spaced[i] = p.piece.startswith(chr(SPACE))
                raw.append(p.piece.replace(chr(SPACE), " ").encode())
        self.raw_at = _bounds(np.array([len(x) for x in raw]))
        self.raw = np.frombuffer(b"".join(raw), np.uint8)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rank of each pair and what it merges to; NONE where it doesn't."""
        key = left * SYMBOLS + right
        at = np.searchsorted(self.keys, key)
        found = self.keys[at] == key
        return np.where(found, self.ranks[at], NONE), np.where(found, self.merged[at], -1)

    def merge(self, sym: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of words (of so many symbols each) after all merges, and their new sizes."""
        word = np.repeat(np.arange(len(sizes)), sizes)
        rank, made = np.full(len(sym), NONE), np.full(len(sym), -1, np.int64)
        inner = np.flatnonzero(word[:-1] == word[1:])
        rank[inner], made[inner] = self.look_up(sym[inner], sym[inner + 1])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(sym):
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            size = np.diff(np.append(starts, len(sym)))
            best = np.minimum.reduceat(rank, starts)
            over = np.repeat(best == NONE, size)
            if over.any():
                done.append((word[over], sym[over]))
                sym, word, rank, made = (x[~over] for x in (sym, word, rank, made))
                size, best = size[best != NONE], best[best != NONE]
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == np.repeat(best, size))
            # of hits that overlap, every second counts, from the left
            first = np.concatenate([[True], hit[1:] != hit[:-1] + 1])
            nth = np.arange(len(hit)) - np.maximum.accumulate(np.where(first, np.arange(len(hit)), 0))
            hit = hit[nth % 2 == 0]
            # the neighbours that each meets when those before it have merged
            last = len(sym) - 1
            beside = np.concatenate([[False], hit[1:] == hit[:-1] + 2])
            left = np.where(beside, made[np.maximum(hit - 2, 0)], sym[np.maximum(hit - 1, 0)])
            has_left = (hit > 0) & (word[np.maximum(hit - 1, 0)] == word[hit])
            right, has_right = sym[np.minimum(hit + 2, last)], (hit + 2 <= last) & (word[np.minimum(hit + 2, last)] == word[hit])
            new_left, _ = self.look_up(left, made[hit])
            new_right, _ = self.look_up(made[hit], right)
            sooner = (has_left & (new_left <= rank[hit])) | (has_right & (new_right <= rank[hit]))
            before = np.cumsum(sooner) - sooner
            opens = np.concatenate([[True], word[hit[1:]] != word[hit[:-1]]])
            hit = hit[before == np.maximum.accumulate(np.where(opens, before, 0))]
            sym[hit] = made[hit]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            at = (np.cumsum(keep) - 1)[hit]
            sym, word, rank, made = (x[keep] for x in (sym, word, rank, made))
            changed = np.zeros(len(sym), bool)
            changed[at] = changed[np.maximum(at - 1, 0)] = True
            again = np.flatnonzero(changed)
            end = again == len(sym) - 1
            follow = np.minimum(again + 1, len(sym) - 1)
            r, m = self.look_up(sym[again], sym[follow])
            apart = end | (word[again] != word[follow])
            rank[again], made[again] = np.where(apart, NONE, r), np.where(apart, -1, m)
        if not done:
            return sym, np.zeros(len(sizes), np.int64)
        word, sym = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(word, kind="stable")
        return sym[order], np.bincount(word, minlength=len(sizes))

    def _as_ids(self, sym: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols as ids, bytes for those that are no piece."""
        odd = np.flatnonzero(sym >= self.n)
        if not len(odd):
            return sym, sizes
        chars, which = np.unique(sym[odd] - self.n, return_inverse=True)
        raw = [chr(c).encode() for c in chars.tolist()]
        length, at = np.ones(len(sym), np.int64), _bounds(np.array([len(x) for x in raw]))
        length[odd] = np.diff(at)[which]
        begin = np.cumsum(length) - length
        out = np.zeros(int(length.sum()), np.int64)
        out[begin] = np.where(sym < self.n, sym, 0)
        flat = self.byte[np.frombuffer(b"".join(raw), np.uint8)]
        place = np.repeat(begin[odd], length[odd]) + np.arange(int(length[odd].sum())) - np.repeat(np.cumsum(length[odd]) - length[odd], length[odd])
        out[place] = gathered(flat, at[which], length[odd])
        bounds, end = _bounds(sizes), np.append(begin, len(out))
        return out, end[bounds[1:]] - end[bounds[:-1]]

    def _slice(self, chars: np.ndarray, opens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words that begin at `opens`, and how many each has; equal words are merged once."""
        ends = np.append(opens[1:], len(chars))
        _, first, which = np.unique(K.span_hashes(chars, opens, ends), return_index=True, return_inverse=True)
        size = ends - opens
        same = np.array_equal(size, size[first][which]) and np.array_equal(chars, gathered(chars, opens[first][which], size))
        if not same:  # two words share a hash
            first = which = np.arange(len(opens))
        ids, n = self._as_ids(*self.merge(self.symbol[gathered(chars, opens[first], size[first])], size[first]))
        return gathered(ids, (np.cumsum(n) - n)[which], n[which]), n[which]

    def encode(self, texts: list[str], begin: bool = True, end: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and where each text's begin."""
        led = [(chr(SPACE) + x if self.prefix and x else x) for x in texts]
        chars = np.frombuffer("".join(led).encode("utf-32-le"), "<u4").astype(np.int64)
        chars[chars == 0x20] = SPACE
        at = _bounds(np.array([len(x) for x in led]))
        opens = np.zeros(len(chars), bool)
        if self.cuts:
            opens[1:] = (chars[1:] == SPACE) & (chars[:-1] != SPACE)
        opens[at[:-1][at[:-1] < at[1:]]] = True
        opens = np.flatnonzero(opens)
        ids, n, lo = [], [], 0
        while lo < len(opens):
            hi = max(lo + 1, int(np.searchsorted(opens, opens[lo] + SLICE)))
            stop = opens[hi] if hi < len(opens) else len(chars)
            found = self._slice(chars[opens[lo] : stop], opens[lo:hi] - opens[lo])
            ids.append(found[0])
            n.append(found[1])
            lo = hi
        flat = np.concatenate(ids) if ids else np.zeros(0, np.int64)
        words = _bounds(np.concatenate(n)) if n else np.zeros(1, np.int64)
        bounds = words[np.searchsorted(opens, at)]
        if begin or end:
            where = np.concatenate(([bounds[:-1]] if begin else []) + ([bounds[1:]] if end else []))
            what = np.repeat([*([self.begin] if begin else []), *([self.end] if end else [])], len(texts))
            text = np.tile(np.arange(len(texts)), int(begin) + int(end))
            order = np.lexsort((np.arange(len(text)) >= len(texts), text))
            flat = np.insert(flat, where[order], what[order])
            bounds = bounds + np.arange(len(bounds)) * (int(begin) + int(end))
        return flat, bounds

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """The texts of ids[bounds[i] : bounds[i + 1]]; the first piece loses the space that begins a text."""
        ids = ids.astype(np.int64)
        start, size = self.raw_at[ids], np.diff(self.raw_at)[ids]
        told = np.flatnonzero(~self.control[ids])
        if self.prefix and len(told):
            k = np.searchsorted(told, bounds[:-1])
            head = told[np.minimum(k, len(told) - 1)]
            head = head[(k < len(told)) & (head < bounds[1:]) & (head >= bounds[:-1])]
            head = head[self.spaced[ids[head]]]
            start[head] += 1
            size[head] -= 1
        # bytes on both sides of a control piece are no character together: each side is read on its own
        raw, at = gathered(self.raw, start, size).tobytes(), _bounds(size)
        text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        cut = np.flatnonzero(self.control[ids])
        cut = cut[(at[cut] > at[bounds[text[cut]]]) & (at[cut] < at[bounds[text[cut] + 1]])]
        ends = np.unique(np.concatenate([at[bounds], at[cut]]))
        parts = [_text(raw[s:e]) for s, e in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        of = np.searchsorted(ends, at[bounds])
        return ["".join(parts[s:e]) for s, e in zip(of[:-1].tolist(), of[1:].tolist(), strict=True)]


def _text(raw: bytes) -> str:
    """UTF-8; a byte that belongs to no character becomes U+FFFD."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        out, i = [], 0
        while i < len(raw):
            for n in (1, 2, 3, 4):
                try:
                    out.append(raw[i : i + n].decode())
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                n = 1
            i += n
        return "".join(out)


@functools.lru_cache(maxsize=2)
def load(path: str) -> PieceModel:
    return PieceModel(path)


def _encode(path: str, keep_ids: bool, keep_text: bool):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in batches:
            _, offsets = K.text_column(batch, "text")
            for lo, hi in K.slices(offsets, 1 << 20):
                ids, at = model.encode([x or "" for x in batch.column(1)[lo:hi].to_pylist()])
                raw, none = ids.astype("<u4").tobytes(), [None] * (hi - lo)
                packed = [raw[4 * s : 4 * e] for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)] if keep_ids else none
                texts = model.decode(ids, at) if keep_text else none
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array(np.diff(at)), pa.array(packed, pa.binary()), pa.array(texts, pa.string())], ["doc_id", "n_tokens", "ids", "decoded"])

    return rows


def encode_documents(docs: DataFrame, path: str, keep_ids: bool = True, keep_text: bool = True) -> DataFrame:
    """ENCODED: the ids of each whole text (little-endian unsigned 32-bit, with begin and end) and their decoded text."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_encode(path, keep_ids, keep_text), ENCODED)


def _decode(path: str):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in batches:
            raw = [x or b"" for x in batch.column(1).to_pylist()]
            texts = model.decode(np.frombuffer(b"".join(raw), "<u4"), _bounds(np.array([len(x) // 4 for x in raw])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text of rows (doc_id, ids); null ids are an empty text."""
    small_batches(encoded.sparkSession)
    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("binary").alias("ids")).mapInArrow(_decode(path), "doc_id long, text string")
