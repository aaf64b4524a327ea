"""Public tokenizers inside tasks: whole texts, one lookup a word.

No piece of either tokenizer crosses the chunks that a text is cut into here,
so the ids of a text are those of its chunks in order. A chunk that is not yet
in the worker's memo is cut into pieces by the tokenizer's own pattern, and the
library's model encodes each distinct piece once. Byte-level ids take a shorter
way where they can: a text is cut before each space, the words of many texts are
looked up together in arrays, and only new ones are looked at further. A text with characters or special strings for which that
can't be relied on goes to the library whole.
"""

from __future__ import annotations

import functools
import itertools
import json
import re
import struct
import unicodedata
from collections.abc import Callable

import numpy as np

from . import kernels as K

#: Latin letters, digits, punctuation and plain white space, settled in all Unicode versions.
_UNSETTLED = re.compile("[^\t\n\r\x20-\x7e\xa0-ɏ‐-‧€]")
#: Where a cut before a space can split a piece of white space.
_SPACE_RUN = re.compile("[\t\n\r\xa0] (?:[\t\n\r\xa0]|\\Z)")
_LEADING_SPACE = re.compile(r" ?\S+|\s+(?!\S)|\s+")
#: The pattern of byte-level tokenizers that name no other.
_BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CHUNKS, PIECES = 300_000, 100_000
#: Words of a table of arrays, some 50 bytes each.
WORDS = 1 << 19


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.lru_cache(maxsize=4)
def load(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def _byte_letters() -> dict[int, int]:
    """Printable bytes stand for themselves, the others for code points from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    return {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in plain)}


def _plain(pattern: str) -> str:
    """The pattern with the classes L and N spelled out over the settled characters."""
    settled_chars = [chr(c) for c in range(0x2028) if not _UNSETTLED.match(chr(c))]
    for kind in "LN":
        members = re.escape("".join(c for c in settled_chars if unicodedata.category(c)[0] == kind))
        pattern = pattern.replace(f"[\\p{{{kind}}}]", f"[{members}]").replace(f"\\p{{{kind}}}+", f"[{members}]+").replace(f"\\p{{{kind}}}", members)
    return pattern


def folds_space(path: str) -> bool:
    """Whether the tokenizer's own normalizer makes each run of white space one space."""
    with open(path, encoding="utf-8") as f:
        normalizer = json.load(f)["normalizer"] or {}
    steps = normalizer.get("normalizers", [normalizer])
    return any(x.get("type") == "Replace" and x["pattern"].get("Regex") == r"\s+" and x.get("content") == " " for x in steps)


def settled(text: str) -> bool:
    """Whether chunks can be relied on."""
    return "<|" not in text and _UNSETTLED.search(text) is None


class Memo:
    """From a chunk to what `value` makes of its ids, and from a piece to its ids; each starts anew when it is full."""

    def __init__(self, path: str, value: Callable[[list[int]], object]) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = [x["pattern"]["Regex"] for x in spec["pre_tokenizer"].get("pretokenizers", []) if x["type"] == "Split"]
        self.words = bool(split)
        self.lower = "Lowercase" in json.dumps(spec["normalizer"])
        self.pattern = re.compile(_plain(split[0] if split else _BYTE_LEVEL))
        self.model = load(path).model
        self.path, self.value, self.letters, self.chunks, self.pieces = path, value, _byte_letters(), {}, {}

    def split(self, text: str) -> list[str]:
        return text.split() if self.words else _LEADING_SPACE.findall(text)

    def whole(self, text: str) -> object:
        return self.value(load(self.path).encode(text, add_special_tokens=False).ids)

    def value_of(self, chunk: str) -> object:
        out: list[int] = []
        for piece in self.pattern.findall(chunk.lower() if self.lower else chunk):
            if (ids := self.pieces.get(piece)) is None:
                if len(self.pieces) >= PIECES:
                    self.pieces.clear()
                letters = piece.encode().decode("latin-1").translate(self.letters)
                ids = self.pieces[piece] = tuple(t.id for t in self.model.tokenize(letters))
            out += ids
        return self.value(out)

    def learn(self, chunks: set[str]) -> dict:
        """The memo with all of chunks in it."""
        new = chunks.difference(self.chunks)
        if len(self.chunks) + len(new) > CHUNKS:
            self.chunks, new = {}, chunks
        self.chunks.update((c, self.value_of(c)) for c in new)
        return self.chunks

    def values(self, texts: list[str], join: Callable) -> list:
        parts = [self.split(x) if settled(x) else None for x in texts]
        known = self.learn(set().union(*(x for x in parts if x is not None)))
        return [self.whole(x) if p is None else join(map(known.__getitem__, p)) for x, p in zip(texts, parts, strict=True)]


@functools.lru_cache(maxsize=4)
def _counter(path: str) -> Memo:
    return Memo(path, len)


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class SpacedIds:
    """Ids of texts of a byte-level tokenizer: a table of the ids of words with the space before them.

    Words are found by a 64-bit hash of their bytes, all words of a slice at
    once; only words that are new to the table are looked at one by one. It
    starts anew when it is full.
    """

    def __init__(self, path: str) -> None:
        self.memo, self.space = Memo(path, tuple), " ".translate(_byte_letters())
        self._clear(0)

    def _clear(self, expected: int) -> None:
        """An empty table of four slots a word. Word 0 has no hash of its own; it stands for an empty slot."""
        self.room = max(WORDS, expected)
        self.bits = (4 * self.room - 1).bit_length()
        self.slot, self.known = np.zeros(1 << self.bits, np.int32), 1
        self.keys, self.starts, self.sizes = (np.zeros(self.room + 1, t) for t in (np.uint64, np.int32, np.int32))
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each hash in the table, 0 where it has none: slots by its first bits and onwards, up to an empty one."""
        place = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        out = self.slot[place]
        left = ((self.keys[out] != hashes) & (out > 0)).nonzero()[0]
        while len(left):
            place[left] = (place[left] + 1) & (len(self.slot) - 1)
            out[left] = at = self.slot[place[left]]
            left = left[(self.keys[at] != hashes[left]) & (at > 0)]
        return out

    def _ids_of(self, word: str) -> tuple[int, ...]:
        """One of Latin letters alone is a single piece with its space."""
        if word.isascii() and word.isalpha():
            return tuple([t.id for t in self.memo.model.tokenize(self.space + word)])
        return self.memo.value_of(" " + word)

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        """Adds words, which are new to the table and for which it has room."""
        ids = [self._ids_of(w) for w in words]
        new = np.arange(self.known, self.known + len(words), dtype=np.int32)
        self.known += len(words)
        self.keys[new], self.sizes[new] = hashes, [len(x) for x in ids]
        ends = self.used + np.cumsum(self.sizes[new])
        self.starts[new] = ends - self.sizes[new]
        if ends[-1] > len(self.flat):
            self.flat = np.append(self.flat, np.zeros(ends[-1], np.uint32))
        self.flat[self.used : ends[-1]] = list(itertools.chain.from_iterable(ids))
        self.used = int(ends[-1])
        place = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(new):
            free = self.slot[place] == 0
            self.slot[place[free]] = new[free]
            left = self.slot[place] != new
            new, place = new[left], (place[left] + 1) & (len(self.slot) - 1)

    def arrays(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and where each text's begin."""
        plain = ["  " not in x and settled(x) and _SPACE_RUN.search(x) is None for x in texts]
        heads = self.memo.values([x.split(" ", 1)[0] if p else x for x, p in zip(texts, plain, strict=True)], lambda ids: tuple(itertools.chain.from_iterable(ids)))
        raw = [x.encode() if p else b"" for x, p in zip(texts, plain, strict=True)]
        data = np.frombuffer(b"".join(raw), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
        spaces = np.flatnonzero(data == 0x20)
        of = np.searchsorted(spaces, offsets)  # words of text i: [of[i], of[i + 1])
        text = np.repeat(np.arange(len(texts)), np.diff(of))
        begin = spaces + 1
        end = np.append(spaces[1:], len(data)) if len(spaces) else spaces
        end = np.minimum(end, offsets[text + 1])
        hashes = K.span_hashes(data, begin, end)
        at = self._find(hashes)
        if not at.all():
            miss = np.flatnonzero(at == 0)
            new, first = np.unique(hashes[miss], return_index=True)
            first = miss[first]
            if self.known + len(new) > self.room:  # the table starts anew: with all words of these texts
                new, first = np.unique(hashes, return_index=True)
                self._clear(len(new) + 1)
            self._learn(new, [data[begin[i] : end[i]].tobytes().decode() for i in first.tolist()])
            at = self._find(hashes)
        size, head = self.sizes[at], np.array([len(x) for x in heads], np.int64)
        before = np.concatenate([[0], np.cumsum(size)])
        total = head + before[of[1:]] - before[of[:-1]]
        base = np.concatenate([[0], np.cumsum(total)]).astype(np.int64)
        out = np.empty(base[-1], np.uint32)
        turn = np.arange(before[-1])
        target = (base[:-1] + head - before[of[:-1]])[text] + before[:-1]
        out[np.repeat(target - before[:-1], size) + turn] = self.flat[np.repeat(self.starts[at] - before[:-1], size) + turn]
        for x, b in zip(heads, base[:-1].tolist(), strict=True):
            out[b : b + len(x)] = x
        return out, base


@functools.lru_cache(maxsize=4)
def _ids(path: str) -> Memo | SpacedIds:
    memo = Memo(path, _packed)
    return memo if memo.words or memo.lower else SpacedIds(path)


def counts(path: str, texts: list[str]) -> list[int]:
    """Tokens of each text."""
    return _counter(path).values(texts, sum)


def id_arrays(path: str, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts, one after the other, and where each text's begin."""
    by = _ids(path)
    if isinstance(by, SpacedIds):
        return by.arrays(texts)
    each = by.values(texts, b"".join)
    return np.frombuffer(b"".join(each), "<u4"), np.concatenate([[0], np.cumsum([len(x) // 4 for x in each])]).astype(np.int64)


def ids(path: str, texts: list[str]) -> list[bytes]:
    """Little-endian unsigned 32-bit ids of each text."""
    flat, at = id_arrays(path, texts)
    raw = flat.astype("<u4").tobytes()
    return [raw[4 * s : 4 * e] for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
