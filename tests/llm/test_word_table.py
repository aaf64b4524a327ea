"""The table of words with their ids: the library's ids, and one look at each word."""

import itertools

import pytest

from apexlap.llm import tokens

PATH = tokens.tokenizer_path("byte_bpe_50k.json")
WORDS = ["".join(x) for x in itertools.product("abcdefghij", repeat=5)]


def library(texts):
    return [x.ids for x in tokens.load(PATH).encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("room", [1, 40, 1000])
def test_small_tables_start_anew(monkeypatch, room):
    monkeypatch.setattr(tokens, "WORDS", room)
    table = tokens.SpacedIds(PATH)
    for texts in (["a b c a", "", "x"], ["one two,\nthree élan 12.5% "], [" ".join(WORDS[i : i + 30]) for i in range(0, 300, 25)], ["c b a", "b"]):
        flat, at = table.arrays(texts)
        assert [flat[s:e].tolist() for s, e in itertools.pairwise(at.tolist())] == library(texts)


def test_words_are_looked_at_once(monkeypatch):
    table, looked = tokens.SpacedIds(PATH), []
    monkeypatch.setattr(table, "_ids_of", lambda word: looked.append(word) or (len(word),))
    texts = [" ".join(f"{a}{w}" for w in WORDS) for a in "uvwx"]
    for text in [*texts, *texts]:
        table.arrays([f"a {text}"])
    assert len(looked) == len(set(looked)) == 4 * len(WORDS)


def test_hash_of_zero(monkeypatch):
    monkeypatch.setattr(tokens.K, "span_hashes", lambda data, begin, end: (end - begin).astype("u8") - 1)
    flat, _ = tokens.SpacedIds(PATH).arrays(["a b cc b"])
    assert [flat.tolist()] == library(["a b cc b"])
