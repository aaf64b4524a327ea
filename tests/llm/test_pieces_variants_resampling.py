"""SentencePiece by merge rounds, spelling variants and importance resampling against the library and brute force."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from apexlap.llm import crc, pieces, resample, variants
from apexlap.llm.tokens import tokenizer_path

SCHEMA = "doc_id long, text string, place long, ids string, word string, n long, score string, rank string, bucket string"
EXTRA = (7, "i", "w", 9, "s", "r", "b")


def frame(spark, rows):
    return spark.createDataFrame([(i, x, *EXTRA) for i, x in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def model():
    return pieces.load(tokenizer_path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def library():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))


def odd_texts() -> list[str]:
    rng = random.Random(2)
    texts = ["", " ", "a", "  a  b\n\x00▁ é 日本 ", "x" * 3000, " " * 700, "ab" * 900 + " " * 37, "<s></s> <0x41>", "\U0001f600" * 20 + "é", "aaaaaaaaaa bbbbbbbbb", "\n" * 90, "▁▁▁a▁▁ ▁b"]
    for letters in ("abcdefghijklmnopqrstuvwxyz  \n.é日本の1234567890-_=/*\t", "etaion s", "=-*/# \n", "ab "):
        texts += ["".join(rng.choice(letters) for _ in range(rng.randint(1, 200))) for _ in range(250)]
    return texts


def test_pieces_are_the_librarys(model, library):
    texts = odd_texts()
    ids, at = model.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == library.encode(texts, add_bos=True, add_eos=True)
    assert model.decode(ids, at) == [library.decode(x) for x in library.encode(texts)]
    plain, at = model.encode(texts[:9], begin=False, end=False)
    assert [plain[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == library.encode(texts[:9])


def test_small_slices_change_nothing(model, monkeypatch):
    texts = odd_texts()[:40]
    whole = model.encode(texts)
    monkeypatch.setattr(pieces, "SLICE", 5)
    assert all(np.array_equal(a, b) for a, b in zip(whole, model.encode(texts), strict=True))


def test_any_ids_decode(model, library):
    rng = random.Random(4)
    rows = [[rng.choice([rng.randrange(3, 259), rng.randrange(32000), rng.randrange(3), 259, 28705]) for _ in range(rng.randint(0, 30))] for _ in range(1500)]
    got = model.decode(np.array([x for r in rows for x in r], np.int64), np.cumsum([0, *map(len, rows)]))
    assert got == [library.decode(r) for r in rows]


def test_encoded_documents(spark, library):
    rows = list(enumerate([None, *odd_texts()[:60]])) + [(3, "again"), (3, "again"), (None, "no id")]
    docs = frame(spark, rows)
    got = collections.Counter((r.doc_id, r.n_tokens, bytes(r.ids), r.decoded) for r in pieces.encode_documents(docs, tokenizer_path("piece_bpe_32k.model")).collect())
    want = collections.Counter()
    for i, x in rows:
        ids = library.encode(x or "", add_bos=True, add_eos=True)
        want[(i, len(ids), np.array(ids, "<u4").tobytes(), library.decode(ids))] += 1
    assert got == want
    assert pieces.encode_documents(docs.limit(0), tokenizer_path("piece_bpe_32k.model")).count() == 0
    back = pieces.decode_documents(pieces.encode_documents(docs, tokenizer_path("piece_bpe_32k.model"), keep_text=False), tokenizer_path("piece_bpe_32k.model"))
    assert collections.Counter(r.text for r in back.collect()) == collections.Counter(k[3] for k in got.elements())


def near(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(rows, damage=199):
    n = collections.Counter()
    for i, x in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", x or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % damage == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}
    beside = {w: [v for v in n if near(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(beside[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(beside[w]), n[form[w]] if form[w] else None))
    return out


def variant_rows() -> list[tuple[int | None, str | None]]:
    rng = random.Random(6)
    rows: list[tuple[int | None, str | None]] = [(0, None), (1, ""), (2, "ÀÉ×÷ " * 3), (None, "Parabole " * 7)]
    base = ["".join(rng.choice("abé") for _ in range(rng.randint(6, 9))) for _ in range(60)] + ["aaaaaaa", "aaaaaaaa", "abababab", "bababab"]
    for i in range(5, 90):
        words = []
        for _ in range(60):
            w = base[min(int(rng.expovariate(0.06)), len(base) - 1)]
            if rng.random() < 0.3:
                k = rng.randrange(len(w))
                w = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("abz") + w[k:], w[:k] + rng.choice("abz") + w[k + 1 :]])
            words.append(w.upper() if rng.random() < 0.2 else w)
        rows.append((i, rng.choice([" ", ", ", "1"]).join(words)))
    rows += [(200 + i, f"{'qqqqqqq ' * 13} {'qqqqqqz ' * 2} {'qqqqqzz' if i < 5 else ''}") for i in range(14)]
    long_word = "xyz" * 2000
    return rows + [(90 + i, f"{long_word} {long_word}q") for i in range(6)] + [(5, rows[4][1]), (5, rows[4][1])]


@pytest.mark.parametrize("damage", [199, 7])
def test_variants(spark, damage):
    rows = variant_rows()
    got = {tuple(r) for r in variants.group_variants(frame(spark, rows), damage=damage).collect()}
    want = brute_variants(rows, damage)
    assert got == want and sum(1 for r in want if r[1]) > 20 and (damage == 7 or ("qqqqqzz", "qqqqqqz", "qqqqqqq") in {r[:3] for r in want})


def test_paths_are_nodes_over_partitions(spark):
    rng = random.Random(8)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(1, 9))) for _ in range(500)} | {"aaaa" + "b" * 50})
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    got = variants.trie_paths(spark.createDataFrame([(w,) for w in words], "word string")).collect()
    spark.conf.set("spark.sql.shuffle.partitions", before)
    node = {}
    for r in got:
        assert len(r.path) == len(r.word)
        for i, x in enumerate(r.path):
            assert node.setdefault(r.word[: i + 1], x) == x
    assert len(set(node.values())) == len(node) and len({r.place >> 33 for r in got}) > 5
    assert [r.word for r in sorted(got, key=lambda r: r.place)] == words


def test_no_variants(spark):
    assert variants.group_variants(frame(spark, [])).count() == 0
    assert {tuple(r) for r in variants.group_variants(frame(spark, [(1, "lonely " * 5)])).collect()} == {("lonely", None, "lonely", 5, 0, None)}


def test_crc_of_spans():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 60_000).astype(np.uint8)
    begin = rng.integers(0, 60_000, 900)
    end = np.minimum(60_000, begin + np.concatenate([rng.integers(0, 20, 300), rng.integers(0, 400, 300), rng.integers(0, 60_000, 300)]))
    assert crc.crc32_spans(data, begin, end).tolist() == [zlib.crc32(data[b:e].tobytes()) for b, e in zip(begin, end, strict=True)]
    assert crc.crc32_spans(data, begin[:0], end[:0]).tolist() == []


def brute_resample(rows, target, percent, least, grams, buckets):
    def features(x):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (x or "").translate({c: c + 32 for c in range(65, 91)}))
        runs = [" ".join(w[i : i + n]) for n in range(grams[0], grams[1] + 1) for i in range(len(w) - n + 1)]
        return len(w), [zlib.crc32(f.encode()) % buckets for f in runs]

    s, t = collections.Counter(), collections.Counter()
    for _, x in rows:
        s.update(features(x)[1])
    for _, x in target:
        t.update(features(x)[1])
    gain = [math.floor(1000.0 * math.log((t[b] + 1.0) * (s.total() + float(buckets)) / ((s[b] + 1.0) * (t.total() + float(buckets))))) for b in range(buckets)]
    scored = []
    for i, x in rows:
        words, f = features(x)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        scored.append((i, words, len(f), weight, weight + math.floor(-1000.0 * math.log(-math.log((h + 0.5) / 4294967296.0)))))
    able = sorted((r for r in scored if r[1] >= least), key=lambda r: (-r[4], math.inf if r[0] is None else r[0]))
    drawn = {id(r): k + 1 for k, r in enumerate(able[: len(able) * percent // 100])}
    return collections.Counter((*r, drawn.get(id(r))) for r in scored)


@pytest.mark.parametrize("grams", [(1, 1), (1, 3)])
def test_resampling(spark, grams):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdé9") for _ in range(rng.randint(1, 4)))
    texts = [None, "", " . ", "One", "x" * 9000 + " " + "y" * 70] + [" ".join(word() for _ in range(rng.randint(1, 60))).title() for _ in range(150)]
    rows = list(enumerate(texts)) + [(9, texts[9]), (9, texts[9]), (None, "no id " * 12)]
    target = [(i, " ".join(word() for _ in range(30))) for i in range(9)] + [(99, None)]
    for percent, least, aims in ((10, 20, target), (100, 0, target), (50, 1, [])):
        got = resample.importance_resample(frame(spark, rows), frame(spark, aims), percent, least, grams=grams, buckets=300)
        got = collections.Counter(tuple(r) for r in got.drop("text_hash").collect())
        want = brute_resample(rows, aims, percent, least, grams, 300)
        assert got == want
    assert resample.importance_resample(frame(spark, []), frame(spark, target)).count() == 0
    with pytest.raises(ValueError, match="buckets"):
        resample.importance_resample(frame(spark, rows), frame(spark, target), buckets=0)
