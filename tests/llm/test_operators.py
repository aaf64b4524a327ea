"""The training-data operators against brute force, with nulls, empties, ties, repeats and odd columns."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from apexlap.llm import counts, debruijn, exact, langid, minhash, packing, suffix, tokens, toxicity, warc, wumanber

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, anchor long"


def corpus() -> list[tuple[int, str | None]]:
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    shared = [word() for _ in range(130)]
    docs: list[str | None] = [None, "", "   ", "one", "One two  three", "a b c d"]
    for i in range(50):
        own = [word() for _ in range(rng.randint(1, 150))]
        if i % 3 == 0:
            a = rng.randint(0, 40)
            own[rng.randint(0, len(own)) : 0] = shared[a : a + rng.randint(30, 90)]
        docs.append(" ".join(own))
    base = docs[20] + " " + " ".join(shared)
    docs += [base, base, base.replace(" ", "\n"), base + " tail end", "ab " * 400, "".join(["x"] * 900), " ".join(word() for _ in range(6000)), "don't <|endoftext|> 12³ あ　b"]
    return list(enumerate(docs))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, x, None, "s", 1, "d", 3) for i, x in corpus()] + [(None, "no id", None, None, None, None, None)], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(x: str | None) -> list[bytes]:
    return (x or "").encode().split()


def test_exact(docs, none):
    norm = {i: re.sub(r"[\x20\x09-\x0D]+", " ", x or "") for i, x in corpus()}
    for fan_in in (2, 16):
        got = {r.doc_id: r for r in exact.exact_duplicates(docs, fan_in).collect()}
        for i, x in norm.items():
            group = sorted(j for j, y in norm.items() if x == y)
            assert tuple(got[i])[:5] == (i, group[0], len(group), i == group[0], hashlib.sha256(x.encode()).hexdigest())
    assert exact.exact_duplicates(none).count() == 0


def test_passages(docs, none):
    got = {r.doc_id: r for r in debruijn.remove_repeated_passages(docs).collect()}
    first: dict = {}
    for i, x in corpus():
        for j in range(len(words(x)) - 49):
            first.setdefault(tuple(words(x)[j : j + 50]), i)
    removed = 0
    for i, x in corpus():
        w = words(x)
        cut = [False] * len(w)
        for j in range(len(w) - 49):
            if first[tuple(w[j : j + 50])] < i:
                cut[j : j + 50] = [True] * 50
        removed += sum(cut)
        kept = b" ".join(a for a, c in zip(w, cut, strict=True) if not c)
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(w), sum(cut), hashlib.sha256(kept).hexdigest())
    assert removed > 500 and debruijn.remove_repeated_passages(none).count() == 0


@pytest.mark.parametrize("shard_bytes", [1 << 20, 300])
def test_bytes(docs, none, shard_bytes):
    """With the small shards, minimizers with several contents are split twice."""
    got = {r.doc_id: r for r in suffix.remove_repeated_bytes(docs, shard_bytes=shard_bytes).collect()}
    seen: set[bytes] = set()
    for i, x in corpus():
        b = (x or "").encode()
        cut = np.zeros(len(b), bool)
        for j in range(len(b) - 99):
            if b[j : j + 100] in seen:
                cut[j : j + 100] = True
            seen.add(b[j : j + 100])
        kept = np.frombuffer(b, np.uint8)[~cut].tobytes()
        spans = int((cut & ~np.concatenate([[False], cut[:-1]])).sum()) if len(b) else 0
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(b), int(cut.sum()), spans, hashlib.sha256(kept).hexdigest())
    if shard_bytes > 300:
        assert suffix.remove_repeated_bytes(none).count() == 0


def test_suffix_array():
    rng = random.Random(1)
    for n in (0, 1, 2, 60, 3000):
        for size in (1, 2, 3, 200):
            x = np.array([rng.randint(1, size) for _ in range(n)] + [0])
            b = bytes(x.astype(np.uint8))
            assert suffix.suffix_array(x).tolist() == sorted(range(n + 1), key=lambda i: b[i:])


def test_near_duplicates(docs, none):
    got = {r.doc_id: r for r in minhash.near_duplicates(docs, 85).collect()}
    sets = {}
    for i, x in corpus():
        w = [y.lower() for y in words(x)]
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} - {()}
    label = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
        break
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(sets[i]), label[i], label[i] == i) for i in sets}
    assert minhash.near_duplicates(none).count() == 0


def test_bayes_table():
    least = minhash.least_matches(85, 1e-9)
    assert list(least) == sorted(least) and least[-1] < 109 and least[0] >= 1


def test_counts(spark, docs, tmp_path):
    path, cache = tokens.tokenizer_path("word_bpe_49k.json"), f"file://{tmp_path}/cache"
    for _ in range(2):
        got = {r.doc_id: r for r in counts.count_tokens(docs, path, cache).collect()}
        for i, x in corpus():
            n = len(tokens.load(path).encode(x or "", add_special_tokens=False).ids)
            assert tuple(got[i]) == (i, len((x or "").encode()), n, n > 2048)
    stored = spark.read.parquet(cache)
    assert stored.count() == stored.select("digest").distinct().count()


def test_packing(docs, none):
    path = tokens.tokenizer_path("byte_bpe_50k.json")
    rows = packing.pack_documents(docs, path).collect()
    ids = {i: np.array([*tokens.load(path).encode(x or "", add_special_tokens=False).ids, 1], "<u4").tobytes() for i, x in corpus()}
    total, inside = collections.Counter(), collections.defaultdict(list)
    for r in rows:
        inside[r.sequence_id].append((r.offset, r.length))
        if r.doc_id is not None:
            part = ids[r.doc_id][4 * r.start : 4 * (r.start + r.length)]
            assert bytes(r.ids) == part and zlib.crc32(part) == r.ids_crc32 and r.doc_tokens * 4 == len(ids[r.doc_id])
            total[r.doc_id] += r.length
    assert total == {i: len(x) // 4 for i, x in ids.items()}
    for pieces in inside.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack_documents(none, path).count() == 0


def test_best_fit():
    where, offset, used = packing.best_fit_decreasing(np.array([3, 7, 5, 2, 10, 3]), 10)
    assert used == 3 and [sorted(np.flatnonzero(where == w)) for w in range(3)] == [[4], [0, 1], [2, 3, 5]] and sorted(offset[where == 1]) == [0, 7]


def test_contamination(spark, docs, none):
    items = [(1, corpus()[20][1]), (2, "ONE"), (3, None), (4, "three a b"), (11, corpus()[30][1]), (None, "x"), (5, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    low = lambda x: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (x or "").encode().lower())
    for size in (1 << 23, 50):
        got = {r.doc_id: r for r in wumanber.find_contamination(docs, bench, group_bytes=size).collect()}
        for i, x in corpus():
            w, hit, names = low(x), set(), set()
            for item, text in items:
                t = low(text)
                m = min(10, len(t))
                if item is None or not m:
                    continue
                for a in range(len(t) - m + 1):
                    for b in range(len(w) - m + 1):
                        if w[b : b + m] == t[a : a + m]:
                            hit |= set(range(b, b + m))
                            names.add(str(item))
            assert tuple(got[i])[1:6] == (len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit))
    assert wumanber.find_contamination(none, bench).count() == 0


def test_languages(spark, docs, none):
    data = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    got = langid.identify_languages(data, ~held).join(data.select("doc_id", "lang"), "doc_id").where(held)
    right = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.97
    assert {r.lang_pred for r in langid.identify_languages(docs, F.lit(True)).collect()} == {"und"}
    assert langid.identify_languages(none, F.lit(True)).count() == 0


def test_toxicity(spark, none):
    bad = ["vile", "grubby", "rotten"]
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    rows = [(i, " ".join([word() for _ in range(30)] + ([rng.choice(bad), rng.choice(bad)] if i % 4 == 0 else []))) for i in range(400)] + [(400, None), (401, "")]
    data = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score_toxicity(data, labels, F.col("doc_id") % 5 != 0).collect()}
    assert [got[i].predicted for i in range(402)] == [int(i < 400 and i % 4 == 0) for i in range(402)]
    assert all(0 <= r.score <= 1 for r in got.values())
    assert toxicity.score_toxicity(none, labels, F.lit(True)).count() == 0


def test_revisits(spark):
    full = {"etag": '"a"', "date": "1", "content-type": "text/html"}
    rows = [(1, "http://www.A.org:80/x/?utm_a=1#q", 10, "response", full), (2, "https://a.org/x", 20, "revisit", {"etag": 'W/"a"', "date": "2", "content-length": "0"}), (3, "a.org/x", 9, "revisit", None), (4, "http://a.org/x", 9000, "revisit", {"etag": '"b"'}), (5, None, 5, "revisit", {}), (6, "http://a.org/x", None, "response", None), (7, "http://a.org/x/", 10, "revisit", {})]
    records = spark.createDataFrame(rows, "record_id long, url string, time long, kind string, headers map<string,string>")
    got = {r.record_id: r for r in warc.resolve_revisits(records).collect()}
    assert {i: (r.status, r.source_id) for i, r in got.items()} == {1: ("response", None), 2: ("resolved", 1), 3: ("no_response", None), 4: ("mismatch", 1), 5: ("no_response", None), 6: ("response", None), 7: ("resolved", 1)}
    assert got[2].headers == {"etag": 'W/"a"', "date": "2", "content-type": "text/html"}


def test_spaced_ids():
    rng, parts = random.Random(4), ["a", "b ", " ", "\n", "\t", " \n", "12", "é", "!?", "'s", "Word", " x", "\r\n", "\xa0", "’", "<|", "я"]
    path = tokens.tokenizer_path("byte_bpe_50k.json")
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(3000)]
    want = [np.array(x.ids, "<u4").tobytes() for x in tokens.load(path).encode_batch(texts, add_special_tokens=False)]
    assert tokens.ids(path, texts) == want
