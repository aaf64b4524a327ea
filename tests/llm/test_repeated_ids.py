"""Rows that repeat a doc_id: equal rows share a result, other texts are documents of their own."""

import hashlib

from pyspark.sql import functions as F

from apexlap.llm import counts, debruijn, exact, minhash, packing, suffix, tokens, wumanber
from apexlap.llm.storage import frequent, joined


def _docs(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(120)) for x in "abc")
    rows = [(1, a), (1, b), (1, b), (2, a), (3, c), (None, a), (None, b)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3), a, b, c


def _sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_passages_and_bytes(spark):
    docs, a, b, c = _docs(spark)
    for got in (debruijn.remove_repeated_passages(docs).collect(), suffix.remove_repeated_bytes(docs).collect()):
        assert sorted((r.doc_id, r.n_removed > 0, r.kept_sha256) for r in got) == sorted([(1, False, _sha(a)), (1, False, _sha(b)), (1, False, _sha(b)), (2, True, _sha("")), (3, False, _sha(c))])


def test_dedup(spark):
    docs, *_ = _docs(spark)
    got = sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact.exact_duplicates(docs).collect())
    assert got == [(1, 1, 2, True), (1, 1, 2, True), (1, 1, 2, True), (2, 1, 2, False), (3, 3, 1, True)]
    near = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect())
    assert near == [(1, 116, 1, True), (1, 116, 1, True), (1, 116, 1, True), (2, 116, 1, False), (3, 116, 3, True)]


def test_contamination_in_several_groups(spark):
    docs, a, *_ = _docs(spark)
    items = spark.createDataFrame([(i, " ".join(a.split()[10 * i : 10 * i + 10])) for i in range(8)], "item_id long, text string")
    for size in (1 << 23, 100):
        got = wumanber.find_contamination(docs, items, group_bytes=size).collect()
        assert sorted((r.doc_id or 0, r.n_hit, r.n_items) for r in got) == [(0, 0, 0), (0, 80, 8), (1, 0, 0), (1, 0, 0), (1, 80, 8), (2, 80, 8), (3, 0, 0)]


def test_counts_and_packing(spark):
    docs, a, b, c = _docs(spark)
    path = tokens.tokenizer_path("word_bpe_49k.json")
    n = {x: len(tokens.load(path).encode(x, add_special_tokens=False).ids) for x in (a, b, c)}
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_tokens) for r in counts.count_tokens(docs, path).collect())
    assert got == sorted((i, len(x), n[x]) for i, x in [(1, a), (1, b), (1, b), (2, a), (3, c), (0, a), (0, b)])
    assert counts.count_tokens(docs.limit(0), path).count() == 0
    path = tokens.tokenizer_path("byte_bpe_50k.json")
    n = {x: len(tokens.load(path).encode(x, add_special_tokens=False).ids) + 1 for x in (a, b, c)}
    pieces = packing.pack_documents(docs, path, keep_ids=False).collect()
    assert sum(r.length for r in pieces) == sum(n[x] for x in (a, b, b, a, c, a, b))
    assert len({(r.sequence_id, r.offset) for r in pieces}) == len(pieces)


def test_frequent_keys_join_as_others(spark):
    rows = spark.range(5000).select(F.expr("case when id % 3 = 0 then 0 when id % 7 = 0 then null else id end").alias("k"), "id")
    groups = rows.where("k is not null").groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    often = frequent(groups, ["k"], "n")
    assert [r.k for r in often.collect()] == [0]
    facts = groups.where("k < 4000")
    for how in ("inner", "left"):
        got = sorted(joined(rows, facts, ["k"], often, how).select("id", "n").collect())
        assert got == sorted(rows.join(facts, ["k"], how).select("id", "n").collect())
