"""The two learnt operators on repeats, odd columns, mixed case, short and very long texts, and without labels."""

import random

from pyspark.sql import functions as F

from apexlap.llm import langid, toxicity

ALPHABETS = ["abcdef", "ghijkl", "mnopqr", "stuvwx", "яжщъэю", "αβγδεζ"]


def _text(rng, letters, n):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n))


def _spoken(rng):
    return [(i, _text(rng, ALPHABETS[i % 6], 20), f"l{i % 6}") for i in range(120)]


def test_every_language_is_learnt(spark):
    """With a bound of fewer texts than languages, each still lends two."""
    rng = random.Random(3)
    docs = spark.createDataFrame(_spoken(rng), "doc_id long, text string, lang string").repartition(3)
    for bounds in ({}, {"texts": 1, "marks": 1}):
        got = langid.identify_languages(docs, F.lit(True), **bounds).join(docs.select("doc_id", "lang"), "doc_id").collect()
        assert {r.lang_pred for r in got} == {f"l{i}" for i in range(6)}
        if not bounds:
            assert all(r.lang == r.lang_pred for r in got)


def test_language_of_odd_rows(spark):
    rng = random.Random(4)
    long = _text(rng, ALPHABETS[1], 200_000)
    odd = [(200, long, None), (201, "abc DEF bad", None), (202, "ABC def BAD", None), (203, "12 !?", None), (204, "", None), (205, None, None), (206, "a", None), (None, "ghi jkl", "l0"), (7, "mno pqr", "l2"), (7, "mno pqr", "l2")]
    rows = [(*r, 1, "x", 2.0) for r in _spoken(rng) + odd]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, train int, lang_pred string, score double").repartition(3)
    got = langid.identify_languages(docs, F.coalesce(F.col("doc_id") < 200, F.lit(False))).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: (r.lang_pred, r.score) for r in got}
    assert by[200][0] == "l1" and by[201] == by[202] and by[201][0] == "l0" and by[206][0].startswith("l")
    assert by[203] == by[204] == by[205] == ("und", 0.0) and by[None][0] == "l1"
    assert sorted(r.lang_pred for r in got if r.doc_id == 7) == ["l1", "l2", "l2"]
    assert all(0 <= r.score <= 1 for r in got)


def test_toxicity_of_odd_rows(spark):
    rng = random.Random(5)
    said = [(i, _text(rng, "abcdefghij", 30) + (" vile grubby" if i % 4 == 0 else "")) for i in range(400)]
    odd = [(500, None), (501, ""), (None, "vile grubby rotten"), (502, _text(rng, "abcdefghij", 200_000)), (503, "VILE Grubby"), (3, "vile grubby"), (4, said[4][1])]
    rows = [(*r, "row", 0.5, 7, 1) for r in said + odd]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string, score double, predicted int, toxic int").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)] * 2 + [(None, 1), (4, None)], "doc_id long, toxic int")
    train = F.col("doc_id") % 5 != 0
    got = toxicity.score_toxicity(docs, labels, train).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r.predicted)
    assert by[500] == by[501] == by[502] == [0] and by[None] == by[503] == [1] and sorted(by[3]) == [0, 1] and by[4] == [1, 1]
    left = toxicity.without_toxic(docs, labels, train)
    assert left.columns == docs.columns and left.count() == sum(not x for p in by.values() for x in p)
    assert {tuple(r)[2:] for r in left.collect()} == {("row", 0.5, 7, 1)}


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "vile"), (2, None)], "doc_id long, text string")
    for labels in ([], [(1, 0)], [(1, None)]):
        got = toxicity.score_toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), F.lit(True)).collect()
        assert [(r.score < 1e-9, r.predicted) for r in got] == [(True, 0)] * 2
