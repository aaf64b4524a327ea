"""The corpus pipeline over a small table: each stage narrows documents, and packing loses none of the rest."""

import corpus_pipeline
from apexlap.llm.storage import written

SF_DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, left = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, SF_DIR), "stage")
        assert docs.columns == columns
        ids = [r.doc_id for r in docs.select("doc_id").collect()]
        assert ids and len(ids) == len(set(ids)) and set(ids) <= left
        left = set(ids)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR).collect()
    assert {r.doc_id for r in pieces} == left
    total = {r.doc_id: r.doc_tokens for r in pieces}
    assert sum(r.length for r in pieces) == sum(total.values())


def _odd(spark, tmp_path):
    """Documents with nulls, empties, repeats and columns named like those that stages make, and the tables beside them."""
    words = lambda a, n: " ".join(f"{a}{i}" for i in range(n))
    long = words("w", 3000)
    rows = [(1, words("a", 60)), (2, words("a", 60)), (1, words("a", 60)), (1, words("b", 60)), (3, None), (4, ""), (5, "  \n"), (6, words("a", 58) + " x y"), (7, long), (8, long + " end"), (None, words("c", 30)), (9, words("q", 12) + " tail"), (10, "short")]
    schema = "doc_id long, text string, lang string, text_hash string, row string, kept string, maybe string, n int, key string"
    docs = spark.createDataFrame([(i, x, "l", "h", "r", "k", "m", 7, "y") for i, x in rows], schema).repartition(3)
    spark.createDataFrame([(i, 0) for i in range(1, 11)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, words("q", 12)), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return docs, f"file://{tmp_path}"


def test_stages_on_odd_rows(spark, tmp_path):
    docs, folder = _odd(spark, tmp_path)
    stages = dict(corpus_pipeline.STAGES)
    extra = ("l", "h", "r", "k", "m", 7, "y")
    ids = lambda df: sorted((r.doc_id or 0, len(r.text or "")) for r in df.collect())
    clean = stages["toxicity"](spark, docs, folder)
    assert clean.columns == docs.columns and ids(clean) == ids(docs)
    exact = stages["exact_dedup"](spark, docs, folder)
    assert exact.columns == docs.columns and {tuple(r)[2:] for r in exact.collect()} == {extra}
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id not in (None, 1)}
    # equal rows of document 1 are one, its other text is a document of its own; null and empty are equal, a blank isn't
    assert [i for i, _ in ids(exact)] == [1, 1, 3, 5, 6, 7, 8, 9, 10]
    near = stages["near_dedup"](spark, docs, folder)
    assert near.columns == docs.columns and [i for i, _ in ids(near)] == [1, 1, 3, 4, 5, 7, 9, 10] and len(texts[7]) < len(texts[8])
    left = stages["decontamination"](spark, docs, folder)
    assert left.columns == docs.columns and [i for i, _ in ids(left)] == [i for i, _ in ids(docs) if i != 9]
    pieces = stages["packing"](spark, docs, folder).collect()
    assert sum(1 for r in pieces if r.start == 0) == docs.count()
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), folder).count() == 0, name


def test_all_stages_on_odd_rows(spark, tmp_path):
    docs, folder = _odd(spark, tmp_path)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    pieces = corpus_pipeline.run(spark, folder).collect()
    assert sorted({r.doc_id for r in pieces}) == [1, 3, 5, 7, 10]
