"""Byte strings: what moves to find the first place of each distinct run."""

import random

import pyarrow as pa

from apexlap.llm import repeats, suffix

NAMES = repeats.PATHS.replace(",", "").split()[::2]
TEXT = "".join(random.Random(3).choices("abcdefgh ", k=100))


def batch(ids):
    runs = [[{"pos": 0, "run": 1, "anchor": 7}]] * len(ids)
    kind = pa.list_(pa.struct([("pos", pa.int64()), ("run", pa.int32()), ("anchor", pa.int64())]))
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array([0] * len(ids), pa.int32()), pa.array([TEXT] * len(ids)), pa.array(runs, kind)], ["doc_id", "slot", "text", "runs"])


def test_content_comes_with_the_least_row_of_a_task():
    rows = repeats._paths(repeats.Windows("byte", 100, 28), NAMES, False)(iter([batch([9, 5, 7]), batch([3, 4])]))
    assert [x["doc_id"] for b in rows for x in b.to_pylist() if x["content"] is not None] == [9, 5, 3]


def test_distinct_runs_from_rows_with_content(spark):
    docs = spark.createDataFrame([(i, TEXT * (1 + i % 3)) for i in (9, 5, 7, 3, 4, 8)], "doc_id long, text string").repartition(2)
    found = repeats.paths(repeats.numbered(docs), repeats.Windows("byte", 100, 28), within=True)
    names = ["anchor", "c1", "c2", "first_doc", "first_pos", "run", "content"]
    got, want = (sorted(map(tuple, x.select(names).collect())) for x in (repeats.distinct_paths(found), repeats.unique_paths(found)))
    assert got == want and len(got) > 1


def test_a_single_content_is_not_sorted(monkeypatch):
    monkeypatch.setattr(suffix, "suffix_array", None)
    columns = {"anchor": [1, 2], "c1": [3, 4], "c2": [5, 6], "first_doc": [7, 8], "first_pos": [9, 10], "run": pa.array([1, 2], pa.int32()), "content": [b"x" * 100, b"y" * 101]}
    (out,) = suffix._shard(100)(iter([pa.RecordBatch.from_pydict(columns)]))
    assert [x["firsts"] for x in out.to_pylist()] == [[{"d0": 0, "d1": 1, "first_doc": 7, "first_pos": 9}], [{"d0": 0, "d1": 2, "first_doc": 8, "first_pos": 10}]]
