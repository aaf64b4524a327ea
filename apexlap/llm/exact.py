"""Exact dedup by a tree merge of sorted digest runs.

Every input partition sorts its digests into one run. Runs have addresses,
at first the partitions' numbers, read as digits in base `fan_in`. In round r
the runs exchange rows so that digit r of a row's address becomes digit r of its
digest: sixteen runs meet, which is four binomial rounds in one. The receiver
merges what arrives in order of digest (Spark's sort merges the runs that it
spills) and one sweep over the merged run keeps, of each group of equal digests
whose size and second hash agree too, the smallest doc_id and the number of
rows. After all rounds equal digests have met. However often a text occurs, a
merge receives one row of it from each run, and its rows learn of the result
through a broadcast of the few groups with over a thousandth of all rows.

Equality is that of SHA-256, size and a second, independent hash of the text
after replacing each run of white space by one space. Null counts as empty.
Rows without doc_id are left out; rows that repeat a doc_id are decided by their
own texts, one row each, and of equal rows all share one decision. An empty
table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import frequent, joined, written

KEY = ["digest", "size", "check"]
RUN = "address long, digest binary, size int, check long, keep_id long, group_size long"


def normalised(text: str = "text"):
    return F.regexp_replace(F.coalesce(F.col(text).cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each group of a merged run, which comes in order; a batch's last group waits for the next batch."""
    held = None
    for batch in batches:
        batch = pa.RecordBatch.from_arrays(batch.columns, batch.schema.names)
        table = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
        if not len(table):
            continue
        address, size, check, count = (table[c].to_numpy() for c in ("address", "size", "check", "group_size"))
        digest = np.array(table["digest"].to_pylist(), "S32")
        digest = np.frombuffer(digest.tobytes(), np.uint64).reshape(-1, 4)
        new = np.ones(len(table), bool)
        new[1:] = (address[1:] != address[:-1]) | (size[1:] != size[:-1]) | (check[1:] != check[:-1]) | (digest[1:] != digest[:-1]).any(1)
        heads = np.flatnonzero(new)
        out = table.take(pa.array(heads)).set_column(5, "group_size", pa.array(np.add.reduceat(count, heads)))
        out = out.combine_chunks().to_batches()[0]
        yield out.slice(0, len(out) - 1)
        held = out.slice(len(out) - 1)
    if held is not None:
        yield held


def _merged(runs: DataFrame) -> DataFrame:
    """Each address's rows in order of digest, one row for each group."""
    return runs.sortWithinPartitions("address", *KEY, "keep_id").mapInArrow(_merge, RUN)


def exact_duplicates(docs: DataFrame, fan_in: int = 16) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, text_hash: one row for each document.

    text_hash: xxhash64 of the text as it is, which tells rows of one doc_id apart.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"), normalised().alias("text")).where("doc_id is not null")
    digests = written(texts.select("doc_id", "text_hash", F.spark_partition_id().cast("long").alias("address"), F.unhex(F.sha2("text", 256)).alias("digest"), F.octet_length("text").alias("size"), F.xxhash64("text").alias("check")), "digests")
    top, rounds = int(digests.agg(F.max("address")).first()[0] or 0), 1
    while fan_in**rounds <= top:
        rounds += 1
    runs = _merged(digests.select("address", *KEY, F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size")))
    for r in range(rounds):
        low, high = fan_in**r, fan_in ** (r + 1)
        address = f"address - (address % {high} - address % {low}) + {low} * pmod(shiftright(check, {8 * (r % 7)}), {fan_in})"
        runs = _merged(runs.withColumn("address", F.expr(address)).repartition("address"))
    kept = (F.col("doc_id") == F.col("keep_id")).alias("kept")
    groups = written(runs.drop("address"), "groups")
    decided = joined(digests.select("doc_id", "text_hash", *KEY), groups, KEY, frequent(groups, KEY, "group_size"))
    return decided.select("doc_id", "keep_id", "group_size", kept, F.lower(F.hex("digest")).alias("text_sha256"), "text_hash")
