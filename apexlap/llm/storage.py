"""Intermediate tables in the folder that driver and executors share, and rows that scorers carry along."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from ..sources.staging import discard, shared_dir, written
from . import kernels as K

__all__ = ["among", "carried", "discard", "frequent", "joined", "key_filter", "may_hold", "row_and", "shared_dir", "small_batches", "uncarried", "written"]


def small_batches(spark: SparkSession) -> None:
    """Batches of some megabytes for Python workers, unless the session says otherwise: whole texts can be long."""
    key, usual = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"
    if spark.conf.get(key, usual) == usual:
        spark.conf.set(key, "4m")


#: A key with more than this share of all rows is frequent, so that there are fewer frequent keys than its inverse.
SHARE = 1 / 1000


def frequent(counts: DataFrame, key: list[str], n: str) -> DataFrame:
    """The keys with more than a thousandth of all rows. counts: one row for each key, with its rows in column n."""
    total = counts.agg(F.sum(n)).first()[0] or 0
    return counts.where(F.col(n) > SHARE * total).select(*key)


def joined(rows: DataFrame, facts: DataFrame, key: list[str], often: DataFrame, how: str = "inner") -> DataFrame:
    """rows with the one row of facts that their key has.

    Rows of a frequent key stay where they are and the facts of these keys, a
    thousand rows at most, are broadcast; only the other rows are shuffled.
    """
    hot = rows.join(F.broadcast(facts.join(F.broadcast(often), key, "left_semi")), key)
    rest = rows.join(F.broadcast(often), key, "left_anti").join(facts, key, how)
    return hot.unionByName(rest)


def carried(docs: DataFrame) -> DataFrame:
    """The whole row in one struct `row`, so that no column of the input can clash with a result's."""
    small_batches(docs.sparkSession)
    return docs.select(F.struct("*").alias("row"))


def row_and(docs: DataFrame, more: str) -> StructType:
    """The schema of a carried row and more columns."""
    return StructType([docs.select(F.struct("*").alias("row")).schema["row"], *StructType.fromDDL(more).fields])


def uncarried(scored: DataFrame) -> DataFrame:
    """The input's rows alone."""
    return scored.select("row.*")


#: Bits of a filter, whatever it holds, and how many each key sets.
FILTER_BITS, PROBES = 1 << 26, 3


def _bits(keys: np.ndarray) -> np.ndarray:
    """The bits of each 64-bit key, one row for each probe."""
    h = K.mix64(keys.view(K.U64) + K.U64(1))
    return np.stack([(h >> K.U64(19 * i)) & K.U64(FILTER_BITS - 1) for i in range(PROBES)]).astype(np.int64)


def _fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = np.zeros(FILTER_BITS, bool)
    for batch in batches:
        held[_bits(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)).ravel()] = True
    words = np.packbits(held, bitorder="little").view(np.int64)
    used = np.flatnonzero(words)
    for lo in range(0, len(used), 1 << 16):
        part = used[lo : lo + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(words[part])], ["word", "bits"])


def key_filter(keys: DataFrame) -> Broadcast:
    """What `may_hold` asks for the one column of keys, longs, in every worker: FILTER_BITS, eight megabytes however many they are."""
    found = keys.mapInArrow(_fill, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(FILTER_BITS // 64, np.int64)
    words[found["word"].to_numpy()] = found["bits"].to_numpy()
    return keys.sparkSession.sparkContext.broadcast(words)


def may_hold(held: Broadcast, keys: np.ndarray) -> np.ndarray:
    """True for every 64-bit key that the filter has, and for few others; for more and more of them when it has over a tenth of its bits."""
    at = _bits(keys)
    return ((held.value[at >> 6] >> (at & 63)) & 1).all(0)


def among(rows: DataFrame, key: Column, keys: DataFrame, mark: str | None = None) -> DataFrame:
    """The rows whose key, a long, can be among the one column of keys; or with mark all rows, with a boolean of that name.

    Rows which surely have no partner need not move for a join, and no row with
    a partner is missed. It never costs more than the pass of the rows.
    """
    small_batches(rows.sparkSession)
    held = key_filter(keys)

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maybe = pa.array(may_hold(held, batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False).astype(np.int64)))
            own, names = batch.columns[:-1], batch.schema.names[:-1]
            if mark:
                yield pa.RecordBatch.from_arrays([*own, maybe], [*names, mark])
            else:
                yield pa.RecordBatch.from_arrays(own, names).filter(maybe)

    schema = StructType([*rows.schema.fields, *([StructField(mark, BooleanType())] if mark else [])])
    return rows.select("*", key.alias("key__")).mapInArrow(test, schema)
