"""Target-distribution importance resampling over hashed n-grams.

Words of whole texts, A-Z lower-cased, make features of one or more consecutive
words joined by one space; a feature's bucket is the CRC-32 of its bytes modulo
the number of buckets (`crc`). Two tables of bucket counts, of the target and of
all documents, give each bucket a gain in thousandths of a nat. A document
weighs the sum of its features' gains; weight and a Gumbel value from a hash of
its doc_id make its score, and the highest scores are drawn, which draws without
replacement in proportion to the importance weights.

Tasks add up their own bucket counts, so a table of at most BUCKETS rows a task
is shuffled; the gains, at most BUCKETS numbers, go to the tasks with the code.
Texts are read twice and never shuffled. Ranks come from a range partitioning by
score: the place in a sorted partition and the sizes of those before it.

A null text has no words. A document without doc_id is hashed as if its id were
empty and comes behind others of its score; rows that repeat a doc_id are
documents of their own and tie in the order of a hash of their texts. An empty
table gives an empty result, an empty target has no feature in any bucket. Extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .crc import crc32_spans
from .storage import discard, small_batches, written

#: The most buckets whose counts and gains are held by the driver and each task.
BUCKETS = 1 << 20


def feature_buckets(data: np.ndarray, offsets: np.ndarray, grams: tuple[int, int], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bucket of each feature, the text each is of, and how many words each text has."""
    data = K.LOWER[data]
    starts, ends, rows = K.words(data, offsets, K.ALNUM_WORDS)
    n_words = np.diff(rows)
    text = np.repeat(np.arange(len(n_words)), n_words)
    if grams == (1, 1):
        return crc32_spans(data, starts, ends) % np.uint32(buckets), text, n_words
    joined, begin = K.joined_words(data, starts, ends)
    found, of, stop = [], [], np.repeat(rows[1:], n_words)
    for n in range(grams[0], grams[1] + 1):
        i = np.flatnonzero(np.arange(len(starts)) + n <= stop)
        found.append(crc32_spans(joined, begin[i], begin[i + n] - 1) % np.uint32(buckets))
        of.append(text[i])
    return np.concatenate(found), np.concatenate(of), n_words


def _counted(grams: tuple[int, int], buckets: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, data, offsets in K.text_slices(batch, "text", 1 << 21):
                total += np.bincount(feature_buckets(data, offsets, grams, buckets)[0], minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    return rows


def bucket_counts(docs: DataFrame, grams: tuple[int, int] = (1, 1), buckets: int = 10_000) -> DataFrame:
    """bucket, n: the features of all whole texts by bucket; buckets without any are left out."""
    small_batches(docs.sparkSession)
    parts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_counted(grams, buckets), "bucket long, n long")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(source: DataFrame, target: DataFrame, buckets: int = 10_000) -> DataFrame:
    """bucket, gain of every bucket: floor(1000 ln) of its share in the target over its share in the source, each count plus one."""
    totals = [df.agg(F.sum("n")).first()[0] or 0 for df in (source, target)]
    b = source.sparkSession.range(buckets).select(F.col("id").alias("bucket"))
    both = b.join(source.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left")
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double") + 1.0
    ratio = count("t") * F.lit(float(totals[0] + buckets)) / (count("s") * F.lit(float(totals[1] + buckets)))
    return both.select("bucket", F.floor(1000.0 * F.ln(ratio)).cast("long").alias("gain"))


def _weighed(grams: tuple[int, int], gains: np.ndarray):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, features, weights = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for lo, hi, data, offsets in K.text_slices(batch, "text", 1 << 21):
                bucket, text, n[lo:hi] = feature_buckets(data, offsets, grams, len(gains))
                features[lo:hi] = np.bincount(text, minlength=hi - lo)
                np.add.at(weights[lo:hi], text, gains[bucket])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, (n, features, weights))], ["doc_id", "text_hash", "n_words", "n_features", "weight"])

    return rows


def ranked(rows: DataFrame, by: list, partitions: int) -> DataFrame:
    """rows with rank 1, 2, 3, ... in the order `by`; equal rows take any of their ranks.

    Ranges of the order are sorted apart and numbered from the sizes of the
    ranges before, one number for each of `partitions`.
    """
    placed = rows.repartitionByRange(partitions, *by).sortWithinPartitions(*by).withColumn("place", F.monotonically_increasing_id())
    placed = written(placed, "ranges")
    part = F.shiftright("place", 33)
    sizes = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(F.broadcast(sizes), part == sizes.part).withColumn("rank", F.col("before") + inside + 1).drop("place", "part", "before")


def importance_resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, seed: str = "2024", grams: tuple[int, int] = (1, 1), buckets: int = 10_000) -> DataFrame:
    """doc_id, text_hash, n_words, n_features, weight, score, rank of every document; rank is null for those not drawn.

    Of the documents with least_words words the percent with the highest scores are drawn.
    """
    if not 0 < buckets <= BUCKETS:
        raise ValueError(f"buckets must be 1 to {BUCKETS}")
    spark = docs.sparkSession
    small_batches(spark)
    counts = [written(bucket_counts(df, grams, buckets), "buckets") for df in (docs, target)]
    gains = np.zeros(buckets, np.int64)
    for r in bucket_gains(*counts, buckets).collect():  # one row for each bucket
        gains[r.bucket] = r.gain
    discard(*counts)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"), F.col("text").cast("string").alias("text"))
    weighed = texts.mapInArrow(_weighed(grams, gains), "doc_id long, text_hash long, n_words long, n_features long, weight long")
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    luck = F.floor(-1000.0 * F.ln(-F.ln((h + 0.5) / 4294967296.0))).cast("long")
    scored = written(weighed.withColumn("score", F.col("weight") + luck), "scored")
    able = scored.where(F.col("n_words") >= least_words)
    n = able.count()
    drawn = n * percent // 100
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("text_hash")]
    able = ranked(able, order, int(spark.conf.get("spark.sql.shuffle.partitions"))).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return able.unionByName(scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")))
