"""Token counts through a digest cache.

The cache is a Parquet table (version, digest, n_tokens): version is the digest
of the tokenizer's file and library, digest that of the normalised text (runs
of ASCII white space as one space) where the tokenizer itself reads those alike,
else that of the text. Digests go first: they are joined to the cache, and of
those that miss, one row each lends its text. A filter of fixed size keeps texts
of other rows where they are, but for the few that it can't tell apart; the
others move, are joined to the misses and encoded, and their counts are
appended. Where nothing misses, no text moves. A text that makes up a third of the rows costs one row a task, and its rows get their
count through a broadcast of the few digests with over a thousandth of all rows.

Null counts as empty and has no tokens. Rows without doc_id are counted too;
repeated rows give repeated results. An empty table gives an empty result. Extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from . import tokens
from .exact import normalised
from .storage import among, discard, frequent, joined, shared_dir, small_batches, written

CACHE = "version string, digest binary, n_tokens long"


def version_of(path: str) -> str:
    import tokenizers

    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + tokenizers.__version__.encode()).hexdigest()


def _encode(path: str):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()  # equal rows of one doc_id, or of none, come once a task
        for batch in batches:
            new = []
            for i, digest in enumerate(batch.column(0).to_pylist()):
                if digest not in seen:
                    new.append(i)
                    seen.add(digest)
            if len(seen) > 1_000_000:
                seen.clear()
            batch = batch.take(pa.array(new, pa.int64()))
            text = batch.column(1)
            _, offsets = K.text_column(batch, "text")
            for lo, hi in K.slices(offsets, 1 << 22):
                n = tokens.counts(path, [x or "" for x in text[lo:hi].to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array(n, pa.int64())], ["digest", "n_tokens"])

    return rows


def count_tokens(docs: DataFrame, path: str, cache: str | None = None, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each document.

    path: the tokenizer's file; cache: where counts are kept between calls (a
    new table in the shared folder if None).
    """
    spark = docs.sparkSession
    small_batches(spark)
    cache = cache or f"{shared_dir(spark)}/token-counts-{uuid.uuid4().hex}"
    version = version_of(path)
    spark.createDataFrame([], CACHE).write.mode("append").parquet(cache)

    def stored() -> DataFrame:
        return spark.read.schema(CACHE).parquet(cache).where(F.col("version") == version)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.withColumn("text_hash", F.xxhash64("text"))
    read_as = normalised() if tokens.folds_space(path) else F.coalesce("text", F.lit(""))
    rows = written(texts.select("doc_id", "text_hash", F.unhex(F.sha2(read_as, 256)).alias("digest"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")), "digests")
    groups = written(rows.groupBy("digest").agg(F.min(F.struct("doc_id", "text_hash")).alias("of"), F.count(F.lit(1)).alias("n")), "groups")
    lenders = groups.join(stored().select("digest"), "digest", "left_anti")
    misses = written(lenders.select("digest", F.coalesce("of.doc_id", F.lit(-1)).alias("id"), F.col("of.text_hash").alias("hash")), "misses")
    if not misses.isEmpty():
        keyed = texts.select("text", F.coalesce("doc_id", F.lit(-1)).alias("id"), F.col("text_hash").alias("hash"))
        keyed = among(keyed, F.xxhash64("id", "hash"), misses.select(F.xxhash64("id", "hash").alias("key")))
        counted = keyed.join(misses.hint("shuffle_hash"), ["id", "hash"]).select("digest", "text").mapInArrow(_encode(path), "digest binary, n_tokens long")
        counted.select(F.lit(version).alias("version"), "digest", "n_tokens").dropDuplicates(["digest"]).write.mode("append").parquet(cache)
    discard(misses)
    known = stored().groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    counted = joined(rows, known, ["digest"], frequent(groups, ["digest"], "n"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
