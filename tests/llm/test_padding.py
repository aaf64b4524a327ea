"""Padding of packed sequences doesn't depend on how the input is partitioned."""

import pytest
from pyspark.sql import functions as F

from apexlap.llm import packing, tokens


@pytest.mark.parametrize("partitions", [1, 50, 211])
def test_padding(spark, partitions):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(partitions)
    pieces = packing.pack_documents(docs, tokens.tokenizer_path("byte_bpe_50k.json"), keep_ids=False)
    r = pieces.agg(F.sum("length").alias("used"), F.countDistinct("sequence_id").alias("sequences")).first()
    assert r.used > 0.99 * 2048 * r.sequences
