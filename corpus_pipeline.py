"""A corpus pipeline of five stages; each is written and read again before the next.

Every stage takes and returns whole rows of documents, with all their columns;
the last returns pieces of training sequences. Null and empty texts are clean
and not toxic, equal to each other for exact dedup, like nothing for near dedup,
and documents of the end id alone for packing. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from apexlap.llm.exact import exact_duplicates
from apexlap.llm.minhash import near_duplicates
from apexlap.llm.packing import pack_documents
from apexlap.llm.storage import among, written
from apexlap.llm.tokens import tokenizer_path
from apexlap.llm.toxicity import without_toxic
from apexlap.llm.wumanber import without_contaminated

#: No single statement can express the learnt first stage and the tokenizer.
ORACLE_SQL = None


def _kept(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """The rows of docs that decisions (doc_id, text_hash, kept) keep, with their columns.

    Rows without doc_id go. Rows that repeat a doc_id are told apart by their
    texts; of those that repeat the text too, one stays, whichever comes first.
    Rows travel as a struct, so that no column can clash. A filter of fixed size
    tells which rows are surely neither dropped nor repeated; they don't move.
    """
    key = ["doc_id", "text_hash"]
    told = decisions.groupBy(*key).agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    told = written(told.where("not kept or n > 1"), "decided")
    id_, hash_ = F.col("row.doc_id").cast("long"), F.xxhash64(F.col("row.text").cast("string"))
    rows = docs.select(F.struct("*").alias("row")).select("row", id_.alias("doc_id"), hash_.alias("text_hash")).where("doc_id is not null")
    rows = among(rows, F.xxhash64(*key), told.select(F.xxhash64(*key).alias("key")), "maybe")
    moved = rows.where("maybe").join(told.where("not kept").hint("shuffle_hash"), key, "left_anti").dropDuplicates(key)
    return rows.where("not maybe").select("row.*").unionByName(moved.select("row.*"))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't call toxic; rows without doc_id and repeated rows are judged like others."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return without_toxic(docs, labels, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of equal texts; rows without doc_id go."""
    return _kept(docs, exact_duplicates(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near duplicates (five words, 0.8); rows without doc_id go."""
    return _kept(docs, near_duplicates(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark; rows without doc_id and repeated rows are searched like others."""
    return without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences of 2048 tokens: one row for each piece of a document, repeated rows included."""
    return pack_documents(docs, tokenizer_path("byte_bpe_50k.json"), keep_ids=False).drop("ids")


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return written(STAGES[-1][1](spark, docs, sf_dir), f"stage-{STAGES[-1][0]}")
