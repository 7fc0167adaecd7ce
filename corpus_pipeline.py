"""A corpus pipeline over the documents table: each stage works on all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's docs. All but the last return the columns of documents, and any others that docs
has, whatever their names.

A null or empty text is a document without words: it is rated, one of all such texts stays, it is nobody's
near copy, holds no benchmark item and packs as a single end id. Repeated rows are equal texts. Null ids come
after all others where the largest or smallest id decides. An empty table passes as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajlake.llm import decontaminate, exact, jaccard, packing, quality
from trajlake.llm.common import documents, stored, work_path
from trajlake.llm.queries import ratings
from trajlake.llm.tokens import public_tokenizer


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the rated ones among them, does not reject."""
    return quality.keep_good(docs, ratings(spark, sf_dir))


def one_of_each_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id. The stream reads files, so ``docs`` is landed first."""
    landed = work_path(spark, "pipeline-landed")
    docs.write.option("compression", "zstd").parquet(landed)
    return exact.keep_one(spark, landed)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents that share 80 % of their five-word shingles, the smallest doc_id."""
    gone = stored(jaccard.near_duplicates(docs, words=5, percent=80).filter(~F.col("keep")).select(
        F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash")), "pipeline-near")
    if gone.count() <= jaccard.BROADCAST_ROWS:
        gone = F.broadcast(gone)
    text_hash = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    return docs.join(gone, (text_hash == gone["gone_hash"]) & docs["doc_id"].eqNullSafe(gone["gone_id"]), "left_anti")


def free_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 1024 ids: one row per piece of a document, with its ids' checksum."""
    return packing.pack_documents(docs, public_tokenizer("byte_bpe_50k.json"), payload=F.crc32("ids").alias("ids_crc32"))


STAGES = [
    ("quality", good_documents),
    ("exact_dedup", one_of_each_text),
    ("near_dedup", one_of_near_copies),
    ("decontamination", free_of_benchmark),
    ("packing", packed),
]

# Classifier and tokenizer have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the rows of the last."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
