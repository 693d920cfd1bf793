"""Training-data pipeline over the documents table: each stage works on what the one before kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and read again as the next
stage's documents.  All stages but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from replytime.llm import bpe, langid, mixing, quality, shingle_join
from replytime.llm.common import fold, free_name, small_batches, table
from replytime.llm.queries import vocabulary_path
from replytime.session import ensure_checkpoint_dir


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those with no letter or no clear language go.

    The model learns from the given documents that are not held out.
    """
    small_batches(spark)
    model = langid.train(docs.where(fold(F.col("doc_id"), 3) != 1))
    name = free_name(docs, "found")
    judged = docs.withColumn(name, langid.detector(docs, model)(F.col("text")))
    clear = (F.col(f"{name}.lang_pred") != langid.UNKNOWN) & (F.col(f"{name}.score") >= 0.5)
    return judged.where(clear).select(*docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base counts and lie inside the compression bands."""
    small_batches(spark)
    name = free_name(docs, "verdict")
    judged = docs.withColumn(name, quality.quality(F.col("text")))
    return judged.where(F.col(f"{name}.kept")).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of five-word shingle links (similarity 0.75 or more)."""
    small_batches(spark)
    return shingle_join.one_of_each(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents as often as their source's target asks, shuffled inside 16 shards."""
    row = free_name(docs, "row")
    packed = docs.select("doc_id", "source", "text", F.struct(*docs.columns).alias(row))
    return mixing.draw(mixing.mix(packed, keep=("doc_id", row))).select(f"{row}.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with their number and the hashes of ids and decoded bytes."""
    small_batches(spark)
    # smaller memos: the workers still hold what the earlier stages left
    coded = bpe.encode_documents(docs.select("doc_id", "text"), vocabulary_path(), public_tokenizers.PATTERN, memo=0.5)
    return coded.select("doc_id", "token_ids", *bpe.digests(F.col("token_ids"), F.col("decoded")))


STAGES = [("language_id", language), ("quality_rules", quality_rules), ("shingle_join", near_copies),
          ("source_mix", source_mix), ("byte_bpe", tokens)]

#: SQL can't state a trained classifier or zstandard ratios; tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again."""
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return docs
