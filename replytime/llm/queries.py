"""One query for each operator, over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (alignment, bpe, chat, collocations, html_text, langid, mixing, oracles, quality, sharding, shingle_join,
               toxicity, urlgraph, vector_join)
from .common import fold, small_batches, table
from .registry import query

VOCABULARY = "byte_bpe_50k.tiktoken"


def vocabulary_path() -> str:
    return public_tokenizers.path(VOCABULARY)


@query("op1_language_id")
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text, learned from the two folds that are not held out."""
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = fold(F.col("doc_id"), 3) == 1
    model = langid.train(docs.where(~held_out))
    found = langid.detector(docs, model)(F.col("text")).alias("found")
    return docs.select("doc_id", held_out.alias("held_out"), found).select("doc_id", "held_out", "found.*")


@query("op2_byte_bpe")
def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text and the bytes they decode to, as digests."""
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode_documents(docs, vocabulary_path(), public_tokenizers.PATTERN)
    return coded.select("doc_id", *bpe.digests(F.col("token_ids"), F.col("decoded")))


@query("op3_html_text")
def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    small_batches(spark)
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    texts = pages.select("page_id", "url", html_text.extract(F.col("html")).alias("text"))
    return texts.withColumn("n_chars", F.length("text").cast("long"))


#: Rules of the url query.
RULES = [urlgraph.Rule("net", "/", "block"), urlgraph.Rule("example.net", "/en/", "allow"),
         urlgraph.Rule("example.com", "/de/", "block"), urlgraph.Rule("org", "/fr/", "allow")]


@query("op4_url_filter", sql=oracles.url_filter(RULES))
def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every page's url: its rule's, else by trust over the host graph."""
    return urlgraph.judge(table(spark, sf_dir, "pages").select("page_id", "url", "html"), RULES)


@query("op5_shingle_join", sql=oracles.SHINGLE_JOIN)
def op5_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingle set size and link component of every document, by the exact metric join."""
    small_batches(spark)
    return shingle_join.shingle_join(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op6_toxicity")
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text, learned from the folds that are not held out."""
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.train(docs, labels.where(fold(F.col("doc_id"), 5) != 0))
    scored = docs.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"),
                         toxicity.scorer(docs, model)(F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


#: A conversation whose texts hold control strings.
CONTROL = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


@query("op7_chat_format", sql=oracles.CHAT_FORMAT)
def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations rendered, encoded and masked; turns and masked text read back as digests."""
    small_batches(spark)
    columns = ["conv_id", "turn", "role", "text"]
    rows = table(spark, sf_dir, "conversations").select(*columns)
    extra = spark.createDataFrame(CONTROL, "conv_id long, turn long, role string, text string")
    made = chat.format_conversations(rows.unionByName(extra), vocabulary_path(), public_tokenizers.PATTERN)
    return chat.read_back(made, vocabulary_path(), public_tokenizers.PATTERN).select(
        "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


@query("op8_source_mix")
def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document, and the shards of its copies."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "shards")


@query("op9_quality_rules")
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the compression verdict of every whole text."""
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.select("doc_id", quality.quality(F.col("text")).alias("q")).select("doc_id", "q.*")


@query("op10_vector_join", sql=oracles.VECTOR_JOIN)
def op10_vector_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, component and keeper of every embedding, by the exact metric range join within labels."""
    small_batches(spark)
    return vector_join.vector_join(table(spark, sf_dir, "embeddings"))


@query("op11_token_alignment")
def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links between two tokenizers' tokens of every whole text, with corpus counts of the links."""
    small_batches(spark)
    return alignment.align(table(spark, sf_dir, "documents").select("doc_id", "text"),
                           public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op12_phrase_collocations", sql=oracles.COLLOCATIONS)
def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest phrases of every language, by relational mining of all documents."""
    return collocations.collocations(table(spark, sf_dir, "documents").select("text", "lang"))


@query("op13_kd_shards")
def op13_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document, by a k-d tree whose 16 leaves hold near equal bytes."""
    return sharding.shard(table(spark, sf_dir, "documents"))
