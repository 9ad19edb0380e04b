"""A corpus pipeline of five stages over `documents`.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is
written (or checkpointed) and read again as the next one's docs. All stages but
the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.llm.common import cut
from spanforge.llm.langid import keep_identified, learn
from spanforge.llm.lines import dedup_lines
from spanforge.llm.packing import pack_documents
from spanforge.llm.passages import drop_passages
from spanforge.llm.simhash import similar_groups


def measured(docs: DataFrame) -> DataFrame:
    """n_chars as the text is now."""
    return docs.withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast("long")) if "n_chars" in docs.columns else docs


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; those without a letter go, and those of a posterior below one half."""
    return keep_identified(docs, learn(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three or more documents share stay in one of them. A document that loses all its lines stays, empty."""
    return measured(dedup_lines(docs).select(*docs.columns))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each group linked by 0.8 similar five-word shingles or more; rows without an id stay, and of several texts of one id each goes or stays by its own group."""
    lost = similar_groups(docs).where("doc_id <> component_id").select(F.col("doc_id").alias("id_"), F.col("sum").alias("sum_")).distinct()
    return docs.join(lost, (F.col("doc_id").cast("long") == F.col("id_")) & (F.xxhash64("text") == F.col("sum_")), "left_anti").select(*docs.columns)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that a document with a smaller doc_id holds as well are cut out."""
    return measured(drop_passages(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 4096 tokens."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language", language), ("lines", lines), ("near_copies", near_copies), ("passages", passages), ("packing", packing)]

#: No SQL can express the fitted language model, the fingerprints, the alignments and the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
