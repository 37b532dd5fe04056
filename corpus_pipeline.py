"""A corpus pipeline of five operators: quality rules, near-dedup, repeated passages, secrets, packing.

Each stage takes (spark, docs, sf_dir) and all that its predecessor kept; ``run`` writes every stage as Parquet in the
cluster's shared folder and reads it again, so that a lost executor never costs more than the stage it was in.

Nulls: a document without text fails the quality rules; without doc_id it links with nothing; a null source is an owner of
its own. Empty tables give empty results at every stage. Very long texts are worked on whole. Repeated rows of one id and
text are one document, so near_dedup keeps one of them; rows of one id that differ in text are documents of their own.
Ties fall to the least doc_id. Columns beside those of documents pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismet.llm import minhash, packing, quality, secrets, suffix_dedup
from prismet.llm._stage import scoped, stage


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the fixed rule and the learned decision list keep."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the least doc_id. Rows of one id are judged by their own texts."""
    return minhash.first_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, later copies of passages cut out of their texts."""
    out = suffix_dedup.remove_repeats(docs)
    return _counted(out).select(docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, live secrets cut out of their texts."""
    return _counted(secrets.redacted(docs)).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    import public_tokenizers

    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"))


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars follows the text."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("repeated_passages", repeated_passages), ("secret_scan", secret_scan), ("packing", pack)]

#: The learned rules, components of a graph and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, f in STAGES[:-1]:
        with scoped(spark) as folder:  # what the stage writes on its way goes when its result is written
            docs = stage(f(spark, docs, sf_dir), name, folder)
    return STAGES[-1][1](spark, docs, sf_dir)
