"""A training-data pipeline of five stages over `documents`.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's documents. All but the last return the columns of `documents`; the last returns packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orderlens.llm import ngram_join, packing, quality_classifier, source_mixing, substring_dedup
from orderlens.llm.queries import TOKENIZER
from orderlens.llm.scratch import Scratch
from orderlens.session import ship


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    ship(spark)
    return quality_classifier.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    ship(spark)
    return ngram_join.drop_near_duplicates(docs)


def without_repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the long spans that they share."""
    ship(spark)
    return substring_dedup.remove_repeated_spans(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    ship(spark)
    return source_mixing.mixed_documents(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of tokens."""
    ship(spark)
    return packing.pack_documents(docs, TOKENIZER)


STAGES = [("quality classifier", good_documents), ("n-gram Jaccard join", one_of_each_group), ("substring dedup", without_repeated_spans), ("source mixing", mixed_sources), ("packing", packed_sequences)]

# The classifier's and the packer's results can't be expressed in SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(scratch.path(f"stage-{k}"))
            docs = spark.read.parquet(scratch.path(f"stage-{k}"))
            scratch.drop(f"stage-{k - 1}")
    return docs
