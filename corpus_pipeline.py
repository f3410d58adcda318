"""From raw documents to packed training sequences: rules, language, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written as Parquet and read again as the next stage's docs. All
but the last return rows of `documents` with all their columns, whatever other columns the table has and however they are named.

Defined results: a null or empty text fails the rules and goes; a null language is one of its own for the rules and no example for the
language model. Of repeated rows one stays, of rows that share an id and differ in text each is a document of its own; rows with a
null id are linked with nothing and stay. Ties go to the smallest id. An empty table gives empty tables at each stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sweeplog.llm import language_id, minhash_dedup, packing, quality_rules
from sweeplog.llm.frames import fold, small_batches
from sweeplog.session import materialize

# The rules and models of the stages are not expressible in SQL; tests/llm compares them with plain versions.
ORACLE_SQL = None


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    small_batches(spark)
    return quality_rules.keep_good(docs)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with enough certainty."""
    small_batches(spark)
    return language_id.keep_identified(docs, language_id.fit(docs, fold(docs["doc_id"], 4) != 2))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group linked by 0.8 or more of their five-word shingles."""
    small_batches(spark)
    return minhash_dedup.keep_first(docs, size=5, threshold=80)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document's ids with its place in a sequence of 4096."""
    small_batches(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), 2, bare=True)


STAGES = [("quality rules", rules), ("language ID", language), ("MinHash near-dedup", near_duplicates), ("packing", sequences)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, "stage")
    return docs
