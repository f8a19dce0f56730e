"""The corpus pipeline: stages over ``documents``, each written and read again as the next one's input.

1. documents whose language cannot be told go;
2. of near-duplicates the document with the smallest id stays;
3. passages of 400 bytes or more that occur more than once go from the texts; documents stay, even if empty;
4. documents that hold a passage of a test item go;
5. the rest is encoded.

A stage sees the whole of what its predecessor kept. All but the last return the columns
of ``documents``; the last adds ids, n_tokens and round_trip, whether decoding gives the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm import bpe, decontaminate, language, simhash, suffix_dedup
from tidemark.session import cut


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.accepted(docs, label="lang", host="source")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    stripped = suffix_dedup.strip_text(docs)
    return stripped.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))


def test_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    coded = bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, decoded="__decoded")
    return coded.select(*docs.columns, "ids", bpe.n_tokens(F.col("ids")).alias("n_tokens"),
                        (F.col("__decoded") == F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("round_trip"))


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages),
          ("test_passages", test_passages), ("token_ids", token_ids)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, over the whole table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs


# Fingerprints, languages and tokens cannot be told in SQL.
ORACLE_SQL = None
QUERIES = {"pipeline": (run, ORACLE_SQL)}
