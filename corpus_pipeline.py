"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and gives a table that is written as Parquet and read again before the next stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from finality.llm import decontaminate, jaccard_join, language, packing, secret_links
from finality.llm.shared import small_batches, stored
from finality.session import ship

#: Packing can't be written in SQL; tests hold the rows against a plain version.
ORACLE_SQL = None


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language the models of the labelled documents recognise."""
    ship(spark)
    small_batches(spark)
    models = language.train(docs.select("doc_id", "text", "lang"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(12)) == 0)
    return language.accepted_only(docs, models)


def one_per_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies."""
    ship(spark)
    small_batches(spark)
    return jaccard_join.one_of_each(docs)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a passage close to a benchmark item."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def no_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Overwrites secrets in the texts."""
    return secret_links.without_secrets(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences of 2048 tokens."""
    ship(spark)
    small_batches(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, window=2048)


STAGES = [
    ("language", known_language),
    ("near copies", one_per_class),
    ("benchmark", no_benchmark),
    ("secrets", no_secrets),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
