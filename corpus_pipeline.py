"""A corpus from raw documents to packed training sequences, as stages that each call one operator of lodestone.llm.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before it kept, and all but the last return
the columns of documents; the last returns the places of the pieces. Every stage's output is written as Parquet and
read again before the next.

Defined cases: stages decide by row, never by id: rows that share an id but not the text live or go on their own, and
rows with null id are treated by their text. Null text is rejected by the first stage. Extra columns come through all
stages but the last. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import decontamination, exact_dedup, language_id, near_dedup, packing
from lodestone.llm.common import materialize
from lodestone.llm.queries import crc_mod, tokenizer_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text a language model accepts."""
    model = language_id.train(docs, learn=crc_mod(3) != 1)
    return language_id.accepted(docs, model)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row, that of the largest id; repeated rows leave one, null counts as empty text."""
    return exact_dedup.unique_rows(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates (five words, 80 %) one row, that of the smallest id; null ids go last."""
    return near_dedup.representatives(docs, shingle=5, percent=80)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of ten words of a benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.uncontaminated(docs, benchmark, window=10)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in sequences of 4096 tokens."""
    return packing.pack_documents(docs, tokenizer_path(), capacity=4096, end_id=1)


STAGES = [("language", language), ("exact", exact), ("near", near), ("decontaminated", decontaminated), ("packed", packed)]

#: Language models and a tokenizer are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
