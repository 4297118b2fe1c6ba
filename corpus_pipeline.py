"""From raw documents to packed training bins: quality, near duplicates, repeated passages, source mix, packing.

Each stage takes what the one before kept, written as Parquet and read again; all but the last return the columns of
``documents``. A null or wordless text doesn't pass the first stage, as it has no score; an empty table passes all.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shardlight.llm import minhash, mixing, packing, quality, repeats
from shardlight.llm.shared import written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on ``labels``, doesn't reject."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return minhash.keep_one(docs)


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one has too."""
    return repeats.keep_first(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source up to its share of the tokens."""
    return mixing.keep_mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(bin_id, doc_id, part, position, length) of every piece of every document."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [("quality", good), ("near_duplicates", distinct), ("repeats", unrepeated), ("mix", mixed), ("pack", packed)]
#: Scores and signatures have no SQL form; tests/llm/test_pipeline.py holds each stage against a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


QUERIES = {"pipeline": run}
