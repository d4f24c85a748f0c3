"""From raw documents to shards of training data, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes each result
as Parquet to the session's shared folder and hands what it reads back to the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from walksieve.llm import language_id, leaks, mixing, near_copies, queries, ring
from walksieve.session import written


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without letters or in no language that the labelled rows have."""
    return language_id.only_known_languages(docs, language_id.fit(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, keep the document with the smallest id."""
    return near_copies.one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that contain a benchmark item."""
    return leaks.without_leaks(docs, queries.table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat documents so that sources reach their tempered weights; none is lost."""
    return mixing.mixed_documents(docs, queries.MIX)


def to_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Give every row its shard and its place in it."""
    return ring.placed(docs, queries.SHARDS)


STAGES = [
    ("language_id", keep_known_languages),
    ("simhash_near_dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("temperature_mixing", mix_sources),
    ("bounded_ring_sharding", to_shards),
]

#: A trained network decides the first stage, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of `sf_dir` through all stages."""
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
