"""One registered query per operator, with its production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from walksieve.llm import (hard_negatives, language_id, leaks, mixing, multiprobe, packing, pii, repair, ring, separators, simhash, url_filter,
                           whitening)
from walksieve.session import scratch_path

SHARDS = 40
MIX = mixing.Target(repetitions=2.0)
FLAT_END = 50256
RULES = [url_filter.Rule(v, t) for v, t in (
    ("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.languages(docs, language_id.fit(docs))


def op2_repair_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-shards")
    repair.write_shards(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return repair.read_shards(spark, path)


def op3_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents"), MIX)


def op4_bounded_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ring.shards(table(spark, sf_dir, "documents"), SHARDS)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = spark.createDataFrame(url_filter.LABELLED, "url string, unwanted int")
    return url_filter.judged(table(spark, sf_dir, "pages"), RULES, url_filter.fit(labelled))


def op6_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "flat-tokens")
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    separators.write_flat(table(spark, sf_dir, "documents"), path, ranks, public_tokenizers.PATTERN, FLAT_END)
    return separators.token_counts(spark.read.parquet(path), FLAT_END)


def op7_multiprobe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiprobe.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.personal_data(table(spark, sf_dir, "documents")))


def op11_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-blocks")
    packing.tokens_of(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return packing.digest(packing.pack(spark, path))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.by_component(whitening.whitened(table(spark, sf_dir, "embeddings")))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_language_id, op2_repair_shards, op3_temperature_mixing, op4_bounded_ring, op5_url_filter,
                            op6_separator_scan, op7_multiprobe, op8_simhash, op9_leaks, op10_pii, op11_mixture_packing, op12_whitening,
                            op13_hard_negatives)}

_SHINGLED = """
    SELECT r, {key}, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) <= 5 THEN [array_to_string(w, ' ')]
           ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END) AS s
    FROM (SELECT row_number() OVER () AS r, {key}, list_filter(string_split_regex(
              translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
          FROM {table})"""

#: Exact containment and exact scores can be said in SQL; the others rest on XXH64, tokenizers or trained models.
SQL: dict[str, str] = {"op9_leaks": f"""
    WITH d AS ({_SHINGLED.format(key="doc_id", table="documents")}), i AS ({_SHINGLED.format(key="item_id", table="benchmark")}),
         n AS (SELECT r, count(*) AS n FROM i GROUP BY r)
    SELECT item_id, doc_id, count(*) AS shared, any_value(n) AS item_shingles, count(*) / any_value(n) AS containment
    FROM d JOIN i USING (s) JOIN n ON n.r = i.r GROUP BY i.r, item_id, d.r, doc_id HAVING count(*) >= 0.8::DOUBLE * any_value(n)""",
    "op13_hard_negatives": """
    WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                      list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
               FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
               AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
         s AS (SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS alike, list_dot_product(a.v, r.v)::BIGINT AS score
               FROM r AS a JOIN r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0),
         p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE alike
               QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
         n AS (SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
                      vec_id AS negative_id, positive_score, score AS negative_score
               FROM p JOIN s USING (anchor_id) WHERE NOT alike AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
    SELECT * FROM n WHERE rank <= 10"""}
