"""The queries of this subpackage: each applies one operator to its whole table and derives the stated columns."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, common, exact_dedup, lang_id, negatives, neighbours, packing, passages, phrases, repeats, simhash, simple8b, topk, toxicity


def op1_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.shared_passages(common.documents(spark, sf_dir), min_words=50, min_identity=0.8)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(common.documents(spark, sf_dir), shingle=3, distance=3, seed=42)


def op3_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.identify(common.documents(spark, sf_dir))


def op4_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = simple8b.write_ids(common.documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return simple8b.read_ids(segments)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.detect(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=20, scale=64, every=20)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(common.documents(spark, sf_dir), keep="largest")


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(common.documents(spark, sf_dir), length=200)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(common.documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), end_id=2, size=4096)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(common.documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(rows.withColumn("label", moved), positives=5, negatives=3, low=50, high=95, scale=256, every=50)


def op12_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=20, every=20)


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(common.documents(spark, sf_dir), longest=3, threshold=10, share=50, top=2000)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_passages, op2_simhash, op3_lang_id, op4_simple8b, op5_toxicity, op6_topk, op7_exact_dedup, op8_repeats, op9_packing, op10_byte_bpe, op11_negatives, op12_neighbours, op13_phrases)}
