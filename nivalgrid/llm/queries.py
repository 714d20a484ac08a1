"""Registered queries of the text operators; SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, grid_join, jaccard_join, line_dedup, mixing, piece_codec, quality_crf, ranked_search, secret_scan, sharding
from . import suffix_dedup, toxicity, zone_clustering
from .common import documents


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(documents(spark, sf_dir))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_report(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = piece_codec.encode_decode(documents(spark, sf_dir))
    return out.select("doc_id", "pieces", "n_pieces", "n_bytes", "round_trip",
                      F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_chunks", "removed_chunks", "removed_lines",
                      F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_report(documents(spark, sf_dir))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_groups(documents(spark, sf_dir), words=4, percent=85)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_decisions(documents(spark, sf_dir))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_crf.quality_report(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_embedding_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid_join.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(documents(spark, sf_dir), shards=40)


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zone_clustering.zone_clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.ranked_search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {f.__name__: f for f in (
    op1_suffix_dedup, op2_exact_dedup, op3_toxicity, op4_sentencepiece, op5_line_dedup, op6_secrets, op7_ngram_jaccard, op8_mixing, op9_quality, op10_embedding_near,
    op11_sharding, op12_centroid_clusters, op13_ranked_search)}
ORACLES = {"op2_exact_dedup": exact_dedup.ORACLE, "op5_line_dedup": line_dedup.ORACLE, "op8_mixing": mixing.ORACLE,
           "op12_centroid_clusters": zone_clustering.ORACLE, "op13_ranked_search": ranked_search.ORACLE}
