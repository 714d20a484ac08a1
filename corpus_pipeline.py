"""Corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

Every stage takes ``(spark, docs, sf_dir)`` and works on all that the one before it kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nivalgrid.llm import jaccard_join, line_dedup, mixing, piece_codec, quality_crf
from nivalgrid.llm.common import carry, documents, stored

KEEP_SCORE = 0.7


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores below ``KEEP_SCORE`` go; the held-out quarter of labels is not used."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    packed, unpack = carry(docs, ["doc_id", "text"])
    model = quality_crf.train_on(packed, labels, ~quality_crf.held_out(F.col("doc_id")))
    return unpack(quality_crf.quality_scores(packed, model).where(F.col("quality_score") >= KEEP_SCORE))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated multi-line chunks go, but for their first occurrence; a document of which nothing visible is left goes with them."""
    packed, unpack = carry(docs, ["doc_id", "text", "n_chars"])
    out = line_dedup.line_dedup(packed, carry=[c for c in packed.columns if c not in ("doc_id", "text", "n_chars")])
    out = out.where((F.col("removed_chunks") == 0) | F.col("text").rlike("[^\\x20\\x09-\\x0D]"))
    return unpack(out.withColumn("n_chars", F.length("text").cast("bigint")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles (Jaccard 0.8 or more) the smallest id stays; rows without id stay.

    Where an id repeats, rows equal in id and text count once, and its other texts stay with it.
    """
    groups = jaccard_join.similar_groups(docs, words=5, percent=80)
    first = groups.where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    kept = docs.join(first, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.unionByName(docs.where(F.col("doc_id").isNull())).select(*[F.col(f"`{c}`") for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every remaining text, and whether they decode to it."""
    return piece_codec.encode_decode(docs).select("doc_id", "pieces", "n_pieces", "n_bytes", "round_trip")


STAGES = [("quality", quality), ("line_dedup", lines), ("near_duplicates", near_duplicates), ("mix", mix), ("encode", encode)]

#: The first stage learns a model and cannot be stated in SQL; tests compare the run with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
