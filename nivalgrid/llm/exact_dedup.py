"""Exact duplicates by a distributed content sort.

Rows are range-partitioned by Spark's sampled splitters on (text prefix, text hash,
salt), so that a splitter stays small however long the texts are, and sorted
externally on the whole normalised text. Equal texts are then neighbours; the
window compares each text with its neighbour in full and hands down the smallest
identifier. A text with more than 1/(4 x partitions) of all rows is split by a
hash of the identifier; its few sub-runs are compared again afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, partitions, stored, text_or_empty


def normalise(text: Column) -> Column:
    """Each run of ASCII white space becomes one space."""
    return F.regexp_replace(text, SPACES, " ")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = 64) -> DataFrame:
    """One row per input row: its group of equal normalised texts.

    Returns ``doc_id, keep_id, group_size, kept, text_sha256``. Null text is empty
    text; empty texts form a group. Null ids sort last and still count. Of repeated
    rows with the same id one is kept. Other columns are not read. An empty table
    gives an empty result.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), normalise(text_or_empty(text_col)).alias("norm"))
    rows = rows.withColumn("h", F.xxhash64("norm"))
    limit = max(1, docs.count() // (4 * n))
    # more than `limit` rows each, so at most 4n + 1 hashes: the bound of this broadcast
    hot = (rows.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit)
           .select("h", F.ceil(F.col("n") / limit).alias("salts")))
    rows = (rows.join(F.broadcast(hot), "h", "left")
            .withColumn("salt", F.when(F.col("salts").isNull(), -1)
                        .otherwise(F.pmod(F.xxhash64("doc_id"), F.col("salts"))).cast("int"))
            .withColumn("head", F.substring("norm", 1, prefix))
            .select("head", "h", "salt", "norm", "doc_id"))
    run = Window.partitionBy("head", "h", "salt", "norm").orderBy(F.col("doc_id").asc_nulls_last())
    whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    runs = (rows.repartitionByRange(n, "head", "h", "salt")
            .select("doc_id", "salt", "norm", F.row_number().over(run).alias("place"),
                    F.first("doc_id").over(whole).alias("first_id"), F.count(F.lit(1)).over(whole).alias("size"))
            .select("doc_id", "salt", "place", "first_id", "size", F.sha2(F.col("norm").cast("binary"), 256).alias("sha"),
                    F.when((F.col("salt") >= 0) & (F.col("place") == 1), F.col("norm")).alias("norm")))
    runs = stored(runs, "exact-runs")
    # one row per sub-run of a split text: no more than 8n + 2 rows
    parts = runs.where((F.col("salt") >= 0) & (F.col("place") == 1))
    best = F.min(F.struct(F.col("first_id").isNull(), F.col("first_id"), F.col("salt")))
    merged = (parts.groupBy("norm").agg(best.alias("best"), F.sum("size").alias("total"),
                                        F.collect_list(F.struct("sha", "salt")).alias("runs"))
              .select("best", "total", F.explode("runs").alias("r"))
              .select(F.col("r.sha").alias("sha"), F.col("r.salt").alias("salt"), F.col("best.first_id").alias("best_id"),
                      F.col("best.salt").alias("best_salt"), "total"))
    out = runs.drop("norm").join(F.broadcast(merged), ["sha", "salt"], "left")
    split = F.col("total").isNotNull()
    return out.select(
        "doc_id", F.when(split, F.col("best_id")).otherwise(F.col("first_id")).alias("keep_id"),
        F.coalesce("total", "size").alias("group_size"),
        ((F.col("place") == 1) & (~split | (F.col("salt") == F.col("best_salt")))).alias("kept"),
        F.col("sha").alias("text_sha256"))


ORACLE = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM n
"""
