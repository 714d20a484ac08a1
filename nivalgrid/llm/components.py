"""Connected components of a distributed link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(links: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """``node, component``: the smallest node reachable from each node that has a link.

    Alternates two rounds (every node's larger neighbours, then its smaller ones, are
    linked to the smallest), so that the number of rounds grows with the logarithm of the
    size. Each round is a table in the shared folder; only a count of changes reaches
    the driver. Nodes are bigint; null ends and self links are ignored.
    """
    now = stored(links.select(F.col(a).cast("bigint").alias("u"), F.col(b).cast("bigint").alias("v"))
                 .where(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v")))
                 .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = (both.join(low, F.col("u") == F.col("k")).where(F.col("v") > F.col("u"))
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        large = stored(large, "links-large")
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
        small = (large.join(low, F.col("u") == F.col("k"))
                 .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
                 .select("e.u", "e.v").where(F.col("u") != F.col("v")).distinct())
        small = stored(small, "links-small")
        if _same(now, small):
            break
        now = small
    else:
        raise RuntimeError(f"components did not settle within {most_rounds} rounds")
    star = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return star.unionByName(star.select(F.col("component").alias("node"), "component").distinct())


def _same(x: DataFrame, y: DataFrame) -> bool:
    digest = lambda t: t.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(digest(x)) == tuple(digest(y))
