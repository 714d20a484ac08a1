"""Mixing sources to target weights by Pareto order sampling.

Sources share the words of the whole corpus by weight, capped at ``max_copies``
times their own words. A document first gets its certain whole copies; the rest of
the target is a sample with inclusion probability proportional to size (documents
that would exceed probability one are certain). Documents are ranked by their
random odds over their inclusion odds and taken in that order up to the target.
The decision for a row needs only a few numbers of its source, so no text moves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import CARRIED, SPACE_CHARS, carry, stored

BUCKETS = 4096


def word_count(text: Column) -> Column:
    """Number of runs of non-space characters; null counts as 0."""
    marks = F.regexp_replace(text, r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+", "x")
    return F.coalesce(F.length(F.translate(marks, SPACE_CHARS, "")), F.lit(0)).cast("bigint")


def unit_random(doc_id: Column, seed: str) -> Column:
    """A fixed number in (0, 1) per id."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":" + seed)).cast("binary"))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("bigint") + 0.5) / float(2 ** 48)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_copies: int = 3) -> DataFrame:
    """One row per source: ``source, source_size, target``.

    The windows run over one row per source, not per document.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    choice = F.element_at(F.array(*[F.lit(w) for w in weights]), ((place - 1) % len(weights) + 1).cast("int"))
    w = totals.withColumn("weight", choice.cast("bigint"))
    # sources whose cap is small for their weight fill up first; the others share what is left by weight
    order = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(every)
             - max_copies * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("weight").over(after)
    cap = max_copies * F.col("source_size")
    w = w.withColumn("level", level).withColumn("k", F.row_number().over(order))
    first_open = F.min(F.when(F.col("level") * F.col("weight") < cap, F.struct("k", "level")))
    w = w.withColumn("share", first_open.over(every).getField("level"))
    return w.select("source", "source_size", F.least(
        cap.cast("double"), F.coalesce(F.col("share") * F.col("weight"), cap.cast("double"))).alias("target"))


def _inclusion(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Adds per source: whole copies for all, the largest size below certainty, and the probability per word.

    The window runs over the distinct sizes of a source, bounded by the longest text.
    """
    t = targets.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
                           .otherwise(F.lit(0)).cast("bigint"))
    t = t.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    hist = (sizes.where(F.col("size") > 0).groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
            .join(t.select(F.col("source").alias("s"), "rest"), F.col("source").eqNullSafe(F.col("s"))))
    down = Window.partitionBy("source").orderBy(F.desc("size"))
    above = F.coalesce(F.sum(F.col("size") * F.col("n")).over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    squares = F.sum((F.col("size").cast("decimal(19,0)") * F.col("size").cast("decimal(9,0)") * F.col("n")).cast("decimal(38,0)")).over(
        down.rowsBetween(0, Window.unboundedFollowing)).cast("double")
    c = hist.withColumn("above", above).withColumn("rate", (F.col("rest") - F.col("above")) / squares)
    c = (c.where(F.col("rate") * F.col("size") < 1)
         .groupBy("source").agg(F.max(F.struct("size", "rate", "above")).alias("b"))
         .select(F.col("source").alias("s"), F.col("b.size").alias("top"),
                 F.greatest(F.col("b.rate"), F.lit(0.0)).alias("rate"),
                 (F.col("b.above")).alias("certain_words")))
    return (t.join(c, t["source"].eqNullSafe(c["s"]), "left").drop("s")
            .withColumn("rest", F.greatest(F.col("rest") - F.coalesce("certain_words", F.lit(0)), F.lit(0.0))))


def _pareto(size: Column, rate: Column, u: Column) -> Column:
    p = rate * size
    return F.when((p > 0) & (p < 1), (u / (1 - u)) / (p / (1 - p)))


def _boundary(ranked: DataFrame, level: int = 2) -> DataFrame:
    """Per source the last rank taken: ``s, cut, cut_id``; rows ``source, size, q, doc_id, rest``.

    Sums per bucket of rank find the bucket in which the target falls; only that
    bucket is looked at again, so a source that holds most rows is never sorted whole.
    """
    rows = ranked.withColumn("z", F.col("q") / (1 + F.col("q"))).withColumn("start", F.lit(0).cast("bigint"))
    for i in range(level):
        scaled = F.col("z") * float(BUCKETS)
        rows = rows.withColumn("b", F.least(F.floor(scaled), F.lit(BUCKETS - 1))).withColumn("z", scaled - F.col("b"))
        run = Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
        sums = (rows.groupBy("source", "b").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"),
                                                F.first("start").alias("start"))
                .withColumn("begin", F.col("start") + F.coalesce(F.sum("words").over(run), F.lit(0)))
                .where((F.col("begin") < F.col("rest")) & (F.col("begin") + F.col("words") >= F.col("rest")))
                .groupBy("source").agg(F.min(F.struct("b", "begin")).alias("m"))
                .select(F.col("source").alias("s"), F.col("m.b").alias("sb"), F.col("m.begin").alias("begin")))
        rows = (rows.join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("b") == F.col("sb")))
                .withColumn("start", F.col("begin")).drop("s", "sb", "begin", "b"))
    run = Window.partitionBy("source").orderBy("q", F.col("doc_id").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    cum = F.col("start") + F.coalesce(F.sum("size").over(run), F.lit(0))
    first_out = (rows.withColumn("cum", cum).where(F.col("cum") + F.col("size") / 2 > F.col("rest"))
                 .groupBy("source").agg(F.min(F.struct("q", F.col("doc_id").isNull().alias("none"), "doc_id")).alias("m")))
    # where every row of the bucket is taken, the next bucket begins above it
    edge = rows.groupBy("source").agg(F.max("q").alias("top_q")).select(F.col("source").alias("e"), "top_q")
    return (edge.join(first_out, F.col("source").eqNullSafe(F.col("e")), "left")
            .select(F.col("e").alias("s"), F.coalesce(F.col("m.q"), F.col("top_q") * (1 + 1e-15)).alias("cut"),
                    F.col("m.doc_id").alias("cut_id"), F.col("m.none").alias("cut_none")))


def mixing_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                weights: tuple[int, ...] = (1, 2, 3), max_copies: int = 3, seed: str = "mix") -> tuple[DataFrame, DataFrame]:
    """Sizes of all documents and, per source, the numbers that decide each document's copies."""
    sizes = stored(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
                               word_count(F.col(text_col)).alias("size")), "mix-sizes")
    plan = stored(_inclusion(sizes, source_targets(sizes, weights, max_copies)), "mix-plan")
    small = plan.select(F.col("source").alias("s"), "top", "rate", "rest")
    ranked = (sizes.join(small, sizes["source"].eqNullSafe(small["s"]))
              .where((F.col("size") > 0) & (F.col("size") <= F.col("top")))
              .withColumn("q", _pareto(F.col("size"), F.col("rate"), unit_random(F.col("doc_id"), seed)))
              .where(F.col("q").isNotNull() & (F.col("rest") > 0)).select("source", "size", "q", "doc_id", "rest"))
    cuts = _boundary(ranked)
    plan = stored(plan.join(cuts, plan["source"].eqNullSafe(cuts["s"]), "left").drop("s")
                  .withColumnRenamed("source", "_source"), "mix-cuts")
    return sizes, plan


def _copies(rows: DataFrame, plan: DataFrame, seed: str) -> DataFrame:
    """Adds ``_copies`` to rows with ``_id, _src, _size``."""
    out = rows.join(plan, rows["_src"].eqNullSafe(plan["_source"]))
    q = _pareto(F.col("_size"), F.col("rate"), unit_random(F.col("_id"), seed))
    before = (q < F.col("cut")) | ((q == F.col("cut")) & F.col("cut_id").isNotNull() & (F.col("_id") < F.col("cut_id"))) | (
        (q == F.col("cut")) & F.coalesce(F.col("cut_none"), F.lit(False)) & F.col("_id").isNotNull())
    certain = F.col("_size") > F.coalesce("top", F.lit(0))
    # with nothing certain and no rank to cut at, only the whole copies remain
    more = F.when(F.col("top").isNull(), 0).when(certain, 1).otherwise(F.coalesce(before, F.lit(False)).cast("int"))
    return out.withColumn("_copies", F.when(F.col("_size") > 0, F.col("whole") + more).otherwise(F.lit(0)).cast("bigint"))


def mix_decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                  weights: tuple[int, ...] = (1, 2, 3), max_copies: int = 3, seed: str = "mix") -> DataFrame:
    """One row per document: ``doc_id, source, size, source_size, target, copies, taken``.

    Null text has size 0 and is never taken; a null source is a source of its own,
    last in order. Repeated rows with one id share a decision. Empty tables give an
    empty result. Other columns are not read.
    """
    sizes, plan = mixing_plan(docs, id_col, text_col, source_col, weights, max_copies, seed)
    rows = sizes.select(F.col("doc_id").alias("_id"), F.col("source").alias("_src"), F.col("size").alias("_size"))
    return _copies(rows, plan, seed).select(
        F.col("_id").alias("doc_id"), F.col("_src").alias("source"), F.col("_size").alias("size"), "source_size", "target",
        F.col("_copies").alias("copies"), (F.col("_copies") * F.col("_size")).alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[int, ...] = (1, 2, 3), max_copies: int = 3, seed: str = "mix") -> DataFrame:
    """The mixed documents themselves, each repeated by its copies, with the input's columns."""
    _, plan = mixing_plan(docs, id_col, text_col, source_col, weights, max_copies, seed)
    packed, unpack = carry(docs, [])
    inside = lambda c: F.col(CARRIED)[f"c{docs.columns.index(c)}"]
    rows = packed.withColumns({"_id": inside(id_col), "_src": inside(source_col), "_size": word_count(inside(text_col))})
    plan = plan.select("_source", "whole", "top", "rate", "cut", "cut_id", "cut_none")
    out = _copies(rows, plan, seed).withColumn("_n", F.explode(F.array_repeat(F.lit(1), F.col("_copies").cast("int"))))
    return unpack(out)


ORACLE = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS weight FROM s),
l AS (SELECT *, row_number() OVER o AS k,
      ((sum(source_size) OVER ())::BIGINT - 3 * coalesce(sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)::DOUBLE
      / (sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
      FROM w WINDOW o AS (ORDER BY source_size::DOUBLE / weight, source NULLS LAST)),
g AS (SELECT *, (SELECT level FROM l WHERE level * weight < 3 * source_size ORDER BY k LIMIT 1) AS share FROM l),
t AS (SELECT source, source_size, least((3 * source_size)::DOUBLE, coalesce(share * weight, (3 * source_size)::DOUBLE)) AS target FROM g),
r AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
q AS (SELECT *, target - whole * source_size AS rest FROM r),
h AS (SELECT d.source, size, count(*) AS n, any_value(rest) AS rest FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source
      WHERE size > 0 GROUP BY d.source, size),
c AS (SELECT *, coalesce(sum(size * n) OVER (PARTITION BY source ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS above,
      (sum(size::HUGEINT * size * n) OVER (PARTITION BY source ORDER BY size DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS squares FROM h),
b AS (SELECT source, max({'size': size, 'rate': (rest - above) / squares, 'above': above}) AS b FROM c
      WHERE (rest - above) / squares * size < 1 GROUP BY source),
p AS (SELECT q.*, b.b.size AS top, greatest(b.b.rate, 0.0) AS rate, greatest(rest - coalesce(b.b.above, 0), 0.0) AS open_words
      FROM q LEFT JOIN b ON q.source IS NOT DISTINCT FROM b.source),
u AS (SELECT d.*, source_size, target, whole, top, open_words, rate * size AS pi,
      (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':mix'), 1, 12))::BIGINT + 0.5) / 281474976710656.0 AS u
      FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
v AS (SELECT *, CASE WHEN size > 0 AND size <= top AND pi > 0 AND pi < 1 THEN (u / (1 - u)) / (pi / (1 - pi)) END AS q FROM u),
x AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source, q IS NULL ORDER BY q, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cum FROM v)
SELECT doc_id, source, size, source_size, target,
       CASE WHEN size > 0 THEN whole + CASE WHEN top IS NULL THEN 0 WHEN size > top THEN 1
            WHEN q IS NOT NULL AND cum + size / 2.0 <= open_words THEN 1 ELSE 0 END ELSE 0 END::BIGINT AS copies,
       size * copies AS taken
FROM x
"""
