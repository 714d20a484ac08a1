"""Joins and set relations between sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scale import unique_rows


def pair(reference: DataFrame, model: DataFrame, keys: Sequence[str], columns: Sequence[str],
         suffixes: tuple[str, str] = ("_i", "_n")) -> DataFrame:
    """Inner join of two sources with suffixed columns."""
    a = reference.select(*keys, *[F.col(c).alias(c + suffixes[0]) for c in columns])
    b = model.select(*keys, *[F.col(c).alias(c + suffixes[1]) for c in columns])
    return a.join(b, list(keys))


def pair_long(df: DataFrame, keys: Sequence[str], columns: Sequence[str], reference: str = "I",
              model: str = "N", source: str = "source", cluster_by: Sequence[str] | None = None,
              suffixes: tuple[str, str] = ("_i", "_n")) -> DataFrame:
    """Pair two sources that live in one long table, without a self join.

    One aggregation turns the two rows of a key into one. With ``cluster_by`` (a
    subset of ``keys``) rows are shuffled on it once, and later windows on the
    same columns reuse that partitioning.
    """
    keys = list(keys)
    rows = df.where(F.col(source).isin(reference, model))
    if cluster_by:
        rows = rows.repartition(*cluster_by)
    is_ref, is_mod = F.col(source) == reference, F.col(source) == model
    aggs = []
    for c in columns:
        aggs += [F.max(F.when(is_ref, F.col(c))).alias(c + suffixes[0]),
                 F.max(F.when(is_mod, F.col(c))).alias(c + suffixes[1])]
    return (rows.groupBy(*keys).agg(*aggs, F.count_if(is_ref).alias("_r"), F.count_if(is_mod).alias("_m"))
            .where((F.col("_r") > 0) & (F.col("_m") > 0)).drop("_r", "_m"))


def alignment_report(reference: DataFrame, model: DataFrame, date: str = "date",
                     by: Sequence[str] = ()) -> DataFrame:
    """Counts of dates on each side, common and exclusive, with first/last common."""
    by = list(by)
    tagged = (reference.select(*by, date).withColumn("_r", F.lit(1)).withColumn("_m", F.lit(0))
              .unionByName(model.select(*by, date).withColumn("_r", F.lit(0)).withColumn("_m", F.lit(1))))
    dates = tagged.groupBy(*by, date).agg(F.max("_r").alias("r"), F.max("_m").alias("m"))
    both = (F.col("r") == 1) & (F.col("m") == 1)
    return dates.groupBy(*by).agg(
        F.sum("r").alias("reference_date_count"), F.sum("m").alias("model_date_count"),
        F.count_if(both).alias("common_date_count"),
        F.count_if((F.col("r") == 1) & (F.col("m") == 0)).alias("reference_only_count"),
        F.count_if((F.col("r") == 0) & (F.col("m") == 1)).alias("model_only_count"),
        F.min(F.when(both, F.col(date))).alias("first_common_date"),
        F.max(F.when(both, F.col(date))).alias("last_common_date"))


def fill_gaps(observed: DataFrame, replacement: DataFrame, keys: Sequence[str], column: str,
              replacement_column: str, label: str = "model nearest cell") -> DataFrame:
    """Fill missing observations from a second source and record where each value came from."""
    other = replacement.select(*keys, F.col(replacement_column).alias("_fill"))
    o, r = F.col(column), F.col("_fill")
    return (observed.join(other, list(keys), "left")
            .withColumn(f"{column}_gapfilled", F.coalesce(o, r))
            .withColumn(f"{column}_gapfill_source",
                        F.when(o.isNotNull(), "observed").when(r.isNotNull(), label).otherwise("missing"))
            .drop("_fill"))


def gap_log(filled: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Rows whose observation was missing."""
    return filled.where(F.col(column).isNull()).select(
        *keys, f"{column}_gapfilled", f"{column}_gapfill_source")


def join_three(a: DataFrame, b: DataFrame, c: DataFrame, key: str = "date") -> DataFrame:
    return a.join(b, key, "full").join(c, key, "full")


def one_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner",
               context: str = "one-to-one join") -> DataFrame:
    """Join that fails when a key repeats on either side."""
    return unique_rows(left, keys, f"{context} (left)").join(
        unique_rows(right, keys, f"{context} (right)"), list(keys), how)


def key_difference(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys on one side only, with the side that has them. One shuffle of distinct keys."""
    keys = list(keys)
    tagged = (left.select(*keys).withColumn("_side", F.lit(1))
              .unionByName(right.select(*keys).withColumn("_side", F.lit(2))))
    sides = tagged.groupBy(*keys).agg(F.min("_side").alias("_lo"), F.max("_side").alias("_hi"))
    return sides.where(F.col("_lo") == F.col("_hi")).select(
        *keys, F.when(F.col("_lo") == 1, "left_only").otherwise("right_only").alias("side"))


def missing_keys(expected: DataFrame, actual: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Expected keys without data."""
    return expected.join(actual.select(*keys), list(keys), "left_anti")


def require_coverage(expected: DataFrame, actual: DataFrame, keys: Sequence[str],
                     policy: str = "error") -> DataFrame:
    """Rows of ``actual`` for the expected keys; ``error`` fails on a missing one."""
    keys = list(keys)
    marked = expected.select(*keys).join(actual.withColumn("_there", F.lit(True)), keys,
                                         "left" if policy == "error" else "inner")
    if policy not in ("error", "warn-skip"):
        raise ValueError("policy must be 'error' or 'warn-skip'")
    there = F.when(F.col("_there"), True).otherwise(
        F.raise_error(F.concat(F.lit("missing input for "), F.to_json(F.struct(*keys)))).cast("boolean"))
    return marked.where(there).drop("_there")


def same_day_years(df: DataFrame, keys: Sequence[str], columns: Sequence[str], first: int, second: int,
                   day: str = "season_day", wy: str = "water_year") -> DataFrame:
    """Two years side by side on the season day, with their difference; no self join."""
    keys = list(keys)
    rows = df.where(F.col(wy).isin(first, second))
    a, b = F.col(wy) == first, F.col(wy) == second
    aggs = [F.count_if(a).alias("_a"), F.count_if(b).alias("_b")]
    for c in columns:
        aggs += [F.max(F.when(a, F.col(c))).alias(f"{c}_first"), F.max(F.when(b, F.col(c))).alias(f"{c}_second")]
    out = rows.groupBy(*keys, day).agg(*aggs).where((F.col("_a") > 0) & (F.col("_b") > 0)).drop("_a", "_b")
    return out.withColumns({f"delta_{c}": F.col(f"{c}_second") - F.col(f"{c}_first") for c in columns})


def difference_of_sources(df: DataFrame, keys: Sequence[str], columns: Sequence[str], minuend: str = "N",
                          subtrahend: str = "I", source: str = "source") -> DataFrame:
    """``minuend - subtrahend`` of each column on keys that both sources have."""
    a, b = F.col(source) == minuend, F.col(source) == subtrahend
    aggs = [(F.max(F.when(a, F.col(c))) - F.max(F.when(b, F.col(c)))).alias(f"double_difference_{c}")
            for c in columns]
    return (df.groupBy(*keys).agg(*aggs, F.count_if(a).alias("_a"), F.count_if(b).alias("_b"))
            .where((F.col("_a") > 0) & (F.col("_b") > 0)).drop("_a", "_b"))


def lattice_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join of two tables that both have a row per lattice cell, by sorting and merging.

    Spark estimates a side from the compressed size of its files, in which millions of cells may seem small
    enough to be broadcast; every task would then hold the whole lattice.
    """
    return left.join(right.hint("merge"), list(keys), how)


def attach_where(left: DataFrame, right: DataFrame, keys: Sequence[str], condition: Column) -> DataFrame:
    """Left join whose right-hand columns are kept only on rows fulfilling a condition."""
    extra = [c for c in right.columns if c not in keys]
    joined = left.join(right, list(keys), "left")
    for c in extra:
        joined = joined.withColumn(c, F.when(condition, F.col(c)))
    return joined


def last_by(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last row per key (map-side combined, no sort)."""
    rest = [c for c in df.columns if c not in keys]
    return (df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
            .select(*[F.col(c) if c in keys else F.col("_r").getField(c).alias(c) for c in df.columns]))


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)


def stack_sources(frames: Sequence[DataFrame], leading: Sequence[str] = ("date", "water_year", "source"),
                  ) -> DataFrame:
    """Union with missing columns as NULL: leading columns first, the rest by name."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    rest = sorted(c for c in out.columns if c not in leading)
    return out.select(*leading, *rest)
