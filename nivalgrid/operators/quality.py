"""Quality control of gridded observations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import physics
from .scale import bucketed_rank, counts_percentiles, exact_percentiles, value_counts

# Physical upper limits in mm, reasons and actions of the rules.
HARD_MAXIMUM_MM = {"SWE": 5000.0, "Snow depth": 15000.0}
REASONS = (("clipped_to_zero", "small_negative", "set_to_zero"),
           ("masked_negative", "negative_below_tolerance", "set_to_nodata"),
           ("masked_above_maximum", "above_hard_maximum", "set_to_nodata"))
BLOCKS = ("raw", "cleaned", "inside_raw", "inside_cleaned")
PERCENTILES = {"p50": 0.50, "p95": 0.95, "p99": 0.99, "p99_9": 0.999, "p99_99": 0.9999}


def apply_limits(obs: DataFrame, limits: dict[str, float] | None = None, tolerance: float = 1.0,
                 variable: str = "variable", raw: str = "raw_mm") -> DataFrame:
    """Flag and clean observations.

    Negatives within the tolerance become 0; larger negatives and values above
    the variable's limit become NULL; everything else is kept.
    """
    tol = abs(float(tolerance))
    limit: Column = F.lit(None).cast("double")
    for name, top in (limits or HARD_MAXIMUM_MM).items():
        limit = F.when(F.col(variable) == name, F.lit(float(top))).otherwise(limit)
    v = physics.finite(raw)
    unknown = F.raise_error(F.concat(F.lit("no limit for variable "), F.col(variable))).cast("double")
    out = (obs.withColumn("hard_maximum_mm", F.coalesce(limit, unknown)).withColumn(raw, v))
    false_if_null = lambda c: F.coalesce(c, F.lit(False))
    out = (out.withColumn("clipped_to_zero", false_if_null((F.col(raw) < 0) & (F.col(raw) >= -tol)))
           .withColumn("masked_negative", false_if_null(F.col(raw) < -tol))
           .withColumn("masked_above_maximum", false_if_null(F.col(raw) > F.col("hard_maximum_mm"))))
    return (out.withColumn("cleaned_mm", F.when(F.col("clipped_to_zero"), F.lit(0.0))
                           .when(~F.col("masked_negative") & ~F.col("masked_above_maximum"), F.col(raw)))
            .withColumn("adjusted", F.col("clipped_to_zero") | F.col("masked_negative")
                        | F.col("masked_above_maximum")))


def percentile_blocks(flagged: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Count, minimum, percentiles and maximum of raw and cleaned values, everywhere and inside.

    Raw and cleaned values are counted once, in total and inside, and each count gives two blocks, so one
    exact quantile pass serves all. Rows are dealt out by value before they are counted (a frequent value to
    several tasks): a task then counts a part of bounded size, not all values of a large, well compressed split.
    """
    keys = list(keys)
    dealt = (flagged.where(F.col("raw_mm").isNotNull() | F.col("cleaned_mm").isNotNull())
             .select(*keys, "raw_mm", "cleaned_mm", "inside").hint("rebalance", *keys, "raw_mm"))
    kinds = F.array(F.struct(F.lit("raw").alias("kind"), F.col("raw_mm").alias("v")), F.struct(F.lit("cleaned").alias("kind"), F.col("cleaned_mm").alias("v")))
    long = dealt.select(*keys, "inside", F.explode(kinds).alias("_k")).select(*keys, "inside", "_k.kind", "_k.v").where(F.col("v").isNotNull())
    counted = long.groupBy(*keys, "kind", "v").agg(F.count(F.lit(1)).alias("_all"), F.count_if("inside").alias("_in"))
    blocks = F.array(F.struct(F.col("kind").alias("block"), F.col("_all").alias("cnt")), F.struct(F.concat(F.lit("inside_"), "kind").alias("block"), F.col("_in").alias("cnt")))
    counts = counted.select(*keys, "v", F.explode(blocks).alias("_b")).select(*keys, "_b.block", "v", "_b.cnt").where(F.col("cnt") > 0)
    wanted = flagged.select(*keys).distinct().withColumn("block", F.explode(F.array(*[F.lit(b) for b in BLOCKS])))
    stats = counts_percentiles(counts, [*keys, "block"], "v", {f"{n}_mm": p for n, p in PERCENTILES.items()},
                               {"count": "count", "min_mm": "min", "max_mm": "max"})
    return wanted.join(stats, [*keys, "block"], "left").withColumn("count", F.coalesce("count", F.lit(0)))


def summary(flagged: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts of each rule, in total and inside the polygon."""
    raw, inside, adjusted = F.col("raw_mm").isNotNull(), F.col("inside"), F.col("adjusted")
    counts = flagged.groupBy(*keys).agg(
        F.max("hard_maximum_mm").alias("hard_maximum_mm"),
        F.count_if(~raw).alias("nodata_count"), F.count_if(raw).alias("raw_valid_count"),
        F.count_if("clipped_to_zero").alias("clipped_to_zero_count"),
        F.count_if("masked_negative").alias("masked_negative_count"),
        F.count_if("masked_above_maximum").alias("masked_above_hard_max_count"),
        F.count_if(adjusted).alias("adjusted_count"),
        F.count_if(raw & inside).alias("inside_raw_valid_count"),
        F.count_if(adjusted & inside).alias("inside_adjusted_count"))
    pct = lambda a, b: F.try_divide(100.0 * F.col(a), F.col(b))
    return (counts.withColumn("adjusted_percent", pct("adjusted_count", "raw_valid_count"))
            .withColumn("inside_adjusted_percent", pct("inside_adjusted_count", "inside_raw_valid_count")))


def top_values(flagged: DataFrame, keys: Sequence[str], n: int = 20) -> DataFrame:
    """Highest raw values per raster with rank and reasons (ties: last cell first)."""
    order = Window.partitionBy(*keys).orderBy(F.col("raw_mm").desc(), F.col("row").desc(), F.col("col").desc())
    reason = F.concat_ws(";", *[F.when(F.col(flag), F.lit(text)) for flag, text, _ in REASONS])
    return (flagged.where(F.col("raw_mm").isNotNull())
            .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
            .select(*keys, "rank", "row", "col", "raw_mm", "inside", "adjusted", reason.alias("reason")))


def flagged_log(flagged: DataFrame, keys: Sequence[str], maximum: int | None = None) -> DataFrame:
    """Adjusted cells in reason priority then row-major order: all of them, or at most ``maximum`` per raster.

    The position of a cell is the count of flagged cells in earlier (reason, row)
    lines plus its rank inside its own line, so no raster is sorted in one task.
    """
    priority = F.when(F.col("clipped_to_zero"), 0).when(F.col("masked_negative"), 1).otherwise(2)
    pick = lambda k: F.element_at(F.array(*[F.lit(r[k]) for r in REASONS]), F.col("_p") + 1)
    cells = flagged.where("adjusted").withColumn("_p", priority)
    ranked = bucketed_rank(cells, keys, F.struct("_p", "row"), [F.col("col")], limit=maximum,
                           name="position", total="adjusted_total")
    return (ranked.withColumn("reason", pick(1)).withColumn("action", pick(2))
            .withColumn("truncated", F.lit(False) if maximum is None else F.col("adjusted_total") > maximum)
            .select(*keys, "position", "reason", "action", "row", "col", "raw_mm", "cleaned_mm", "inside",
                    "adjusted_total", "truncated"))


def density_diagnostics(swe: DataFrame, depth: DataFrame, keys: Sequence[str], minimum_depth: float = 100.0,
                        review: tuple[float, float] = (50.0, 700.0), impossible: float = 1000.0) -> DataFrame:
    """Bulk density of cleaned observations inside the polygon: percentiles and review counts."""
    keys = list(keys)
    cell = [*keys, "row", "col"]
    pairs = (swe.where("inside").select(*cell, F.col("cleaned_mm").alias("swe"))
             .join(depth.select(*cell, F.col("cleaned_mm").alias("depth")), cell))
    return density_summary(pairs, keys, minimum_depth, review, impossible)


def density_summary(pairs: DataFrame, keys: Sequence[str], minimum_depth: float = 100.0,
                    review: tuple[float, float] = (50.0, 700.0), impossible: float = 1000.0) -> DataFrame:
    """As :func:`density_diagnostics`, from rows that hold both values: ``keys, swe, depth``.

    Depth counts to 1e-9 mm and density to 1e-12 kg/m3, so a depth that was summed in another order,
    or a ratio that is exactly a limit, falls on the same side of the limits in every run.
    """
    keys = list(keys)
    dense = (pairs.where(F.col("swe") >= 0).withColumn("depth", F.round("depth", 9))
             .withColumn("density", F.round(physics.bulk_density("swe", "depth", minimum_depth=minimum_depth), 12))
             .where(F.col("density").isNotNull()))
    counts = dense.groupBy(*keys).agg(
        F.count("density").alias("cell_count"),
        F.count_if(F.col("density") < review[0]).alias("below_review_min_count"),
        F.count_if(F.col("density") > review[1]).alias("above_review_max_count"),
        F.count_if(F.col("density") > impossible).alias("above_water_density_count"))
    q = exact_percentiles(dense, keys, "density", {"density_p01": 0.01, "density_p05": 0.05, "density_p50": 0.5,
                                                   "density_p95": 0.95, "density_p99": 0.99})
    return counts.join(q, keys)


def boxplot(df: DataFrame, keys: Sequence[str], value: str, whisker: float = 1.5) -> DataFrame:
    """Quartiles and whiskers (most extreme values within 1.5 IQR of the box)."""
    keys = list(keys)
    q = exact_percentiles(df, keys, value, {"q1": 0.25, "median": 0.5, "q3": 0.75}, {"n": "count"})
    reach = (F.col("q3") - F.col("q1")) * whisker
    v = F.col(value)
    fenced = value_counts(df, keys, value).join(q, keys)
    out = fenced.groupBy(*keys, "n", "q1", "median", "q3").agg(
        F.min(F.when(v >= F.col("q1") - reach, v)).alias("_lo"), F.max(F.when(v <= F.col("q3") + reach, v)).alias("_hi"))
    return out.select(*keys, "n", F.least("_lo", "q1").alias("whisker_low"), "q1", "median", "q3",
                      F.greatest("_hi", "q3").alias("whisker_high"))
