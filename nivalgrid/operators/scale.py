"""Building blocks that keep one large or hot group out of a single task.

* previous row / centred frame over a long axis without a one-partition window
* exact quantiles and ranks of arbitrarily large groups, by sampled splitters
* top-N / capped selections of arbitrarily large groups
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

def _c(value) -> Column:
    return value if isinstance(value, Column) else F.col(value)


def chunked_lag(df: DataFrame, keys: Sequence[str], order: str, chunk: Column,
                columns: Sequence[str], prefix: str = "prev_") -> DataFrame:
    """Values of the previous row along a long axis.

    ``chunk`` must be non-decreasing in ``order`` (for example the month of a
    timestamp). Rows are compared inside (keys, chunk); the first row of a chunk
    takes the last row of the nearest earlier non-empty chunk, found on a table
    with one row per chunk. No task ever holds more than one chunk.
    """
    keys = list(keys)
    base = df.withColumn("_chunk", chunk)
    # both branches carry every column, so they share one shuffle of the input
    packed = F.struct(*df.columns)
    inside = Window.partitionBy(*keys, "_chunk").orderBy(order)
    rows = (base.withColumn("_rn", F.row_number().over(inside))
            .withColumn("_prev", F.lag(packed).over(inside)))
    ends = base.groupBy(*keys, "_chunk").agg(F.max_by(packed, F.col(order)).alias("_last"))
    over_chunks = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_chunk")
    carry = ends.select(*keys, "_chunk", F.lag("_last").over(over_chunks).alias("_carry"))
    joined = rows.join(carry, [*keys, "_chunk"], "left")
    prev = F.when(F.col("_rn") == 1, F.col("_carry")).otherwise(F.col("_prev"))
    return (joined.withColumn("_p", prev)
            .select(*[F.col(c) for c in df.columns],
                    *[F.col("_p").getField(c).alias(prefix + c) for c in columns]))


def with_row_index(df: DataFrame, order: str, chunk: Column, name: str = "row_index") -> DataFrame:
    """0-based position along ``order``, built from per-chunk counts."""
    inside = Window.partitionBy("_chunk").orderBy(order)
    rows = df.withColumn("_chunk", chunk).withColumn("_rn", F.row_number().over(inside))
    # the last row of a chunk tells its length; taking it whole lets both branches share one shuffle
    last = F.max_by(F.struct(*df.columns, "_rn"), F.col("_rn"))
    counts = rows.groupBy("_chunk").agg(last.getField("_rn").cast("bigint").alias("_n"))
    over_chunks = Window.partitionBy(F.lit(0)).orderBy("_chunk")
    offsets = counts.select("_chunk", (F.sum("_n").over(over_chunks) - F.col("_n")).alias("_offset"))
    return (rows.join(offsets, "_chunk")
            .select(*[F.col(c) for c in df.columns],
                    (F.col("_offset") + F.col("_rn") - 1).alias(name)))


def centered_row_means(df: DataFrame, order: str, chunk: Column, columns: dict[str, str],
                       half: int = 3, min_periods: int = 1, block: int = 4096) -> DataFrame:
    """Centred row-based rolling means over one long ordered axis.

    ``columns`` maps an output name to its input. Blocks of consecutive rows
    carry ``half`` extra rows on each side, so every block is computed on its own.
    """
    block = max(block, half, 1)  # a frame then reaches into the neighbouring blocks only
    indexed = with_row_index(df, order, chunk, "_idx")
    own = F.floor(F.col("_idx") / block)
    blocks = F.array_distinct(F.array(F.floor((F.col("_idx") - half) / block), own,
                                      F.floor((F.col("_idx") + half) / block)))
    w = Window.partitionBy("_block").orderBy("_idx").rowsBetween(-half, half)
    rolled = indexed.withColumn("_block", F.explode(blocks))
    for out, source in columns.items():
        rolled = rolled.withColumn(
            out, F.when(F.count(source).over(w) >= min_periods, F.avg(source).over(w)))
    return rolled.where(F.col("_block") == own).drop("_idx", "_block")


def value_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Distinct values of each group with their multiplicity ``cnt`` (NULLs dropped)."""
    if not keys:
        raise ValueError("name at least one group key")
    return (df.where(F.col(value).isNotNull())
            .groupBy(*keys, value).agg(F.count(F.lit(1)).alias("cnt")))


#: Sampled rows per range, and the most ranges that an ordered axis is cut into.
STEPS, PARTS = 32, 4096


def _sampled_cuts(axis: DataFrame, order: Sequence[str], ranges: int) -> Column:
    """Sorted splitters of the rows' own order as one array: a scalar subquery of at most ``ranges - 1`` structs.

    The sample is the ``STEPS * ranges`` rows with the smallest hash, so it is bounded and the same in
    every branch of a plan that asks for it, unlike the bounds of a range exchange.
    """
    tup = F.struct(*order).alias("t")
    # ordering by the other columns too keeps them in, so that the sample reads the same exchange as the rows
    rest = [c for c in axis.columns if c not in order]
    sample = axis.orderBy(F.xxhash64(*order), *rest).limit(STEPS * ranges)
    held = sample.agg(F.sort_array(F.collect_list(tup)).alias("s"))
    at = F.sequence(F.lit(1), F.lit(ranges - 1))
    place = lambda i: F.floor(i * F.size("s") / F.lit(float(ranges))).cast("int")
    return held.select(F.array_distinct(F.transform(at, lambda i: F.get("s", place(i))))).scalar()


def _placed(axis: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Adds ``_b1``, the number of the sampled range that holds (keys, value).

    Splitters are drawn from all rows by (keys, value), so a group gets as many ranges as
    its share of the rows, wherever its values lie; small groups lie in one. The range is found by
    halving. Ranges only balance the work; results are exact.
    """
    spark = axis.sparkSession
    ranges = max(2, min(PARTS, 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    # groups without a key are in no result; said here, every branch of a plan reads the same exchange
    axis = axis.where(F.lit(True) if not keys else reduce(and_, [F.col(k).isNotNull() for k in keys]))
    cuts = _sampled_cuts(axis, [*keys, value], ranges)
    me = F.struct(*keys, value)
    steps = F.array(*[F.lit(1 << bit) for bit in range((ranges - 1).bit_length() - 1, -1, -1)])
    passed = lambda at, step: at + F.when(F.get(F.col("_cuts"), at + step - 1) <= me, step).otherwise(F.lit(0))
    return axis.withColumn("_cuts", cuts).withColumn("_b1", F.coalesce(F.aggregate(steps, F.lit(0), passed), F.lit(0))).drop("_cuts")


def _starts(placed: DataFrame, keys: list[str], weight: str = "cnt") -> DataFrame:
    """``_bn`` (rows), ``_start`` (rows before) of each range of a group, and the group size ``n``.

    The windows run over the ranges of a group, which are bounded in number.
    """
    along, whole = Window.partitionBy(*keys).orderBy("_b1"), Window.partitionBy(*keys)
    sizes = placed.groupBy(*keys, "_b1").agg(F.sum(weight).alias("_bn"))
    return sizes.select(*keys, "_b1", "_bn", (F.sum("_bn").over(along) - F.col("_bn")).alias("_start"), F.sum("_bn").over(whole).alias("n"))


def value_cdf(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Exact cumulative distribution of each group, one row per distinct value.

    Returns ``keys, value, cnt, before, n``: multiplicity, number of smaller
    values and group size. Equal values are collapsed first (map-side), so a task
    sorts one sampled range of distinct values at most.
    """
    return counts_cdf(value_counts(df, keys, value), list(keys), value)


def counts_cdf(counts: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """As :func:`value_cdf`, from distinct values with their multiplicity ``cnt``."""
    keys = list(keys)
    placed = _placed(counts, keys, value)
    inside = Window.partitionBy(*keys, "_b1").orderBy(value)
    return (placed.join(_starts(placed, keys), [*keys, "_b1"])
            .select(*keys, value, "cnt",
                    (F.col("_start") + F.sum("cnt").over(inside) - F.col("cnt")).alias("before"), "n"))


#: Moments that can be taken from the value counts of a group.
MOMENTS = ("count", "min", "max", "mean", "mean_abs", "rms", "std_pop")


def _moments(placed: DataFrame, keys: list[str], value: str, moments: dict[str, str]) -> DataFrame:
    """Moments per group, from sums per range.

    The standard deviation adds squares around the mean of the group: inside a range
    around the range's own mean, between ranges around the group mean, so a
    large common offset costs no digits.
    """
    v = f"CAST(`{value}` AS DOUBLE)"
    spread = [name for name, m in moments.items() if m == "std_pop"]
    rows = placed
    if spread:
        within = Window.partitionBy(*keys, "_b1")
        rows = placed.withColumn("_m", F.sum(F.expr(f"{v} * cnt")).over(within) / F.sum("cnt").over(within))
        rows = rows.withColumn("_d", F.expr(f"{v} - _m"))
    parts = rows.groupBy(*keys, "_b1").agg(
        F.sum("cnt").alias("_n"), F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.expr(f"sum({v} * cnt)").alias("_s"),
        F.expr(f"sum(abs({v}) * cnt)").alias("_abs"), F.expr(f"sum({v} * {v} * cnt)").alias("_sq"),
        *([F.expr("sum(_d * _d * cnt)").alias("_d2"), F.first("_m").alias("_m")] if spread else []))
    n = "sum(_n)"
    exprs = {"count": n, "min": "min(_lo)", "max": "max(_hi)", "mean": f"sum(_s) / {n}", "mean_abs": f"sum(_abs) / {n}",
             "rms": f"sqrt(sum(_sq) / {n})"}
    if spread:
        # ranges of a group are bounded in number, so its window is
        parts = parts.withColumn("_mean", F.expr("sum(_s) OVER w / sum(_n) OVER w".replace("OVER w", f"OVER (PARTITION BY {', '.join(f'`{k}`' for k in keys)})")))
        exprs["std_pop"] = f"sqrt(sum(_d2 + _n * (_m - _mean) * (_m - _mean)) / {n})"
    return parts.groupBy(*keys).agg(*[F.expr(exprs[m]).alias(name) for name, m in moments.items()])


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float],
                      moments: dict[str, str] | None = None) -> DataFrame:
    """Exact interpolated quantiles (and moments) per group, for groups of any size.

    ``probs`` maps output names to probabilities, ``moments`` output names to one
    of :data:`MOMENTS`. Values are counted and placed in ranges between splitters that are
    sampled from them; the ranges that hold a wanted rank are found from range sizes, and only
    their values are sorted. Groups without a value are absent. For groups bounded by the
    calendar the built-in ``percentile`` is cheaper.
    """
    return counts_percentiles(value_counts(df, keys, value), keys, value, probs, moments)


def counts_percentiles(counts: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float],
                       moments: dict[str, str] | None = None) -> DataFrame:
    """As :func:`exact_percentiles`, from distinct values with their multiplicity ``cnt``."""
    keys = list(keys)
    placed = _placed(counts, keys, value)
    # SQL text: many small expressions, built in one call each
    position = [f"({float(p)!r}D * (n - 1))" for p in probs.values()]
    ends = [f"{side}({pos})" for pos in position for side in ("floor", "ceil")]
    holds = F.expr(" OR ".join(f"(_start <= {r} AND {r} < _start + _bn)" for r in ends))
    ranges = [*keys, "_b1"]
    wanted = _starts(placed, keys).where(holds)
    inside = Window.partitionBy(*ranges).orderBy(value)
    ranked = placed.join(wanted, ranges).withColumn("_before", F.col("_start") + F.sum("cnt").over(inside) - F.col("cnt"))
    found = ranked.groupBy(*keys).agg(F.max("n").alias("n"), *[
        F.expr(f"max(CASE WHEN _before <= {r} AND {r} < _before + cnt THEN `{value}` END) AS _e{i}")
        for i, r in enumerate(ends)])
    quantiles = found.select(*keys, *[
        F.expr(f"_e{2 * i} + (_e{2 * i + 1} - _e{2 * i}) * ({pos} - floor({pos})) AS `{name}`")
        for i, (name, pos) in enumerate(zip(probs, position))])
    return _moments(placed, keys, value, moments).join(quantiles, keys) if moments else quantiles


def bucketed_rank(df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[Column],
                  limit: int | None = None, name: str = "rank", total: str | None = None) -> DataFrame:
    """1-based rank inside each group, sorted bucket by bucket.

    ``bucket`` must be non-decreasing along ``order``. With ``limit`` the buckets
    that start beyond it are dropped before any sort. ``total`` adds the group size.
    """
    keys = list(keys)
    base = df.withColumn("_bucket", bucket)
    sizes = base.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_bn"))
    over_buckets = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_bucket")
    whole = Window.partitionBy(*(keys or [F.lit(0)]))
    starts = sizes.select(*keys, "_bucket",
                          (F.sum("_bn").over(over_buckets) - F.col("_bn")).alias("_start"),
                          F.sum("_bn").over(whole).alias("_total"))
    if limit is not None:
        starts = starts.where(F.col("_start") < limit)
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    ranked = (base.join(starts, [*keys, "_bucket"])
              .withColumn(name, F.col("_start") + F.row_number().over(inside)))
    if limit is not None:
        ranked = ranked.where(F.col(name) <= limit)
    if total is not None:
        ranked = ranked.withColumn(total, F.col("_total"))
    return ranked.drop("_bucket", "_start", "_total")


#: Bits of the hash that orders a sample.
SAMPLE_BITS = 40


def hash_sample(df: DataFrame, keys: Sequence[str], identity: Sequence[str], limit: int,
                seed: int = 0, digest: Column | None = None) -> DataFrame:
    """Reproducible sample of at most ``limit`` rows per group: those with the smallest hash.

    Rows are ordered by a seeded hash of their identity columns, so the same
    rows are chosen whatever the partitioning; ``digest`` gives another hash, a bigint below
    ``2 ** SAMPLE_BITS``. ``n_full`` is the group size. The threshold of a group
    follows from its counts: hashes fall into levels, each holding half of what lies below the
    next one, and only the lowest levels that together reach ``limit`` are kept, about
    twice the rows that are asked for. Only these are sorted.
    """
    keys = list(keys)
    hashed = df.withColumn("_h", F.pmod(F.xxhash64(F.lit(seed), *identity), F.lit(1 << SAMPLE_BITS)) if digest is None else digest)
    # level 0: upper half of the hashes, level 1: upper half of the rest, and so on
    hashed = hashed.withColumn("_level", F.lit(SAMPLE_BITS) - F.length(F.regexp_replace(F.bin("_h"), "^0+", "")))
    sizes = hashed.groupBy(*keys, "_level").agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(*(keys or [F.lit(0)]))
    lower = whole.orderBy(F.desc("_level")).rowsBetween(Window.unboundedPreceding, -1)
    kept = (sizes.select(*keys, "_level", F.coalesce(F.sum("_n").over(lower), F.lit(0)).alias("_below"), F.sum("_n").over(whole).alias("n_full"))
            .where(F.col("_below") < limit).select(*keys, "_level", "n_full"))
    near = hashed.join(kept, [*keys, "_level"])
    order = whole.orderBy("_h", *identity)
    return (near.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= limit)
            .select(*df.columns, "n_full"))


def unique_rows(df: DataFrame, keys: Sequence[str], context: str) -> DataFrame:
    """Pass a frame through while enforcing that ``keys`` are unique.

    Duplicates collapse on the map side into a count, so a badly duplicated key
    costs nothing before it is reported as an error.
    """
    rest = [c for c in df.columns if c not in keys]
    grouped = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"),
                                    F.any_value(F.struct(*rest)).alias("_row"))
    message = F.concat(F.lit(f"duplicate key in {context}: "), F.to_json(F.struct(*keys)))
    checked = F.when(F.col("_n") == 1, F.col("_row")).otherwise(
        F.raise_error(message).cast(grouped.schema["_row"].dataType))
    return grouped.select(*keys, checked.alias("_row")).select(
        *[F.col(c) if c in keys else F.col("_row").getField(c).alias(c) for c in df.columns])
