from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from nivalgrid.operators import events, scale


@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds most rows, with heavy ties."""
    rng = np.random.default_rng(3)
    big = pd.DataFrame({"k": "hot", "v": np.round(rng.normal(100, 30, 6000), 1)})
    mid = pd.DataFrame({"k": "mid", "v": rng.exponential(5, 500)})
    one = pd.DataFrame({"k": ["one", "two", "two", "none"], "v": [7.0, 1.0, 2.0, np.nan]})
    pdf = pd.concat([big, mid, one], ignore_index=True)
    df = spark.createDataFrame(pdf).withColumn("v", F.when(~F.isnan("v"), F.col("v"))).repartition(5)
    return pdf.dropna(), df


@pytest.mark.parametrize("steps,parts", [(1, 2), (64, 4096)])
def test_exact_percentiles(skewed, monkeypatch, steps, parts):
    monkeypatch.setattr(scale, "STEPS", steps)
    monkeypatch.setattr(scale, "PARTS", parts)
    pdf, df = skewed
    probs = {"p1": 0.01, "p25": 0.25, "p50": 0.5, "p999": 0.999, "lo": 0.0, "hi": 1.0}
    got = scale.exact_percentiles(df, ["k"], "v", probs, {"n": "count", "m": "mean", "s": "std_pop", "r": "rms"}).toPandas().set_index("k")
    for k, g in pdf.groupby("k"):
        np.testing.assert_allclose([got.loc[k, n] for n in probs], np.percentile(g.v, [100 * p for p in probs.values()]), rtol=1e-12)
        np.testing.assert_allclose(list(got.loc[k, ["n", "m", "s", "r"]]), [len(g), g.v.mean(), g.v.std(ddof=0), np.sqrt((g.v ** 2).mean())], rtol=1e-9, atol=1e-9)
    assert "none" not in got.index


def test_value_cdf(skewed):
    pdf, df = skewed
    got = scale.value_cdf(df, ["k"], "v").toPandas()
    for k, g in got.groupby("k"):
        v = np.sort(pdf[pdf.k == k].v.to_numpy())
        g = g.sort_values("v")
        np.testing.assert_array_equal(g.before, np.searchsorted(v, g.v, side="left"))
        assert g.cnt.sum() == len(v) == g.n.iloc[0]


def test_spearman(spark):
    rng = np.random.default_rng(8)
    x = np.round(rng.normal(size=900), 1)
    pdf = pd.DataFrame({"k": "a", "x": x, "y": np.round(x + rng.normal(size=900), 0)})
    tiny = pd.DataFrame({"k": ["b", "b", "c", "c", "c"], "x": [1.0, 2, 1, 1, 1], "y": [1.0, 2, 1, 2, 3]})
    got = events.spearman(spark.createDataFrame(pd.concat([pdf, tiny])), ["k"], "x", "y").toPandas().set_index("k")
    want = pdf.x.rank().corr(pdf.y.rank())
    assert got.loc["a", "spearman_rho"] == pytest.approx(want)
    assert pd.isna(got.loc["b", "spearman_rho"]) and pd.isna(got.loc["c", "spearman_rho"])


def test_chunked_lag(spark):
    pdf = pd.DataFrame({"k": "a", "t": np.array([0, 1, 2, 10, 11, 57, 58, 90])})
    got = scale.chunked_lag(spark.createDataFrame(pdf), ["k"], "t", F.floor(F.col("t") / 10), ["t"]).orderBy("t").toPandas()
    np.testing.assert_array_equal(got.prev_t.iloc[1:].astype(int), pdf.t.iloc[:-1])
    assert pd.isna(got.prev_t.iloc[0])


@pytest.mark.parametrize("block", [1, 2, 5, 64])
def test_centered_rows(spark, block):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"t": np.cumsum(rng.integers(1, 9, 100)), "v": rng.normal(size=100)})
    pdf.loc[rng.random(100) < 0.2, "v"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    got = scale.centered_row_means(df, "t", F.floor(F.col("t") / 37), {"m": "v"}, half=3, min_periods=2, block=block).orderBy("t").toPandas()
    np.testing.assert_allclose(got.m.astype(float), pdf.v.rolling(7, center=True, min_periods=2).mean(), equal_nan=True)


def test_bucketed_rank_and_limit(skewed):
    pdf, df = skewed
    rows = df.where("v IS NOT NULL").withColumn("id", F.monotonically_increasing_id())
    ranked = scale.bucketed_rank(rows, ["k"], F.floor(F.col("v") / 10), [F.col("v"), F.col("id")], limit=250, total="n").toPandas()
    for k, g in ranked.groupby("k"):
        v = np.sort(pdf[pdf.k == k].v.to_numpy())
        np.testing.assert_array_equal(np.sort(g["rank"]), np.arange(1, min(250, len(v)) + 1))
        np.testing.assert_allclose(g.sort_values("rank").v, v[:250])
        assert g.n.iloc[0] == len(v)


def test_sample_is_reproducible(spark):
    df = spark.range(5000).withColumn("k", F.when(F.col("id") < 4900, "big").otherwise("small"))
    a = scale.hash_sample(df.repartition(3), ["k"], ["id"], 300, seed=1).toPandas()
    b = scale.hash_sample(df.repartition(11), ["k"], ["id"], 300, seed=1).toPandas()
    c = scale.hash_sample(df, ["k"], ["id"], 300, seed=2).toPandas()
    assert set(a.id) == set(b.id) != set(c.id)
    assert a.groupby("k").size().to_dict() == {"big": 300, "small": 100}


def test_histogram_matches_numpy(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"k": 1, "x": rng.normal(size=800), "y": rng.exponential(size=800)})
    got = events.histogram2d(spark.createDataFrame(pdf), ["k"], "x", "y", bins=9).toPandas()
    h = np.zeros((9, 9))
    h[got.bin_x, got.bin_y] = got.pair_count
    np.testing.assert_array_equal(h, np.histogram2d(pdf.x, pdf.y, bins=9)[0])
    flat = events.histogram2d(spark.createDataFrame(pdf.assign(x=3.0)), ["k"], "x", "y", bins=9).toPandas()
    assert set(flat.bin_x) == {4}


def test_deviation_keeps_its_digits_far_from_zero(spark):
    values = [1e9 + i % 2 for i in range(400)] + [-1e9 - i % 2 for i in range(400)]
    df = spark.createDataFrame([("up" if v > 0 else "down", v) for v in values], "k string, v double")
    got = {r.k: (r.s, r.q) for r in scale.exact_percentiles(df, ["k"], "v", {"q": 0.5}, {"s": "std_pop"}).collect()}
    assert got == {"up": (pytest.approx(0.5), 1e9 + 0.5), "down": (pytest.approx(0.5), -1e9 - 0.5)}


def test_values_are_never_shuffled_on_the_group_alone(skewed):
    _, df = skewed
    plan = scale.exact_percentiles(df, ["k"], "v", {"q": 0.5})._jdf.queryExecution().executedPlan().toString()
    joins = re.findall(r"(?:SortMergeJoin|BroadcastHashJoin) \[([^\]]*)\]", plan)
    assert joins and all("_b1" in keys for keys in joins)


def test_sample_members_follow_the_hash_order(spark):
    df = spark.range(4000).withColumn("k", F.col("id") % 3).withColumn("h", F.pmod(F.xxhash64(F.lit(5), "id"), F.lit(1 << 40)))
    want = {k: set(g.sort_values(["h", "id"]).id[:50]) for k, g in df.toPandas().groupby("k")}
    got = {k: set(g.id) for k, g in scale.hash_sample(df.repartition(6), ["k"], ["id"], 50, seed=5).toPandas().groupby("k")}
    assert got == want


@pytest.mark.parametrize("low,step", [(0.0, 5e-11), (1.7e9, 1e-3)])
def test_sampled_ranges_follow_the_values(spark, low, step):
    """Close or far-off values are spread as well as any others; small groups stay in one range or two."""
    big = spark.range(200_000).select(F.lit("big").alias("k"), (low + F.col("id") * step).alias("v"))
    df = big.unionByName(spark.range(50).select(F.lit("few").alias("k"), F.col("id").cast("double").alias("v")))
    placed = scale._placed(scale.value_counts(df, ["k"], "v"), ["k"], "v")
    sizes = {k: g["count"].tolist() for k, g in placed.groupBy("k", "_b1").count().toPandas().groupby("k")}
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert len(sizes["big"]) >= partitions and max(sizes["big"]) < 2.5 * 200_000 / (2 * partitions) and len(sizes["few"]) <= 2
    got = scale.exact_percentiles(df, ["k"], "v", {"p10": 0.1, "p50": 0.5, "p99": 0.99}, {"s": "std_pop", "n": "count"}).toPandas().set_index("k")
    v = low + np.arange(200_000) * step
    np.testing.assert_allclose(got.loc["big", ["p10", "p50", "p99"]].to_numpy(float), np.percentile(v, [10, 50, 99]), rtol=1e-14)
    assert got.loc["big", "n"] == 200_000 and got.loc["big", "s"] == pytest.approx(step * np.sqrt((200_000 ** 2 - 1) / 12), rel=1e-6)


def test_ranges_do_not_depend_on_partitioning(spark):
    df = spark.range(5000).select(F.lit(1).alias("k"), (F.col("id") * 7919 % 5003).alias("v"))
    place = lambda d: {(r.v, r._b1) for r in scale._placed(scale.value_counts(d, ["k"], "v"), ["k"], "v").collect()}
    assert place(df) == place(df.repartition(13))


def test_quantiles_of_empty_and_null_groups(spark):
    df = spark.createDataFrame([], "k string, v double")
    assert scale.exact_percentiles(df, ["k"], "v", {"q": 0.5}, {"s": "std_pop"}).collect() == []
    nan = spark.createDataFrame([("a", float("nan")), ("a", 1.0), ("b", None)], "k string, v double")
    got = scale.exact_percentiles(nan, ["k"], "v", {"lo": 0.0, "hi": 1.0}).collect()
    assert [(r.k, r.lo) for r in got] == [("a", 1.0)] and np.isnan(got[0].hi)


def test_spearman_against_pandas_with_hot_values(spark):
    """A value held by a third of all pairs, negative zero and both columns of other types."""
    rng = np.random.default_rng(11)
    pdf = pd.DataFrame({"k": np.where(rng.random(3000) < 0.7, "a", "b"), "x": np.where(rng.random(3000) < 0.35, 0, rng.integers(-50, 50, 3000)),
                        "y": np.where(rng.random(3000) < 0.35, -0.0, rng.normal(size=3000))})
    got = {r.k: (r.n, r.spearman_rho) for r in events.spearman(spark.createDataFrame(pdf).repartition(7), ["k"], "x", "y").collect()}
    for k, g in pdf.groupby("k"):
        assert got[k] == (len(g), pytest.approx(g.x.rank().corr(g.y.rank())))


def test_spearman_plan(spark):
    """Both columns are ranked together: one scan and one pass over ranges."""
    df = spark.range(1000).select(F.lit(1).alias("k"), (F.col("id") % 97).alias("x"), (F.col("id") % 89).alias("y"))
    tree = events.spearman(df, ["k"], "x", "y")._jdf.queryExecution().executedPlan().toString()
    body = tree.split("Subquery")[0]
    assert len(re.findall(r"(?:SortMergeJoin|BroadcastHashJoin) ", body)) == 2  # range starts, and the ranks to the pairs


def test_sample_sorts_few_rows(spark):
    """Of any group about twice the limit comes to the sort, whatever the group's size."""
    df = spark.range(60_000).withColumn("k", F.when(F.col("id") < 59_000, "big").when(F.col("id") < 59_990, "mid").otherwise("small"))
    out = scale.hash_sample(df, ["k"], ["id"], 100, seed=3)
    joined = out._jdf.queryExecution().optimizedPlan().toString()
    assert "_level" in joined
    h = F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(1 << 40))
    pdf = df.withColumn("h", h).toPandas()
    for k, g in pdf.groupby("k"):
        want = set(g.sort_values(["h", "id"]).id[:100])
        assert {r.id for r in out.where(F.col("k") == k).collect()} == want
        level = 40 - np.floor(np.log2(np.maximum(g.h, 1))).astype(int) - 1
        counts = level.value_counts().sort_index(ascending=False)
        assert counts[counts.cumsum().shift(fill_value=0) < 100].sum() <= max(400, 0.02 * len(g))


def test_sample_with_own_digest_and_no_keys(spark):
    df = spark.range(500)
    got = scale.hash_sample(df, [], ["id"], 20, digest=(F.lit(500) - F.col("id")).cast("bigint")).collect()
    assert {r.id for r in got} == set(range(480, 500)) and {r.n_full for r in got} == {500}
