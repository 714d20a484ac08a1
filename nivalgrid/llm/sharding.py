"""Sharding by vector bin packing.

Groups of equal texts are demands of three dimensions: bytes, tokens and rows, each as a share of
its total. Shards are bins of equal capacity. A group goes to the shard where the dot product of
its demand with the residual capacity is highest, among the shards where it fits in every dimension
(among all, where it fits nowhere). Larger groups go first.

A group that holds a notable share of a shard is split into parts by a hash of its rows before it
is placed. Heavy units, whose number is bounded by their share, are placed first and in
one task; all others are dealt to slices of bounded length, which are packed side by side, each into
its share of the capacity that the heavy ones left. Texts are read once; what moves afterwards
is one short row per document.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, text_or_empty
from .mixing import word_count

#: Units of a slice, rows of a slot run and rows that a part of a split group may have, on average.
SLICE, RUN, PART_ROWS = 20_000, 50_000, 1_000_000
#: A unit is heavy from this share of a total; at most three times its inverse of them.
HEAVY = 1 / 16_384
#: Parts of a shard that a group may fill unsplit.
WHOLE = 8


def pack(demand: np.ndarray, capacity: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Bin of every demand (n x dimensions), placed in ``order`` into bins of ``capacity`` (bins x dimensions)."""
    residual = capacity.astype(float).copy()
    out = np.empty(len(demand), np.int64)
    for i in order.tolist():
        d = demand[i]
        worth = sum(residual[:, k] * d[k] for k in range(len(d)))  # in this order, so that machines agree
        fits = (residual >= d).all(1)
        best = int(np.argmax(np.where(fits, worth, -np.inf))) if fits.any() else int(np.argmax(worth))
        out[i] = best
        residual[best] -= d
    return out


def _largest_first(demand: np.ndarray, keys: list) -> np.ndarray:
    return np.array(sorted(range(len(keys)), key=lambda i: (-demand[i].max(), keys[i])), np.int64)


def _sizes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    raw = text_or_empty(text_col).cast("binary")
    # the mark differs from row to row, also where ids repeat
    return stored(docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(raw) + 16).cast("bigint").alias("size"), F.crc32(raw).alias("text_crc32"),
        word_count(F.col(text_col)).alias("tokens"), F.unhex(F.sha2(raw, 256)).alias("digest"),
        F.xxhash64(F.col(id_col), F.monotonically_increasing_id()).alias("mark")), "shard-sizes")


def _units(rows: DataFrame) -> DataFrame:
    return rows.groupBy("digest", "part").agg(
        F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows"))


def shard_documents(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, size, text_crc32, law, shard, slot, grown_shard`` and ``tokens``.

    ``size`` is the bytes of the text plus 16, ``law`` is ``bytes``, ``slot`` counts from 0 in each shard and
    ``grown_shard`` is null. Null texts are empty texts; these form a group of their own. Rows of
    equal texts share a shard unless the group is more than an eighth of one. Null ids and repeated
    rows count as rows of their own; a rerun over the same files gives the same shards. Other columns
    are not read. An empty table gives an empty result.
    """
    if shards < 1:
        raise ValueError("at least one shard")
    rows = _sizes(docs, id_col, text_col)
    whole = rows.agg(F.sum("size"), F.sum("tokens"), F.count(F.lit(1))).first()
    total = np.array([float(x or 0) for x in whole])
    total[total == 0] = 1.0
    n = int(total[2])
    share = lambda: F.greatest(F.col("size") / total[0], F.col("tokens") / total[1], F.col("rows") / max(total[2], 1))
    # parts of a group: by its share of a shard, and by rows; at most 24 x shards + 16,384 groups are split
    row_limit = max(PART_ROWS, n / 16_384)
    groups = _units(rows.withColumn("part", F.lit(0)))
    parts = F.least(F.col("rows"), F.greatest(F.ceil(share() * float(shards * WHOLE)), F.ceil(F.col("rows") / float(row_limit))))
    split = groups.select("digest", parts.cast("int").alias("parts")).where(F.col("parts") > 1)
    rows = rows.join(F.broadcast(split), "digest", "left").withColumn(
        "part", F.coalesce(F.pmod(F.col("mark"), F.col("parts")), F.lit(0)).cast("int")).drop("parts")
    units = stored(_units(rows).withColumn("share", share()), "shard-units")
    placed = stored(_place(units, total, shards), "shard-places")
    # slots: runs of a shard are bounded and known from the units alone
    runs = max(1, math.ceil(n / (shards * RUN)))
    run = F.pmod(F.xxhash64("digest", "part"), F.lit(runs)).cast("int")
    placed = placed.withColumn("run", run)
    before = Window.partitionBy("shard").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    starts = (placed.groupBy("shard", "run").agg(F.sum("rows").alias("held"))
              .select("shard", "run", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("start")))
    inside = Window.partitionBy("shard", "run").orderBy("digest", "part", F.col("doc_id").asc_nulls_last(), "mark")
    out = (rows.join(placed.select("digest", "part", "shard", "run"), ["digest", "part"])
           .withColumn("at", F.row_number().over(inside) - 1).join(starts, ["shard", "run"]))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("at")).cast("bigint").alias("slot"),
                      F.lit(None).cast("int").alias("grown_shard"), "tokens")


def _place(units: DataFrame, total: np.ndarray, shards: int) -> DataFrame:
    """Adds ``shard`` to ``digest, part, rows``."""
    shape = "digest binary, part int, rows bigint, shard int"

    def packed(table: pa.Table, capacity: np.ndarray) -> pa.Table:
        demand = np.stack([table.column(c).to_numpy().astype(float) for c in ("size", "tokens", "rows")], 1) / total
        keys = list(zip(table.column("digest").to_pylist(), table.column("part").to_pylist()))
        shard = pack(demand, capacity if capacity is not None else np.zeros((shards, 3)), _largest_first(demand, keys))
        return pa.table({"digest": table.column("digest"), "part": table.column("part"), "rows": table.column("rows"),
                         "shard": pa.array(shard, pa.int32())})

    def heavy(table: pa.Table) -> pa.Table:
        return packed(table, np.full((shards, 3), 1 / shards))

    big = units.where(F.col("share") >= HEAVY)
    first = stored(big.groupBy(F.lit(0).alias("one")).applyInArrow(heavy, shape), "shard-heavy")
    # what the heavy units left: one row per shard
    used = np.zeros((shards, 3))
    for r in (first.join(big.select("digest", "part", "size", "tokens"), ["digest", "part"]).groupBy("shard")
              .agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.sum("rows").alias("rows")).collect()):
        used[r["shard"]] = np.array([r["size"], r["tokens"], r["rows"]], float) / total
    small = units.where(F.col("share") < HEAVY)
    told = small.agg(F.sum("size"), F.sum("tokens"), F.sum("rows"), F.count(F.lit(1))).first()
    left = np.array([float(x or 0) for x in told[:3]]) / total
    slices = max(1, math.ceil(told[3] / SLICE))
    free = 1 / shards - used

    def light(key: tuple, table: pa.Table) -> pa.Table:
        own = np.array([float(np.sum(table.column(c).to_numpy().astype(float))) for c in ("size", "tokens", "rows")]) / total
        # its share of what is free; shards in another order in each slice, so that leanings even out
        turn = np.roll(np.arange(shards), -(key[0].as_py() % shards))
        capacity = (free * np.divide(own, left, out=np.zeros(3), where=left > 0))[turn]
        out = packed(table, capacity)
        return out.set_column(3, "shard", pa.array(turn[out.column("shard").to_numpy()].astype(np.int32)))

    small = small.withColumn("slice", F.pmod(F.xxhash64("part", "digest"), F.lit(slices)).cast("int"))
    rest = small.groupBy("slice").applyInArrow(light, shape)
    return first.unionByName(rest)
