"""Centroid clustering over Hilbert-ordered blocks with zone maps.

Vectors are projected on their leading principal dimensions, numbered along a Hilbert curve
and range-partitioned by that number once; each partition is cut into blocks of bounded
length that are written with the smallest and largest value of every component. A round
of clustering then moves no vectors. A block compares its box with the centroids first: a
centroid that is farther than another one from every point of the box is out. If one
is left the whole block is its, and the block's stored sums are used without a look at the
vectors; otherwise the vectors are compared with the candidates only, as one matrix
product. Everything is integer arithmetic, so results do not depend on order or blocks.

A round sends one row of sums per cluster and task to a sum per cluster; at most
``clusters`` rows reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .grid_join import principal

#: Vectors of a block; dimensions and bits of the curve.
BLOCK, DIMS, BITS = 512, 8, 7
#: Integers up to here are exact in a double-precision matrix product of 64 components.
EXACT = 1 << 20
#: Larger ones are cut to this, so that squared distances fit into a long.
LARGEST = 1 << 27


def hilbert_numbers(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place of each row of ``cells`` (n x d, each in 0 .. 2**bits - 1) along the d-dimensional Hilbert curve.

    Gray-code form: from the highest bit down every dimension either inverts the lower bits of
    the first one or swaps them with its own, then the bits are Gray-decoded and interleaved.
    """
    x = cells.T.astype(np.int64).copy()
    d = len(x)
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for i in range(d):
            ones = (x[i] >> level) & 1 == 1
            swap = np.where(ones, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(ones, low, swap)
            x[i] ^= swap
    for i in range(1, d):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, 0, -1):
        flip ^= np.where((x[d - 1] >> level) & 1 == 1, (1 << level) - 1, 0)
    x ^= flip
    out = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, -1, -1):
        for i in range(d):
            out = (out << 1) | ((x[i] >> level) & 1)
    return out


def lattice(vec: Column, components: int) -> Column:
    """``floor(64 * x)`` of every component as integer; null unless there are ``components`` finite ones."""
    v = vec.cast("array<double>")
    fine = (F.size(v) == components) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    cut = lambda x: F.greatest(F.least(F.floor(F.greatest(F.least(x * 64.0, F.lit(float(LARGEST))), F.lit(-float(LARGEST)))),
                                       F.lit(LARGEST)), F.lit(-LARGEST)).cast("int")
    return F.when(fine, F.transform(v, cut))


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Numbers of the centroids that some point of the box may be nearest to.

    First by distance: a centroid whose nearest point of the box is farther than another's farthest one
    is out. Then against the centroid nearest to the box's middle, by the greatest difference of
    the two distances over the box, which is linear in the point and exact per component.
    """
    near = np.maximum(0, np.maximum(low - centroids, centroids - high))
    far = np.maximum(np.abs(centroids - low), np.abs(centroids - high))
    left = np.flatnonzero((near * near).sum(1) <= (far * far).sum(1).min())
    if len(left) > 1:
        middle = (low + high) // 2
        best = centroids[left[np.argmin(((centroids[left] - middle) ** 2).sum(1))]]
        # distance to best minus distance to c, at the point of the box where it is greatest
        step = best - centroids[left]
        most = (best * best).sum() - (centroids[left] * centroids[left]).sum(1) - 2 * (np.where(step > 0, low, high) * step).sum(1)
        left = left[most >= 0]
    return left


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Position and squared distance of the nearest centroid of every row; ties go to the earlier one."""
    if not len(x):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if max(int(np.abs(x).max()), int(np.abs(centroids).max())) < EXACT:
        f, c = x.astype(float), centroids.astype(float)
        distance = (f * f).sum(1)[:, None] - 2 * (f @ c.T) + (c * c).sum(1)
    else:
        distance = np.stack([((x - c) ** 2).sum(1) for c in centroids], 1)
    best = distance.argmin(1)
    return best, distance[np.arange(len(x)), best].astype(np.int64)


def ordered_blocks(points: DataFrame, block: int = BLOCK, dims: int = DIMS, bits: int = BITS) -> DataFrame:
    """Blocks along the Hilbert curve, written to the shared folder: ``ids, n, low, high, total, data``."""
    dims = min(dims, 60 // bits)
    axes = principal(points.select(F.col("q").alias("u")), dims)

    def project(x: np.ndarray) -> np.ndarray:
        return x @ axes[x.shape[1]]

    def extent(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                p = project(np.stack(b["q"].to_numpy()).astype(float))
                yield pd.DataFrame({"i": np.arange(p.shape[1]), "lo": p.min(0), "hi": p.max(0)})

    ends = {r["i"]: (r["lo"], r["hi"]) for r in points.select("q").mapInPandas(extent, "i int, lo double, hi double")
            .groupBy("i").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect()}
    low = np.array([ends[i][0] for i in range(len(ends))])
    width = np.array([max(ends[i][1] - ends[i][0], 1e-300) for i in range(len(ends))])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(2))
            n = len(x)
            cells = np.clip((project(x.astype(float)) - low) / width * (1 << bits), 0, (1 << bits) - 1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(hilbert_numbers(cells, bits) if n else [], pa.int64()), b.column(2)],
                                             ["vec_id", "mark", "place", "q"])

    kind = points.schema["vec_id"].dataType.simpleString()
    placed = points.select("vec_id", "mark", "q").mapInArrow(place, f"vec_id {kind}, mark bigint, place bigint, q array<int>")
    # the mark differs from row to row, so equal vectors are dealt to as many partitions as they need
    placed = placed.repartitionByRange("place", "mark").sortWithinPartitions("place", "mark")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows, held = [], [], 0
        for b in batches:
            ids.append(b.column(0))
            rows.append(_matrix(b.column(1)))
            held += len(rows[-1])
            if held >= block:
                all_ids, x = pa.concat_arrays(ids), np.concatenate(rows)
                whole = held - held % block
                for at in range(0, whole, block):
                    yield _block(all_ids.slice(at, block), x[at:at + block])
                ids, rows, held = [all_ids.slice(whole)], [x[whole:]], held - whole
        if held:
            yield _block(pa.concat_arrays(ids), np.concatenate(rows))

    out = placed.select("vec_id", "q").mapInArrow(
        cut, f"ids array<{kind}>, n bigint, low array<bigint>, high array<bigint>, total array<bigint>, data binary")
    return stored(out, "zone-blocks")


def _matrix(lists: pa.Array) -> np.ndarray:
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(lists), -1) if len(lists) else np.zeros((0, 1), np.int64)


def _block(ids: pa.Array, x: np.ndarray) -> pa.RecordBatch:
    longs = pa.list_(pa.int64())
    return pa.RecordBatch.from_arrays([
        pa.array([ids.to_pylist()], pa.list_(ids.type)), pa.array([len(x)], pa.int64()), pa.array([x.min(0).tolist()], longs),
        pa.array([x.max(0).tolist()], longs), pa.array([x.sum(0).tolist()], longs), pa.array([x.astype(np.int32).tobytes()], pa.binary())],
        ["ids", "n", "low", "high", "total", "data"])


def _assigned(batch: pa.RecordBatch, centroids: np.ndarray, distances: bool) -> Iterator[tuple]:
    """Per block: its row, candidate numbers, and assignment of its vectors (None where one candidate takes all and no distance is asked)."""
    d = centroids.shape[1]
    for r in range(batch.num_rows):
        low, high = (np.array(batch.column(c)[r].as_py(), np.int64) for c in ("low", "high"))
        left = candidates(low, high, centroids)
        if len(left) == 1 and not distances:
            yield r, left, None, None, None
            continue
        x = np.frombuffer(batch.column("data")[r].as_py(), np.int32).reshape(-1, d).astype(np.int64)
        best, distance = nearest(x, centroids[left])
        yield r, left, left[best], distance, x


def _round(blocks: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids after one assignment: componentwise floor of the mean; empty clusters stay."""
    k, d = centroids.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(k, np.int64), np.zeros((k, d), np.int64)
        for batch in batches:
            for r, left, own, _, x in _assigned(batch, centroids, False):
                if own is None:
                    count[left[0]] += batch.column("n")[r].as_py()
                    total[left[0]] += np.array(batch.column("total")[r].as_py(), np.int64)
                else:
                    count += np.bincount(own, minlength=k)
                    for c in left:
                        total[c] += x[own == c].sum(0)
        yield pa.RecordBatch.from_arrays([
            pa.array(np.repeat(np.arange(k, dtype=np.int32), d + 1)), pa.array(np.tile(np.arange(-1, d, dtype=np.int32), k)),
            pa.array(np.concatenate([count[:, None], total], 1).ravel())], ["cluster", "i", "s"])

    # k x (d + 1) numbers, whatever the number of vectors; decimals, so that no sum overflows
    rows = (blocks.select("n", "low", "high", "total", "data").mapInArrow(sums, "cluster int, i int, s bigint")
            .groupBy("cluster", "i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect())
    found = {(r["cluster"], r["i"]): int(r["s"]) for r in rows}
    out = centroids.copy()
    for c in range(k):
        n = found.get((c, -1), 0)
        if n:
            out[c] = [found[c, i] // n for i in range(d)]
    return out


def zone_clusters(vectors: DataFrame, clusters: int = 16, rounds: int = 3, components: int = 64, id_col: str = "vec_id",
                  vec_col: str = "embedding", seed: str = "1", block: int = BLOCK) -> DataFrame:
    """One row per kept vector: ``vec_id, cluster int, distance, cluster_inertia, inertia bigint, centroid_sha256``.

    Vectors with another number of components, or with a null or non-finite one, are left out, null vectors
    too. The others become integers ``floor(64 * x)``, cut at +-2**27 so that squared distances stay in a long. The
    first centroids are the vectors with the smallest sha256 of ``seed:id`` (a null id counts as the empty
    text; equal hashes go by components); fewer vectors give fewer centroids. Repeated rows and ids count
    as vectors of their own. Empty tables, or none kept, give an empty result. Sums of distances beyond a
    long are null. Other columns are not read.
    """
    spark = vectors.sparkSession
    points = vectors.select(F.col(id_col).alias("vec_id"), lattice(F.col(vec_col), components).alias("q")).where(F.col("q").isNotNull())
    points = stored(points.withColumn("mark", F.xxhash64("vec_id", F.monotonically_increasing_id())), "zone-vectors")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    first = points.select(digest.alias("h"), "q").orderBy("h", "q").limit(clusters).collect()
    kind = points.schema["vec_id"].dataType.simpleString()
    if not first:
        return spark.createDataFrame([], f"vec_id {kind}, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    centroids = np.array([r["q"] for r in first], np.int64)
    blocks = ordered_blocks(points, block)
    for _ in range(rounds):
        centroids = _round(blocks, centroids)

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r, _, own, distance, _ in _assigned(batch, centroids, True):
                ids = batch.column("ids")[r].values
                yield pa.RecordBatch.from_arrays([ids, pa.array(own.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    members = stored(blocks.select("ids", "n", "low", "high", "data").mapInArrow(final, f"vec_id {kind}, cluster int, distance bigint"), "zone-members")
    own = members.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()
    whole = sum(int(r["s"]) for r in own)
    fits = lambda s: s if s < 1 << 63 else None
    names = [",".join(map(str, c)) for c in centroids.tolist()]
    # one row per cluster
    told = spark.createDataFrame([(r["cluster"], fits(int(r["s"])), fits(whole), hashlib.sha256(names[r["cluster"]].encode()).hexdigest()) for r in own],
                                 "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return members.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle(rounds: int = 3) -> str:
    steps = []
    for i in range(rounds + 1):
        steps.append(f"d{i} AS (SELECT rn, k, sum((v.x - c.x) * (v.x - c.x))::BIGINT AS dist FROM v JOIN c{i} c USING (i) GROUP BY rn, k),\n"
                     f"a{i} AS (SELECT rn, k, dist FROM d{i} QUALIFY row_number() OVER (PARTITION BY rn ORDER BY dist, k) = 1)")
        if i < rounds:
            steps.append(f"m{i} AS (SELECT k, i, sum(x)::BIGINT AS s, count(*)::BIGINT AS n FROM a{i} JOIN v USING (rn) GROUP BY k, i),\n"
                         f"c{i + 1} AS (SELECT c.k, c.i, CASE WHEN n IS NULL THEN c.x ELSE (s - ((s % n) + n) % n) // n END AS x FROM c{i} c LEFT JOIN m{i} m USING (k, i))")
    return ("""
WITH e AS (SELECT row_number() OVER () AS rn, vec_id, embedding FROM embeddings
           WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
v AS (SELECT rn, unnest(range(64)) AS i, unnest(list_transform(embedding, lambda x: floor(x::DOUBLE * 64)::BIGINT)) AS x FROM e),
f AS (SELECT rn, row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS k FROM e QUALIFY k < 16),
c0 AS (SELECT k, i, x FROM f JOIN v USING (rn)),
""" + ",\n".join(steps) + f""",
t AS (SELECT k, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS sha FROM c{rounds} GROUP BY k)
SELECT vec_id, k::INTEGER AS cluster, dist AS distance, (sum(dist) OVER (PARTITION BY k))::BIGINT AS cluster_inertia,
       (sum(dist) OVER ())::BIGINT AS inertia, sha AS centroid_sha256
FROM a{rounds} JOIN e USING (rn) JOIN t USING (k)
""")


ORACLE = _oracle()
