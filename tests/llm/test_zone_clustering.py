from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import types as T

from nivalgrid.llm import zone_clustering as zc
from tests.llm.helpers import rows

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
                       T.StructField("label", T.IntegerType()), T.StructField("cluster", T.StringType()), T.StructField("q", T.StringType())])


def brute(data, clusters=16, rounds=3, components=64):
    kept = []
    for vec_id, v in data:
        if v is None or len(v) != components or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.append((vec_id, [max(-zc.LARGEST, min(zc.LARGEST, math.floor(64 * float(np.float32(x))))) for x in v]))
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    cents = [list(r[1]) for r in order[:clusters]]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v: min((dist(v, c), k) for k, c in enumerate(cents))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for k in range(len(cents)):
            mine = [v for (_, v), o in zip(kept, own) if o == k]
            if mine:
                cents[k] = [sum(x) // len(mine) for x in zip(*mine)]
    last = [near(v) for _, v in kept]
    inertia = {}
    for d, k in last:
        inertia[k] = inertia.get(k, 0) + d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted(((i, k, d, inertia[k], sum(inertia.values()), sha[k]) for (i, _), (d, k) in zip(kept, last)), key=repr)


def run(spark, data, **kw):
    df = spark.createDataFrame([(i, v, 0, "x", "y") for i, v in data], SCHEMA)
    return sorted(((r["vec_id"], r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"])
                   for r in rows(zc.zone_clusters(df, **kw))), key=repr)


def test_against_brute_force(spark):
    rng = np.random.default_rng(6)
    data = []
    for g in range(9):
        centre = rng.normal(size=64) * 0.3
        data += [(len(data) + k, (centre + rng.normal(size=64) * 0.05).astype(np.float32).tolist()) for k in range(30)]
    data += [(500 + k, data[0][1]) for k in range(40)] + [(3, data[3][1])] * 5 + [(None, data[7][1])] * 2
    data += [(900, None), (901, []), (902, [0.0] * 63), (903, [float("nan")] * 64), (904, [None] * 64), (905, [float("inf")] + [0.0] * 63), (906, [0.0] * 64)]
    assert run(spark, data, block=32) == brute(data)


def test_large_components(spark):
    data = [(i, [float((-1) ** i * 3000.0 * (i % 5))] * 63 + [1e30 if i % 3 else 20000.0]) for i in range(20)]
    assert run(spark, data, block=4) == brute(data)


def test_few_and_none(spark):
    assert run(spark, []) == [] and run(spark, [(1, None)]) == []
    data = [(i, [0.25 * i] * 64) for i in range(3)]
    assert run(spark, data) == brute(data)


def test_hilbert_curve_is_a_path():
    """Successive places differ by one step in one dimension, and every cell is met once."""
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        side = 1 << bits
        cells = np.stack(np.meshgrid(*[np.arange(side)] * dims, indexing="ij"), -1).reshape(-1, dims)
        place = zc.hilbert_numbers(cells, bits)
        assert sorted(place.tolist()) == list(range(side ** dims))
        assert (np.abs(np.diff(cells[np.argsort(place)], axis=0)).sum(1) == 1).all()


def test_candidates_hold_the_nearest():
    """No centroid that is nearest to a vector of a box is left out, and tight boxes leave few."""
    rng = np.random.default_rng(8)
    cents = rng.integers(-40, 40, (16, 6))
    few = 0
    for spread in (1, 3, 15, 60):
        for _ in range(50):
            x = rng.integers(-40, 40, 6) + rng.integers(-spread, spread + 1, (30, 6))
            left = set(zc.candidates(x.min(0), x.max(0), cents).tolist())
            dist = ((x[:, None] - cents) ** 2).sum(2)
            assert {k for row in dist for k in np.flatnonzero(row == row.min())} <= left
            few += spread == 1 and len(left) <= 2
    assert few > 30
