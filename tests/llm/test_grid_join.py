from __future__ import annotations

import numpy as np
from pyspark.sql import types as T

from nivalgrid.llm import grid_join
from tests.llm.helpers import rows

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
                       T.StructField("label", T.IntegerType()), T.StructField("u", T.StringType())])


def brute(data, threshold=0.98):
    ids = [d[0] for d in data]
    ok = [d[0] is not None and d[2] is not None and d[1] is not None and len(d[1]) > 0 and all(x is not None and np.isfinite(x) for x in d[1])
          and any(d[1]) for d in data]
    x = [np.array(d[1], np.float32).astype(float) if o else None for d, o in zip(data, ok)]
    n = len(data)
    links, parent = [0] * n, list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(n):
        for j in range(i + 1, n):
            if ok[i] and ok[j] and data[i][2] == data[j][2] and len(x[i]) == len(x[j]):
                a, b = x[i] / np.abs(x[i]).max(), x[j] / np.abs(x[j]).max()
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= threshold:
                    links[i] += 1
                    links[j] += 1
                    p, q = root(i), root(j)
                    if p != q:
                        parent[max(p, q)] = min(p, q)
    groups = {}
    for i in range(n):
        groups.setdefault(root(i), []).append(i)
    out = []
    for i in range(n):
        members = [ids[k] for k in groups[root(i)] if ids[k] is not None]
        comp = min(members) if ok[i] else ids[i]
        out.append((ids[i], links[i], comp, True if ids[i] is None else ids[i] == comp))
    return sorted(out, key=repr)


def run(spark, data, **kw):
    df = spark.createDataFrame([(*d, "x") for d in data], SCHEMA)
    return sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in rows(grid_join.near_vectors(df, **kw))), key=repr)


def test_against_brute_force(spark):
    rng = np.random.default_rng(5)
    data, i = [], 0
    for label in (0, 1, 2):
        for _ in range(12):
            centre = rng.normal(size=16)
            for _ in range(int(rng.integers(1, 12))):
                data.append((i, (centre + rng.normal(size=16) * 0.13).astype(np.float32).tolist(), label))
                i += 1
    data += [(i + k, data[0][1], 0) for k in range(5)]
    i += 5
    data += [(i, [1e-30] * 16, 0), (i + 1, [1e30] * 16, 0), (i + 2, [0.0] * 16, 0), (i + 3, [float("nan")] * 16, 0), (i + 4, None, 0),
             (i + 5, [], 0), (i + 6, [None] * 16, 0), (i + 7, [1.0] * 8, 0), (i + 8, [1.0] * 8, 0), (i + 9, data[0][1], None),
             (None, data[0][1], 0), (i + 10, [float("inf")] + [0.0] * 15, 0)]
    got = run(spark, data, interval=16, dims=4)
    assert got == brute(data)


def test_empty(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None, None)]) == [(1, 0, 1, True)]


def test_repeated_ids_with_other_vectors_or_labels(spark):
    """An id may stand for several vectors: one row per input row, and a link only where there is one."""
    e = lambda i: [1.0 if k == i else 0.0 for k in range(3)]
    near = [1.0, 0.01, 0.0]
    for data in ([(7, e(0), 0), (7, e(1), 0)], [(7, e(0), 0), (7, e(0), 1), (8, near, 1)], [(5, e(0), 0), (5, near, 0), (3, e(1), 0), (3, near, 0)]):
        got = run(spark, data)
        want = brute(data)
        assert len(got) == len(data) and [g[:2] for g in got] == [w[:2] for w in want] and got == want


def shuffled(spark):
    """Bytes written by all shuffles of the session so far."""
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_shuffle_follows_the_vectors_not_their_pairs(spark):
    """Hundreds of intervals that all may hold neighbours: each vector is shuffled once, and copies beyond a unit's share stay linked."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(1600, 16)).astype(np.float32)
    x[1:300:2] = x[0:300:2] + (rng.normal(size=(150, 16)) * 0.1).astype(np.float32)
    x[700:1300] = x[700]
    data = [(i, v.tolist(), 3) for i, v in enumerate(x)]
    before = shuffled(spark)
    got = run(spark, data, interval=4, dims=4)
    assert shuffled(spark) - before < 10 * x.nbytes
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    near = u @ u.T >= 0.98
    assert {g[0]: g[1] for g in got} == dict(enumerate((near.sum(1) - 1).tolist()))
    assert {g[0] for g in got if g[2] == 700} >= set(range(700, 1300))


def test_equal_vectors_link_at_any_threshold(spark):
    """Copies in several units have cosine 1, also where their product is rounded below; labels of text, components in double precision."""
    x = np.random.default_rng(8).normal(size=(3, 7))
    df = spark.createDataFrame([(i, x[i % 3].tolist(), "ab"[i % 2]) for i in range(1200)], "vec_id bigint, embedding array<double>, label string")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in rows(grid_join.near_vectors(df, threshold=1.0, interval=1))}
    assert got == {i: (199, i % 6, i < 6) for i in range(1200)}
