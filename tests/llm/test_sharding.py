from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from nivalgrid.llm import sharding
from tests.llm.helpers import docs, rows


def check_law(got, texts_by_id, shards):
    """Sizes, checksums, gapless slots; returns bytes per shard."""
    held, slots = defaultdict(int), defaultdict(list)
    for r in got:
        raw = (texts_by_id[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 16, zlib.crc32(raw), "bytes", None)
        assert 0 <= r["shard"] < shards
        held[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    return held


def plain_pack(demand, capacity, order):
    residual = [list(c) for c in capacity]
    out = [None] * len(demand)
    for i in order:
        worth = [r[0] * demand[i][0] + r[1] * demand[i][1] + r[2] * demand[i][2] for r in residual]
        fits = [b for b, r in enumerate(residual) if all(x >= y for x, y in zip(r, demand[i]))]
        best = max(fits or range(len(residual)), key=lambda b: (worth[b], -b))
        out[i] = best
        residual[best] = [x - y for x, y in zip(residual[best], demand[i])]
    return out


def test_packing_rule():
    rng = np.random.default_rng(3)
    demand = rng.integers(1, 50, (300, 3)).astype(float)
    capacity = np.tile(demand.sum(0) / 7, (7, 1))
    order = np.argsort(-demand.max(1), kind="stable")
    assert sharding.pack(demand, capacity, order).tolist() == plain_pack(demand.tolist(), capacity.tolist(), order.tolist())


def test_one_task_equals_the_plain_rule(spark):
    """With few units all are heavy: the whole result is one greedy run over the groups."""
    rng = np.random.default_rng(4)
    texts = ["w " * int(rng.integers(1, 60)) + str(i % 90) for i in range(150)]
    got = rows(sharding.shard_documents(docs(spark, texts), shards=5))
    check_law(got, dict(enumerate(texts)), 5)
    import hashlib
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[hashlib.sha256(t.encode()).digest()].append(i)
    keys = sorted(groups)
    demand = np.array([[sum(len(texts[i]) + 16 for i in groups[k]), sum(len(texts[i].split()) for i in groups[k]), len(groups[k])] for k in keys], float)
    demand /= demand.sum(0)
    assert demand.max() < 1 / 40  # nothing is split
    order = sorted(range(len(keys)), key=lambda i: (-demand[i].max(), keys[i]))
    want = plain_pack(demand.tolist(), [[1 / 5] * 3] * 5, order)
    shard = {r["doc_id"]: r["shard"] for r in got}
    assert {tuple(groups[k]): {shard[i] for i in groups[k]} for k in keys} == {tuple(groups[k]): {s} for k, s in zip(keys, want)}


def test_balance_and_groups(spark, monkeypatch):
    """A group with a third of all rows is split; others stay whole; bytes, tokens and rows are near equal."""
    monkeypatch.setattr(sharding, "HEAVY", 1 / 200)
    monkeypatch.setattr(sharding, "SLICE", 300)
    monkeypatch.setattr(sharding, "RUN", 40)
    rng = np.random.default_rng(5)
    texts = ["same words in all"] * 2000 + [" ".join("ab"[: int(rng.integers(1, 3))] for _ in range(int(rng.integers(1, 80)))) for _ in range(4000)]
    texts += ["pair %d" % (i // 2) for i in range(400)]
    got = rows(sharding.shard_documents(docs(spark, texts), shards=8))
    held = check_law(got, dict(enumerate(texts)), 8)
    for column in ("size", "tokens", None):
        sums = Counter()
        for r in got:
            sums[r["shard"]] += r[column] if column else 1
        assert max(sums.values()) < 1.03 * sum(sums.values()) / 8 and min(sums.values()) > 0.97 * sum(sums.values()) / 8, (column, sums)
    assert len(held) == 8
    where = defaultdict(set)
    for r in got:
        where[texts[r["doc_id"]]].add(r["shard"])
    assert all(len(s) == 1 for t, s in where.items() if t.startswith("pair")) and len(where["same words in all"]) > 2


def test_odd_rows(spark):
    texts = [None, "", "x" * 200_000, "a", "a", "a", None]
    df = docs(spark, texts, ids=[1, 2, 3, 4, 4, None, 1])
    df = df.withColumns({c: F.lit("z") for c in ("shard", "slot", "digest", "part", "mark", "size", "run", "tokens", "parts")})
    got = rows(sharding.shard_documents(df, shards=3))
    assert Counter(r["doc_id"] for r in got) == {1: 2, 2: 1, 3: 1, 4: 2, None: 1}
    assert {r["size"] for r in got if r["doc_id"] in (1, 2)} == {16} and {r["text_crc32"] for r in got if r["doc_id"] in (1, 2)} == {0}
    for s in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    assert rows(sharding.shard_documents(docs(spark, []))) == []


def test_rerun_agrees(spark):
    df = docs(spark, ["t%d" % (i % 50) for i in range(400)])
    key = lambda got: sorted((r["doc_id"], r["shard"], r["slot"]) for r in got)
    assert key(rows(sharding.shard_documents(df, 4))) == key(rows(sharding.shard_documents(df, 4)))
