from __future__ import annotations

import random

import pytest

from nivalgrid.llm import mixing
from tests.llm.helpers import docs, rows


def targets(sizes, weights=(1, 2, 3), most=3):
    """Repeats the sharing until no source is above its cap."""
    total, order = sum(sizes.values()), sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    fixed = {}
    while True:
        left = [s for s in order if s not in fixed]
        rest = total - sum(fixed.values())
        over = [s for s in left if rest * w[s] / sum(w[x] for x in left) > most * sizes[s]]
        if not over:
            return {**fixed, **{s: rest * w[s] / sum(w[x] for x in left) for s in left}}
        fixed |= {s: most * sizes[s] for s in over}


def corpus(seed):
    r = random.Random(seed)
    texts, sources = [], []
    for source, n in (("a", 400), ("b", 30), ("c", 60), ("d", 5), (None, 40), ("B", 20), ("empty", 3)):
        for _ in range(n):
            texts.append(None if source == "empty" else " ".join("w" for _ in range(r.choice([0, 1, 3, 10, 40, 200]))) + r.choice(["", " \n"]))
            sources.append(source)
    return texts, sources


def test_targets_and_words_taken(spark):
    texts, sources = corpus(3)
    got = rows(mixing.mix_decisions(docs(spark, texts, sources)))
    sizes = {s: 0 for s in sources}
    for t, s in zip(texts, sources):
        sizes[s] += len((t or "").split())
    want = targets(sizes)
    taken, largest = {}, {}
    for x in got:
        assert x["size"] == len((texts[x["doc_id"]] or "").split()) and x["source_size"] == sizes[x["source"]]
        assert x["target"] == pytest.approx(want[x["source"]])
        assert x["taken"] <= 3 * x["size"] and x["taken"] == x["copies"] * x["size"]
        taken[x["source"]] = taken.get(x["source"], 0) + x["taken"]
        largest[x["source"]] = max(largest.get(x["source"], 0), x["size"])
    for s, t in want.items():
        assert abs(taken[s] - t) <= largest[s] / 2 + 1e-6 or taken[s] == pytest.approx(t)


def test_reruns_and_partitions_agree(spark):
    texts, sources = corpus(5)
    frame = docs(spark, texts, sources)
    a = sorted(map(str, rows(mixing.mix_decisions(frame.repartition(1)))))
    assert a == sorted(map(str, rows(mixing.mix_decisions(frame.repartition(7)))))


def test_buckets_do_not_change_the_cut(spark, monkeypatch):
    texts, sources = corpus(6)
    frame = docs(spark, texts, sources)
    a = sorted(map(str, rows(mixing.mix_decisions(frame))))
    monkeypatch.setattr(mixing, "BUCKETS", 2)
    assert a == sorted(map(str, rows(mixing.mix_decisions(frame))))


def test_larger_documents_are_likelier(spark):
    texts = ["w " * n for n in [5] * 300 + [50] * 300]
    got = rows(mixing.mix_decisions(docs(spark, texts + ["w"] * 40000, ["a"] * 600 + ["b"] * 40000)))
    picked = {n: sum(x["copies"] for x in got if x["source"] == "a" and x["size"] == n) for n in (5, 50)}
    assert picked[50] > picked[5]


def test_mix_repeats_rows_and_keeps_columns(spark):
    from pyspark.sql import functions as F

    texts, sources = corpus(8)
    frame = docs(spark, texts, sources).withColumn("rate", F.lit("kept")).withColumn("top", F.col("doc_id"))
    copies = {x["doc_id"]: x["copies"] for x in rows(mixing.mix_decisions(frame))}
    out = rows(mixing.mix(frame))
    assert list(out[0]) == frame.columns and all(x["rate"] == "kept" and x["top"] == x["doc_id"] for x in out)
    found = {}
    for x in out:
        found[x["doc_id"]] = found.get(x["doc_id"], 0) + 1
    assert found == {d: n for d, n in copies.items() if n}


def test_empty_and_blank(spark):
    assert rows(mixing.mix_decisions(docs(spark, []))) == []
    got = rows(mixing.mix_decisions(docs(spark, [None, "", " "], ["a", "b", None], ids=[None, 1, 1])))
    assert [(x["size"], x["target"], x["taken"]) for x in got] == [(0, 0.0, 0)] * 3
