from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nivalgrid.llm import ranked_search as rs
from tests.llm.helpers import docs, rows

PATTERN = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_terms(text):
    return PATTERN.findall((text or "").translate(LOWER))


def brute(texts, items, ids=None, k=10):
    ids = list(range(len(texts))) if ids is None else ids
    counts = [Counter(plain_terms(t)) for t in texts]
    n = [sum(c.values()) for c in counts]
    docs_, words = sum(x > 0 for x in n), sum(n)
    df = Counter(t for c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in enumerate(counts):
            m = 25 + 75 * n[i] * docs_ // words if words else 0
            s = sum(math.floor(1000 * math.log((2 * docs_ + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m))
                    for t in plain_terms(text) if c[t])
            if s > 0:
                scored.append((-s, ids[i] is None, ids[i] or 0, i))
        out += [(item, r + 1, ids[x[3]], -x[0]) for r, x in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def items_of(spark, items):
    return spark.createDataFrame([(i, t, "x") for i, t in items], "item_id bigint, text string, rank string")


def run(spark, texts, items, ids=None, **kw):
    df = docs(spark, texts, ids=ids).withColumns({c: F.lit("z") for c in ("segment", "term", "score", "item_id")})
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in rows(rs.ranked_search(df, items_of(spark, items), **kw))), key=repr)


def corpus(seed, n, vocabulary=400):
    rng = np.random.default_rng(seed)
    word = lambda: "w%d" % min(int(rng.pareto(0.7)), vocabulary)
    return [" ".join(word() for _ in range(int(rng.integers(1, 60)))) for _ in range(n)]


@pytest.mark.parametrize("block_chars", [4_000_000, 60])
def test_against_brute_force(spark, block_chars):
    texts = corpus(1, 500)
    texts += [texts[5]] * 30 + [None, "", " ... ", "É W1-w2_W3 ßx   9", "W1 " * 5000]
    items = [(i, t) for i, t in enumerate(corpus(2, 12))] + [(50, texts[5]), (51, "w0 w0 w1 W1 É"), (52, None), (53, "?"), (54, "unknownword"), (51, "w0 w0 w1 W1 É")]
    want = brute(texts, list(dict.fromkeys(items)))
    assert run(spark, texts, items, block_chars=block_chars) == want


def test_segments_and_ties(spark, monkeypatch):
    """Equal scores over several segments go by id, null ids last; repeated rows stay rows."""
    monkeypatch.setattr(rs, "SEGMENT_DOCS", 7)
    texts = ["alpha beta"] * 40 + ["gamma"] * 10
    ids = [*range(39, 1, -1), None, None, *range(100, 105), *range(100, 105)]
    items = [(1, "alpha"), (2, "gamma beta")]
    assert run(spark, texts, items, ids=ids) == brute(texts, items, ids=ids)


def test_hybrid_search_equals_all_scores():
    """Any split into short and long lists gives the same rows as a full sum."""
    rng = np.random.default_rng(9)
    for case in range(60):
        n = int(rng.integers(1, 3000))
        lists = []
        for _ in range(int(rng.integers(1, 12))):
            at = np.flatnonzero(rng.random(n) < rng.random() ** 3)
            lists.append((at, rng.integers(0, 1000, len(at))))
        rank = rng.permutation(n)
        full = np.zeros(n, np.int64)
        for at, part in lists:
            full[at] += part
        want = sorted(((-int(full[i]), int(rank[i]), i) for i in np.flatnonzero(full)))[:10]
        for short in (0.0, 0.1, 1.0):
            at, score = rs.search(lists, n, 10, rank, short=short, window=int(rng.integers(16, 700)))
            assert [(-s, int(rank[a]), a) for a, s in zip(at.tolist(), score.tolist())] == want, case


def test_empty(spark):
    assert run(spark, [], [(1, "a")]) == [] and run(spark, ["a"], []) == [] and run(spark, [None, ""], [(1, "a")]) == []


def test_terms_follow_the_pattern():
    text = "".join(chr(c) for c in range(1, 0x250)) + "İKſ x　y"
    assert [t.decode() for t in rs.terms(text.encode())] == plain_terms(text)
    assert rs.damping(np.array([10 ** 9]), 10 ** 12, 10 ** 15).tolist() == [25 + 75 * 10 ** 9 * 10 ** 12 // 10 ** 15]


def test_string_ids(spark):
    df = spark.createDataFrame([("b", "x y"), ("a", "x y")], T.StructType([T.StructField("doc_id", T.StringType()), T.StructField("text", T.StringType())]))
    assert [(r["doc_id"], r["rank"]) for r in rows(rs.ranked_search(df, items_of(spark, [(1, "x")])).orderBy("rank"))] == [("a", 1), ("b", 2)]
