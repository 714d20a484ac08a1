from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from nivalgrid.llm import jaccard_join as jj
from nivalgrid.llm.shingles import Shingler
from tests.llm.helpers import docs, rows


def word_sets(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(data, k, percent):
    sets = [word_sets(t, k) for _, t in data]
    parent = list(range(len(data)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(data)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(data):
        low[root(i)] = min(low.get(root(i), d), d)
    return sorted((d, len(s), low[root(i)]) for i, ((d, _), s) in enumerate(zip(data, sets)))


def corpus(seed, groups, size):
    r, out = random.Random(seed), []
    vocabulary = ["w%d" % i for i in range(60)] + ["é", "The", "THE", "the"]
    passage = " ".join(r.choice(vocabulary) for _ in range(15))
    for _ in range(groups):
        base = [r.choice(vocabulary) for _ in range(r.choice([3, 6, 9, 40, 120]))]
        for _ in range(r.randint(1, size)):
            t = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 5])):
                t[r.randrange(len(t))] = r.choice(vocabulary)
            out.append(r.choice([" ", "  ", "\n"]).join(t) + (" " + passage if r.random() < 0.3 else ""))
    return out + ["", " \n", None, "one", "ONE", "a b c d", "a b c d e", "a b c d\x0be\x1cf"]


def test_shingles_match_words():
    texts = corpus(1, 20, 3) + ["x" * 5000, "y " * 3000, " lead", "trail "]
    ids = {}
    for k in (4, 5):
        for part in (pa.array(texts), pa.array(["pad", *texts]).slice(1)):
            for t, tokens in zip(texts, Shingler(k).sets(part)):
                want = word_sets(t, k)
                assert len(tokens) == len(want) and list(tokens) == sorted(tokens.tolist())
                if len(want) == 1:
                    assert ids.setdefault((k, next(iter(want))), tokens[0]) == tokens[0]


def test_divide_skip():
    r = np.random.default_rng(3)
    for size in (5, 200):
        for need in (1, 2, 5, 9, 10, 11):
            lists = [np.unique(r.integers(0, size, r.integers(0, size))) for _ in range(10)]
            ids, counts = np.unique(np.concatenate(lists), return_counts=True)
            got = jj.divide_skip(lists, need, size)
            assert got[0].tolist() == ids[counts >= need].tolist() and got[1].tolist() == counts[counts >= need].tolist()


@pytest.mark.parametrize("k,percent,block,short", [(4, 85, 256, 64), (5, 80, 16, 4)])
def test_against_brute_force(spark, monkeypatch, k, percent, block, short):
    monkeypatch.setattr(jj, "BLOCK", block)
    monkeypatch.setattr(jj, "SHORT", short)
    monkeypatch.setattr(jj, "LEADERS", 2 if block == 16 else 4)
    texts = corpus(7, 25, 14)
    data = list(enumerate(texts))
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows(jj.similar_groups(docs(spark, texts), k, percent)))
    assert got == brute(data, k, percent)


def test_large_cell_of_chained_copies(spark, monkeypatch):
    monkeypatch.setattr(jj, "BLOCK", 16)
    monkeypatch.setattr(jj, "SHORT", 8)
    monkeypatch.setattr(jj, "LEADERS", 1)
    r = random.Random(2)
    base = ["w%d" % i for i in range(80)]
    texts = []
    for i in range(150):
        t = list(base)
        for _ in range(r.choice([1, 2, 3, 4, 6])):
            t[r.randrange(80)] = "x%d" % r.randrange(1000)
        texts.append(" ".join(t))
    got = sorted((x["doc_id"], x["n_shingles"], x["component_id"]) for x in rows(jj.similar_groups(docs(spark, texts), 4, 85)))
    assert got == brute(list(enumerate(texts)), 4, 85)


def test_split_cell_links_across_blocks_and_size_classes(spark, monkeypatch):
    """Near copies of 94 and 95 shingles stand in neighbouring size classes, those of 93 and 94 in one that takes several signature blocks."""
    for name, value in (("BLOCK", 8), ("WIDE", 8), ("SHORT", 8)):
        monkeypatch.setattr(jj, name, value)
    r = random.Random(5)
    base = ["w%d" % i for i in range(97)]
    texts = []
    for i in range(60):
        t = list(base)
        for at in r.sample(range(97), 4):
            t[at] = "x%d_%d" % (i, at)
        at = r.randrange(97)
        texts += [" ".join(t), " ".join(t[:at] + ["y%d" % i] + t[at:] if i % 2 else t[:at] + t[at + 1:])]
    want = brute(list(enumerate(texts)), 4, 85)
    assert {n for _, n, _ in want} == {93, 94, 95}
    assert [int(np.floor(np.log(n) / np.log(100 / 85))) for n in (93, 94, 95)] == [27, 27, 28]
    assert sum(d != c for d, _, c in want) >= 55
    got = sorted((x["doc_id"], x["n_shingles"], x["component_id"]) for x in rows(jj.similar_groups(docs(spark, texts), 4, 85)))
    assert got == want


def test_token_rare_in_every_task_ties_no_cell(spark, monkeypatch):
    """A passage in 120 unlike texts, two texts to a task: no task counts it as frequent, yet it must not tie its texts together."""
    r = random.Random(9)
    passage = " ".join("p%d" % i for i in range(12))
    texts = [" ".join("w%d_%d" % (i, r.randrange(10 ** 6)) for _ in range(20)) + " " + passage for i in range(120)]
    texts += [texts[0] + " end", texts[7] + " end"]
    ties, in_blocks = [], jj._in_blocks

    def seen(rows, percent):
        ties.append(max((x["count"] for x in rows.groupBy("cell").count().collect()), default=0))
        return in_blocks(rows, percent)

    monkeypatch.setattr(jj, "_in_blocks", seen)
    got = sorted((x["doc_id"], x["n_shingles"], x["component_id"]) for x in rows(jj.similar_groups(docs(spark, texts).repartition(61), 4, 85)))
    assert got == brute(list(enumerate(texts)), 4, 85)
    assert ties[0] == 2


def test_empty_and_repeated(spark):
    assert rows(jj.similar_groups(docs(spark, []), 4, 85)) == []
    t = "a b c d e f g h i j"
    got = rows(jj.similar_groups(docs(spark, [t, t, t, None], ids=[4, 4, None, None]), 4, 85))
    assert sorted([(r["doc_id"], r["component_id"]) for r in got], key=repr) == [(4, 4), (4, 4), (None, 4), (None, None)]
