from __future__ import annotations

import itertools
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from nivalgrid.llm import quality_crf as crf
from nivalgrid.llm import toxicity as tox
from tests.llm.helpers import docs, rows

SF = "/root/testdata/sf0.01"
TEXTS = [None, "", "\n\n", "word " * 30000, "ok\n" * 3000, "same", "same"]


def test_forward_backward_against_all_paths():
    r = np.random.default_rng(1)
    scores, move, lengths = r.normal(size=(3, 5)), r.normal(size=(2, 2)), np.array([5, 3, 1])
    good, pairs = crf.chain(scores, lengths, move)
    for i, n in enumerate(lengths):
        total, node, edge = 0.0, np.zeros(n), np.zeros((2, 2))
        for path in itertools.product((0, 1), repeat=int(n)):
            p = np.exp(sum(scores[i, t] for t in range(n) if path[t]) + sum(move[a, b] for a, b in zip(path, path[1:])))
            total += p
            node += p * np.array(path)
            for a, b in zip(path, path[1:]):
                edge[a, b] += p
        assert good[i, :n] == pytest.approx(node / total) and pairs[i] == pytest.approx(edge / total)


def test_neighbouring_lines_matter():
    f, w = crf.line_features("fine words here now\n### $$$ %%%\nfine words here now")
    assert f.shape == (3, crf.WIDTH) and w.tolist() == [20, 12, 20]
    assert f[0, crf.OWN:crf.OWN + 8].sum() == 0 and f[1, 1] == f[0, crf.OWN + 8] == f[2, crf.OWN] > 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not mounted")
def test_quality_on_held_out_rows(spark):
    d, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = crf.quality_report(d, labels).join(labels, "doc_id").toPandas()
    test = got[got.held_out]
    assert len(got) == labels.count() and got.score.between(0, 1).all()
    assert (test.predicted == test.quality).mean() > 0.95


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not mounted")
def test_toxicity_on_held_out_rows(spark):
    d, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = tox.toxicity_report(d, labels).join(labels, "doc_id").toPandas()
    test = got[got.held_out]
    assert got.score.between(0, 1).all()
    assert (test.predicted == test.toxic).mean() > 0.9 and test[test.toxic == 0].predicted.mean() < 0.05  # 64 rows


def test_folding():
    assert tox.fold("ІD1ОТ, $tup1d! 2023 a1b​c ｍｏｒｏｎ") == " idiot stupid 2023 aibc moron "
    assert tox.fold("") == "  ".replace("  ", "  ")[:2]


def test_lexicon_weights_and_exceptions():
    a = tox.Lexicon({" bad ": 4.0, " vile": 3.0}, ["not bad"]).automaton()
    density = lambda t: tox.features(t, a)[0]
    assert density("a bad day") > density("a bad day " + "x " * 50) > 0
    assert density("badly done") == 0 and density("vileness") > 0
    assert density("this is not bad") == 0 and density("so bad") > 0
    assert tox.features("b4d", a) == tox.features("bad", a)


def test_odd_texts_score_alike_and_stay(spark):
    model = crf.Model(np.ones(crf.WIDTH) * 0.1, np.zeros((2, 2)), np.array([0.0, 1.0, 1.0]))
    frame = docs(spark, TEXTS, ids=[None, 1, 2, 3, 4, 5, 5]).withColumn("quality_score", F.lit("old"))
    q = rows(crf.quality_scores(frame, model))
    lexicon = tox.Lexicon({" word ": 1.0}, [], np.array([-1.0, 1.0, 1.0]))
    t = rows(tox.toxicity_scores(docs(spark, TEXTS), lexicon))
    assert len(q) == len(t) == 7 and all(0 <= x["quality_score"] <= 1 for x in q) and all(0 <= x["toxicity_score"] <= 1 for x in t)
    assert q[0]["quality_score"] == q[1]["quality_score"] and q[5]["quality_score"] == q[6]["quality_score"]
    assert rows(crf.quality_scores(docs(spark, []), model)) == [] == rows(tox.toxicity_scores(docs(spark, []), lexicon))


def test_no_labels(spark):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    got = rows(tox.toxicity_report(docs(spark, ["a"]), labels)) + rows(crf.quality_report(docs(spark, ["a"]), labels))
    assert [x["score"] for x in got] == [0.5, 0.5]


def test_long_words_fold_too():
    assert tox.fold("x " + "1d10t" * 9) == " x " + "idiot" * 9 + " " and tox.fold("1d10t 123456") == " idiot 123456 "


def test_exception_spans_against_every_pair():
    """The merged spans spare the same places as a comparison of each hit with each span."""
    import random

    r = random.Random(4)
    lexicon = tox.Lexicon({" bad": 1.0, " worse ": 2.0, " b": 0.5}, ["not bad", "bad luck", "worse luck today"])
    automaton = lexicon.automaton()
    for _ in range(60):
        text = " ".join(r.choice(["bad", "worse", "luck", "not", "today", "ok", "badly"]) for _ in range(r.randrange(60)))
        folded, at, spans = tox.fold(text), {}, []
        for k, w in lexicon.entries.items():
            for s in range(len(folded)):
                if folded.startswith(k, s):
                    at[s] = max(at.get(s, 0.0), w)
        for k in lexicon.exceptions:
            spans += [(s, s + len(k) + 1) for s in range(len(folded)) if folded.startswith(f" {k} ", s)]
        want = sum(w for s, w in at.items() if not any(a <= s < b for a, b in spans))
        words = folded.count(" ") - 1
        got = tox.features(text, automaton)
        assert got[0] == pytest.approx(10 * want / (max(words, 0) + tox.WORDS_ADDED)), text
