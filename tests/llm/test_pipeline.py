from __future__ import annotations

import os
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline as cp
from pyspark.sql import functions as F
from nivalgrid.llm import mixing, piece_codec
from nivalgrid.llm import quality_crf as crf
from nivalgrid.llm.common import documents
from nivalgrid.llm.fitting import score_logistic
from tests.llm.helpers import docs, rows
from tests.llm.test_exact_and_lines import plain_lines
from tests.llm.test_jaccard_join import brute

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.mark.skipif(not os.path.isdir(SF) or not os.path.exists(piece_codec.DEFAULT_MODEL), reason="driver tables or vocabulary not mounted")
def test_run_against_plain_version(spark):
    from pyspark.sql import functions as F

    frame = documents(spark, SF)
    model = crf.train_on(frame, spark.read.parquet(f"{SF}/labels.parquet"), ~crf.held_out(F.col("doc_id")))
    text = {r["doc_id"]: r["text"] for r in rows(frame)}
    score = {d: score_logistic(crf.document_inputs(*[[x] for x in crf.line_features(t or "")], model), model.curve)[0] for d, t in text.items()}
    good = {d: t for d, t in text.items() if score[d] >= cp.KEEP_SCORE}
    lined = {d: (t, n) for d, (t, n) in plain_lines(list(good.items())).items()}
    lined = {d: t for d, (t, n) in lined.items() if n == 0 or t.strip(" \t\n\x0b\x0c\r")}
    near = {d for d, _, c in brute(list(lined.items()), 5, 80) if d == c}
    kept = {d: lined[d] for d in near}
    sources = {r["doc_id"]: r["source"] for r in rows(frame)}
    order = sorted(kept)
    copies = {r["doc_id"]: r["copies"] for r in rows(mixing.mix_decisions(docs(spark, [kept[d] for d in order], [sources[d] for d in order], order)))}
    coder = piece_codec.Unigram(piece_codec.read_pieces(piece_codec.DEFAULT_MODEL))
    want = Counter({(d, tuple(coder.encode(kept[d]))): n for d, n in copies.items() if n})
    got = rows(cp.run(spark, SF))
    assert Counter((r["doc_id"], tuple(r["pieces"])) for r in got) == want
    assert all(r["round_trip"] and r["n_pieces"] == len(r["pieces"]) for r in got)
    assert 0 < len(near) < len(lined) <= len(good) < len(text)


def test_stages_with_odd_rows(spark, tmp_path):
    """Nulls anywhere, empty and repeated rows, more columns: every stage runs and keeps the columns."""
    from pyspark.sql import functions as F

    long = "some quite ordinary words in a line\n" * 400
    texts = [None, "", long, long, "plain words here " * 9, "plain words here " * 9]
    frame = docs(spark, texts, [None, "a", "a", "b", "b", "b"], [1, 2, 3, 3, 4, None]).withColumn("label", F.lit("x")).withColumn("text_key", F.lit(1))
    spark.createDataFrame([(1, 1, 0), (2, None, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = frame
    for name, stage in cp.STAGES[1:-1]:
        out = stage(spark, out, str(tmp_path))
        assert out.columns == frame.columns, name
        assert all(r["label"] == "x" for r in rows(out))
    assert cp.STAGES[0][1](spark, frame, str(tmp_path)).columns == frame.columns
    assert len(cp.STAGES[-1][1](spark, out, str(tmp_path)).collect()) == out.count()
    empty = docs(spark, [])
    for _, stage in cp.STAGES:
        empty = stage(spark, empty, str(tmp_path))
    assert empty.count() == 0


def test_the_rest_does_not_need_these_folders():
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    found = subprocess.run(["grep", "-rlE", r"nivalgrid[.]llm|from [.]+llm|corpus_pipeline", "--include=*.py", root], capture_output=True, text=True).stdout.split()
    rest = [f for f in found if "/llm/" not in f and not f.endswith(("corpus_pipeline.py", "__spark_entry__.py"))]
    assert rest == [] and sys.version_info and np is not None


def test_columns_named_like_internal_ones_come_back(spark, tmp_path):
    """Extra columns of any name pass every stage unchanged."""
    names = ["_id", "_src", "_size", "_copies", "_n", "_key", "n_lines", "n_chunks", "removed_chunks", "removed_lines", "quality_score", "key", "rep", "cell", "whole", "top"]
    texts = ["one fine line of words number %d\nand one more line %d" % (i, i * i) for i in range(12)]
    df = docs(spark, texts).withColumns({n: F.concat(F.lit(n + ":"), F.col("doc_id").cast("string")) for n in names})
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, df, str(tmp_path))
        assert out.columns == df.columns, name
        assert all(r[n] == f"{n}:{r['doc_id']}" for r in out.collect() for n in names), name


def test_one_id_with_two_texts(spark):
    a, b = " ".join("a%d" % i for i in range(30)), " ".join("b%d" % i for i in range(30))
    df = docs(spark, [a, b, a, a], ids=[1, 1, 1, 2])
    out = cp.near_duplicates(spark, df, "")
    assert sorted((r["doc_id"], r["text"]) for r in out.collect()) == [(1, a), (1, b)]
