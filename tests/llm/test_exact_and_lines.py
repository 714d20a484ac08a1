from __future__ import annotations

import hashlib
import random
import re

from nivalgrid.llm import exact_dedup, line_dedup
from tests.llm.helpers import docs, rows


def test_exact_groups_against_plain(spark, monkeypatch):
    r = random.Random(4)
    pool = ["", " ", "a b", "a  b", "a\tb", "x" * 5000, "é\x1c", "é", "A b", "same start " * 30 + "1", "same start " * 30 + "2"]
    texts = [r.choice(pool) for _ in range(60)] + ["hot copy \n"] * 80 + [None, None]
    got = {x["doc_id"]: x for x in rows(exact_dedup.exact_groups(docs(spark, texts)))}
    groups = {}
    for i, t in enumerate(texts):
        groups.setdefault(re.sub("[\x20\x09-\x0d]+", " ", t or ""), []).append(i)
    for norm, ids in groups.items():
        for i in ids:
            g = got[i]
            assert (g["keep_id"], g["group_size"], g["kept"]) == (ids[0], len(ids), i == ids[0])
            assert g["text_sha256"] == hashlib.sha256(norm.encode()).hexdigest()


def test_exact_groups_repeated_null_and_empty(spark):
    got = rows(exact_dedup.exact_groups(docs(spark, ["t", "t", "t", None], ids=[7, 7, None, None])))
    assert sorted((x["doc_id"] is None, x["keep_id"], x["group_size"], x["kept"]) for x in got if x["group_size"] == 3) == [
        (False, 7, 3, False), (False, 7, 3, True), (True, 7, 3, False)]
    assert rows(exact_dedup.exact_groups(docs(spark, []))) == []


def plain_lines(data, window=2, divisor=3, least=2):
    """Chunks by the same cutting rule; a chunk seen before in the order of ids goes."""
    seen, out = set(), {}
    for d, t in sorted(data, key=lambda x: (x[0] is None, x[0])):
        lines = (t or "").split("\n")
        h = [int(hashlib.md5(x.encode()).hexdigest()[:7], 16) for x in lines]
        kept, piece, removed = [], [], 0
        for i, line in enumerate(lines):
            piece.append(line)
            rolled = 0
            for back in range(window - 1, -1, -1):
                rolled = rolled * 257 + (h[i - back] if i >= back else 0)
            if i == len(lines) - 1 or rolled % divisor == 0:
                body = "\n".join(piece)
                if len(piece) >= least and body.strip(" \t\n\x0b\x0c\r"):
                    if body in seen:
                        removed += 1
                        body = None
                    seen.add("\n".join(piece))
                kept += [body] if body is not None else []
                piece = []
        out[d] = ("\n".join(kept), removed)
    return out


def test_line_chunks_against_plain(spark):
    r = random.Random(9)
    lines = [f"line {i} é" for i in range(30)] + ["", " "]
    passage = [f"shared {i}" for i in range(9)]
    texts = []
    for _ in range(40):
        body = [r.choice(lines) for _ in range(r.randint(0, 6))] + passage * r.randint(0, 1) + [r.choice(lines) for _ in range(r.randint(0, 6))]
        texts.append("\n".join(body))
    texts += [None, "", "\n\n\n", texts[0], "z" * 9000]
    got = {x["doc_id"]: (x["text"], x["removed_chunks"]) for x in rows(line_dedup.line_dedup(docs(spark, texts)))}
    assert got == plain_lines(list(enumerate(texts)))
    assert any(n for _, n in got.values())


def test_line_dedup_repeated_rows_and_columns(spark):
    t = "\n".join(f"l{i}" for i in range(12))
    frame = docs(spark, [t, t, t], ids=[1, 1, 2])
    out = rows(line_dedup.line_dedup(frame, carry=["source", "lang"]))
    assert sorted((x["doc_id"], x["text"] == t, x["source"]) for x in out)[:2] == [(1, True, "a"), (1, True, "a")]
    assert [x["removed_chunks"] > 0 for x in out if x["doc_id"] == 2] == [True]
    assert rows(line_dedup.line_dedup(docs(spark, []))) == []
