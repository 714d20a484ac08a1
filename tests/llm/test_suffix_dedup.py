from __future__ import annotations

import hashlib
import random

from nivalgrid.llm import suffix_dedup as sd
from tests.llm.helpers import docs, rows


def brute(data, length=50):
    first = {}
    texts = [(d, (t or "").encode()) for d, t in data]
    for d, b in texts:
        for i in range(len(b) - length + 1):
            w = b[i:i + length]
            key = float("inf") if d is None else d
            first[w] = min(first.get(w, key), key)
    out = []
    for d, b in texts:
        key = float("inf") if d is None else d
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if first[b[i:i + length]] < key:
                gone[i:i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def run(spark, data, **kw):
    got = rows(sd.suffix_dedup(docs(spark, [t for _, t in data], ids=[d for d, _ in data]), least_groups=3, **kw))
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got), key=repr)


def corpus(seed):
    r = random.Random(seed)
    letters = "abcdé \nXY"
    pool = ["".join(r.choice(letters) for _ in range(r.randint(30, 160))) for _ in range(8)]
    out = []
    for i in range(60):
        t = "".join(r.choice([r.choice(pool)[r.randint(0, 20):], "".join(r.choice(letters) for _ in range(r.randint(0, 90)))])
                    for _ in range(r.randint(0, 6)))
        out.append((i, t))
    base = out[5][1] + pool[0]
    out += [(60 + i, base[:i] + "Q" + base[i:]) for i in range(6)]
    out += [(70, base), (71, base), (71, base), (None, base), (None, pool[1] * 2), (72, None), (73, ""), (74, "a" * 200), (75, "a" * 130), (3, base)]
    r.shuffle(out)
    return out


def test_against_brute_force(spark, monkeypatch):
    data = corpus(1)
    assert run(spark, data) == brute(data)
    monkeypatch.setattr(sd, "SEGMENT", 100)  # long texts in several stretches
    assert run(spark, data) == brute(data)


def test_equal_hashes_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(sd, "mix", lambda x: x & sd.np.uint64(0xFF) if x.dtype == sd.np.uint64 else x)
    data = corpus(2)
    assert run(spark, data) == brute(data)


def test_empty_table_and_texts(spark):
    assert run(spark, []) == []
    got = rows(sd.suffix_dedup(docs(spark, ["x" * 60 + "tail", "head" + "x" * 60]), with_text=True))
    assert {r["doc_id"]: bytes(r["kept"]) for r in got} == {0: b"x" * 60 + b"tail", 1: b"head"}
