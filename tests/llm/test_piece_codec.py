from __future__ import annotations

import os

import pytest

from nivalgrid.llm import piece_codec as sp
from tests.llm.helpers import docs, rows

MODEL = sp.DEFAULT_MODEL
TEXTS = ["", "Hello world", "  two  spaces\n\nlines\t", "naïve Gesch verße ñllá çê", "日本語のテキスト 😀 \x00\x01", "aaaaaaaaaaaaaaaaaaaa " * 40,
         "Ouwhea the of rend and threlyes ofthstth " * 30, "ẞ̈x🜁🜂", " ", "\n"]


def as_unigram(path):
    """The same pieces as a model of the library's unigram kind, for comparison."""
    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    data, out = open(path, "rb").read(), b""
    for number, value in sp._fields(data):
        if number == 2:
            spec = b""
            for k, v in sp._fields(value):
                v = 1 if k == 3 else v
                spec += varint(k << 3) + varint(v) if isinstance(v, int) else varint(k << 3 | (5 if isinstance(v, bytes) and len(v) == 4 and k in (10, 15) else 2)) + (b"" if k in (10, 15) else varint(len(v))) + v
            value = spec
        out += varint(number << 3 | 2) + varint(len(value)) + value
    return out


@pytest.fixture(scope="module")
def coder():
    if not os.path.exists(MODEL):
        pytest.skip("no vocabulary here")
    return sp.Unigram(sp.read_pieces(MODEL))


def brute(coder, word):
    """Best score by trying every piece of the dictionary at every place."""
    ids = {p: (i, s) for i, (p, s, t) in enumerate(coder.pieces) if t in (sp.NORMAL, sp.USER)}
    best = [0.0] + [-1e300] * len(word)
    for a in range(len(word)):
        for b in range(a + 1, min(len(word), a + 20) + 1):
            if word[a:b] in ids:
                best[b] = max(best[b], best[a] + ids[word[a:b]][1])
        if word[a] not in ids:
            best[a + 1] = max(best[a + 1], best[a] + coder.penalty)
    return best[-1]


def test_best_score_and_round_trip(coder):
    for text in TEXTS:
        ids = coder.encode(text)
        assert coder.decode(ids) == text
        for word in coder.split(sp.MARK + text.replace(" ", sp.MARK)) if text else []:
            score, pending = 0.0, 0
            for i in coder._word(word):
                if i in coder.byte_of:
                    pending += coder.byte_of[i] & 0xC0 != 0x80
                else:
                    score += coder.scores[i]
            assert score + pending * coder.penalty == pytest.approx(brute(coder, word))


def test_double_array():
    keys = [b"a", b"ab", b"abc", b"b", b"bcd", b"\xff\x00", b"\x00"]
    trie = sp.DoubleArray([(k, i) for i, k in enumerate(keys)])
    for data in (b"abcd", b"bcd", b"\xff\x00a", b"\x00\x00", b"zz", b""):
        assert [v for _, v in trie.prefixes(data, 0)] == [i for i, k in enumerate(keys) if data.startswith(k)]


def test_same_as_library(coder):
    spm = pytest.importorskip("sentencepiece")
    lib = spm.SentencePieceProcessor(model_proto=as_unigram(MODEL))
    for text in TEXTS[1:8]:
        ours, theirs = coder.encode(text), lib.encode(text)
        if ours != theirs:  # ties only
            total = lambda ids: sum(coder.penalty if i in coder.byte_of else coder.scores[i] for i in ids)
            assert total(ours) == pytest.approx(total(theirs)), text


def test_operator(spark, coder):
    got = rows(sp.encode_decode(docs(spark, [*TEXTS, None, "mark ▁ here"], ids=[*range(len(TEXTS)), None, 7])))
    for r, text in zip(got, [*TEXTS, "", "mark ▁ here"]):
        assert r["pieces"] == coder.encode(text) and r["n_pieces"] == len(r["pieces"])
        assert r["round_trip"] == ("▁" not in text) and (r["decoded"] == text or "▁" in text)
    assert rows(sp.encode_decode(docs(spark, []))) == []
