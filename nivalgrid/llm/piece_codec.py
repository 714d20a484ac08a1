"""Unigram encoding and decoding with a SentencePiece vocabulary.

The best segmentation maximises the sum of piece scores (Viterbi over a double-array
trie of the pieces). Characters outside the vocabulary fall back to byte pieces.
White space is written as a marker, and one marker is put before the text. No piece
of a supported vocabulary has the marker behind another character, so the lattice
falls apart at each word start and words are solved once per task and remembered,
up to a fixed number of words. The vocabulary is a few tens of thousands of pieces
and is broadcast.
"""

from __future__ import annotations

import re
import struct
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the format.
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: A character without a piece costs this much more than the worst piece.
UNKNOWN_PENALTY = 10.0
#: Longer words are solved one by one and not remembered; so many words are solved side by side.
LONG_WORD, SIDE_BY_SIDE = 64, 4096
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def _varint(data: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        b = data[at]
        out |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return out, at


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        if tag & 7 == 0:
            value, at = _varint(data, at)
        elif tag & 7 == 2:
            n, at = _varint(data, at)
            value, at = data[at:at + n], at + n
        else:
            n = 4 if tag & 7 == 5 else 8
            value, at = data[at:at + n], at + n
        yield tag >> 3, value


def read_pieces(path: str) -> list[tuple[str, float, int]]:
    """``(piece, score, type)`` by id from a model file."""
    with open(path, "rb") as f:
        data = f.read()
    out = []
    for number, value in _fields(data):
        if number == 1:
            part = dict(_fields(value))
            out.append((part[1].decode(), struct.unpack("<f", part[2])[0] if 2 in part else 0.0, part.get(3, NORMAL)))
    return out


class DoubleArray:
    """Static trie in two arrays: child of state s by byte c is base[s] + c when check there is s."""

    def __init__(self, keys: list[tuple[bytes, int]] = (), arrays: tuple[list[int], list[int], list[int]] | None = None):
        if arrays:
            self.base, self.check, self.value = arrays
            return
        children: list[dict[int, int]] = [{}]
        leaf: list[int] = [-1]
        for key, value in keys:
            node = 0
            for c in key:
                nxt = children[node].get(c)
                if nxt is None:
                    nxt = children[node][c] = len(children)
                    children.append({})
                    leaf.append(-1)
                node = nxt
            leaf[node] = value
        size = 2 * len(children) + 1024
        base, check, value = [0] * size, [-1] * size, [-1] * size
        free = bytearray(b"\1") * size
        free[0] = 0
        low, todo = 1, [(0, 0)]  # low: where the search for free slots begins
        while todo:
            node, at = todo.pop()
            value[at] = leaf[node]
            labels = sorted(children[node])
            if not labels:
                continue
            low = free.index(1, low)
            slot, tries = free.index(1, max(low, labels[0] + 1)), 0
            while not all(free[slot + c - labels[0]] for c in labels[1:]):
                slot, tries = free.index(1, slot + 1), tries + 1
                if slot + 512 > size:
                    base, check, value = base + [0] * size, check + [-1] * size, value + [-1] * size
                    free, size = free + bytearray(b"\1") * size, 2 * size
            if tries > 100:  # the front is nearly full
                low = max(low, slot - 512)
            base[at] = slot - labels[0]
            for c in labels:
                to = base[at] + c
                free[to], check[to] = 0, at
                todo.append((children[node][c], to))
            if slot + 1024 > size:
                base, check, value = base + [0] * size, check + [-1] * size, value + [-1] * size
                free, size = free + bytearray(b"\1") * size, 2 * size
        used = free.rindex(0) + 257
        self.base, self.check, self.value = (array("i", x[:used]) for x in (base, check, value))

    def prefixes(self, data: bytes, at: int) -> Iterator[tuple[int, int]]:
        """``(end, value)`` of each key that begins at ``at``."""
        base, check, value, state = self.base, self.check, self.value, 0
        for i in range(at, len(data)):
            to = base[state] + data[i]
            if to >= len(check) or check[to] != state:
                return
            state = to
            if value[state] >= 0:
                yield i + 1, value[state]


class Unigram:
    """Encoder and decoder for one vocabulary; ``remember`` bounds the words kept with their pieces."""

    def __init__(self, pieces: list[tuple[str, float, int]], remember: int = 400_000, arrays: tuple | None = None):
        self.pieces, self.remember = pieces, remember
        self.scores = [s for _, s, _ in pieces]
        self.bytes = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(pieces) if t == BYTE}
        self.unknown = next((i for i, (_, _, t) in enumerate(pieces) if t == UNKNOWN), 0)
        usable = [(p, i) for i, (p, _, t) in enumerate(pieces) if t in (NORMAL, USER)]
        bad = [p for p, _ in usable if re.search(f"[^{MARK}]{MARK}", p)]
        if bad:
            raise ValueError(f"pieces with the marker behind another character: {bad[:3]}")
        self.trie = DoubleArray([(p.encode(), i) for p, i in usable], arrays)
        self.penalty = min((s for _, s, t in pieces if t == NORMAL), default=0.0) - UNKNOWN_PENALTY
        self.arrays = (*(np.array(x, np.int64) for x in (self.trie.base, self.trie.check, self.trie.value)), np.array(self.scores))
        self.words: dict[str, tuple[int, ...]] = {}
        self.split = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+").findall
        self.plain = [p.replace(MARK, " ") if t in (NORMAL, USER) else None for p, _, t in pieces]
        self.byte_of = {i: b for b, i in self.bytes.items()}

    def _word(self, word: str) -> tuple[int, ...]:
        data = word.encode()
        n = len(data)
        best, back = [-1e300] * (n + 1), [(0, -1)] * (n + 1)
        best[0] = 0.0
        scores, base, check, value = self.scores, self.trie.base, self.trie.check, self.trie.value
        for at in range(n):
            if data[at] & 0xC0 == 0x80:  # inside a character
                continue
            here, state, i, after = best[at], 0, at, at + 1
            while after < n and data[after] & 0xC0 == 0x80:
                after += 1
            single = False
            while i < n:
                to = base[state] + data[i]
                if check[to] != state:
                    break
                state, i = to, i + 1
                piece = value[to]
                if piece >= 0:
                    if i == after:
                        single = True
                    total = here + scores[piece]
                    if total > best[i]:
                        best[i], back[i] = total, (at, piece)
            if not single and here + self.penalty > best[after]:
                best[after], back[after] = here + self.penalty, (at, -1)
        out: list[int] = []
        at = n
        while at > 0:
            start, piece = back[at]
            if piece >= 0:
                out.append(piece)
            elif self.bytes:
                out.extend(self.bytes[b] for b in reversed(data[start:at]))
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
            at = start
        return tuple(reversed(out))

    def _solve(self, words: list[str]) -> Iterator[tuple[str, tuple[int, ...]]]:
        """Segmentation of many words at once: :meth:`_word` for all words of one length side by side, with its rule for ties."""
        by_length: dict[int, list[tuple[str, bytes]]] = {}
        for word in words:
            data = word.encode()
            by_length.setdefault(len(data), []).append((word, data))
        for n, group in by_length.items():
            if n > LONG_WORD or len(group) < 8:
                yield from ((word, self._word(word)) for word, _ in group)
                continue
            for at in range(0, len(group), SIDE_BY_SIDE):
                part = group[at:at + SIDE_BY_SIDE]
                rows = np.frombuffer(b"".join(d for _, d in part), np.uint8).reshape(len(part), n).astype(np.int64)
                for (word, _), ids in zip(part, self._segment(rows)):
                    yield word, self._word(word) if ids is None else ids

    def _segment(self, data: np.ndarray) -> list[tuple[int, ...] | None]:
        """Best pieces of each row of ``data`` (bytes of words of one length); None where a character has no piece."""
        base, check, value, scores = self.arrays
        count, n = data.shape
        best = np.full((count, n + 1), -1e300)
        best[:, 0] = 0.0
        start = np.zeros((count, n + 1), np.int64)
        piece = np.full((count, n + 1), -1, np.int64)
        begins = data & 0xC0 != 0x80
        after = np.full(count, n)  # of the character at hand: where the next one begins
        nexts = np.empty((count, n), np.int64)
        for at in range(n - 1, -1, -1):
            nexts[:, at] = after
            after = np.where(begins[:, at], at, after)
        for at in range(n):
            rows = np.flatnonzero(begins[:, at])
            alone = np.zeros(count, bool)
            alive, state = rows, np.zeros(len(rows), np.int64)
            for i in range(at, n):
                to = base[state] + data[alive, i]
                known = check[to] == state
                alive, state = alive[known], to[known]
                if not len(alive):
                    break
                here = value[state]
                hit = alive[here >= 0]
                here = here[here >= 0]
                alone[hit] |= nexts[hit, at] == i + 1
                total = best[hit, at] + scores[here]
                better = total > best[hit, i + 1]
                hit, here = hit[better], here[better]
                best[hit, i + 1], start[hit, i + 1], piece[hit, i + 1] = total[better], at, here
            rows = rows[~alone[rows]]
            ends, total = nexts[rows, at], best[rows, at] + self.penalty
            better = total > best[rows, ends]
            rows, ends = rows[better], ends[better]
            best[rows, ends], start[rows, ends], piece[rows, ends] = total[better], at, -1
        steps, each, now = [], np.arange(count), np.full(count, n)
        whole = np.ones(count, bool)
        while (now > 0).any():
            steps.append(np.where(now > 0, piece[each, now], -2))
            whole &= steps[-1] != -1
            now = np.where(now > 0, start[each, now], 0)
        table = np.stack(steps[::-1], 1)
        used = (table != -2).sum(1).tolist()
        return [tuple(row[len(row) - k:]) if fine else None for row, k, fine in zip(table.tolist(), used, whole.tolist())]

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        """Pieces of each text; unknown words of all of them are solved together."""
        split = [self.split(MARK + text.replace(" ", MARK)) if text else [] for text in texts]
        needed = set().union(*split)
        new = needed.difference(self.words)
        if len(self.words) + len(new) > self.remember:
            self.words.clear()
            new = needed
        solved = dict(self._solve(list(new)))
        known = self.words
        if len(solved) <= self.remember:
            known.update((w, ids) for w, ids in solved.items() if len(w) <= LONG_WORD)
        out = []
        for words in split:
            found = list(map(known.get, words))
            if None in found:
                found = [solved[w] if ids is None else ids for w, ids in zip(words, found)]
            out.append(list(chain.from_iterable(found)))
        return out

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0]

    def decode(self, ids: list[int]) -> str:
        try:
            text = "".join(map(self.plain.__getitem__, ids))
        except TypeError:  # a byte or an unknown piece
            out, run = [], bytearray()
            for i in ids:
                if i in self.byte_of:
                    run.append(self.byte_of[i])
                    continue
                if run:
                    out.append(run.decode("utf-8", "replace"))
                    run = bytearray()
                plain = self.plain[i]
                out.append(plain if plain is not None else " ⁇ " if i == self.unknown else "")
            out.append(run.decode("utf-8", "replace"))
            text = "".join(out)
        return text[1:] if text.startswith(" ") else text


def encode_decode(docs: DataFrame, model: str = DEFAULT_MODEL, id_col: str = "doc_id", text_col: str = "text",
                  remember: int = 400_000) -> DataFrame:
    """One row per input row: ``doc_id, pieces array<int>, n_pieces, n_bytes, round_trip, decoded``.

    ``decoded`` is the text got back from the pieces alone; ``round_trip`` says that it
    equals the input. They are equal unless the text holds the marker character itself,
    which decodes as a space. Null and empty texts have no pieces and decode to the empty
    text. Null ids, repeated rows and other columns do not matter; the rows of a task are
    encoded one after the other, and only remembered words stay in memory.
    """
    spark = docs.sparkSession
    pieces = read_pieces(model)
    trie = Unigram(pieces).trie
    shared = spark.sparkContext.broadcast({"pieces": pieces, "trie": (trie.base, trie.check, trie.value)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value  # lives as long as the Python worker
        if "coder" not in vocabulary:
            vocabulary["coder"] = Unigram(vocabulary["pieces"], remember, vocabulary["trie"])
        coder = vocabulary["coder"]
        is_byte = np.zeros(len(coder.pieces), bool)
        is_byte[list(coder.byte_of)] = True
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [text or "" for text in part.column(1).to_pylist()]
                coded = coder.encode_all(texts)
                back = [coder.decode(pieces) for pieces in coded]
                offsets = np.cumsum([0, *map(len, coded)])
                flat = np.fromiter(chain.from_iterable(coded), np.int32, int(offsets[-1]))
                bytes_before = np.concatenate([[0], np.cumsum(is_byte[flat])])
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.ListArray.from_arrays(offsets.astype(np.int32), flat),
                    pa.array(np.diff(offsets), pa.int64()), pa.array(bytes_before[offsets[1:]] - bytes_before[offsets[:-1]], pa.int64()),
                    pa.array([x == y for x, y in zip(back, texts)]), pa.array(back, pa.string())],
                    ["doc_id", "pieces", "n_pieces", "n_bytes", "round_trip", "decoded"])
        coder.words.clear()  # the worker may go on to other stages

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, pieces array<int>, n_pieces bigint, n_bytes bigint, round_trip boolean, decoded string")
