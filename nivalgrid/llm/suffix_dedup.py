"""Removal of byte strings that also occur in a document with a smaller id.

The order of suffixes is needed only to a depth of ``length`` bytes, so the
difference-cover scheme is cut to that depth. A cover that samples fixed residues
would keep a fifth of all positions or more; here the sample is synchronised with the
text instead: every window of ``length`` bytes samples the position of its smallest
``seed``-byte hash, so equal windows always sample the same place, and about one
position in sixteen remains.

1. Sampled strings get names (hashes); names are sorted, and those met in two
   documents are kept.
2. Windows around kept names are the remaining suffixes. They are merged in the order
   of (hash, id), first within a group of documents, then between groups: only
   windows of the smallest id within a group travel.
3. Neighbours in that order are compared byte by byte; a window behind an equal one
   of a smaller id is removed.

Documents are dealt by hash into groups of about ``group_mb``, and names into as many
buckets, so a group stays the same size however large the table is. A string that
very many documents share is one entry per group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shingles import _BASE, _INVERSE, _VALUES as _FOLDED, _powers, mix

_RAW = _FOLDED.copy()
_RAW[65:91] = np.random.default_rng(77).integers(1, 2 ** 63, 26, dtype=np.uint64) * np.uint64(2) + np.uint64(1)  # case counts here
PLACE = np.uint64((1 << 24) - 1)  # low bits of a sample key hold the position
SEGMENT = 1 << 20
NO_ID = np.iinfo(np.int64).max  # a null id comes last
NAME_BYTES = 6  # of a name that travel; fewer bytes only let more names pass the first step


class Bytes:
    """Rolling hashes over a stretch of bytes."""

    up = np.zeros(0, np.uint64)
    down = np.zeros(0, np.uint64)

    def __init__(self, data: np.ndarray):
        if len(Bytes.up) < len(data) + 1:
            Bytes.up, Bytes.down = (_powers(b, max(len(data) + 1, SEGMENT + 4096)) for b in (_BASE, _INVERSE))
        self.data = data
        self.total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_RAW[data] * Bytes.up[:len(data)], dtype=np.uint64)])

    def hashes(self, width: int, at: np.ndarray | None = None) -> np.ndarray:
        if at is None:
            n = len(self.data) - width + 1
            return mix((self.total[width:] - self.total[:n]) * Bytes.down[:n])
        return mix((self.total[at + width] - self.total[at]) * Bytes.down[at])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while 2 * span <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[:len(x) - (width - span)], x[width - span:]) if width > span else x


class Group:
    """The documents of a group in the order of id and text, cut into stretches of about ``SEGMENT`` bytes."""

    def __init__(self, table: pa.Table, length: int, seed: int):
        self.length, self.seed = length, seed
        table = table.select(["doc_id", "text"]).sort_by([("doc_id", "ascending"), ("text", "ascending")])
        self.ids = table.column("doc_id").combine_chunks()
        self.id_values = self.ids.fill_null(NO_ID).to_numpy()
        text = table.column("text").cast(pa.large_binary()).fill_null(b"").combine_chunks()
        text = text if isinstance(text, pa.Array) else text.chunk(0)
        n = len(text)
        self.offsets = np.frombuffer(text.buffers()[1], np.int64, n + 1 + text.offset)[text.offset:] if n else np.zeros(1, np.int64)
        self.data = np.frombuffer(text.buffers()[2], np.uint8) if n and text.buffers()[2] else np.zeros(0, np.uint8)

    def stretches(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """``(begin, end, last)``: bytes to look at, and the first position of each document end within, for whole documents;
        a longer document is cut into overlapping stretches."""
        off, n, at = self.offsets, len(self.offsets) - 1, 0
        while at < n:
            stop = max(at + 1, int(np.searchsorted(off, off[at] + SEGMENT, "right")) - 1)
            if off[stop] - off[at] <= 2 * SEGMENT:
                yield int(off[at]), int(off[stop]), off[at + 1:stop + 1]
            else:
                for b in range(int(off[at]), int(off[stop]), SEGMENT):
                    e = min(b + SEGMENT + self.length - 1, int(off[stop]))
                    if e - b >= self.length:
                        yield b, e, off[stop:stop + 1]
            at = stop

    def windows(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, Bytes, int]]:
        """Per stretch: window starts, their sampled places (both relative), names of the places, hashes, and the begin."""
        length, seed = self.length, self.seed
        for begin, end, ends in self.stretches():
            if end - begin < length:
                continue
            roll = Bytes(self.data[begin:end])
            grams = roll.hashes(seed)
            keys = (grams & ~PLACE) | np.arange(len(grams), dtype=np.uint64)
            low = sliding_min(keys, length - seed + 1)
            ok = np.ones(len(low), bool)
            for e in (ends - begin).tolist():
                ok[max(0, e - length + 1):e] = False
            starts = np.flatnonzero(ok)
            places = (low[starts] & PLACE).astype(np.int64)
            yield starts, places, mix(grams ^ np.uint64(0xA5A5A5A5A5A5A5A5)), roll, begin


def _cut(names: np.ndarray) -> np.ndarray:
    return names >> np.uint64(8 * (8 - NAME_BYTES))


def _pack(values: np.ndarray) -> bytes:
    """Sorted numbers by byte planes, which compress well."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :NAME_BYTES].T).tobytes()


def _unpack(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(blob, np.uint8).reshape(NAME_BYTES, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :NAME_BYTES] = planes.T
    return out.view("<u8").ravel().astype(np.uint64)


def _bucket(cut_names: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(cut_names) % np.uint64(buckets)).astype(np.int64)


def sample_names(table: pa.Table, buckets: int, length: int, seed: int) -> pa.Table:
    """Names of a group by bucket; those met in two documents of the group separately."""
    group, q = Group(table, length, seed), table.column("q")[0].as_py()
    names, owners = [], []
    for starts, places, all_names, _, begin in group.windows():
        places = np.unique(places)
        names.append(_cut(all_names[places]))
        owners.append(group.id_values[np.searchsorted(group.offsets, places + begin, "right") - 1])
    name, owner = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((names, np.uint64), (owners, np.int64)))
    order = np.lexsort((owner, name))
    name, owner = name[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]])) if len(name) else np.zeros(0, np.int64)
    last = np.concatenate([first[1:], [len(name)]]) - 1 if len(first) else first
    shared = owner[first] != owner[last]
    name = name[first]
    bucket = _bucket(name, buckets)
    by = np.argsort(bucket, kind="stable")
    cut = np.searchsorted(bucket[by], np.arange(buckets + 1))
    rows: dict[str, list] = {"bucket": [], "q": [], "one": [], "many": []}
    for b in range(buckets):
        mine = by[cut[b]:cut[b + 1]]
        if len(mine):
            rows["bucket"].append(b)
            rows["q"].append(q)
            rows["one"].append(_pack(name[mine[~shared[mine]]]))
            rows["many"].append(_pack(name[mine[shared[mine]]]))
    return pa.table(rows, pa.schema([("bucket", pa.int64()), ("q", pa.int64()), ("one", pa.binary()), ("many", pa.binary())]))


def repeated_names(table: pa.Table) -> pa.Table:
    """Names of a bucket that occur in two documents, sent back to the groups that have them."""
    qs = table.column("q").to_numpy()
    parts, group, sure = [], [], []
    for i, q in enumerate(qs.tolist()):
        for column, flag in (("one", False), ("many", True)):
            x = _unpack(table.column(column)[i].as_py())
            parts.append(x)
            group.append(np.full(len(x), q))
            sure.append(np.full(len(x), flag))
    name, group, sure = np.concatenate(parts), np.concatenate(group), np.concatenate(sure)
    _, index, count = np.unique(name, return_inverse=True, return_counts=True)
    known = np.zeros(len(count), bool)
    known[index[sure]] = True
    keep = (count[index] > 1) | known[index]
    name, group = name[keep], group[keep]
    order = np.lexsort((name, group))
    name, group = name[order], group[order]
    cut = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]])) if len(group) else np.zeros(1, np.int64)
    return pa.table({"q": pa.array([int(group[a]) for a in cut[:-1]], pa.int64()),
                     "names": pa.array([_pack(name[a:b]) for a, b in zip(cut[:-1], cut[1:])], pa.binary())})


def _ordered_runs(data: np.ndarray, at: np.ndarray, hashes: np.ndarray, rank: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of windows by (content, rank), and where a new content begins, after comparing neighbours byte by byte."""
    order = np.lexsort((rank, hashes))
    h, p = hashes[order], at[order]
    new = np.ones(len(order), bool)
    new[1:] = h[1:] != h[:-1]
    same = np.flatnonzero(~new)
    step = np.arange(length)
    odd = False
    for lo in range(0, len(same), 50_000):
        k = same[lo:lo + 50_000]
        if (data[p[k][:, None] + step] != data[p[k - 1][:, None] + step]).any():
            odd = True
    if odd:  # two contents with one hash: order by the bytes themselves
        whole = np.ascontiguousarray(data[at[:, None] + step]).view(f"V{length}").ravel()
        _, content = np.unique(whole, return_inverse=True)
        order = np.lexsort((rank, content))
        new[1:] = content[order][1:] != content[order][:-1]
    return order, new


def _behind(order: np.ndarray, new: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Per window: has an equal one a smaller id."""
    lowest = ids[order][new][np.cumsum(new) - 1]
    removed = np.zeros(len(order), bool)
    removed[order] = ids[order] > lowest
    return removed


def _intervals(starts: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of runs of consecutive starts of one owner."""
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = (starts[1:] != starts[:-1] + 1) | (owner[1:] != owner[:-1])
    return np.concatenate([[0], np.flatnonzero(edge) + 1]), np.concatenate([np.flatnonzero(edge), [len(starts) - 1]])


SPANS = np.dtype([("doc", "<u4"), ("a", "<i8"), ("b", "<i8")])
PIECES = np.dtype([("id", "<i8"), ("doc", "<u4"), ("a", "<i8"), ("n", "<u1")])


def local_windows(table: pa.Table, names: pa.Table, buckets: int, length: int, seed: int) -> pa.Table:
    """Windows with a repeated name: removed ones of the group itself, and those of the smallest id for the other groups, by bucket."""
    schema = pa.schema([("bucket", pa.int64()), ("q", pa.int64()), ("pieces", pa.binary()), ("text", pa.binary()), ("spans", pa.binary())])
    if not table.num_rows or not names.num_rows:
        return schema.empty_table()
    group, q = Group(table, length, seed), table.column("q")[0].as_py()
    known = np.unique(np.concatenate([_unpack(x) for x in names.column("names").to_pylist()]))
    starts, hashes, bucket = [], [], []
    for s, places, all_names, roll, begin in group.windows():
        name = _cut(all_names[places])
        at = np.searchsorted(known, name)
        at[at == len(known)] = 0
        hit = known[at] == name
        starts.append(s[hit] + begin)
        hashes.append(roll.hashes(length, s[hit]))
        bucket.append(_bucket(name[hit], buckets))
    if not starts:
        return schema.empty_table()
    starts, hashes, bucket = np.concatenate(starts), np.concatenate(hashes), np.concatenate(bucket)
    doc = np.searchsorted(group.offsets, starts, "right") - 1
    order, new = _ordered_runs(group.data, starts, hashes, doc, length)
    removed = _behind(order, new, group.id_values[doc])
    rows: dict[str, list] = {"bucket": [], "q": [], "pieces": [], "text": [], "spans": []}
    gone = np.flatnonzero(removed)
    f, t = _intervals(starts[gone], doc[gone])
    spans = np.zeros(len(f), SPANS)
    spans["doc"] = doc[gone][f]
    spans["a"], spans["b"] = starts[gone][f] - group.offsets[doc[gone][f]], starts[gone][t] - group.offsets[doc[gone][f]]
    rows["bucket"].append(q % buckets)
    rows["q"].append(q)
    rows["pieces"].append(b"")
    rows["text"].append(b"")
    rows["spans"].append(spans.tobytes())
    send = np.flatnonzero(~removed)
    send = send[np.argsort(bucket[send], kind="stable")]
    cut = np.searchsorted(bucket[send], np.arange(buckets + 1))
    for b in range(buckets):
        mine = send[cut[b]:cut[b + 1]]
        if not len(mine):
            continue
        f, t = _intervals(starts[mine], doc[mine])
        n = t - f + 1
        more = np.repeat(np.arange(len(f)), -(-n // 200))  # a piece holds at most 200 windows
        part = np.arange(len(more)) - np.repeat(np.cumsum(-(-n // 200)) - -(-n // 200), -(-n // 200))
        f, n = f[more] + 200 * part, np.minimum(200, n[more] - 200 * part)
        pieces = np.zeros(len(f), PIECES)
        where = starts[mine][f]
        pieces["doc"], pieces["id"], pieces["n"] = doc[mine][f], group.id_values[doc[mine][f]], n
        pieces["a"] = where - group.offsets[doc[mine][f]]
        rows["bucket"].append(b)
        rows["q"].append(q)
        rows["pieces"].append(pieces.tobytes())
        rows["text"].append(group.data[_ranges(where, n + length - 1)].tobytes())
        rows["spans"].append(b"")
    return pa.table(rows, schema)


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """All positions of the ranges ``start[i] .. start[i] + n[i] - 1``."""
    if not len(n):
        return np.zeros(0, np.int64)
    ends = np.cumsum(n)
    return np.arange(ends[-1]) + np.repeat(start - (ends - n), n)


def merge_windows(table: pa.Table, length: int) -> pa.Table:
    """Windows of a bucket from all groups: those with an equal one of a smaller id go back to their group as spans."""
    q = table.column("q").to_numpy()
    pieces = [np.frombuffer(x, PIECES) for x in table.column("pieces").to_pylist()]
    data = np.frombuffer(b"".join(table.column("text").to_pylist()), np.uint8)
    group = np.repeat(q, [len(p) for p in pieces])
    piece = np.concatenate(pieces)
    out = {int(g): [x] for g, x in zip(q.tolist(), table.column("spans").to_pylist()) if x}
    if len(piece):
        n = piece["n"].astype(np.int64)
        begin = np.concatenate([[0], np.cumsum(n + length - 1)])[:-1]
        at = _ranges(begin, n)
        of = np.repeat(np.arange(len(piece)), n)
        ids = piece["id"][of]
        hashes = Bytes(data).hashes(length, at)
        order, new = _ordered_runs(data, at, hashes, ids, length)
        gone = np.flatnonzero(_behind(order, new, ids))
        f, t = _intervals(at[gone], of[gone])
        owner = of[gone][f]
        spans = np.zeros(len(f), SPANS)
        spans["doc"] = piece["doc"][owner]
        spans["a"] = piece["a"][owner] + at[gone][f] - begin[owner]
        spans["b"] = spans["a"] + (t - f)
        by = np.argsort(group[owner], kind="stable")
        cut = np.flatnonzero(np.concatenate([[True], np.diff(group[owner][by]) != 0, [True]])) if len(by) else np.zeros(1, np.int64)
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
            out.setdefault(int(group[owner][by[a]]), []).append(spans[by[a:b]].tobytes())
    return pa.table({"q": pa.array(list(out), pa.int64()), "spans": pa.array([b"".join(x) for x in out.values()], pa.binary())})


def kept_texts(table: pa.Table, spans: pa.Table, length: int, seed: int, with_text: bool) -> pa.Table:
    group = Group(table, length, seed)
    found = np.frombuffer(b"".join(spans.column("spans").to_pylist()), SPANS) if spans.num_rows else np.zeros(0, SPANS)
    found = found[np.argsort(found["doc"], kind="stable")]
    cut = np.searchsorted(found["doc"], np.arange(len(group.ids) + 1))
    n_bytes, n_removed, n_spans, digest, texts = [], [], [], [], []
    for i in range(len(group.ids)):
        data = group.data[group.offsets[i]:group.offsets[i + 1]]
        mine = found[cut[i]:cut[i + 1]]
        n_bytes.append(len(data))
        if len(mine):
            change = np.zeros(len(data) + 1, np.int64)
            np.add.at(change, mine["a"], 1)
            np.add.at(change, mine["b"] + length, -1)
            gone = np.cumsum(change[:-1]) > 0
            n_spans.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
            n_removed.append(int(gone.sum()))
            data = data[~gone]
        else:
            n_spans.append(0)
            n_removed.append(0)
        raw = data.tobytes()
        digest.append(hashlib.sha256(raw).hexdigest())
        if with_text:
            texts.append(raw)
    out = {"doc_id": group.ids, "n_bytes": pa.array(n_bytes, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()),
           "n_spans": pa.array(n_spans, pa.int64()), "kept_sha256": pa.array(digest, pa.string())}
    if with_text:
        out["kept"] = pa.array(texts, pa.binary())
    return pa.table(out)


def suffix_dedup(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", group_mb: float = 4.0,
                 least_groups: int = 64, with_text: bool = False) -> DataFrame:
    """One row per input row: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` (and ``kept`` bytes on request).

    A byte goes if a string of ``length`` bytes that covers it also starts in a document of a smaller id;
    strings are those of the input. Null text is empty. A null id counts as larger
    than any other; documents with one id (repeated rows) do not remove from each other. Texts
    shorter than ``length`` stay. Other columns are not read; an empty table stays empty.
    """
    seed = max(1, length * 2 // 5)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(least_groups, int(-(-total // int(group_mb * 1e6))))
    rows = rows.withColumn("q", F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)))

    def names(table: pa.Table) -> pa.Table:
        return sample_names(table, groups, length, seed)

    def local(left: pa.Table, right: pa.Table) -> pa.Table:
        return local_windows(left, right, groups, length, seed)

    def merge(table: pa.Table) -> pa.Table:
        return merge_windows(table, length)

    kind = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + (", kept binary" if with_text else "")

    def final(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return kept_texts(left.slice(0, 0), right.slice(0, 0), length, seed, with_text)
        return kept_texts(left, right, length, seed, with_text)

    # one plan: the three steps that look at texts share the exchange that deals them out
    sampled = rows.groupBy("q").applyInArrow(names, "bucket bigint, q bigint, one binary, many binary")
    repeated = sampled.groupBy("bucket").applyInArrow(repeated_names, "q bigint, names binary")
    windows = rows.groupBy("q").cogroup(repeated.groupBy("q")).applyInArrow(
        local, "bucket bigint, q bigint, pieces binary, text binary, spans binary")
    spans = windows.groupBy("bucket").applyInArrow(merge, "q bigint, spans binary")
    return rows.groupBy("q").cogroup(spans.groupBy("q")).applyInArrow(final, kind)
