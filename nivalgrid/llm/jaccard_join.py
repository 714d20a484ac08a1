"""N-gram Jaccard join by T-occurrence search.

Documents with equal shingle sets form a class and are compared once. A class can
link only with classes that share several tokens of its prefix, the first tokens in
an order that puts frequent ones last. Inverted lists of prefix tokens give, per
class, the classes that occur in enough of its lists (T-occurrence: DivideSkip merges
the short lists and probes the long ones); a list that many classes share only joins
its classes to one cell. Which tokens are frequent is counted twice, first per task and then on the
prefixes that follow, so that few lists are that long. Connected candidates form cells, and only their texts
are moved (they compress, shingle sets do not). Inside a cell DivideSkip runs over whole sets with the exact overlap that
the threshold asks for; classes already connected are not compared again, because
only links between different components matter.

Cells beyond ``BLOCK`` classes are split into blocks. Blocks are joined first, then a few
members of each component found, until one block is left; last,
signatures that bound the overlap from above show which classes of different components
may still link, and only their texts meet.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .components import components
from .shingles import Shingler

OCCUR = 8  # prefix tokens that a candidate must share; fewer in small sets
SHORT = 64  # classes on an inverted list that is still merged
BLOCK = 256
BLOCK_TOKENS = 200_000
PARTS = 256  # of a signature
WIDE = 1024  # signatures in a block
FILTER_BITS = 1 << 23
LEADERS = 4
HOT_TOKENS = 500_000  # bound of the broadcast table of frequent tokens; it only sets the order of tokens
LOCAL_COUNT = 4


def least_overlap(n: int, percent: int) -> int:
    """Overlap that a set of n tokens needs with any partner."""
    return -(-n * percent // 100)


def pair_overlap(n: int, m: np.ndarray | int, percent: int):
    """Smallest overlap o with 100 o >= percent (n + m - o)."""
    return -(-percent * (n + m) // (100 + percent))


def occur(n: int, percent: int) -> int:
    """Prefix tokens that a set of n shares at least with any partner, whose own prefix may be as short as the smallest partner's."""
    return max(1, min(OCCUR, least_overlap(least_overlap(n, percent), percent)))


def set_key(tokens: np.ndarray) -> int:
    """64-bit name of a set; two of N different sets share one with a chance of about N^2 / 2^65."""
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def divide_skip(lists: list[np.ndarray], need: int, universe: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids that occur on at least ``need`` of the sorted ``lists``, and how often.

    The ``need - 1`` longest lists are set aside: an id that reaches ``need`` occurs on at least
    one of the others. These are merged (by a heap while they are few, else by sorting),
    and each id found is looked up in the long lists by binary search.
    """
    empty = np.zeros(0, np.int64)
    if need < 1 or len(lists) < need:
        return empty, empty
    lists = sorted(lists, key=len)
    short, long = lists[:len(lists) - need + 1], lists[len(lists) - need + 1:]
    entries = sum(map(len, short))
    if entries <= 64:
        ids, counts, last = [], [], None
        for x in heapq.merge(*[s.tolist() for s in short]):
            if x == last:
                counts[-1] += 1
            else:
                ids.append(x)
                counts.append(1)
                last = x
        found, count = np.array(ids, np.int64), np.array(counts, np.int64)
    else:
        found, count = np.unique(np.concatenate(short), return_counts=True)
    for i, probe in enumerate(long):
        if not len(found):
            break
        where = np.searchsorted(probe, found)
        where[where == len(probe)] = 0
        count = count + (probe[where] == found if len(probe) else 0)
        alive = count + (len(long) - 1 - i) >= need
        if not alive.all():
            found, count = found[alive], count[alive]
    return found[count >= need], count[count >= need]


class Forest:
    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, x: int) -> int:
        p = self.parent
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def link_sets(sets: list[np.ndarray], percent: int, group: np.ndarray, tried: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links between sets of different components, enough of them to connect what is linked.

    ``group`` gives components known before. With ``tried``, a 0/1 side per set, only sets of
    different sides meet.
    """
    n = len(sets)
    forest = Forest(n)
    known: dict[int, int] = {}
    for i, g in enumerate(group.tolist()):
        forest.join(i, known.setdefault(g, i))
    order = sorted(range(n), key=lambda i: len(sets[i]))
    sizes = np.array([len(sets[i]) for i in order], np.int64)
    flat = np.concatenate([sets[i] for i in order]) if n else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(n), sizes)
    _, token = np.unique(flat, return_inverse=True)
    by = np.argsort(token, kind="stable")
    bounds = np.concatenate([[0], np.cumsum(np.bincount(token))]) if len(token) else np.zeros(1, np.int64)
    posted = owner[by]
    place = np.empty(len(by), np.int64)
    place[by] = np.arange(len(by))
    starts = np.concatenate([[0], np.cumsum(sizes)])
    roots = np.array([forest.root(i) for i in order])
    side = None if tried is None else tried[order]
    out = []
    for q in range(1, n):
        need = least_overlap(int(sizes[q]), percent)
        low = int(np.searchsorted(sizes[:q], need))  # smaller sets that are large enough
        if low >= q or (roots[low:q] == roots[q]).all():
            continue
        mine = slice(starts[q], starts[q + 1])
        begin, here = bounds[token[mine]], place[mine]
        # own place on a list: what stands before it are smaller sets
        lists = [posted[b:h] for b, h in zip(begin.tolist(), here.tolist()) if h > b]
        lists = [x[np.searchsorted(x, low):] for x in lists] if low else lists
        found, count = divide_skip([x for x in lists if len(x)], need, n)
        good = count >= pair_overlap(int(sizes[q]), sizes[found], percent) if len(found) else found
        for s in found[good].tolist() if len(found) else ():
            if side is not None and side[s] == side[q]:
                continue
            if forest.join(order[q], order[s]):
                out.append((order[q], order[s]))
        if out:
            roots[q] = forest.root(order[q])
            roots = np.array([forest.root(i) for i in order]) if len(found) else roots
    return out


def _token_counts(percent: int, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, kept, size = Shingler(words), [], 0

        def flush():
            token, count = np.unique(np.concatenate(kept), return_counts=True)
            many = count >= LOCAL_COUNT
            return pa.RecordBatch.from_arrays([pa.array(token[many].view(np.int64)), pa.array(count[many].astype(np.int64))], ["token", "n"])

        for batch in batches:
            for tokens in shingler.sets(batch.column(0)):
                kept.append(tokens)
                size += len(tokens)
                if size > 3_000_000:
                    yield flush()
                    kept, size = [], 0
        if kept:
            yield flush()
    return run


def _prefix(tokens: np.ndarray, percent: int, hot: np.ndarray, hot_rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First tokens of a set, enough for ``OCCUR`` common ones: others by their hash, then frequent ones by their rank."""
    n = len(tokens)
    few = least_overlap(n, percent)
    if n == 0 or 100 * n < percent * (n + 1):
        return tokens[:0], tokens[:0]  # nothing but an equal set can link
    take = min(n, n - few + min(OCCUR, few))
    at = np.searchsorted(hot, tokens)
    at[at == len(hot)] = 0
    is_hot = hot[at] == tokens if len(hot) else np.zeros(n, bool)
    cold = tokens[~is_hot][:take]
    return cold, tokens[is_hot][np.argsort(hot_rank[at[is_hot]], kind="stable")][:take - len(cold)]


def _cold_tokens(percent: int, words: int, hot: np.ndarray, hot_rank: np.ndarray):
    """Prefix tokens that are not known as frequent, of each set once in a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, seen = Shingler(words), set()
        for batch in batches:
            found = [np.zeros(0, np.uint64)]
            for tokens in shingler.sets(batch.column(0)):
                key = set_key(tokens)
                if key not in seen:
                    seen.add(key)
                    found.append(_prefix(tokens, percent, hot, hot_rank)[0])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], ["token"])
    return run


def _prefixes(percent: int, words: int, hot: np.ndarray, hot_rank: np.ndarray):
    """Per text ``(doc_id, n, key, rare, frequent)``; token lists only for the first text of a set in a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, seen = Shingler(words), set()
        for batch in batches:
            ns, keys, rare, frequent = [], [], [], []
            for tokens in shingler.sets(batch.column(1)):
                n = len(tokens)
                key = set_key(tokens) if n else None
                ns.append(n)
                keys.append(key)
                cold, more = _prefix(tokens if key not in seen else tokens[:0], percent, hot, hot_rank)
                seen.add(key)
                rare.append(cold.view(np.int64))
                frequent.append(more.view(np.int64))
            lists = [pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(x) for x in part])]).astype(np.int32),
                                              np.concatenate(part) if part else np.zeros(0, np.int64)) for part in (rare, frequent)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ns, pa.int64()), pa.array(keys, pa.int64()), *lists],
                                             ["doc_id", "n", "key", "rare", "frequent"])
    return run


def _runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """Cuts sorted batches so that a key never continues in the next one, while a key fits in memory as a list of ids."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(key).to_numpy()
        if held and held[-1].column(key)[0].as_py() == k[0] and k[0] == k[-1]:
            held.append(batch)
            continue
        change = np.flatnonzero(k[1:] != k[:-1])
        if held:
            stop = 0 if held[-1].column(key)[0].as_py() != k[0] else int(change[0]) + 1
            yield pa.Table.from_batches([*held, batch.slice(0, stop)]).combine_chunks().to_batches()[0]
            batch, k = batch.slice(stop), k[stop:]
            change = np.flatnonzero(k[1:] != k[:-1])
        last = int(change[-1]) + 1 if len(change) else 0
        if last:
            yield batch.slice(0, last)
        held = [batch.slice(last)]
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Inverted lists from rows sorted by token: ``(query, n, list, sizes)`` with the smaller classes on the list.

    A list beyond ``SHORT`` gives one-element rows marked ``sure`` that tie its classes together.
    """
    for batch in _runs(batches, "token"):
        token, key, n = (batch.column(c).to_numpy() for c in ("token", "key", "n"))
        order = np.lexsort((key, token))
        token, key, n = token[order], key[order], n[order]
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (key[1:] != key[:-1])  # a class may come from several tasks
        token, key, n = token[new], key[new], n[new].astype(np.int32)
        first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        size = np.diff(np.concatenate([first, [len(token)]]))
        query, own, lists, sizes, sure = [], [], [], [], []
        for f, s in zip(first[size > 1].tolist(), size[size > 1].tolist()):
            members, counts = key[f:f + s], n[f:f + s]
            query.append(members[1:])
            own.append(counts[1:])
            for many, column in ((lists, members), (sizes, counts)):
                many.extend([column[:1]] * (s - 1) if s > SHORT else [column[:i] for i in range(1, s)])
            sure.extend([s > SHORT] * (s - 1))
        if query:
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(query)), pa.array(np.concatenate(own)),
                                              *[pa.ListArray.from_arrays(offsets, np.concatenate(x)) for x in (lists, sizes)],
                                              pa.array(sure)], ["query", "n", "list", "sizes", "sure"])


def _search(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """T-occurrence over the lists of each query: ``(a, b)`` for classes of fitting size on enough of them."""
    for batch in _runs(batches, "query"):
        query, sure = batch.column("query").to_numpy(), batch.column("sure").to_numpy(zero_copy_only=False)
        column, n = batch.column("list"), batch.column("n").to_numpy()
        flat_sizes = batch.column("sizes").flatten().to_numpy()
        flat, offsets = column.flatten().to_numpy(), np.concatenate([[0], np.cumsum(pc.list_value_length(column).to_numpy())])
        cut = np.concatenate([[0], np.flatnonzero(query[1:] != query[:-1]) + 1, [len(query)]])
        a, b = [], []
        for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist()):
            size = int(n[lo])
            need = occur(size, percent)
            if hi - lo < need and not sure[lo:hi].any():
                continue
            parts = [flat[offsets[i]:offsets[i + 1]] for i in range(lo, hi)]
            found, _ = divide_skip([p for p, s in zip(parts, sure[lo:hi]) if not s], need, 0)
            if len(found):
                ids, where = np.unique(flat[offsets[lo]:offsets[hi]], return_index=True)
                other = flat_sizes[offsets[lo]:offsets[hi]][where[np.searchsorted(ids, found)]]
                found = found[np.minimum(other, size) * 100 >= np.maximum(other, size) * percent]
            tied = [p[0] for p, s in zip(parts, sure[lo:hi]) if s]
            others = set(found.tolist()) | {int(t) for t in tied}
            a.extend([query[lo]] * len(others))
            b.extend(others)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _frequent_ties(rows: DataFrame) -> DataFrame:
    """Classes with a frequent token in their prefix are tied to the smallest class that has it."""
    low = rows.groupBy("token").agg(F.min("key").alias("b"))
    return rows.join(low, "token").where(F.col("key") != F.col("b")).select(F.col("key").alias("a"), "b").distinct()


def signature(tokens: np.ndarray) -> bytes:
    """Numbers of tokens in ``PARTS`` parts of the hash range: the sum of smaller numbers bounds the overlap of two sets."""
    return np.minimum(np.bincount((tokens >> np.uint64(20) & np.uint64(PARTS - 1)).astype(np.int64), minlength=PARTS), 65535).astype("<u2").tobytes()


def _may_link(percent: int):
    """For a pair of signature blocks: classes that may link with one of another component on the other side."""
    def run(table: pa.Table) -> pa.Table:
        key, n, grp, side = (table.column(c).to_numpy() for c in ("key", "n", "grp", "side"))
        marks = np.frombuffer(b"".join(table.column("signature").to_pylist()), "<u2").reshape(-1, PARTS)
        a = np.flatnonzero(side != 2)
        b = a if (side == 2).sum() == 0 else np.flatnonzero(side == 2)
        other, size, name = marks[b], n[b], grp[b]
        hit = np.zeros(len(key), bool)
        for i in a.tolist():
            bound = np.minimum(marks[i], other).sum(1, dtype=np.int64)
            ok = ((bound >= pair_overlap(int(n[i]), size, percent)) | (max(int(n[i]), 0) > 60000)) & (name != grp[i])
            if ok.any():
                hit[i] = True
                hit[b[ok]] = True
        return pa.table({"cell": table.column("cell").take(pa.array(np.flatnonzero(hit))), "block": table.column("block").take(pa.array(np.flatnonzero(hit))),
                         "key": pa.array(key[hit], pa.int64()), "grp": pa.array(grp[hit], pa.int64())})
    return run


ROWS = "a bigint, b bigint, cell bigint, leader boolean, n bigint, signature binary, text string"


def _join_blocks(percent: int, words: int, first: bool):
    """For one block of a cell: its links, and in a split cell its members with their texts.

    ``LEADERS`` members of each large component (at most an eighth of the block) are marked.
    ``first``: all members of split cells are returned, else only leaders.
    """
    def run(table: pa.Table) -> pa.Table:
        keys = table.column("key").to_numpy()
        texts = table.column("text").combine_chunks()
        sets = []
        for part in (texts.chunks if isinstance(texts, pa.ChunkedArray) else [texts]):
            sets.extend(Shingler(words).sets(part))
        # an id may stand for several texts, and a class may have been sent twice
        right = {int(k): i for i, (k, s) in enumerate(zip(keys, sets)) if len(s) and set_key(s) == k}
        index = np.array(sorted(right.values()), np.int64)
        keys, sets = keys[index], [sets[i] for i in index]
        group, side = (table.column(c).to_numpy()[index] for c in ("grp", "side"))
        links = link_sets(sets, percent, group, side if len(side) and side.min() >= 0 else None)
        a, b, who, lead = [int(keys[i]) for i, _ in links], [int(keys[j]) for _, j in links], [], []
        if len(index) and table.column("split")[0].as_py():
            forest = Forest(len(sets))
            for i, j in links:
                forest.join(i, j)
            members: dict[int, list[int]] = {}
            for i in range(len(sets)):
                members.setdefault(forest.root(i), []).append(i)
            leaders = {i for m in members.values() if len(m) >= 8 * LEADERS for i in m[:LEADERS]}
            who = list(range(len(sets))) if first else sorted(leaders)
            lead = [i in leaders for i in who]
        n = len(a)
        text = pa.concat_arrays([pa.nulls(n, pa.string()), table.column("text").combine_chunks().cast(pa.string()).take(pa.array(index[who], pa.int64()))
                                 if who else pa.nulls(0, pa.string())])
        cell = table.column("cell")[0].as_py()
        size = [len(sets[i]) for i in who]
        marks = [signature(sets[i]) for i in who] if first else [None] * len(who)
        return pa.table({"a": pa.array(a + [int(keys[i]) for i in who], pa.int64()), "b": pa.array(b + [None] * len(who), pa.int64()),
                         "cell": pa.array([cell] * (n + len(who)), pa.int64()), "leader": pa.array([None] * n + lead, pa.bool_()),
                         "n": pa.array([None] * n + size, pa.int64()), "signature": pa.array([None] * n + marks, pa.binary()), "text": text})
    return run


def _block_links(rows: DataFrame, percent: int, words: int, first: bool = False) -> DataFrame:
    columns = ["cell", "block", "key", "grp", "side", "split", "text"]
    return stored(rows.select(*columns).groupBy("cell", "block").applyInArrow(_join_blocks(percent, words, first), ROWS), "block-links")


def _possible(base: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows whose id may be wanted: a bit array of fixed size saves moving most other texts, and loses none."""
    words = FILTER_BITS // 64
    spread = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))
    bits = (wanted.select(spread(F.col("rep")).alias("h")).groupBy(F.floor(F.col("h") / 64).alias("w"))
            .agg(F.expr("bit_or(shiftleft(1L, CAST(h % 64 AS INT)))").alias("v")).toArrow())
    array = np.zeros(words, np.int64)
    array[bits.column("w").to_numpy()] = bits.column("v").to_numpy()
    shared = base.sparkSession.sparkContext.broadcast(array)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column("h").to_numpy()
            yield batch.filter(pa.array((shared.value[h >> 6] >> (h & 63)) & 1 == 1)).select(["doc_id", "text"])

    rows = base.where("doc_id IS NOT NULL").withColumn("h", spread(F.col("doc_id")))
    return rows.mapInArrow(run, "doc_id bigint, text string")


def _frequent_tokens(base: DataFrame, percent: int, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens that come last in the order, sorted, and a count for each that ranks them.

    Counts per task miss a token that is frequent as a whole but rare in each task; enough of these in prefixes
    would tie most classes into one cell. So the prefixes that follow from the first counts are counted themselves,
    exactly, and what is on more than ``SHORT`` of them is frequent too.
    """
    def top(counts: DataFrame) -> pa.Table:
        return counts.where(F.col("n") > SHORT).orderBy(F.desc("n"), "token").limit(HOT_TOKENS).toArrow()

    def ordered(*parts: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        token, n = (np.concatenate([t.column(c).to_numpy() for t in parts]) for c in ("token", "n"))
        most = np.lexsort((token, -n))[:HOT_TOKENS]
        token, n = token[most].view(np.uint64), n[most]
        order = np.argsort(token)
        return token[order], n[order]

    text = base.select("text")
    sampled = top(text.mapInArrow(_token_counts(percent, words), "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n")))
    shared = base.sparkSession.sparkContext.broadcast(ordered(sampled))

    def cold(batches):
        return _cold_tokens(percent, words, *shared.value)(batches)

    return ordered(sampled, top(text.mapInArrow(cold, "token bigint").groupBy("token").agg(F.count(F.lit(1)).alias("n"))))


def similar_groups(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id``.

    Words are runs of characters other than ASCII white space, A-Z lower-cased; a text with fewer words
    than ``words`` is one shingle. Two documents link when their distinct shingles have a
    Jaccard index of at least ``percent`` / 100. Null and blank texts have no shingles and
    link with nothing, not even each other: they are their own component. A row without
    id belongs to the component of the rows with an equal set that have one, else to none (null). Repeated rows are equal
    sets. Other columns are not read; an empty table stays empty.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    shared = spark.sparkContext.broadcast(_frequent_tokens(base, percent, words))

    def prefixes(batches):
        return _prefixes(percent, words, *shared.value)(batches)

    def search(batches):
        return _search(batches, percent)

    sets = stored(base.mapInArrow(prefixes, "doc_id bigint, n bigint, key bigint, rare array<bigint>, frequent array<bigint>"), "shingle-prefixes")
    rare = sets.select("key", "n", F.explode("rare").alias("token"))
    lists = rare.repartition("token").sortWithinPartitions("token").mapInArrow(
        _lists, "query bigint, n int, list array<bigint>, sizes array<int>, sure boolean")
    pairs = lists.repartition("query").sortWithinPartitions("query").mapInArrow(search, "a bigint, b bigint")
    ties = _frequent_ties(sets.select("key", F.explode("frequent").alias("token")).distinct())
    cells = components(pairs.unionByName(ties))
    members = sets.where("key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"))
    wanted = stored(_in_blocks(cells.join(members, cells["node"] == members["key"]).where("rep IS NOT NULL")
                               .select(F.col("component").alias("cell"), "key", "rep", "n"), percent), "cells")
    texts = _possible(base, wanted)
    rows = (texts.join(wanted, texts["doc_id"] == wanted["rep"]).withColumn("grp", F.col("key")).withColumn("side", F.lit(-1)))
    links = _join_cells(rows, percent, words)
    linked = components(links)
    names = (members.join(linked.withColumnRenamed("node", "key"), "key", "left").select("key", "rep", F.coalesce("component", "key").alias("c")))
    smallest = names.groupBy("c").agg(F.min("rep").alias("component_id"))
    final = names.join(smallest, "c").select("key", "component_id")
    return sets.select("doc_id", "n", "key").join(final, "key", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def _classes(n: str, percent: int):
    step = float(np.log(100.0 / percent)) if percent < 100 else None
    return F.col(n) if step is None else F.floor(F.log(F.greatest(F.col(n), F.lit(1)).cast("double")) / step - 1e-9)


def _in_blocks(rows: DataFrame, percent: int) -> DataFrame:
    """Adds the row's ``block`` within its cell and whether the cell is ``split``; blocks are bounded in classes and in shingles.

    Blocks of a split cell hold sets of like size, so that near copies meet early.
    """
    size = rows.groupBy("cell").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / BLOCK_TOKENS)).alias("blocks"))
    size = size.where("blocks > 1").select(F.col("cell").alias("c")).withColumn("many", F.lit(True))
    rows = rows.join(size, F.col("cell") == F.col("c"), "left").drop("c").withColumn("split", F.coalesce("many", F.lit(False))).drop("many")
    rows = rows.withColumn("_s", F.when(F.col("split"), _classes("n", percent)).otherwise(F.lit(0)))
    parts = rows.where("split").groupBy("cell", "_s").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / BLOCK_TOKENS)).alias("blocks"))
    parts = parts.select(F.col("cell").alias("c"), F.col("_s").alias("cs"), "blocks")
    return (rows.join(parts, (F.col("cell") == F.col("c")) & (F.col("_s") == F.col("cs")), "left")
            .withColumn("block", F.concat_ws(":", "_s", F.pmod(F.xxhash64("key"), F.coalesce("blocks", F.lit(1))))).drop("c", "cs", "blocks", "_s"))


def _join_cells(rows: DataFrame, percent: int, words: int) -> DataFrame:
    """Links within all cells."""
    one = _block_links(rows, percent, words, first=True)
    links, level = one.where("b IS NOT NULL").select("a", "b"), one.where("leader")
    if one.where("b IS NULL").isEmpty():
        return links
    while not level.isEmpty():
        again = _in_blocks(level.select("cell", F.col("a").alias("key"), "n", "text"), percent)
        # leaders of a cell meet in one block where they fit, whatever their size
        few = again.groupBy("cell").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") <= BLOCK).select(F.col("cell").alias("c"), "k")
        again = again.join(few, F.col("cell") == F.col("c"), "left")
        again = again.withColumn("block", F.when(F.col("k").isNull(), F.col("block")).otherwise("all")).withColumn("split", F.col("k").isNull())
        out = _block_links(again.withColumn("grp", F.col("key")).withColumn("side", F.lit(-1)), percent, words)
        links, level = links.unionByName(out.where("b IS NOT NULL").select("a", "b")), out.where("leader")
    # what is not yet connected within a split cell: signatures of like-sized sets show who may still link, and only those texts meet
    known = components(links)
    members = one.where("b IS NULL").select("cell", F.col("a").alias("key"), "n", "signature")
    members = stored(members.join(known.withColumnRenamed("node", "key"), "key", "left").withColumn("grp", F.coalesce("component", "key"))
                     .withColumn("s", _classes("n", percent)).drop("component"), "split-cells")
    size = members.groupBy("cell", "s").agg(F.ceil(F.count(F.lit(1)) / WIDE).cast("int").alias("parts"))
    mine = size.select("cell", "s", "parts")
    above = size.select("cell", (F.col("s") - 1).alias("s"), F.col("parts").alias("above"))
    below = size.select("cell", (F.col("s") + 1).alias("s"), F.col("parts").alias("below"))
    m = members.join(mine.join(above, ["cell", "s"], "left").join(below, ["cell", "s"], "left"), ["cell", "s"])
    own = F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")
    spot = lambda kind, s, i, j, side: F.struct(F.concat_ws(":", F.lit(kind), s.cast("string"), i.cast("string"), j.cast("string")).alias("block"), F.lit(side).alias("side"))
    upto = lambda c: F.when(F.coalesce(F.col(c), F.lit(0)) > 0, F.sequence(F.lit(0), F.col(c) - 1)).otherwise(F.array().cast("array<int>"))
    s, o = F.col("s"), F.col("own")
    places = F.concat(
        F.transform(F.filter(upto("parts"), lambda j: j > o), lambda j: spot("in", s, o, j, 1)),
        F.transform(F.filter(upto("parts"), lambda j: j < o), lambda j: spot("in", s, j, o, 2)),
        F.array(spot("in", s, o, o, 0)),
        F.transform(upto("above"), lambda j: spot("up", s, o, j, 1)),
        F.transform(upto("below"), lambda j: spot("up", s - 1, j, o, 2)))
    wide = m.withColumn("own", own).withColumn("to", F.explode(places)).select("cell", "to.block", "key", "n", "grp", F.col("to.side").alias("side"), "signature")
    left = stored(wide.groupBy("cell", "block").applyInArrow(_may_link(percent), "cell bigint, block string, key bigint, grp bigint"), "may-link")
    texts = one.where("b IS NULL").select(F.col("a").alias("key"), "text", "n")
    # a few texts of a pair of blocks may be left, or many: they are joined in blocks of bounded size, each with each
    many = left.groupBy("cell", "block").agg(F.count(F.lit(1)).alias("k")).select(F.col("cell").alias("c"), F.col("block").alias("d"), F.ceil(F.col("k") / (2 * BLOCK)).cast("int").alias("parts"))
    todo = left.join(many, (F.col("cell") == F.col("c")) & (F.col("block") == F.col("d"))).withColumn("own", own)
    todo = todo.withColumn("to", F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.concat_ws(
        ".", F.col("block"), F.least(j, F.col("own")).cast("string"), F.greatest(j, F.col("own")).cast("string")))))
    cross = texts.join(todo.select("key", "cell", F.col("to").alias("block"), "grp"), "key")
    last = _block_links(cross.withColumn("side", F.lit(-1)).withColumn("split", F.lit(False)), percent, words)
    return links.unionByName(last.where("b IS NOT NULL").select("a", "b"))
