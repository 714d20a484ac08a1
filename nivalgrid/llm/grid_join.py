"""Embedding near duplicates by the epsilon grid order.

Within a label, unit vectors are projected on the leading principal dimensions of
all vectors and sorted by their grid cells of side epsilon, the distance that the
cosine threshold allows. Exact copies lie side by side in that order, are collapsed
there and weigh as their number. The sorted sequence is cut into intervals of bounded
length; a unit holds neighbouring intervals, packed into one row of a table in the
shared folder.

Pairs of units are read from that table as the original join reads its file, unit
against unit, so no vector is sent once per partner: a shuffle moves each vector once,
whatever the number of pairs. Two units meet only if their bounding boxes come within
epsilon. Inside a pair of units the join halves both sequences recursively and skips
halves that are provably distant, down to two intervals. There one matrix product of the
leading dimensions, with the length of the rest as one more, bounds all cosines from above;
what passes is compared in double precision over all components. A task returns a
count per vector and a spanning set of links, not its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .components import components

INTERVAL = 256
#: Intervals of a unit, if its vectors have no more bytes than UNIT; rows of a unit, in units' lengths, beyond which a class of copies goes on in the next one.
RUN, UNIT, COPIES = 32, 2 << 20, 4
#: Intervals on each side that are compared by their boxes at once, where the recursion ends.
ENDS = 8
#: Leading dimensions whose product bounds a cosine; what single precision may add to that bound.
BOUND, SLACK = 15, 1e-5
#: Places of vectors in a node number.
PLACES = 20
#: Bytes of bounds and boxes that a task keeps at hand.
CACHE = 32 << 20
#: A task holds so many bytes of units, and the others pass by in so many streams; tasks at least, where there are few units.
HELD, STREAMS, TASKS = 64 << 20, 8, 64


def unit_vectors(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """Usable vectors: ``vec_id, label, v`` (array<float> if given so, else array<double>); others have no links."""
    v = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(label_col).alias("label"), F.col(vec_col).alias("embedding"))
    kind = "array<float>" if v.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    return v.where(_usable()).select("vec_id", "label", F.col("embedding").cast(kind).alias("v"))


def principal(points: DataFrame, dims: int) -> dict[int, np.ndarray]:
    """By vector length, the leading eigenvectors of the second moments of all points: one sum of d x d numbers reaches the driver."""
    def moments(batches):
        total = None
        for b in batches:
            for _, part in b.groupby(b["u"].map(len)):
                x = np.stack(part["u"].to_numpy()).astype(float)
                m = x.T @ x
                total = {**(total or {}), x.shape[1]: m + (total or {}).get(x.shape[1], 0)}
        for d, m in (total or {}).items():
            yield pd.DataFrame({"d": d, "i": np.arange(d * d), "s": m.ravel()})

    return _axes(points.select("u").mapInPandas(moments, "d int, i int, s double"), dims)


def _axes(moments: DataFrame, dims: int) -> dict[int, np.ndarray]:
    out: dict[int, np.ndarray] = {}
    for r in moments.groupBy("d", "i").agg(F.sum("s").alias("s")).collect():
        out.setdefault(r["d"], np.zeros((r["d"], r["d"]))).flat[r["i"]] = r["s"]
    return {d: np.linalg.eigh(m)[1][:, ::-1][:, :dims] for d, m in out.items()}


def lengths(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Largest component of each row, and the length of what the row divided by it is: squares of tiny or huge components stay finite."""
    top = np.abs(x).max(1).astype(float)[:, None]
    y = x / top
    return top, np.sqrt(np.einsum("ij,ij->i", y, y))[:, None]


def unit_length(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision."""
    top, norm = lengths(x)
    return x / top / norm


def by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions and matrix of the vectors of each length."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    size = column.value_lengths().to_numpy(zero_copy_only=False)
    start = np.cumsum(size) - size
    for d in np.unique(size):
        at = np.flatnonzero(size == d)
        yield at, flat.reshape(len(size), d) if len(at) == len(size) else flat[start[at][:, None] + np.arange(d)]


class Side:
    """A unit as the join sees it: columns that bound cosines, boxes of its intervals, and ``raw`` vectors while they are at hand."""

    def __init__(self, raw: np.ndarray, axes: np.ndarray, interval: int):
        self.raw = raw
        self.cuts = np.append(np.arange(0, len(raw), interval), len(raw))
        self.top, self.norm, self.bound = np.empty((len(raw), 1)), np.empty((len(raw), 1)), np.empty((len(raw), axes.shape[1] + 1), np.float32)
        self.low, self.high = np.empty((2, len(self.cuts) - 1, axes.shape[1] + 1))
        for k, (s, e) in enumerate(zip(self.cuts[:-1], self.cuts[1:])):
            self.top[s:e], self.norm[s:e] = lengths(raw[s:e])
            p = self.unit(slice(s, e)) @ axes
            p = np.column_stack([p, np.sqrt(np.maximum(0, 1 - np.einsum("ij,ij->i", p, p)))])
            self.bound[s:e], self.low[k], self.high[k] = p, p.min(0), p.max(0)

    def unit(self, at: slice | np.ndarray) -> np.ndarray:
        """These vectors at length 1."""
        return self.raw[at] / self.top[at] / self.norm[at]

    def nbytes(self) -> int:
        """Without ``raw``."""
        return self.bound.nbytes + 2 * self.top.nbytes + 2 * self.low.nbytes


def join_units(a: Side, b: Side, epsilon: float, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of ``a`` x ``b`` (i < j if ``same``) at or above the threshold, for each pair of intervals that may hold some."""
    def near(alow: np.ndarray, ahigh: np.ndarray, blow: np.ndarray, bhigh: np.ndarray) -> np.ndarray:
        gap = np.maximum(0, np.maximum(alow[:, None] - bhigh[None], blow[None] - ahigh[:, None]))
        return np.einsum("ijk,ijk->ij", gap, gap) <= epsilon * epsilon

    def halves(x: slice) -> list[slice]:
        mid = (x.start + x.stop) // 2
        return [slice(x.start, mid), slice(mid, x.stop)] if x.stop - x.start > ENDS else [x]

    def visit(x: slice, y: slice) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if same and y.stop <= x.start or not near(a.low[x].min(0)[None], a.high[x].max(0)[None], b.low[y].min(0)[None], b.high[y].max(0)[None])[0, 0]:
            return
        if x.stop - x.start <= ENDS and y.stop - y.start <= ENDS:
            for s, t in np.argwhere(near(a.low[x], a.high[x], b.low[y], b.high[y])) + (x.start, y.start):
                if not same or s <= t:
                    i, j = _compare(a, b, slice(a.cuts[s], a.cuts[s + 1]), slice(b.cuts[t], b.cuts[t + 1]), threshold, same and s == t)
                    if len(i):
                        yield i, j
            return
        for s in halves(x):
            for t in halves(y):
                yield from visit(s, t)

    yield from visit(slice(0, len(a.low)), slice(0, len(b.low)))


def _compare(a: Side, b: Side, s: slice, t: slice, threshold: float, square: bool) -> tuple[np.ndarray, np.ndarray]:
    may = a.bound[s] @ b.bound[t].T
    least = np.float32(threshold - SLACK)
    if may.max() < least:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    i, j = np.nonzero(may >= least)
    if square:
        i, j = i[i < j], j[i < j]
    if len(i) > len(may) + len(may.T):
        cosine = (a.unit(s) @ b.unit(t).T)[i, j]
    else:
        cosine = np.einsum("ij,ij->i", a.unit(i + s.start), b.unit(j + t.start))
    hit = cosine >= threshold
    if threshold > 1 - 1e-9:  # equal vectors link, however their product is rounded
        hit |= (a.raw[s][i] == b.raw[t][j]).all(1)
    return i[hit] + s.start, j[hit] + t.start


class Forest:
    """Places of nodes with their link counts and a spanning forest, in which each parent has a higher place. The first ``n`` are used anew for each left unit."""

    def __init__(self, n: int):
        self.parent, self.count, self.node = np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int64)

    def clear(self, n: int) -> None:
        self.parent[:n], self.count[:n] = np.arange(n), 0

    def grow(self, node: np.ndarray) -> int:
        """Place of the first of more nodes."""
        first = len(self.parent)
        self.parent = np.append(self.parent, np.arange(first, first + len(node)))
        self.count, self.node = np.append(self.count, np.zeros(len(node), np.int64)), np.append(self.node, node)
        return first

    def roots(self, i: np.ndarray) -> np.ndarray:
        r = self.parent[i]
        while ((up := self.parent[r]) != r).any():
            r = up
        return r

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            i, j = self.roots(i), self.roots(j)
            apart = i != j
            i, j = i[apart], j[apart]
            np.maximum.at(self.parent, np.minimum(i, j), np.maximum(i, j))


def near_vectors(vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vec_col: str = "embedding",
                 label_col: str = "label", dims: int = 8, interval: int = INTERVAL) -> DataFrame:
    """One row per input row: ``vec_id, n_links, component_id, kept``.

    Vectors link within a label (equal, not null) at cosine >= threshold in double
    precision. Vectors that are null, empty, zero or hold null or non-finite components,
    and rows without label or id, link with nothing: 0 links, their own id. Repeated rows
    with one id count as vectors of their own and link with each other. Vectors of
    unequal length do not link. Other columns are not read; empty tables stay empty.
    """
    all_ = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(label_col).alias("label"),
                          F.col(vec_col).alias("embedding"))
    clean = unit_vectors(all_, "vec_id", "embedding", "label")
    # labels that are no whole numbers go by a hash: two of N labels share it with a chance of about N^2 / 2^65
    whole = clean.schema["label"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    clean = clean.select("vec_id", (F.col("label").cast("bigint") if whole else F.xxhash64("label")).alias("key"), "v")
    epsilon = math.sqrt(max(0.0, 2 - 2 * threshold) + 1e-7)  # what rounding may add to a box

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for _, x in by_length(b.column("v")):
                u = unit_length(x)
                total[u.shape[1]] = total.get(u.shape[1], 0) + u.T @ u
        for d, m in total.items():
            yield pa.RecordBatch.from_pydict({"d": np.full(d * d, d, np.int32), "i": np.arange(d * d, dtype=np.int32), "s": m.ravel()})

    axes = _axes(clean.select("v").mapInArrow(moments, "d int, i int, s double"), max(dims, BOUND))
    kind = np.float32 if clean.schema["v"].dataType.simpleString() == "array<float>" else np.float64
    units = _units(clean, axes, epsilon, dims, interval, kind)
    links = _links(units, axes, epsilon, threshold, dims, interval, kind)
    groups = components(links.where(F.col("b").isNotNull()).select("a", "b"))
    counts = links.where(F.col("b").isNull()).groupBy("a").agg(F.sum("n").alias("linked"))
    members = units.select("unit", "n", "ids").mapInArrow(_members, "node bigint, low bigint, n bigint, vec_id bigint")
    lows = members.groupBy("node").agg(F.min("low").alias("low"))
    linked = stored(groups.join(lows, "node").join(counts, F.col("node") == F.col("a")).select("node", "component", "low", "linked"), "vector-classes")
    first = stored(linked.groupBy("component").agg(F.min("low").alias("component_id")), "vector-components")
    linked = linked.join(first, "component").select("node", "linked", "component_id")
    out = (members.join(linked, "node", "left")
           .select("vec_id", (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component_id", "low").alias("component_id")))
    rest = (all_.withColumn("_ok", _usable()).where(~F.col("_ok")).select(
        "vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id")))
    out = out.unionByName(rest)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _usable():
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return F.coalesce(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & fine, F.lit(False))


def _most(size: int, interval: int) -> int:
    """Vectors of a unit, of ``size`` bytes each."""
    return max(1, min(RUN * interval, UNIT // size))


def _box(dims: int) -> list[str]:
    return [f"{side}{i}" for i in range(dims) for side in ("low", "high")]


def _units(clean: DataFrame, axes: dict[int, np.ndarray], epsilon: float, dims: int, interval: int, kind: type) -> DataFrame:
    """The grid order, cut into units: their numbers, boxes, packed vectors, copies of each and ids in that order."""
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, x in by_length(b.column("v")):
                cell = np.floor(unit_length(x) @ axes[x.shape[1]][:, :dims] / epsilon)
                grid = (np.clip(cell, -(1 << 15), (1 << 15) - 1) + (1 << 15)).astype(">u2")  # big-endian: in the order of cells
                x = np.ascontiguousarray(x)
                odd = np.arange(1, 2 * x.shape[1] * x.itemsize // 4, 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                name = (x.view(np.uint32).reshape(len(x), -1) * odd).sum(1, dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_pydict({
                    "key": b.column("key").take(pa.array(at)), "d": np.full(len(at), x.shape[1], np.int32), "grid": [g.tobytes() for g in grid],
                    "name": name, "vec_id": b.column("vec_id").take(pa.array(at)), "v": [v.tobytes() for v in x]})

    names = _box(dims)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << PLACES

        def unit(key: int, d: int, x: np.ndarray, ids: np.ndarray) -> tuple[int, pa.RecordBatch]:
            """One unit of the first rows, and how many they are."""
            nonlocal number
            most = _most(x.shape[1] * x.itemsize, interval)
            first = np.flatnonzero(np.append(True, (x[1:].view(np.uint32) != x[:-1].view(np.uint32)).any(1)))
            end = min(len(x), COPIES * most, first[most] if len(first) > most else len(x))
            first = first[first < end]
            p = unit_length(x[first]) @ axes[d][:, :dims]
            low, high = (np.append(f(0), np.zeros(dims - p.shape[1])) for f in (p.min, p.max))
            row = {"unit": [number], "key": [key], "d": pa.array([d], pa.int32()), **{c: [v] for c, v in zip(names, np.column_stack([low, high]).ravel())},
                   "size": [x[first].nbytes], "v": [x[first].tobytes()], "n": [np.diff(np.append(first, end)).astype(np.int64).tobytes()], "ids": [ids[:end].tobytes()]}
            number += 1
            return end, pa.RecordBatch.from_pydict(row)

        held: tuple | None = None

        def cut(whole: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held
            while held and len(held[2]) > (0 if whole else COPIES * _most(held[2].shape[1] * held[2].itemsize, interval)):
                end, row = unit(*held)
                yield row
                held = (*held[:2], held[2][end:], held[3][end:])

        for b in batches:
            key, d, ids = (b.column(c).to_numpy() for c in ("key", "d", "vec_id"))
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]) | (d[1:] != d[:-1])) + 1).tolist(), len(key)]
            for s, e in zip(cuts[:-1], cuts[1:]):
                if s == e:
                    continue
                x = np.frombuffer(b"".join(b.column("v")[s:e].to_pylist()), kind).reshape(e - s, d[s])
                if held and held[:2] == (key[s], d[s]):
                    held = (*held[:2], np.concatenate([held[2], x]), np.concatenate([held[3], ids[s:e]]))
                else:
                    yield from cut(True)
                    held = (key[s], d[s], x, ids[s:e])
                yield from cut(False)
        yield from cut(True)

    placed = clean.mapInArrow(place, "key bigint, d int, grid binary, name bigint, vec_id bigint, v binary")
    order = ["key", "d", "grid", "name", "vec_id"]  # ids last: a class of very many copies is dealt over several tasks
    placed = placed.repartitionByRange(*order).sortWithinPartitions(*order).select("key", "d", "vec_id", "v")
    boxes = "".join(f"{c} double, " for c in names)
    return stored(placed.mapInArrow(pack, f"unit bigint, key bigint, d int, {boxes}size bigint, v binary, n binary, ids binary"), "grid-units",
                  **{"parquet.block.size": str(16 << 20), "parquet.block.size.row.check.min": "8", "parquet.block.size.row.check.max": "8"})


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every usable row with its class, the smallest id and the number of copies there."""
    for b in batches:
        for number, n, ids in zip(*(b.column(c).to_pylist() for c in ("unit", "n", "ids"))):
            n, ids = np.frombuffer(n, np.int64), np.frombuffer(ids, np.int64)
            low = np.minimum.reduceat(ids, np.cumsum(n) - n)
            node = (number << PLACES) + np.arange(len(n))
            yield pa.RecordBatch.from_pydict({"node": np.repeat(node, n), "low": np.repeat(low, n), "n": np.repeat(n, n), "vec_id": ids})


def _links(units: DataFrame, axes: dict[int, np.ndarray], epsilon: float, threshold: float, dims: int, interval: int, kind: type) -> DataFrame:
    """Counts (``a, null, n``) and spanning links (``a, b``) between classes; of each at most one row for a class, a task and a side."""
    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = RUN * interval  # and no unit has more
        forest, left, number = Forest(most), None, None
        first: dict[int, int] = {}  # place of a right unit's first vector
        sides: dict[int, tuple[Side, np.ndarray]] = {}
        room = CACHE

        def vectors(v: pa.Buffer | bytes, d: int) -> np.ndarray:
            return np.frombuffer(v, kind).reshape(-1, d)

        def side(raw: np.ndarray, n: bytes) -> tuple[Side, np.ndarray]:
            return Side(raw, axes[raw.shape[1]][:, :BOUND], interval), np.frombuffer(n, np.int64)

        def found(i: np.ndarray) -> Iterator[pa.RecordBatch]:
            """What is known of the places ``i``."""
            counted, root = i[forest.count[i] > 0], forest.roots(i)
            tied = i[root != i]
            for a, b, n in ((counted, pa.nulls(len(counted), pa.int64()), forest.count[counted]),
                            (tied, pa.array(forest.node[root[root != i]]), np.zeros(len(tied), np.int64))):
                if len(a):
                    yield pa.RecordBatch.from_pydict({"a": forest.node[a], "b": b, "n": n})

        for batch in batches:
            for r in range(batch.num_rows):
                x, y, d = (batch.column(c)[r].as_py() for c in ("x_unit", "y_unit", "x_d"))
                if x != number:
                    yield from found(np.arange(most))
                    forest.clear(most)
                    number, left = x, side(vectors(batch.column("x_v")[r].as_py(), d), batch.column("x_n")[r].as_py())
                    forest.node[:len(left[1])] = (x << PLACES) + np.arange(len(left[1]))
                raw = vectors(batch.column("y_v")[r].as_buffer(), d)
                if y in sides:
                    right = sides[y]
                    right[0].raw = raw
                else:
                    right = side(raw, batch.column("y_n")[r].as_py())
                    if (size := right[0].nbytes()) <= room:
                        sides[y], room = right, room - size
                if y not in first:
                    first[y] = forest.grow((y << PLACES) + np.arange(len(right[1])))
                for i, j in join_units(left[0], right[0], epsilon, threshold, x == y):
                    p, q = i + (first[y] if x == y else 0), j + first[y]
                    np.add.at(forest.count, p, right[1][j])
                    np.add.at(forest.count, q, left[1][i])
                    forest.link(p, q)
                right[0].raw = None  # else each unit at hand would hold a batch
        yield from found(np.arange(len(forest.node)))

    kept = ["unit", "key", "d", *_box(dims), "v", "n"]
    side = lambda s: units.select(*[F.col(c).alias(f"{s}_{c}") for c in kept])
    gap = F.lit(0.0)
    for i in range(dims):
        gap = gap + F.pow(F.greatest(F.col(f"x_low{i}") - F.col(f"y_high{i}"), F.col(f"y_low{i}") - F.col(f"x_high{i}"), F.lit(0.0)), F.lit(2.0))
    near = (F.col("x_unit") <= F.col("y_unit")) & (F.col("x_key") == F.col("y_key")) & (F.col("x_d") == F.col("y_d")) & (gap <= epsilon * epsilon)
    # both sides are read from the shared folder, task by task: a shuffle would send a unit once per partner
    held = max(1, -(-int(units.agg(F.sum("size")).first()[0] or 0) // HELD))
    pairs = side("x").coalesce(max(STREAMS, TASKS // held)).hint("shuffle_replicate_nl").join(side("y").coalesce(held), near)
    return stored(pairs.select("x_unit", "x_d", "x_v", "x_n", "y_unit", "y_v", "y_n").mapInArrow(match, "a bigint, b bigint, n bigint"), "vector-links")
