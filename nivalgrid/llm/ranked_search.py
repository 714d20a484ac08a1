"""Ranked lexical search: accumulators from short lists, document-at-a-time skipping over long ones.

The corpus is read once per block of items. Each task cuts its documents into segments
and writes, per segment, the inverted lists of the block's terms, so a segment is a
small index of its own with bounded documents and postings. Term statistics are sums
over the stored lists. A segment is then searched by one task for every item of
the block: the short lists are summed term at a time into materialised accumulators,
which from there on are one more iterator with its greatest sum as its bound; this iterator
and the long lists are walked document at a time in windows. Lists whose bounds
together stay below the current tenth score bring up no candidates and are only probed for
the documents that others bring up. Segments hand on their best rows only, which are merged
in two steps.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: A segment ends at so many documents or postings.
SEGMENT_DOCS, SEGMENT_POSTINGS = 16_384, 2_000_000
#: Characters of item texts that are searched in one pass, on average.
BLOCK_CHARS = 4_000_000
#: Documents walked at once, and the share of a segment's documents up to which a list is short.
WINDOW, SHORT = 2048, 1 / 16

#: Byte by byte: A-Z in lower case, every other ASCII byte that is neither letter nor digit a space.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms(text: bytes) -> list[bytes]:
    """Terms of a UTF-8 text in order: runs of ASCII letters and digits and of all other non-ASCII characters."""
    return text.translate(_TABLE).split()


class Segment:
    """Inverted lists of some documents, kept as one entry per document until the segment is written."""

    def __init__(self):
        self.ids: list = []
        self.lengths: list[int] = []
        self.terms: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.postings = 0

    def add(self, doc_id, text: bytes, numbers: dict[bytes, int]) -> None:
        words = terms(text)
        found = np.fromiter((n for n in map(numbers.get, words) if n is not None), np.int32)
        found, count = np.unique(found, return_counts=True)
        self.ids.append(doc_id)
        self.lengths.append(len(words))
        self.terms.append(found)
        self.counts.append(count)
        self.postings += len(found)

    def full(self) -> bool:
        return len(self.ids) >= SEGMENT_DOCS or self.postings >= SEGMENT_POSTINGS

    def rows(self, number: int, id_type: pa.DataType) -> pa.RecordBatch:
        """Row 0 (term -1): ids and lengths of the documents; then one row per term: places and counts."""
        all_terms = np.concatenate(self.terms)
        at = np.repeat(np.arange(len(self.ids), dtype=np.uint16), [len(t) for t in self.terms])
        order = np.argsort(all_terms, kind="stable")
        all_terms, at, tf = all_terms[order], at[order], np.concatenate(self.counts)[order].astype(np.int32)
        cuts = np.flatnonzero(np.diff(all_terms, prepend=-1))
        ends = [*cuts[1:].tolist(), len(all_terms)]
        n = len(cuts)
        return pa.RecordBatch.from_arrays([
            pa.array([number] * (n + 1), pa.int64()), pa.array([-1, *all_terms[cuts].tolist()], pa.int32()),
            pa.array([len(self.ids), *(e - c for c, e in zip(cuts.tolist(), ends))], pa.int64()),
            pa.array([sum(x > 0 for x in self.lengths), *[0] * n], pa.int64()), pa.array([sum(self.lengths), *[0] * n], pa.int64()),
            pa.array([None, *(at[c:e].tobytes() for c, e in zip(cuts.tolist(), ends))], pa.binary()),
            pa.array([None, *(tf[c:e].tobytes() for c, e in zip(cuts.tolist(), ends))], pa.binary()),
            pa.array([self.ids, *[None] * n], pa.list_(id_type)), pa.array([self.lengths, *[None] * n], pa.list_(pa.int64()))],
            ["segment", "term", "size", "filled", "total", "places", "counts", "ids", "lengths"])


def index(docs: DataFrame, numbers: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Segments of inverted lists for the terms in ``numbers``, written to the shared folder."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(numbers)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, segment, made = shared.value, Segment(), TaskContext.get().partitionId() << 32
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            for i, doc_id in enumerate(batch.column(0).to_pylist()):
                segment.add(doc_id, texts[i].as_py() or b"", numbers)
                if segment.full():
                    yield segment.rows(made, batch.schema.field(0).type)
                    made, segment = made + 1, Segment()
            kind = batch.schema.field(0).type
        if segment.ids:
            yield segment.rows(made, kind)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return stored(rows.mapInArrow(build, "segment bigint, term int, size bigint, filled bigint, total bigint, places binary, "
                                         f"counts binary, ids array<{kind}>, lengths array<bigint>"), "search-index")


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def damping(lengths: np.ndarray, documents: int, words: int) -> np.ndarray:
    """m of every document; exact also where the product leaves 64 bits."""
    n = np.asarray(lengths, np.int64)
    if len(n) and 75 * int(n.max()) * documents >= 1 << 63:
        return np.array([25 + 75 * int(x) * documents // words for x in n], np.int64)
    return 25 + 75 * n * documents // max(words, 1)


class Top:
    """The best rows so far: highest score first, then the lower place in the order of ids."""

    def __init__(self, k: int, rank: np.ndarray):
        self.k, self.rank = k, rank
        self.at, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, at: np.ndarray, score: np.ndarray) -> None:
        at, score = np.concatenate([self.at, at]), np.concatenate([self.score, score])
        best = np.lexsort((self.rank[at], -score))[:self.k]
        self.at, self.score = at[best], score[best]

    @property
    def least(self) -> int:
        """A document below this score is out; scores of 0 never count."""
        return max(1, int(self.score[-1])) if len(self.score) == self.k else 1


def search(lists: list[tuple[np.ndarray, np.ndarray]], n_docs: int, k: int, rank: np.ndarray,
           short: float = SHORT, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the ``k`` best documents of a segment for one item.

    ``lists`` holds (places ascending, score parts) per term of the item.
    """
    small = [x for x in lists if len(x[0]) <= max(64, n_docs * short)]
    walk = [x for x in lists if len(x[0]) > max(64, n_docs * short)]
    top = Top(k, rank)
    least = 1
    if small:
        # term at a time: one accumulator per document of a short list, then an iterator like any other
        at, inverse = np.unique(np.concatenate([x[0] for x in small]), return_inverse=True)
        sums = np.zeros(len(at), np.int64)
        np.add.at(sums, inverse, np.concatenate([x[1] for x in small]))
        walk.append((at, sums))
        if len(sums) >= k:
            least = max(1, int(np.partition(sums, len(sums) - k)[len(sums) - k]))  # further terms only add
    walk.sort(key=lambda x: int(x[1].max()) if len(x[1]) else 0)
    bounds = [int(x[1].max()) if len(x[1]) else 0 for x in walk]
    reach = np.cumsum(bounds)
    for lo in range(0, n_docs, window):
        least = max(least, top.least)
        first = int(np.searchsorted(reach, least))  # the lists before it cannot bring up a document by themselves
        score, seen = np.zeros(window, np.int64), np.zeros(window, bool)
        for at, part in walk[first:]:
            a, z = np.searchsorted(at, (lo, lo + window))
            score[at[a:z] - lo] += part[a:z]
            seen[at[a:z] - lo] = True
        found = np.flatnonzero(seen)
        for i in range(first - 1, -1, -1):
            found = found[score[found] + reach[i] >= least]
            if not len(found):
                break
            at, part = walk[i]
            a, z = np.searchsorted(at, (lo, lo + window))
            own = at[a:z]
            if z > a:
                place = np.minimum(np.searchsorted(own, found + lo), z - a - 1)
                hit = own[place] == found + lo
                score[found[hit]] += part[a:z][place[hit]]
        found = found[score[found] >= least]
        if len(found):
            top.add(found + lo, score[found])
    return top.at, top.score


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text",
                  item_id: str = "item_id", item_text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The ``k`` best documents of each item: ``item_id, rank int, doc_id, score bigint``.

    Null and empty texts have no terms: such documents are never found, such items find nothing.
    Every row of ``docs`` is a document of its own, repeated ids and texts too; equal scores go by
    ascending id, null ids last. Rows of ``items`` equal in id and text are one item; texts that share
    an id are ranked as items of their own under that id. Other columns are not read. Empty tables
    give an empty result. Items are handled in blocks of about ``block_chars`` characters, each
    of which reads the corpus once; only a block's terms and their counts reach the driver.
    """
    spark = docs.sparkSession
    wanted = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")).where(F.col("text").isNotNull()).distinct()
    wanted = stored(wanted.withColumn("h", F.xxhash64("item_id", "text")), "search-items")
    blocks = max(1, math.ceil((wanted.agg(F.sum(F.length("text"))).first()[0] or 0) / block_chars))
    id_kind, doc_kind = wanted.schema["item_id"].dataType.simpleString(), docs.schema[id_col].dataType.simpleString()
    out = None
    for b in range(blocks):
        block = wanted.where(F.pmod("h", F.lit(blocks)) == b) if blocks > 1 else wanted
        found = _search_block(docs, [(r["item_id"], r["text"]) for r in block.select("item_id", "text").collect()], k, id_col, text_col, b)
        found = found.withColumn("item_id", F.col("item_id").cast(id_kind))
        out = found if out is None else out.unionByName(found)
    return out.select("item_id", "rank", F.col("doc_id").cast(doc_kind).alias("doc_id"), "score")


def _search_block(docs: DataFrame, items: list[tuple], k: int, id_col: str, text_col: str, block: int) -> DataFrame:
    spark = docs.sparkSession
    asked = [Counter(terms(text.encode("utf-8", "surrogatepass"))) for _, text in items]
    numbers = {t: i for i, t in enumerate(sorted({t for c in asked for t in c}))}
    lists = index(docs, numbers, id_col, text_col)
    totals = lists.where("term = -1").agg(F.sum("filled"), F.sum("total"), F.countDistinct("segment")).first()
    documents, words, segments = (int(x or 0) for x in totals)
    # one row per term of the block: the bound of what comes to the driver
    holding = {r["term"]: r["df"] for r in lists.where("term >= 0").groupBy("term").agg(F.sum("size").alias("df")).collect()}
    plan = spark.sparkContext.broadcast({
        "weights": {t: weight(documents, df) for t, df in holding.items()},
        "items": [[(numbers[t], c) for t, c in sorted(a.items()) if numbers[t] in holding] for a in asked]})
    doc_kind = docs.schema[id_col].dataType.simpleString()

    def best(key: tuple, table: pa.Table) -> pa.Table:
        value = plan.value
        columns = {c: table.column(c).to_pylist() for c in ("term", "places", "counts")}
        head = columns["term"].index(-1)
        ids = table.column("ids")[head].as_py()
        m = damping(np.array(table.column("lengths")[head].as_py(), np.int64), documents, words)
        rank = np.empty(len(ids), np.int64)
        rank[sorted(range(len(ids)), key=lambda i: (ids[i] is None, 0 if ids[i] is None else ids[i]))] = np.arange(len(ids))
        parts: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for term, places, counts in zip(columns["term"], columns["places"], columns["counts"]):
            if term >= 0:
                at, tf = np.frombuffer(places, np.uint16).astype(np.int64), np.frombuffer(counts, np.int32).astype(np.int64)
                parts[term] = at, value["weights"][term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[at]))
        rows: list[tuple] = []
        for i, wanted in enumerate(value["items"]):
            lists = [(parts[t][0], parts[t][1] * c) for t, c in wanted if t in parts]
            if lists:
                at, score = search(lists, len(ids), k, rank)
                rows += [(i, ids[a], s) for a, s in zip(at.tolist(), score.tolist())]
        return pa.table({"item": pa.array([r[0] for r in rows], pa.int32()), "segment": pa.array([key[0].as_py()] * len(rows), pa.int64()),
                         "doc_id": pa.array([r[1] for r in rows], table.schema.field("ids").type.value_type),
                         "score": pa.array([r[2] for r in rows], pa.int64())})

    local = lists.select("segment", "term", "places", "counts", "ids", "lengths").groupBy("segment").applyInArrow(
        best, f"item int, segment bigint, doc_id {doc_kind}, score bigint")
    local = local.select("item", F.pmod(F.xxhash64("segment"), F.lit(max(1, math.isqrt(segments)))).alias("part"), "doc_id", "score")
    # two steps, so that the rows of one item do not all meet in one task
    order = (F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    few = local.withColumn("rank", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))).where(F.col("rank") <= k)
    best_rows = few.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
    names = spark.createDataFrame([(i, None if x is None else str(x)) for i, (x, _) in enumerate(items)], "item int, item_id string")
    return best_rows.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


ORACLE = r"""
WITH t AS (SELECT doc_id, row_number() OVER () AS rn, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents WHERE text IS NOT NULL),
d AS (SELECT rn, count(*)::BIGINT AS n FROM t GROUP BY rn),
g AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS words FROM d),
p AS (SELECT rn, any_value(doc_id) AS doc_id, term, count(*)::BIGINT AS tf FROM t GROUP BY rn, term),
w AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, g GROUP BY term),
q AS (SELECT item_id, term, count(*)::BIGINT AS c FROM (SELECT item_id, unnest(regexp_extract_all(translate(text,
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY item_id, term),
s AS (SELECT item_id, rn, any_value(doc_id) AS doc_id, sum(c * w.w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // words))))::BIGINT AS score
      FROM q JOIN w USING (term) JOIN p USING (term) JOIN d USING (rn), g GROUP BY item_id, rn),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 10
"""
