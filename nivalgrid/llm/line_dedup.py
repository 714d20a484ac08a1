"""Removal of repeated multi-line chunks.

A rolling hash over the hashes of neighbouring lines decides where a chunk ends, so
the same run of lines is cut the same way wherever it starts (boundaries resist
shifts). Chunks of at least ``min_lines`` lines that occur again anywhere in the
corpus are removed, except their first occurrence by (id, place); a chunk is removed
only after its bytes were compared with those of the first occurrence.

Only keys of 8 bytes are grouped over the whole corpus; texts move by identifier,
and chunk texts only for keys that occur twice. A key that many documents share
meets one representative row in a join that adaptive execution can split.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, stored, text_or_empty

#: Line hashes are 28 bits of md5, so that the same cut can be stated in any SQL dialect.
HASH_DIGITS = 7
MULTIPLIER = 257


def _line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, HASH_DIGITS), 16, 10).cast("bigint")


def chunks(text: Column, window: int, divisor: int, min_lines: int) -> Column:
    """Array of ``(pos, lines, body, eligible)``: the chunks of a text, in order."""
    def cut(lines: Column, hashes: Column) -> Column:
        last = F.size(lines) - 1

        def rolled(i: Column) -> Column:
            out = F.lit(0).cast("bigint")
            for back in range(window - 1, -1, -1):
                out = out * MULTIPLIER + F.when(i >= back, F.get(hashes, i - back)).otherwise(F.lit(0))
            return out

        marks = F.transform(hashes, lambda _, i: F.when((i == last) | (rolled(i) % divisor == 0), i))
        return let(F.filter(marks, lambda e: e.isNotNull()), lambda ends: F.transform(ends, lambda end, k: piece(lines, ends, end, k)))

    def piece(lines: Column, ends: Column, end: Column, k: Column) -> Column:
        start = F.when(k == 0, F.lit(0)).otherwise(F.get(ends, k - 1) + 1)
        return let(F.slice(lines, start + 1, end - start + 1), lambda part: let(F.array_join(part, "\n"), lambda body: F.struct(
            k.alias("pos"), F.size(part).alias("lines"), body.alias("body"),
            ((F.size(part) >= min_lines) & body.rlike("[^\\x20\\x09-\\x0D]")).alias("eligible"))))

    return let(F.split(text, "\n", -1), lambda lines: let(F.transform(lines, _line_hash), lambda hashes: cut(lines, hashes)))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 2, divisor: int = 3,
               min_lines: int = 2, carry: Sequence[str] = ()) -> DataFrame:
    """One row per input row: ``doc_id, text`` without repeated chunks, and counts.

    Returns ``doc_id, text, n_lines, n_chunks, removed_chunks, removed_lines`` (plus
    ``_key``, which identifies the row by id and input text). Null text is empty text:
    one blank line, never removed, as is every chunk without a visible character. Null
    ids come last in the order of occurrences. Repeated rows (same id and text) count
    as one occurrence and are treated alike. Columns named in ``carry`` come last in the
    result (they may not clash with its own); others are not read. An empty table gives an
    empty result.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    base = base.withColumn("_key", F.xxhash64(F.col("doc_id"), F.col("text")))
    cut = chunks(F.col("text"), window, divisor, min_lines)
    small = F.transform(F.filter(cut, lambda c: c["eligible"]),
                        lambda c: F.struct(c["pos"].alias("pos"), F.xxhash64(c["body"]).alias("chunk")))
    places = stored(base.select("doc_id", "_key", F.explode(small).alias("c"))
                    .select("doc_id", "_key", "c.pos", "c.chunk").distinct(), "chunk-places")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("_key"), F.col("pos")))
    again = (places.groupBy("chunk").agg(F.count(F.lit(1)).alias("n"), first.alias("f")).where(F.col("n") > 1)
             .select("chunk", F.col("f._key").alias("first_key"), F.col("f.pos").alias("first_pos")))
    lists = (places.join(again, "chunk")
             .groupBy("_key").agg(F.collect_list(F.struct(
                 F.col("pos"), F.col("chunk"),
                 ((F.col("_key") == F.col("first_key")) & (F.col("pos") == F.col("first_pos"))).alias("first"))).alias("found")))
    # texts of chunks whose key occurs twice; a text with many of them is one row here and many after the explode
    bodies = base.join(lists, "_key")
    wanted = let(cut, lambda all_: F.transform(F.col("found"), lambda f: F.struct(
        f["pos"].alias("pos"), f["chunk"].alias("chunk"), f["first"].alias("first"), F.get(all_, f["pos"])["body"].alias("body"))))
    texts = stored(bodies.select("_key", F.explode(wanted).alias("c")).select("_key", "c.*"), "chunk-texts")
    kept = texts.where("first").groupBy("chunk").agg(F.first("body").alias("first_body"))
    same = (texts.where(~F.col("first")).join(kept, "chunk").where(F.col("body") == F.col("first_body"))
            .groupBy("_key").agg(F.collect_set("pos").alias("gone")))
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"), *carry)
    out = rows.withColumn("_key", F.xxhash64(F.col("doc_id"), F.col("text"))).join(same, "_key", "left")
    gone = lambda c: F.coalesce(F.array_contains(F.col("gone"), c["pos"]), F.lit(False))
    lines = lambda part: F.aggregate(part, F.lit(0).cast("bigint"), lambda a, c: a + c["lines"])
    result = let(cut, lambda all_: F.struct(
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(
            F.filter(all_, lambda c: ~gone(c)), lambda c: c["body"]), "\n")).alias("text"),
        lines(all_).alias("n_lines"), F.size(all_).cast("bigint").alias("n_chunks"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("removed_chunks"),
        lines(F.filter(all_, gone)).alias("removed_lines")))
    return out.select("doc_id", "_key", result.alias("r"), *carry).select("doc_id", "_key", "r.*", *carry)


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
h AS (SELECT *, list_transform(lines, lambda x: ('0x' || substr(md5(x), 1, 7))::BIGINT) AS hs FROM d),
e AS (SELECT *, list_filter(range(1, len(lines) + 1), lambda i: i = len(lines)
      OR ((CASE WHEN i > 1 THEN hs[i - 1] ELSE 0 END) * 257 + hs[i]) % 3 = 0) AS ends FROM h),
c AS (SELECT doc_id, t, lines, k, CASE WHEN k = 1 THEN 1 ELSE ends[k - 1] + 1 END AS a, ends[k] AS z
      FROM (SELECT *, unnest(range(1, len(ends) + 1)) AS k FROM e)),
b AS (SELECT doc_id, k, z - a + 1 AS n, array_to_string(lines[a:z], chr(10)) AS body FROM c),
f AS (SELECT *, n >= 2 AND regexp_matches(body, '[^\x20\x09-\x0D]')
      AND row_number() OVER (PARTITION BY body, n >= 2 ORDER BY doc_id, k) > 1 AS gone FROM b)
SELECT doc_id, sum(n)::BIGINT AS n_lines, count(*) AS n_chunks, count(*) FILTER (gone) AS removed_chunks,
       coalesce(sum(n) FILTER (gone), 0)::BIGINT AS removed_lines,
       sha256(coalesce(string_agg(body, chr(10) ORDER BY k) FILTER (NOT gone), '')) AS kept_sha256
FROM f GROUP BY doc_id
"""
