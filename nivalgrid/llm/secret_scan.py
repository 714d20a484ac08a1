"""Secret scan: fixed patterns plus character Markov models of random and ordinary strings.

Patterns give the base spans. Two bigram models over the characters of a token are
trained from labelled samples: values of base spans (random) and the other long
tokens of the corpus (ordinary). A long token outside base spans is reported when
the log-likelihood ratio of the two models exceeds the log prior odds and a margin.
Everything is a SQL expression over match rows; only rows with a match are shuffled.
"""

from __future__ import annotations

import json
import math
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, stored, text_or_empty

#: The pattern of each kind, its value group and its least length.
KINDS = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
    ("markov", r"[A-Za-z0-9+/_.=-]{16,}", 0, 16),
)
#: What a text must contain for a pattern to be tried; cheaper than the pattern.
GATES = (KINDS[0][1], r"AKIA[A-Z0-9]{14}", r"[0-9a-f]{16}", r"[A-Za-z0-9+/_.=-]{16}")
ALPHABET = 66


def _matches(text: Column, number: int) -> Column:
    """Array of ``(kind, seq, gap, len, value, hit)``; positions follow from the running sum of gaps and lengths."""
    _, pattern, group, least = KINDS[number]
    pat = F.lit(pattern)
    shape = "array<struct<kind:int,seq:int,gap:bigint,len:bigint,value:string,hit:boolean>>"
    found = let(F.regexp_extract_all(text, pat, F.lit(0)), lambda m: let(
        F.regexp_extract_all(text, pat, F.lit(group)) if group else m, lambda v: let(F.split(text, pattern, -1), lambda g: F.transform(
            m, lambda x, i: F.struct(F.lit(number).alias("kind"), i.alias("seq"), F.length(F.get(g, i)).cast("bigint").alias("gap"),
                                     F.length(x).cast("bigint").alias("len"), F.get(v, i).alias("value"),
                                     (F.length(F.get(v, i)) >= least).alias("hit"))))))
    return F.when(text.rlike(GATES[number]), found).otherwise(F.array()).cast(shape)


def token_matches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """All matches of all kinds with code point positions: ``doc_id, _key, kind, start, end, value, in_base``."""
    base = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("_text"))
    base = base.withColumn("_key", F.xxhash64("doc_id", "_text"))
    rows = base.select("doc_id", "_key", F.explode(F.concat(*[_matches(F.col("_text"), i) for i in range(len(KINDS))])).alias("m"))
    rows = rows.select("doc_id", "_key", "m.*").distinct()
    order = Window.partitionBy("_key", "kind").orderBy("seq")
    at = F.sum(F.col("gap") + F.col("len")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("len")
    rows = rows.withColumn("start", at).where("hit").withColumn("end", F.col("start") + F.col("len"))
    # overlap with a base span: base ends before it and base starts behind it, in the order of starts
    by = Window.partitionBy("_key").orderBy("start", "kind")
    is_base = F.col("kind") < 3
    before = F.max(F.when(is_base, F.col("end"))).over(by.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(F.when(is_base, F.col("start"))).over(by.rowsBetween(1, Window.unboundedFollowing))
    touch = F.coalesce(before > F.col("start"), F.lit(False)) | F.coalesce(after < F.col("end"), F.lit(False))
    return rows.select("doc_id", "_key", "kind", "start", "end", "value", (is_base | touch).alias("in_base"))


def _bigrams(value: Column) -> Column:
    return let(F.split(value, ""), lambda c: F.transform(F.slice(c, 1, F.size(c) - 1), lambda x, i: F.concat(x, F.get(c, i + 1))))


def train(matches: DataFrame, alpha: float = 10.0) -> tuple[list[float], float]:
    """Log-likelihood ratio per pair of ASCII characters (index ``128 * first + second``) and the log prior odds.

    The counts cover all matches; the driver gets at most 66 x 66 rows per model.
    """
    # a string counts with the root of its occurrences: copies of a document say little about its strings
    sample = (matches.select((F.col("kind") < 3).alias("random"), "in_base", "value").where("random OR NOT in_base")
              .groupBy("random", "value").agg(F.ceil(F.sqrt(F.count(F.lit(1)))).cast("bigint").alias("w")))
    counts = (sample.select("random", "w", F.explode(_bigrams(F.col("value"))).alias("b"))
              .where(F.col("b").rlike(r"^[\x21-\x7e]{2}$")).groupBy("random", "b").agg(F.sum("w").alias("n")).collect())
    sizes = {r["random"]: r["n"] for r in sample.groupBy("random").agg(F.sum("w").alias("n")).collect()}
    pair: dict[bool, dict[str, int]] = {True: {}, False: {}}
    head: dict[bool, dict[str, int]] = {True: {}, False: {}}
    tail: dict[bool, dict[str, int]] = {True: {}, False: {}}
    for r in counts:
        k, b, n = r["random"], r["b"], r["n"]
        pair[k][b] = n
        head[k][b[0]] = head[k].get(b[0], 0) + n
        tail[k][b[1]] = tail[k].get(b[1], 0) + n
    kinds = {k: Counter(b[0] for b in pair[k]) for k in (True, False)}
    total = {k: sum(tail[k].values()) for k in (True, False)}

    def log_p(k: bool, a: str, b: str) -> float:
        single = (tail[k].get(b, 0) + 0.5) / (total[k] + 0.5 * ALPHABET)  # what a rare pair falls back to
        # absolute discounting: a pair seen once says nothing, so that a string does not vouch for itself
        seen, spare = max(pair[k].get(a + b, 0) - 1, 0), alpha + kinds[k].get(a, 0)
        return math.log((seen + spare * single) / (head[k].get(a, 0) + alpha))

    table = [0.0] * (128 * 128)
    for a in map(chr, range(33, 127)):
        for b in map(chr, range(33, 127)):
            table[128 * ord(a) + ord(b)] = round(log_p(True, a, b) - log_p(False, a, b), 6)
    return table, math.log((sizes.get(False, 0) + 1) / (sizes.get(True, 0) + 1))


def log_ratio(value: Column, table: list[float]) -> Column:
    lookup = F.from_json(F.lit(json.dumps(table)), "array<double>")
    return let(F.split(value, ""), lambda c: F.aggregate(
        F.transform(F.slice(c, 1, F.size(c) - 1), lambda x, i: F.get(lookup, F.ascii(x) * 128 + F.ascii(F.get(c, i + 1)))),
        F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0))))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", margin: float = 12.0) -> DataFrame:
    """One row per span: ``doc_id, _key, kind, start, end, value`` (code points, end exclusive).

    Kinds are numbered as in ``KINDS``. Null and empty texts have no spans. Repeated rows
    (same id and text) give their spans once. Null ids are kept. Other columns are not
    read. Without any match at all both models are uniform and nothing is added.
    """
    matches = stored(token_matches(docs, id_col, text_col), "secret-matches")
    table, odds = train(matches)
    # the margin holds for the whole string and, spread over its least length, for each pair
    needed = F.greatest(F.lit(max(0.0, odds) + margin), F.length("value") * margin / KINDS[3][3])
    added = (F.col("kind") == 3) & ~F.col("in_base") & (log_ratio(F.col("value"), table) > needed)
    return matches.where((F.col("kind") < 3) | added).select("doc_id", "_key", "kind", "start", "end", "value")


def secret_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", margin: float = 12.0) -> DataFrame:
    """One row per input row: ``doc_id, n_assign, n_access, n_hex, n_markov, base_sha256, spans``.

    ``spans`` lists ``kind:start:end`` by start, then kind; ``base_sha256`` is the digest of
    the list without the spans that the models add. A document without spans has the empty list.
    """
    spans = find_secrets(docs, id_col, text_col, margin)
    names = F.array(*[F.lit(k[0]) for k in KINDS])
    listed = F.sort_array(F.collect_list(F.struct("start", "kind", "end")))
    text = lambda items: F.concat_ws(",", F.transform(items, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))))
    per = spans.groupBy("_key").agg(listed.alias("all"), *[
        F.count(F.when(F.col("kind") == i, 1)).alias(f"n_{k[0]}") for i, k in enumerate(KINDS)])
    per = per.select("_key", *[f"n_{k[0]}" for k in KINDS], text(F.col("all")).alias("spans"),
                     text(F.filter(F.col("all"), lambda s: s["kind"] < 3)).alias("base"))
    ids = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(id_col), text_or_empty(text_col)).alias("_key"))
    out = ids.join(per, "_key", "left")
    return out.select("doc_id", *[F.coalesce(f"n_{k[0]}", F.lit(0)).cast("bigint").alias(f"n_{k[0]}") for k in KINDS],
                      F.sha2(F.coalesce("base", F.lit("")).cast("binary"), 256).alias("base_sha256"),
                      F.coalesce("spans", F.lit("")).alias("spans"))
