"""Toxicity from a weighted lexicon matched by Aho-Corasick.

Texts are lower-cased, look-alike letters and digits inside words are folded, and
punctuation becomes white space. The lexicon holds whole words and word beginnings,
weighted by how much likelier they are in toxic documents of a bounded labelled
sample, and exception phrases: word pairs around a lexicon word that occur only in
documents that are not toxic. The weights found in a text, normalised by its number
of words, go through a logistic curve fitted on the same sample.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_fold, labelled_sample, stored
from .fitting import fit_logistic, score_logistic

#: Letters of other scripts that look like Latin ones, and digits or signs used for letters.
LOOK_ALIKES = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "һ": "h",
               "ԁ": "d", "ԛ": "q", "ԝ": "w", "в": "b", "к": "k", "м": "m", "н": "h", "т": "t", "α": "a", "ο": "o", "ρ": "p",
               "ν": "v", "ι": "i", "κ": "k", "τ": "t", "υ": "u", "χ": "x", "ε": "e", "η": "n", "ı": "i", "ɡ": "g", "ɑ": "a", "ℓ": "l"}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s"}
_FOLD = {ord(k): v for k, v in LOOK_ALIKES.items()}
_FOLD |= {0xFF41 + i: chr(97 + i) for i in range(26)}  # full-width letters
_FOLD |= {ord(c): " " for c in "!\"#%&'()*+,-./:;<=>?[\\]^_`{|}~\t\n\r\x0b\x0c\xa0«»“”„’‘…–—¿¡"}
_FOLD |= {c: None for c in (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)}  # invisible
_SWAP = {ord(k): v for k, v in SUBSTITUTES.items()}
_MIXED = re.compile(r"(?<![^ ])(?=[^ ]*[a-z])(?=[^ ]*[0-9@$])[^ ]{2,}(?![^ ])")
_HAS_SIGN = re.compile(r"[0-9@$]").search
LENGTHS = range(4, 9)
WORDS_ADDED = 10.0


def fold(text: str) -> str:
    """Folded text with one space before each word and one at the end."""
    text = text.lower().translate(_FOLD)
    if _HAS_SIGN(text):
        text = _MIXED.sub(lambda m: m[0].translate(_SWAP), text)
    return " " + " ".join(text.split()) + " "


@dataclass
class Lexicon:
    """Entries begin with a space; those that also end with one are whole words."""

    entries: dict[str, float]
    exceptions: list[str] = field(default_factory=list)
    curve: np.ndarray = field(default_factory=lambda: np.zeros(3))

    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for k, w in self.entries.items():
            a.add_word(k, (len(k), w))
        for k in self.exceptions:
            a.add_word(f" {k} ", (len(k) + 2, None))
        a.make_automaton()
        return a if len(a) else None


def _inside(at: int, spans: tuple[list[int], list[int]]) -> bool:
    i = bisect_right(spans[0], at) - 1
    return i >= 0 and at < spans[1][i]


def features(text: str, automaton) -> tuple[float, float]:
    """Weight per word (with a few words added, so short texts are not extreme) and total weight on a log scale."""
    folded = fold(text)
    words = folded.count(" ") - 1
    at: dict[int, float] = {}
    spared: tuple[list[int], list[int]] = ([], [])  # begins and ends of disjoint spans, ascending
    found: list[tuple[int, int]] = []
    if automaton is not None:
        for end, (n, w) in automaton.iter(folded):
            start = end - n + 1
            if w is None:
                found.append((start, end))
            elif w > at.get(start, 0.0):
                at[start] = w
    for a, b in sorted(found):
        if spared[1] and a <= spared[1][-1]:
            spared[1][-1] = max(spared[1][-1], b)
        else:
            spared[0].append(a)
            spared[1].append(b)
    total = sum(w for s, w in at.items() if not _inside(s, spared))
    return 10 * total / (max(words, 0) + WORDS_ADDED), math.log1p(total)


def _terms(folded: str) -> set[str]:
    out = set()
    for w in set(folded.split()):
        out.add(f" {w} ")
        out.update(f" {w[:n]}" for n in LENGTHS if n < len(w))
    return out


def learn(docs: DataFrame, labels: DataFrame, keep: Column | None = None, sample_rows: int = 8000, most_entries: int = 20_000,
          id_col: str = "doc_id", text_col: str = "text") -> Lexicon:
    """Learn from at most ``sample_rows`` labelled documents (drawn by a hash of the id).

    Document counts of terms are summed on executors; the driver gets at most
    ``most_entries`` entries, the strongest first, and two numbers per sampled document.
    """
    keep = F.lit(True) if keep is None else keep
    sample = labelled_sample(docs.select(id_col, text_col), labels, "toxic", keep, sample_rows, id_col)
    sample = stored(sample.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), "y"), "toxic-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                seen: tuple[Counter, Counter] = (Counter(), Counter())
                for text, y in zip(*(c.to_pylist() for c in batch.slice(at, 1000).columns)):
                    seen[y].update(_terms(fold(text)))
                terms = list(seen[0] | seen[1])
                yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([seen[0][t] for t in terms], pa.int64()),
                                                  pa.array([seen[1][t] for t in terms], pa.int64())], ["term", "clean", "toxic"])

    sizes = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    if not n1 or not n0:
        return Lexicon({})
    counts = (sample.mapInArrow(count, "term string, clean bigint, toxic bigint").groupBy("term")
              .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")))
    weight = F.log((F.col("toxic") + 0.3) / (n1 + 0.6)) - F.log((F.col("clean") + 0.3) / (n0 + 0.6))
    strong = (counts.where(F.col("toxic") >= 4).withColumn("w", weight).where(F.col("w") >= 3.0)
              .orderBy(F.desc(F.col("w") * F.col("toxic")), "term").limit(most_entries).collect())
    entries = {r["term"]: float(r["w"]) for r in strong}
    # a longer beginning that is no stronger than a shorter one adds nothing
    lean = {k: w for k, w in entries.items() if not any(
        entries.get(" " + k.strip()[:n], -1.0) >= w - 0.5 for n in LENGTHS if n < len(k.strip()))}
    lexicon = Lexicon(lean)
    lexicon.exceptions = _exceptions(sample, lexicon)
    shared = (lexicon.entries, lexicon.exceptions)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Lexicon(*shared).automaton()
        for batch in batches:
            texts, ys = (c.to_pylist() for c in batch.columns)
            pairs = [features(t, automaton) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.float64()), pa.array([p[1] for p in pairs], pa.float64()),
                                              pa.array(ys, pa.int64())], ["a", "b", "y"])

    rows = sorted(tuple(r) for r in sample.mapInArrow(measure, "a double, b double, y bigint").collect())
    data = np.array(rows, float)
    lexicon.curve = fit_logistic(data[:, :2], data[:, 2], ridge=0.1)
    return lexicon


def _exceptions(sample: DataFrame, lexicon: Lexicon, least: int = 5, most: int = 2000) -> list[str]:
    """Word pairs with a lexicon word that occur in at least ``least`` clean documents and in no toxic one."""
    entries = lexicon.entries

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hit = lambda w: f" {w} " in entries or any(f" {w[:n]}" in entries for n in LENGTHS if n < len(w))
        for batch in batches:
            terms, ys = [], []
            for text, y in zip(*(c.to_pylist() for c in batch.columns)):
                words = fold(text).split()
                found = {i for i, w in enumerate(words) if hit(w)}
                here = {f"{words[j]} {words[j + 1]}" for i in found for j in (i - 1, i) if 0 <= j < len(words) - 1}
                terms.extend(here)
                ys.extend([y] * len(here))
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(ys, pa.int64())], ["term", "y"])

    rows = (sample.mapInArrow(pairs, "term string, y bigint").groupBy("term").agg(F.sum("y").alias("toxic"), F.count("y").alias("n"))
            .where((F.col("toxic") == 0) & (F.col("n") >= least)).orderBy(F.desc("n"), "term").limit(most).collect())
    return [r["term"] for r in rows]


def toxicity_scores(docs: DataFrame, lexicon: Lexicon, text_col: str = "text") -> DataFrame:
    """``docs`` with its columns and a last column ``toxicity_score`` in [0, 1].

    Null text scores as the empty text: no match, so the lowest score. Texts are scored
    whole. Repeated rows score alike; an empty table stays empty. A column of the same
    name as the score is replaced.
    """
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = lexicon.automaton()
        for series in batches:
            x = np.array([features(t or "", automaton) for t in series], float).reshape(-1, 2)
            yield pd.Series(score_logistic(x, lexicon.curve))

    return docs.withColumn("toxicity_score", F.pandas_udf("double")(score)(F.col(text_col)))


def held_out(doc_id: Column) -> Column:
    return crc_fold(doc_id, 5) == 0


def toxicity_report(docs: DataFrame, labels: DataFrame, sample_rows: int = 8000, threshold: float = 0.5) -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted``; held-out labels are not used."""
    lexicon = learn(docs, labels, ~held_out(F.col("doc_id")), sample_rows)
    out = toxicity_scores(docs.select("doc_id", "text"), lexicon)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity_score").alias("score"),
                      (F.col("toxicity_score") >= threshold).cast("int").alias("predicted"))
