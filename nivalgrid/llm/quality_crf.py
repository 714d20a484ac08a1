"""Document quality from a linear-chain conditional random field over lines.

Each line is good or bad. Features of a line and of its two neighbours enter a
two-state chain; forward-backward gives the probability of each line being good,
and their mean, weighted by line length, is the quality of a document. Training
uses a bounded sample of labelled documents whose lines carry the document's label;
a logistic curve fitted on the same sample turns the mean into a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_fold, labelled_sample
from .fitting import fit_logistic, score_logistic

SYMBOLS = b"#$%&*@^~<>{}[]\\=+_"
UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
DIGITS = b"0123456789"
OWN = 12  # features of the line itself
SHARED = slice(1, 9)  # those that neighbours lend
WIDTH = OWN + 2 * 8
SCORE_ROWS = 400


def line_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """``(lines x WIDTH, lengths)``; a text has one line more than it has line breaks."""
    out, lengths, seen = [], [], set()
    for line in text.split("\n"):
        words = line.split()
        n = len(words)
        raw = line.encode("utf-8", "replace")
        count = lambda chars: len(raw) - len(raw.translate(None, chars))
        upper, lower = count(UPPER), count(LOWER)
        m = max(n, 1)
        out.append((
            1.0, min(count(SYMBOLS) / m, 3.0) / 3, min(raw.count(b"!") / m, 2.0) / 2, min(raw.count(b"|") / m, 1.0),
            upper / max(upper + lower, 1), 1 - len(set(words)) / m if n else 0.0,
            sum(map(str.__eq__, words, words[1:])) / m, min(count(DIGITS) / max(len(raw), 1) * 4, 1.0),
            float(n > 0 and line in seen), float(n < 4), min(len(line) / 400, 2.0) / 2, float(n == 0)))
        lengths.append(len(line) + 1)
        seen.add(line)
    own = np.array(out)
    zero = np.zeros((1, 8))
    return np.hstack([own, np.vstack([zero, own[:-1, SHARED]]), np.vstack([own[1:, SHARED], zero])]), np.array(lengths, float)


@dataclass
class Model:
    emission: np.ndarray  # score of "good" for a line; "bad" is 0
    transition: np.ndarray  # 2 x 2 log weights, from row to column; 0 is bad
    curve: np.ndarray  # intercept and slopes of the final probability


def _pad(features: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(f) for f in features])
    out = np.zeros((len(features), max(lengths, default=1), WIDTH))
    for i, f in enumerate(features):
        out[i, :len(f)] = f
    return out, lengths


def chain(scores: np.ndarray, lengths: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward for many padded chains at once.

    ``scores`` is chains x steps (the log weight of good). Returns the probability of
    good per step and the expected number of each transition per chain.
    """
    n, steps = scores.shape
    top = np.maximum(scores, 0)
    node = np.stack([np.exp(-top), np.exp(scores - top)], 2)
    move = np.exp(transition - transition.max())
    live = np.arange(steps) < lengths[:, None]
    node[~live] = 1.0
    ahead, back = np.empty((n, steps, 2)), np.ones((n, steps, 2))
    ahead[:, 0] = node[:, 0]
    ahead[:, 0] /= ahead[:, 0].sum(1, keepdims=True)
    for t in range(1, steps):
        f = (ahead[:, t - 1] @ move) * node[:, t]
        ahead[:, t] = f / f.sum(1, keepdims=True)
    for t in range(steps - 2, -1, -1):
        b = (node[:, t + 1] * back[:, t + 1]) @ move.T
        b /= b.sum(1, keepdims=True)
        back[:, t] = np.where(live[:, t + 1, None], b, 1.0)
    both = ahead * back
    both /= both.sum(2, keepdims=True)
    pair = ahead[:, :-1, :, None] * move * (node[:, 1:] * back[:, 1:])[:, :, None, :]
    pair /= pair.sum((2, 3), keepdims=True)
    pair[~live[:, 1:]] = 0
    return both[:, :, 1], pair.sum(1)


def marginals(features: list[np.ndarray], model: Model) -> list[np.ndarray]:
    """Probability of good per line; chains of like length are worked on together."""
    order = np.argsort([len(f) for f in features])
    out: list[np.ndarray] = [np.zeros(0)] * len(features)
    at = 0
    while at < len(order):
        take = order[at:at + 64]
        if len(features[take[-1]]) > 4 * len(features[take[0]]):
            take = take[:max(1, int(np.searchsorted([len(features[i]) for i in take], 4 * len(features[take[0]]), "right")))]
        x, lengths = _pad([features[i] for i in take])
        good, _ = chain(x @ model.emission, lengths, model.transition)
        for i, row in zip(take, good):
            out[i] = row[:len(features[i])]
        at += len(take)
    return out


def document_inputs(features: list[np.ndarray], weights: list[np.ndarray], model: Model) -> np.ndarray:
    """Inputs of the final curve: the length-weighted mean probability of good, linear and as log odds."""
    means = [float(g @ w / w.sum()) for g, w in zip(marginals(features, model), weights)]
    m = np.clip(np.array(means), 1e-4, 1 - 1e-4)
    return np.column_stack([m, np.log(m / (1 - m)) / 4]) if len(m) else np.zeros((0, 2))


def train(texts: list[str], labels: list[int], rounds: int = 120, most_lines: int = 80) -> Model:
    """Fit the chain by gradient ascent (Adam); long training texts are cut into stretches of lines."""
    feats, weights = zip(*[line_features(t) for t in texts]) if texts else ((), ())
    model = Model(np.zeros(WIDTH), np.zeros((2, 2)), np.zeros(3))
    y = np.array(labels, float)
    if not len(y):
        return model
    cut = [(f[a:a + most_lines], label) for f, label in zip(feats, y) for a in range(0, len(f), most_lines)]
    cut.sort(key=lambda c: len(c[0]))
    groups = [cut[i:i + 256] for i in range(0, len(cut), 256)]
    packed = [(*_pad([f for f, _ in g]), np.array([label for _, label in g])) for g in groups]
    total = sum(len(f) for f, _ in cut)
    flat = np.zeros(WIDTH + 4)
    first, second = np.zeros_like(flat), np.zeros_like(flat)
    for r in range(1, rounds + 1):
        grad = np.zeros_like(flat)
        for x, lengths, label in packed:
            good, pairs = chain(x @ flat[:WIDTH], lengths, flat[WIDTH:].reshape(2, 2))
            live = np.arange(x.shape[1]) < lengths[:, None]
            grad[:WIDTH] += np.einsum("nt,ntd->d", (label[:, None] - good) * live, x)
            seen = np.zeros((len(label), 2, 2))
            seen[:, 0, 0], seen[:, 1, 1] = (1 - label) * (lengths - 1), label * (lengths - 1)
            grad[WIDTH:] += (seen - pairs).sum(0).ravel()
        grad = grad / total - 1e-4 * flat
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad ** 2
        flat = flat + 0.15 * (first / (1 - 0.9 ** r)) / (np.sqrt(second / (1 - 0.99 ** r)) + 1e-8)
    model = Model(flat[:WIDTH], flat[WIDTH:].reshape(2, 2), np.zeros(3))
    model.curve = fit_logistic(document_inputs(list(feats), list(weights), model), y)
    return model


def train_on(docs: DataFrame, labels: DataFrame, keep: Column | None = None, sample_rows: int = 3000,
             id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Train on at most ``sample_rows`` labelled documents (drawn by a hash of the id); that many texts reach the driver."""
    keep = F.lit(True) if keep is None else keep
    rows = labelled_sample(docs.select(id_col, text_col), labels, "quality", keep, sample_rows, id_col).collect()
    return train([r[text_col] or "" for r in rows], [r["y"] for r in rows])


def quality_scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with its columns and a last column ``quality_score`` in [0, 1].

    Null text scores as the empty text, which is one empty line. Long texts are scored
    whole. Repeated rows score alike; an empty table stays empty. A column of the same
    name as the score is replaced.
    """
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in batches:
            parts = []
            for at in range(0, len(series), SCORE_ROWS):
                pairs = [line_features(t or "") for t in series[at:at + SCORE_ROWS]]
                parts.append(score_logistic(document_inputs([f for f, _ in pairs], [w for _, w in pairs], model), model.curve))
            yield pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    return docs.withColumn("quality_score", F.pandas_udf("double")(score)(F.col(text_col)))


def held_out(doc_id: Column) -> Column:
    return crc_fold(doc_id, 4) == 2


def quality_report(docs: DataFrame, labels: DataFrame, sample_rows: int = 3000, threshold: float = 0.7) -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted``; held-out labels are not used."""
    model = train_on(docs, labels, ~held_out(F.col("doc_id")), sample_rows)
    out = quality_scores(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("quality_score").alias("score"),
                      (F.col("quality_score") >= threshold).cast("int").alias("predicted"))
