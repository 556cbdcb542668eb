"""Document quality from a linear-chain conditional random field over lines.

Each line is labelled good or bad from features of its own and of the lines beside it; the document's
score is the mean of the lines' forward-backward marginals, weighted by their length. Labels are those
of documents, so training is by multiple instances: all lines begin with their document's label, and a
first model takes each line alone; then lines that the model holds for the other kind change over (at
most half of a document's), and the chain is fitted to them, ROUNDS times. So it learns from labels
that switch, too. Training takes at most TRAIN_DOCS labelled
documents (the first by a hash of doc_id; of rows repeating a doc_id, one) and at most TRAIN_LINES consecutive lines of each, from a place by the same hash; scoring reads every line.

Defined results: a null or empty text is one empty line; null doc_ids are kept as null, count as
empty strings for the hold-out and are never trained on; repeated rows get equal results; with labels
of one kind only, every score is that label, and without any, 1; an empty table gives an empty result;
columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import texts

TRAIN_DOCS = 1000
TRAIN_LINES = 48
FOLDS = 5
THRESHOLD = 0.3
STEPS = 100
ROUNDS = 2

_UPPER, _LOWER, _DIGIT = (s.encode() for s in (string.ascii_uppercase, string.ascii_lowercase, string.digits))
_MARKS, _STOPS = b"#*$%&|<>!", b".?"
N_OWN = 11


def _line(b: bytes) -> list[float]:
    words = b.split()
    n, m = len(words) or 1, len(b) or 1
    upper, lower = m - len(b.translate(None, _UPPER)), m - len(b.translate(None, _LOWER))
    marks = len(b) - len(b.translate(None, _MARKS))
    size = sum(map(len, words))
    return [
        1.0, min(1.0, len(words) / 20), (upper - (not b)) / m, (lower - (not b)) / m, min(2.0, marks / n), min(1.0, (len(b) - len(b.translate(None, _DIGIT))) / n),
        len(set(words)) / n, sum(x == y for x, y in zip(words, words[1:])) / n, min(2.0, size / n / 10), float(b.rstrip()[-1:] in (b".", b"?")), float(b[:1].islower()),
    ]


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Features of each line (its own, and those of the lines before and after), and the lines' lengths."""
    lines = text.encode().split(b"\n")
    own = np.array([_line(b) for b in lines], np.float32)
    beside = np.zeros((len(lines) + 2, N_OWN), np.float32)
    beside[1:-1] = own
    return np.hstack([own, beside[:-2], beside[2:]]), np.array([max(1, len(b)) for b in lines], np.float64)


def marginals(emit: np.ndarray, move: np.ndarray) -> np.ndarray:
    """P(good) of each line by forward-backward; emit: (lines, 2) scores, move: (2, 2) scores of neighbours."""
    n = len(emit)
    e = np.exp(emit - emit.max(axis=1, keepdims=True)).tolist()
    (m00, m01), (m10, m11) = np.exp(move - move.max()).tolist()
    forward, backward = [None] * n, [None] * n
    a, b = e[0]
    for i in range(n):
        if i:
            a, b = (a * m00 + b * m10) * e[i][0], (a * m01 + b * m11) * e[i][1]
        t = a + b
        a, b = a / t, b / t
        forward[i] = (a, b)
    c, d = 1.0, 1.0
    for i in range(n - 1, -1, -1):
        backward[i] = (c, d)
        x, y = c * e[i][0], d * e[i][1]
        c, d = m00 * x + m01 * y, m10 * x + m11 * y
        t = c + d
        c, d = c / t, d / t
    f, g = np.array(forward), np.array(backward)
    p = f * g
    return p[:, 1] / p.sum(axis=1)


def likelihood(docs: list[np.ndarray], lines: list[np.ndarray], weight: np.ndarray, w: np.ndarray, move: np.ndarray) -> float:
    """The weighted log likelihood of the label chains that fit() climbs, one document at a time."""
    total = 0.0
    for x, y, k in zip(docs, lines, weight):
        emit = x @ w
        ahead = emit[0]
        for e in emit[1:]:
            ahead = np.logaddexp(ahead[0] + move[0], ahead[1] + move[1]) + e
        total += k * (emit[np.arange(len(y)), y].sum() + move[y[:-1], y[1:]].sum() - np.logaddexp(*ahead))
    return total


def fit(docs: list[np.ndarray], labels: list[int], lines: list[np.ndarray] | None = None, chained: bool = True, steps: int = STEPS, rate: float = 0.1, decay: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights (features, 2) and moves (2, 2) by gradient ascent (Adam) on the mean log likelihood of whole label chains,
    both classes of documents weighted alike. lines: labels of each document's lines, those of the documents if left out.
    Unless chained, moves stay zero, so each line stands alone."""
    longest, width = max(map(len, docs)), docs[0].shape[1]
    x = np.zeros((len(docs), longest, width), np.float32)
    here = np.zeros((len(docs), longest), bool)
    for i, d in enumerate(docs):
        x[i, : len(d)], here[i, : len(d)] = d, True
    y = np.asarray(labels)
    own = np.zeros((len(docs), longest), int)
    for i, d in enumerate(docs):
        own[i, : len(d)] = y[i] if lines is None else lines[i]
    share = np.bincount(y, minlength=2) / len(y)
    weight = 0.5 / share[y] / len(y) / here.sum(axis=1)
    w, move = np.zeros((width, 2)), np.zeros((2, 2))
    slopes = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(move), np.zeros_like(move)]
    last = here.sum(axis=1) - 1
    rows = np.arange(len(docs))
    for step in range(1, steps + 1):
        emit = x @ w.astype(np.float32)
        alpha, beta = np.zeros_like(emit, np.float64), np.zeros_like(emit, np.float64)
        alpha[:, 0] = emit[:, 0]
        for t in range(1, longest):
            alpha[:, t] = np.logaddexp(alpha[:, t - 1, :1] + move[0], alpha[:, t - 1, 1:] + move[1]) + emit[:, t]
        for t in range(longest - 2, -1, -1):
            ahead = emit[:, t + 1] + beta[:, t + 1]
            beta[:, t] = np.where(here[:, t + 1, None], np.logaddexp(move[:, 0] + ahead[:, :1], move[:, 1] + ahead[:, 1:]), 0.0)
        total = np.logaddexp(*alpha[rows, last].T)
        p = np.exp(np.minimum(alpha + beta - total[:, None, None], 0.0)) * here[..., None]
        error = (np.eye(2)[own] * here[..., None] - p) * weight[:, None, None]
        grad_w = np.einsum("dlf,dlk->fk", x, error) - decay * w
        pair = alpha[:, :-1, :, None] + move + (emit[:, 1:] + beta[:, 1:])[:, :, None, :] - total[:, None, None, None]
        pair = np.exp(np.minimum(pair, 0.0)) * here[:, 1:, None, None]
        want = np.zeros((2, 2))
        np.add.at(want, (own[:, :-1], own[:, 1:]), weight[:, None] * here[:, 1:])
        grad_m = want - (pair * weight[:, None, None, None]).sum(axis=(0, 1)) - decay * move if chained else move
        for k, (param, grad) in enumerate(((w, grad_w), (move, grad_m))):
            first, second = slopes[2 * k], slopes[2 * k + 1]
            first += 0.1 * (grad - first)
            second += 0.01 * (grad**2 - second)
            param += rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return w, move


Model = tuple[np.ndarray, np.ndarray] | float


def relabel(docs: list[np.ndarray], labels: list[int], model: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
    """Labels of lines by their marginals; at least half of a document's lines, the surest, keep the document's."""
    out = []
    for x, label in zip(docs, labels):
        p = marginals(x @ model[0], model[1])
        p = p if label else 1 - p
        lines = np.where(p >= 0.5, label, 1 - label)
        lines[np.argsort(-p, kind="stable")[: -(-len(p) // 2)]] = label
        out.append(lines)
    return out


def fit_instances(docs: list[np.ndarray], labels: list[int], rounds: int = ROUNDS) -> Model:
    """A model from labels of documents; the only label there is, or 1, where there are none of both kinds."""
    if len(set(labels)) < 2:
        return float(labels[0]) if labels else 1.0
    model = fit(docs, labels, chained=False)
    for _ in range(rounds):
        model = fit(docs, labels, relabel(docs, labels, model))
    return model


def score(text: str, model: Model) -> float:
    if isinstance(model, float):
        return model
    x, length = features(text)
    return float(np.average(marginals(x @ model[0], model[1]), weights=length))


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(FOLDS)) == 0


def train(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_DOCS) -> Model:
    """Fit on at most limit labelled documents that are not held out; only their features reach the driver. Of rows that
    repeat a doc_id, in either table, the one with the largest label or features counts."""
    quality = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    quality = quality.groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    first = quality.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    rows = texts(docs).join(first.withColumn("at", F.pmod(F.xxhash64("doc_id"), F.lit(1000)) / 1000.0), "doc_id").select("doc_id", "text", "quality", "at")

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in frames:
            out = []
            for i, t, q, at in zip(b["doc_id"], b["text"], b["quality"], b["at"]):
                x, _ = features(t)
                begin = int(at * (max(0, len(x) - TRAIN_LINES) + 1))
                out.append((i, q, x[begin : begin + TRAIN_LINES].astype("<f4").tobytes()))
            yield pd.DataFrame(out, columns=["doc_id", "quality", "x"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    found = rows.mapInPandas(of, f"doc_id {kind}, quality int, x binary").groupBy("doc_id", "quality").agg(F.max("x").alias("x")).orderBy("doc_id").collect()
    return fit_instances([np.frombuffer(r["x"], "<f4").reshape(-1, 3 * N_OWN) for r in found], [r["quality"] for r in found])


def quality_classifier(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    model = train(docs, labels)
    d = texts(docs).withColumn("held_out", held_out(F.col("doc_id")))

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in frames:
            yield pd.DataFrame({"doc_id": b["doc_id"], "held_out": b["held_out"], "score": [score(t, model) for t in b["text"]]})

    kind = d.schema["doc_id"].dataType.simpleString()
    out = d.mapInPandas(of, f"doc_id {kind}, held_out boolean, score double")
    return out.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))
