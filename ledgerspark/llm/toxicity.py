"""Toxic spans by a linear-chain conditional random field.

A text is its sequence of words, each toxic or not.  A word's emission is the sum of the weights of its features (the
lower-cased word, its first four to seven letters, its last three); a two by two table scores neighbours.  Forward and
backward passes give each word's marginal; a document's score is a logistic function of the largest marginal and of
their sum, and words with a marginal of at least 0.5 are the offending spans.

Labels mark whole documents, so token labels are derived first: in toxic documents of the sample, the words with a
feature that toxic documents hold far more often than clean ones.  The field then learns from these labelled tokens.
At most TRAIN_ROWS rows of each label, with at most TRAIN_CHARS characters teach it.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, held_out

TRAIN_ROWS, TRAIN_CHARS = {1: 1_500, 0: 4_500}, 20_000
SLOTS = 1 << 18
REMEMBERED = 200_000
#: Padded words in a batch of texts.
CELLS = 1 << 20
WORD = re.compile(r"\w+")


def word_features(word: str) -> list[int]:
    w = word.lower()
    return [zlib.crc32(f.encode("utf-8", "surrogatepass")) % SLOTS for f in (f"w {w}", f"4 {w[:4]}", f"5 {w[:5]}", f"6 {w[:6]}", f"7 {w[:7]}", f"s {w[-3:]}")]


def chain(e: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward passes over a batch, time along the first axis, e and table being exponentials: f[t] is
    the ratio of the forward weights of state 1 and state 0, g[t] that of the backward weights; a word's odds are
    f * g.  Every text starts behind a state 0."""
    (t00, t01), (t10, t11) = table
    f, g = np.empty_like(e), np.ones_like(e)
    f[0] = e[0] * t01 / t00
    for t in range(1, len(e)):
        f[t] = e[t] * (t01 + t11 * f[t - 1]) / (t00 + t10 * f[t - 1])
    for t in range(len(e) - 2, -1, -1):
        x = e[t + 1] * g[t + 1]
        g[t] = (t10 + t11 * x) / (t00 + t01 * x)
    return f, g


def _batches(order: list[int], emits: list[np.ndarray], size: int) -> Iterator[list[int]]:
    """order, by ascending length, in parts of at most size texts and, but for a single text, CELLS padded cells."""
    part: list[int] = []
    for i in order:
        if part and (len(part) == size or (len(part) + 1) * len(emits[i]) > CELLS):
            yield part
            part = []
        part.append(i)
    if part:
        yield part


def marginals(emits: list[np.ndarray], trans: np.ndarray, neighbours: np.ndarray | None = None, size: int = 256) -> list[np.ndarray]:
    """P(toxic) of each word of each text; neighbours, if given, gets the expected numbers of neighbouring states.

    Texts of like length share a batch, aligned at their ends.  What is padded in front has weight 0 for state 1, which
    is the very state that a text starts behind, so a text's result doesn't depend on its batch."""
    table = np.exp(trans)
    out: list[np.ndarray] = [np.zeros(0)] * len(emits)
    order = sorted((i for i in range(len(emits)) if len(emits[i])), key=lambda i: len(emits[i]))
    for part in _batches(order, emits, size):
        longest = len(emits[part[-1]])
        e = np.zeros((longest, len(part)))
        for c, i in enumerate(part):
            e[longest - len(emits[i]) :, c] = np.exp(np.clip(emits[i], -20, 20))
        f, g = chain(e, table)
        odds = f * g
        p = odds / (1 + odds)
        if neighbours is not None and longest > 1:
            x = e[1:] * g[1:]
            weights = np.array([[np.full_like(x, table[0, 0]), table[0, 1] * x], [table[1, 0] * f[:-1], table[1, 1] * f[:-1] * x]])
            real = np.arange(longest - 1)[:, None] >= longest - np.array([len(emits[i]) for i in part])[None, :]
            neighbours += (weights / weights.sum(axis=(0, 1)) * real).sum(axis=(2, 3))
        for c, i in enumerate(part):
            out[i] = p[longest - len(emits[i]) :, c]
    return out


def summary(p: np.ndarray) -> tuple[float, float]:
    return (float(p.max()), float(np.log1p(p.sum()))) if len(p) else (0.0, 0.0)


@dataclass
class ToxicModel:
    weights: np.ndarray
    bias: float
    trans: np.ndarray
    head: tuple[float, float, float]

    def emissions(self, known: dict[str, float], text: str | None) -> np.ndarray:
        ws = WORD.findall(text or "")
        return np.fromiter(map(known.__getitem__, ws), dtype=np.float64, count=len(ws))

    def head_score(self, p: np.ndarray) -> float:
        a, b, c = self.head
        most, total = summary(p)
        return float(1 / (1 + np.exp(-np.clip(a + b * most + c * total, -30, 30))))


class Emissions(dict):
    """Word -> emission, filled on demand and bounded."""

    def __init__(self, model: ToxicModel) -> None:
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> float:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = float(self.model.weights[word_features(word)].sum() + self.model.bias)
        return value


def numbered(texts: list[list[str]]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The vocabulary's feature matrix, and for each text its words' numbers."""
    number: dict[str, int] = {}
    ids = [np.fromiter((number.setdefault(w.lower(), len(number)) for w in ws), dtype=np.int64, count=len(ws)) for ws in texts]
    vocab = list(number)
    return np.array([word_features(w) for w in vocab], dtype=np.int64).reshape(len(vocab), 6), ids


def offensive_words(feats: np.ndarray, ids: list[np.ndarray], toxic: np.ndarray, least: float = 2.0) -> np.ndarray:
    """Marks the words of the vocabulary with a feature that toxic texts hold far more often than clean ones: by the
    lower end (1.5 standard errors) of the log odds, with 5 or more occurrences.  Occurrences count once for each word
    before them, so that copies of one text are no evidence."""
    held, total = np.zeros((2, SLOTS)), np.ones(2)
    n = max(len(feats), 1)
    for y in (0, 1):
        own = [t for t, label in zip(ids, toxic, strict=True) if label == y and len(t)]
        if own:
            seen = np.unique(np.concatenate([np.append(-1, t[:-1]) * n + t for t in own]))
            held[y] = np.bincount(feats[seen % n].ravel(), minlength=SLOTS)
            total[y] += len(seen)
    odds = np.log((held[1] + 0.5) / total[1]) - np.log((held[0] + 0.5) / total[0]) - 1.5 * np.sqrt(1 / (held[1] + 0.5) + 1 / (held[0] + 0.5))
    odds[held[1] < 5] = -9
    return odds[feats].max(axis=1) >= least if len(feats) else np.zeros(0, dtype=bool)


def fit_texts(texts: list[str], toxic: np.ndarray, epochs: int = 20, rate: float = 0.5, ridge: float = 1e-5) -> ToxicModel:
    """Without texts of both labels the model scores every text with the smoothed share of toxic ones."""
    share = (toxic.sum() + 1) / (len(toxic) + 2)
    model = ToxicModel(np.zeros(SLOTS), -4.0, np.zeros((2, 2)), (float(np.log(share / (1 - share))), 0.0, 0.0))
    if not 0 < toxic.sum() < len(toxic):
        return model
    feats, ids = numbered([WORD.findall(t) for t in texts])
    bad = offensive_words(feats, ids, toxic)
    gold = [bad[t] & bool(y) for t, y in zip(ids, toxic, strict=True)]
    seen = np.zeros(SLOTS) + 1e-8
    flat, flat_gold = np.concatenate(ids), np.concatenate(gold).astype(float)
    pairs = np.zeros((2, 2))
    for y in gold:
        np.add.at(pairs, (y[:-1].astype(int), y[1:].astype(int)), 1)
    seen_t, seen_b = np.full((2, 2), 1e-8), 1e-8
    n = len(flat)
    for _ in range(epochs):
        emit = model.weights[feats].sum(axis=1) + model.bias
        expected = np.zeros((2, 2))
        p = marginals([emit[t] for t in ids], model.trans, expected)
        grad_word = np.bincount(flat, flat_gold - np.concatenate(p), len(feats)) / n
        grad = np.bincount(feats.ravel(), np.repeat(grad_word, feats.shape[1]), SLOTS) - ridge * model.weights / SLOTS
        seen += grad**2
        model.weights += rate * grad / np.sqrt(seen)
        gb = grad_word.sum()
        seen_b += gb**2
        model.bias += 0.2 * rate * gb / np.sqrt(seen_b)
        gt = (pairs - expected) / n
        seen_t += gt**2
        model.trans += 0.1 * rate * gt / np.sqrt(seen_t)
    emit = model.weights[feats].sum(axis=1) + model.bias
    x = np.array([summary(q) for q in marginals([emit[t] for t in ids], model.trans)])
    model.head = _logistic(x, toxic)
    return model


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60) -> tuple[float, float, float]:
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(3)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + 0.5 * np.eye(3)
        w += np.linalg.solve(h, a.T @ (y - p) - 0.5 * w)
    return tuple(map(float, w))


def fit(docs: DataFrame, labels: DataFrame) -> ToxicModel:
    from .quality_model import labelled_sample

    rows = [labelled_sample(docs, labels.where(F.col("toxic") == y), "toxic", TRAIN_ROWS[y], TRAIN_CHARS).select("y", "text", F.xxhash64("doc_id", "text").alias("o")).toPandas() for y in (1, 0)]
    every = pd.concat(rows).sort_values(["o", "y"])
    return fit_texts(every["text"].tolist(), every["y"].to_numpy(dtype=float))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, spans (start:end of offending words in code points, comma-joined).

    One row per input row.  A null or empty text has no word and gets the head's score of no evidence."""
    bounded_batches(docs.sparkSession)
    model = fit(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        m = shared.value
        known = Emissions(m)
        for batch in batches:
            texts = batch.column(2).to_pylist()
            p = marginals([m.emissions(known, t) for t in texts], m.trans)
            spans = [",".join(f"{w.start()}:{w.end()}" for w, q in zip(WORD.finditer(t), row, strict=True) if q >= 0.5) if len(row) and row.max() >= 0.5 else "" for t, row in zip(texts, p, strict=True)]
            score = np.array([m.head_score(row) for row in p])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32), pa.int32()), pa.array(spans, pa.string())], names=["doc_id", "held_out", "score", "predicted", "spans"])

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int, spans string")
