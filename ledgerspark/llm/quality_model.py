"""Quality classifier: a generalised additive model with pairwise interactions.

Texts become a short vector of numbers.  Training cuts each number into quantile bins and then boosts in cycles: one
shallow tree per feature and round, fitted to the gradient over that feature's bins and added to its lookup table;
afterwards the same over the pairs of features with the largest gain left.  A score is the sum of one table entry per
feature and pair, looked up for a whole batch at once.

Labels are learned from at most TRAIN_ROWS labelled rows, taken in the order of a hash of their id.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from itertools import combinations
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, held_out

TRAIN_ROWS = 12_000
BINS, PAIR_BINS, PAIRS = 32, 8, 6
FEATURES = ("log_words", "word_length", "distinct", "adjacent_repeats", "top_share", "symbols", "upper", "digits", "marks", "non_ascii", "line_words", "repeated_lines", "bars", "window_repeats", "short_words")


def text_features(text: str | None) -> list[float]:
    """FEATURES of a whole text; of a null or empty one, all zero."""
    text = text or ""
    w = text.split()
    n = len(w)
    if not n:
        return [0.0] * len(FEATURES)
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    counts = np.bincount(np.minimum(c, 128).astype(np.uint8), minlength=129)
    letters = counts[97:123].sum() + counts[65:91].sum() + counts[128]
    lines = [x for x in text.split("\n") if x.strip()]
    windows = list(zip(w, w[1:], w[2:], strict=False))
    return [
        float(np.log1p(n)),
        sum(map(len, w)) / n,
        len(set(w)) / n,
        sum(map(eq, w, w[1:])) / n,
        Counter(w).most_common(1)[0][1] / n,
        float(sum(counts[ord(x)] for x in "#*$%&<>!")) / n,
        float(counts[65:91].sum() / max(letters, 1)),
        float(counts[48:58].sum() / len(c)),
        float((counts[44] + counts[46] + counts[59] + counts[63]) / n),
        float(counts[128] / len(c)),
        n / max(len(lines), 1),
        1 - len(set(lines)) / max(len(lines), 1),
        float(counts[ord("|")]) / n,
        1 - len(set(windows)) / max(len(windows), 1) if windows else 0.0,
        sum(1 for x in w if len(x) < 3) / n,
    ]


def feature_matrix(texts: pd.Series) -> np.ndarray:
    return np.array([text_features(t) for t in texts], dtype=np.float32).reshape(len(texts), len(FEATURES))


def _split(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Best gain and cut of a histogram; cut 0: none."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = gl**2 / (hl + 1) + gr**2 / (hr + 1) - g.sum() ** 2 / (h.sum() + 1)
    gain[(hl < 0.5) | (hr < 0.5)] = 0
    return (float(gain.max()), int(gain.argmax()) + 1) if len(gain) and gain.max() > 1e-6 else (0.0, 0)


def shallow_tree(g: np.ndarray, h: np.ndarray, depth: int) -> np.ndarray:
    """Per bin, the leaf value of a tree of that depth over the bins' gradient and curvature sums."""
    cut = _split(g, h)[1] if depth else 0
    if not cut:
        return np.full(len(g), g.sum() / (h.sum() + 1))
    return np.concatenate([shallow_tree(g[:cut], h[:cut], depth - 1), shallow_tree(g[cut:], h[cut:], depth - 1)])


def pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values of the tree that cuts one axis, then the other on either side; the better order of axes."""
    best = (-1.0, np.zeros_like(g))
    for flip in (False, True):
        a, b = (g.T, h.T) if flip else (g, h)
        gain, cut = _split(a.sum(1), b.sum(1))
        parts = []
        for s in (slice(0, cut), slice(cut, None)):
            if cut or s.start == 0:
                rows = a[s] if cut else a
                more, _ = _split(rows.sum(0), (b[s] if cut else b).sum(0))
                gain += more
                parts.append(np.tile(shallow_tree(rows.sum(0), (b[s] if cut else b).sum(0), 1), (len(rows), 1)))
            if not cut:
                break
        if gain > best[0]:
            out = np.concatenate(parts)
            best = gain, out.T if flip else out
    return best


@dataclass
class AdditiveModel:
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    pair_cuts: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        for j, (cut, table) in enumerate(zip(self.cuts, self.tables, strict=True)):
            z += table[np.searchsorted(cut, x[:, j], side="right")]
        at = {j: np.searchsorted(self.pair_cuts[j], x[:, j], side="right") for p in self.pairs for j in p[:2]}
        for a, b, table in self.pairs:
            z += table[at[a], at[b]]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_arrays(x: np.ndarray, y: np.ndarray, rounds: int = 120, rate: float = 0.15) -> AdditiveModel:
    """Without labels of both kinds the model is constant: the smoothed share of ones."""
    share = (y.sum() + 1) / (len(y) + 2)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(len(FEATURES))]
    pair_cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, PAIR_BINS + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(len(FEATURES))]
    model = AdditiveModel(cuts, [np.zeros(len(c) + 1) for c in cuts], pair_cuts, [], float(np.log(share / (1 - share))))
    if not 0 < y.sum() < len(y):
        return model
    bins = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(cuts)]
    z = np.full(len(y), model.bias)

    def gradient() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for j, b in enumerate(bins):
            g, h = gradient()
            step = rate * shallow_tree(np.bincount(b, g, len(cuts[j]) + 1), np.bincount(b, h, len(cuts[j]) + 1), 2)
            model.tables[j] += step
            z += step[b]
    coarse = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(pair_cuts)]

    def grids(a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        shape = len(pair_cuts[a]) + 1, len(pair_cuts[b]) + 1
        at = coarse[a] * shape[1] + coarse[b]
        g, h = gradient()
        return at, np.bincount(at, g, shape[0] * shape[1]).reshape(shape), np.bincount(at, h, shape[0] * shape[1]).reshape(shape)

    gains = sorted(((pair_tree(*grids(a, b)[1:])[0], a, b) for a, b in combinations(range(len(FEATURES)), 2)), reverse=True)[:PAIRS]
    model.pairs = [(a, b, np.zeros((len(pair_cuts[a]) + 1, len(pair_cuts[b]) + 1))) for _, a, b in gains]
    for _ in range(rounds // 4):
        for a, b, table in model.pairs:
            at, g, h = grids(a, b)
            step = rate * pair_tree(g, h)[1]
            table += step
            z += step.ravel()[at]
    return model


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, max_chars: int | None = None) -> DataFrame:
    """doc_id, text, y: at most rows labelled rows that are not held out, in the order of a hash of their id.  Ids
    that are null, or labelled both ways, teach nothing; of documents with the same id one is taken, by a hash of its
    text."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min(label).alias("y"), F.max(label).alias("_most")).where(F.col("y") == F.col("_most"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).select("doc_id", "y")
    texts = docs.select("doc_id", "text")
    if max_chars:
        texts = texts.where(F.length("text") <= max_chars)
    # at most `rows` small rows: a proven bound for the broadcast
    taken = texts.join(F.broadcast(chosen), "doc_id")
    return taken.groupBy("doc_id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> AdditiveModel:
    bounded_batches(docs.sparkSession)
    features = F.pandas_udf(lambda t: pd.Series(list(feature_matrix(t))), "array<float>")
    rows = labelled_sample(docs, labels, label, TRAIN_ROWS).select("y", features("text").alias("x"), F.xxhash64("doc_id", "text").alias("o")).toPandas().sort_values("o")
    x = np.array(rows["x"].tolist(), dtype=np.float32).reshape(len(rows), len(FEATURES))
    return fit_arrays(x, rows["y"].to_numpy(dtype=float))


def score_column(model: AdditiveModel, text: Column) -> Column:
    """Score of whole texts, 0 to 1; a null or empty text is scored as its zero features."""
    return F.pandas_udf(lambda t: pd.Series(model.score(feature_matrix(t))), "double")(text)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted; one row per input row.  Tables without a label give one constant score."""
    model = fit(docs, labels)
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score_column(model, F.col("text")).alias("score"))
    return scored.select("*", (F.col("score") >= 0.3).cast("int").alias("predicted"))
