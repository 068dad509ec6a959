"""Quality classifier: Naive Bayes support vectors over n-gram indicators of words and word shapes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.llm.store import annotate, fold, labelled_sample
from lattica.llm.text import hash_word, hashes, mix, raw
from lattica.llm.toxicity import logistic, sums

BUCKETS = 1 << 18
#: A-Z to X, a-z and bytes above 0x7F to x, 0-9 to 9, the rest as it is.
SHAPE = bytes(88 if 65 <= b <= 90 else 57 if 48 <= b <= 57 else 120 if 97 <= b <= 122 or b >= 128 else b for b in range(256))
ODD, SAME = np.uint64(0x9E3779B97F4A7C15), np.uint64(hash_word(b"same"))
EDGES = np.array([hash_word(b"first"), hash_word(b"last")], np.uint64)


class Grams:
    """Hash buckets of word unigrams and of shape 1- to 3-grams; a word equal to its predecessor has the shape ``=``.

    A shape is the word by character class with runs collapsed. The cache of shapes is bounded.
    """

    def __init__(self) -> None:
        self.seen: dict[bytes, int] = {}

    def shape(self, s: bytes) -> int:
        got = self.seen.get(s)
        if got is None:
            if len(self.seen) > 100_000:
                self.seen.clear()
            got = hash_word(b"shape " + s)
            if len(s) <= 64:
                self.seen[s] = got
        return got

    def of(self, text: str | None) -> np.ndarray:
        data = raw(text)
        words = hashes(data.lower().split())
        n = len(words)
        codes = np.frombuffer(data.translate(SHAPE), np.uint8)
        changed = np.ones(len(codes), bool)
        changed[1:] = codes[1:] != codes[:-1]
        shapes = np.empty(n + 2, np.uint64)
        shapes[0], shapes[-1] = EDGES
        shapes[1:-1] = np.fromiter(map(self.shape, codes[changed].tobytes().split()), np.uint64, n)
        shapes[2:-1][words[1:] == words[:-1]] = SAME
        two = mix(shapes[:-1] * ODD + shapes[1:])
        three = mix(two[:-1] * ODD + shapes[2:])
        return np.unique((np.concatenate([words, mix(shapes[1:-1]), two, three]) % np.uint64(BUCKETS)).astype(np.int32))


def stack(features: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    ptr = np.concatenate([[0], np.cumsum([len(f) for f in features])]).astype(np.int64)
    return (np.concatenate(features) if features else np.zeros(0, np.int32)), ptr


@dataclass
class NaiveBayesSvm:
    """margin = w . (r o f) / |r o f| + b; score = logistic(slope * margin + offset). Sizes are fixed by ``BUCKETS``."""

    r: np.ndarray
    w: np.ndarray
    bias: float
    slope: float = 1.0
    offset: float = 0.0

    def margins(self, features: list[np.ndarray]) -> np.ndarray:
        ids, ptr = stack(features)
        r = self.r[ids].astype(float)
        return sums(self.w[ids] * r, ptr) / np.sqrt(np.maximum(sums(r * r, ptr), 1e-12)) + self.bias

    def scores(self, texts: list) -> np.ndarray:
        grams = Grams()
        return logistic(self.slope * self.margins([grams.of(t) for t in texts]) + self.offset)


def log_count_ratios(features: list[np.ndarray], y: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    """log((p / |p|) / (q / |q|)) of the classes' smoothed indicator counts."""
    p, q = (np.bincount(stack([f for f, l in zip(features, y) if l == c])[0], minlength=BUCKETS) + alpha for c in (1, 0))
    r = np.log(p / p.sum()) - np.log(q / q.sum())
    r[p + q <= 2 * alpha + 1] = 0.0  # seen at most once: no evidence
    return r


def dual_coordinate_descent(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, weight: np.ndarray, size: int, epochs: int = 15, seed: int = 7) -> tuple[np.ndarray, float]:
    """min |w|^2/2 + sum C_i max(0, 1 - y_i (w.x_i + b)) in the dual, one alpha at a time (unit-norm rows, bias as a feature)."""
    w, b, alpha = np.zeros(size), 0.0, np.zeros(len(y))
    norm = np.array([float(x @ x) + 1.0 for _, x in rows])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(y)):
            ids, x = rows[i]
            gradient = y[i] * (w[ids] @ x + b) - 1.0
            new = min(max(alpha[i] - gradient / norm[i], 0.0), weight[i])
            if (step := (new - alpha[i]) * y[i]) != 0.0:
                w[ids] += step * x
                b += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w, b


def platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic calibration, by Newton steps on smoothed targets."""
    n1, n0 = y.sum(), (1 - y).sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a = np.array([1.0, 0.0])
    x = np.stack([margin, np.ones_like(margin)], axis=1)
    for _ in range(50):
        p = logistic(x @ a)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (p - t) + 1e-3 * a)
        a = a - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return max(float(a[0]), 1e-3), float(a[1])


def fit(features: list[np.ndarray], y: np.ndarray, cost: float = 1.0) -> NaiveBayesSvm:
    """Fit on four fifths, calibrate on the rest. Without rows every score is 0.5; with one class, that class's side."""
    if len(y) == 0 or y.min() == y.max():
        side = 0.0 if len(y) == 0 else 3.0 if y[0] == 1 else -3.0
        return NaiveBayesSvm(np.zeros(BUCKETS, np.float32), np.zeros(BUCKETS, np.float32), side)
    held = np.arange(len(y)) % 5 == 4
    if len(y) < 50 or len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held = np.zeros(len(y), bool)
    mine = [f for f, h in zip(features, held) if not h]
    r = log_count_ratios(mine, y[~held])
    rows = []
    for f in mine:
        f = f[r[f] != 0]
        x = r[f]
        rows.append((f, x / max(np.sqrt(x @ x), 1e-12)))
    sign = np.where(y[~held] == 1, 1.0, -1.0)
    share = np.array([(sign == s).mean() for s in sign])
    w, b = dual_coordinate_descent(rows, sign, cost * 0.5 / share, BUCKETS)
    model = NaiveBayesSvm(r.astype(np.float32), w.astype(np.float32), b)
    part = held if held.any() else ~held
    model.slope, model.offset = platt(model.margins([f for f, h in zip(features, part) if h]), y[part])
    return model


def train(docs: DataFrame, labels: DataFrame, keep=None, bound: int = 12_000, **how) -> NaiveBayesSvm:
    """Fit on at most ``bound`` labelled documents; the driver gets their bucket ids, never texts."""

    def fn(texts):
        grams = Grams()
        return [[grams.of(t).tobytes() for t in texts]]

    sample = labelled_sample(docs, labels, "quality", keep, bound)
    got = annotate(sample, fn, T.StructType([T.StructField("f", T.BinaryType())]), ("doc_id", "y")).toPandas().sort_values("doc_id", kind="stable")
    return fit([np.frombuffer(x, np.int32) for x in got["f"]], got["y"].to_numpy(float), **how)


def score_quality(docs: DataFrame, model: NaiveBayesSvm, keep: tuple[str, ...] = ("doc_id",), name: str = "score") -> DataFrame:
    """``keep`` columns plus the score (0 to 1). Null and empty texts have only the boundary shapes."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return annotate(docs, lambda texts: [shared.value.scores(texts)], T.StructType([T.StructField(name, T.DoubleType())]), keep)


def contract(docs: DataFrame, labels: DataFrame, bound: int = 12_000) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``; labels of held-out ids are never read.

    Null and empty texts have no words and get the model's score of none; a null id counts as the empty text for the fold
    and is never learned from; contradicting labels of an id count as 1, null ones are ignored; repeated rows each give a
    row, an empty table none; other columns are left out, whatever their names.
    """
    scored = score_quality(docs, train(docs, labels, fold(4) != 2, bound))
    return scored.select("doc_id", (fold(4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
