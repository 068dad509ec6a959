"""Toxicity: a factorization machine over hashed terms, which learns pairwise interactions between terms."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.llm.store import annotate, fold, labelled_sample
from lattica.llm.text import alnum_words, hashes

BUCKETS = 1 << 20


def terms(text: str | None) -> np.ndarray:
    """Hash buckets of a text's distinct words (indicator features), sorted."""
    return np.unique((hashes(list(set(alnum_words(text)))) % np.uint64(BUCKETS)).astype(np.int32))


def sums(values: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """Sum of each segment ptr[i]:ptr[i+1], empty ones 0 (values: one row an entry)."""
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0)])
    return total[ptr[1:]] - total[ptr[:-1]]


def logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


@dataclass
class FactorizationMachine:
    """score = logistic(b + sum w_i + sum_{i<j} <v_i, v_j> + sum_{i<j} <u_i, u_j> / n) over the n known buckets of a text.

    Every bucket of the labelled sample is known: ``slot`` maps a bucket to its row, or -1. All have ``w`` and ``u``; those
    that carry a marginal signal also have ``v`` (row ``place`` of it, else its row 0, of zeros). The sizes are bounded by
    ``BUCKETS``, whatever the corpus.
    """

    slot: np.ndarray
    place: np.ndarray
    bias: float
    w: np.ndarray
    v: np.ndarray
    u: np.ndarray

    def margins(self, ids: np.ndarray, ptr: np.ndarray) -> np.ndarray:
        out = self.bias + sums(self.w[ids].astype(float), ptr)
        for x, n in ((self.v[self.place[ids]], 1), (self.u[ids], np.maximum(np.diff(ptr), 1))):
            x = x.astype(float)
            out = out + 0.5 * (sums(x, ptr) ** 2 - sums(x * x, ptr)).sum(axis=1) / n
        return out

    def scores(self, texts: list, entries: int = 200_000) -> np.ndarray:
        """The scores of ``texts``, computed in runs of about ``entries`` terms."""
        out, rows, size = [np.zeros(0)], [], 0
        for i, t in enumerate(texts, 1):
            s = self.slot[terms(t)]
            rows.append(s[s >= 0])
            size += len(rows[-1])
            if size >= entries or i == len(texts):
                ptr = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
                out.append(logistic(self.margins(np.concatenate(rows).astype(np.int64), ptr)))
                rows, size = [], 0
        return np.concatenate(out)


def select(features: list[np.ndarray], y: np.ndarray, n_terms: int, min_df: int = 3) -> np.ndarray:
    """The buckets whose class log-odds lie furthest from 0 in standard errors, at most ``n_terms``."""
    pos, neg = (np.bincount(np.concatenate([f for f, l in zip(features, y) if l == c] or [np.zeros(0, np.int32)]), minlength=BUCKETS).astype(float) for c in (1, 0))
    n1, n0 = max(y.sum(), 1), max((1 - y).sum(), 1)
    log_odds = np.log((pos + 0.5) / (n1 - pos + 0.5)) - np.log((neg + 0.5) / (n0 - neg + 0.5))
    z = np.abs(log_odds) / np.sqrt(1 / (pos + 0.5) + 1 / (neg + 0.5) + 1 / (n1 - pos + 0.5) + 1 / (n0 - neg + 0.5))
    z[pos + neg < min_df] = 0
    best = np.argsort(-z, kind="stable")[:n_terms]
    return np.sort(best[z[best] > 2.0])


def fit(
    features: list[np.ndarray], y: np.ndarray, n_terms: int = 4096, rank: int = 8, epochs: int = 10, rate: float = 0.3, l2: float = 1e-3, seed: int = 7,
    l2_weak: float = 5.0, l2_all: float = 0.3,
) -> FactorizationMachine:
    """AdaGrad on the logistic loss over all buckets seen. No labelled rows: every score is 0.5's left neighbour (bias -1).

    The terms of ``select`` have freely fitted weights and factors. Weights of the others and the factors ``u`` of all,
    by which terms without a signal of their own interact, are held near 0 by ``l2_weak`` and ``l2_all`` a term and epoch.
    """
    slot = np.full(BUCKETS, -1, np.int32)
    if len(y) == 0:
        return FactorizationMachine(slot, np.zeros(1, np.int32), -1.0, np.zeros(1), np.zeros((1, rank)), np.zeros((1, rank)))
    seen = np.unique(np.concatenate(features))
    slot[seen] = np.arange(len(seen))
    size = max(len(seen), 1)
    chosen = slot[select(features, y, n_terms)]
    place = np.zeros(size, np.int32)
    place[chosen] = np.arange(1, len(chosen) + 1)
    strong = place > 0
    rng = np.random.default_rng(seed)
    prior = (y.sum() + 0.5) / (len(y) + 1)
    v = rng.normal(0, 0.01, (len(chosen) + 1, rank))
    v[0] = 0
    fm = FactorizationMachine(slot, place, float(np.log(prior / (1 - prior))), np.zeros(size), v, rng.normal(0, 0.05, (size, rank)))
    rows = [slot[f].astype(np.int64) for f in features]
    df = np.bincount(np.concatenate(rows), minlength=size)
    gw, gv, gu, gb = np.where(strong, 1e-6, 1.0), np.full(v.shape, 1e-6), np.full((size, rank), 1e-2), 1e-6
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), 64):
            part = order[at : at + 64]
            ids = np.concatenate([rows[i] for i in part])
            ptr = np.concatenate([[0], np.cumsum([len(rows[i]) for i in part])])
            d = logistic(fm.margins(ids, ptr)) - y[part]
            of = np.repeat(np.arange(len(part)), np.diff(ptr))
            gb += (g := d.mean()) ** 2
            fm.bias -= rate * g / np.sqrt(gb)
            if not len(ids):
                continue
            uniq, inv, times = np.unique(ids, return_inverse=True, return_counts=True)
            by, starts = np.argsort(inv, kind="stable"), np.cumsum(times) - times
            share = times / df[uniq]
            pull = np.bincount(inv, d[of], len(uniq))
            dw = np.where(strong[uniq], (pull + l2 * fm.w[uniq]) / len(part), pull + l2_weak * share * fm.w[uniq])
            gw[uniq] += dw**2
            fm.w[uniq] -= rate * dw / np.sqrt(gw[uniq])
            v = fm.v[place[ids]]
            own = np.flatnonzero(strong[ids])
            per = d[of[own], None] * (sums(v, ptr)[of[own]] - v[own])
            to = place[uniq[strong[uniq]]]
            dv = np.stack([np.bincount(inv[own], per[:, k], len(uniq)) for k in range(rank)], axis=1)[strong[uniq]] / len(part) + l2 / len(part) * fm.v[to]
            gv[to] += dv**2
            fm.v[to] -= rate * dv / np.sqrt(gv[to])
            u = fm.u[ids]
            per = (d / np.maximum(np.diff(ptr), 1))[of, None] * (sums(u, ptr)[of] - u)
            du = np.add.reduceat(per[by], starts, axis=0) + l2_all * share[:, None] * fm.u[uniq]
            gu[uniq] += du**2
            fm.u[uniq] -= rate * du / np.sqrt(gu[uniq])
    fm.w, fm.u = fm.w.astype(np.float32), fm.u.astype(np.float32)
    return fm


def train(docs: DataFrame, labels: DataFrame, keep=None, bound: int = 20_000, **how) -> FactorizationMachine:
    """Fit on at most ``bound`` labelled documents; the driver gets their bucket ids, never texts."""
    fields = T.StructType([T.StructField("f", T.BinaryType())])
    got = annotate(labelled_sample(docs, labels, "toxic", keep, bound), lambda texts: [[terms(t).tobytes() for t in texts]], fields, ("doc_id", "y")).toPandas().sort_values("doc_id", kind="stable")
    return fit([np.frombuffer(x, np.int32) for x in got["f"]], got["y"].to_numpy(float), **how)


def score_toxicity(docs: DataFrame, model: FactorizationMachine, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns plus ``score`` (0 to 1). Null and empty texts, having no term, score as the bias alone does."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return annotate(docs, lambda texts: [shared.value.scores(texts)], T.StructType([T.StructField("score", T.DoubleType())]), keep)


def contract(docs: DataFrame, labels: DataFrame, bound: int = 20_000) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``; labels of held-out ids are never read.

    Null and empty texts have no words and get the model's score of none; a null id counts as the empty text for the fold
    and is never learned from; contradicting labels of an id count as 1, null ones are ignored; repeated rows each give a
    row, an empty table none; other columns are left out, whatever their names.
    """
    scored = score_toxicity(docs, train(docs, labels, fold(5) != 0, bound))
    return scored.select("doc_id", (fold(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
