"""The best rows of each of many queries: kept by one task as it reads its rows. What a task holds is the queries, their best
and a block of scores."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Scores held at once, and the decimals that a rank by cosine goes by, so that a sum's order does not matter.
CELLS, PLACES = 4_000_000, 9


def dealt(df: DataFrame) -> DataFrame:
    """Rows dealt over all cores: each task returns its best of every query, so more tasks would only return more."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def ordered_sum(terms) -> np.ndarray:
    """Sum in the given order, as the engine's own folds take it."""
    total = 0.0
    for t in terms:
        total = total + t
    return total


class Best:
    """The ``k`` best a query by (rank, key): larger ranks first, then smaller keys. Ranks of -inf count as the last."""

    def __init__(self, queries: int, k: int) -> None:
        self.k, self.floor = k, np.full(queries, -np.inf)
        self.kept = pd.DataFrame({"q": np.zeros(0, np.int64), "rank": np.zeros(0), "score": np.zeros(0), "key": np.zeros(0, object)})
        self.new, self.waiting = [], 0

    def candidates(self, approx: np.ndarray, which: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray]:
        """Places (query among ``which``, row) of a block of approximate ranks that may be among the best."""
        low = self.floor[which]
        some = np.isneginf(low)
        if some.any() and approx.shape[1] > self.k:
            low[some] = np.partition(approx[some], approx.shape[1] - self.k, axis=1)[:, approx.shape[1] - self.k]
        return np.nonzero(approx >= (low - margin)[:, None])

    def add(self, q: np.ndarray, rank: np.ndarray, score: np.ndarray, key: np.ndarray) -> None:
        if not len(q):
            return
        self.new.append(pd.DataFrame({"q": q, "rank": rank, "score": score, "key": key}))
        self.waiting += len(q)
        if self.waiting > max(len(self.kept), 100_000) or np.isneginf(self.floor).all():
            self.settle()

    def settle(self) -> pd.DataFrame:
        if self.new:
            parts = ([self.kept] if len(self.kept) else []) + self.new
            both = pd.concat(parts, ignore_index=True).sort_values(["q", "rank", "key"], ascending=[True, False, True], kind="stable", ignore_index=True)
            place = both.groupby("q").cumcount()
            self.kept = both[place < self.k].reset_index(drop=True)
            last = both[place == self.k - 1]
            self.floor[last["q"].to_numpy()] = last["rank"].to_numpy()
            self.new, self.waiting = [], 0
        return self.kept


class Vectors:
    """Vectors of possibly different lengths, or none: matrices by length with their norms."""

    def __init__(self, values) -> None:
        self.count = len(values)
        sizes = np.array([-1 if v is None else len(v) for v in values], np.int64)
        self.by = {}
        for d in np.unique(sizes[sizes >= 0]).tolist():
            at = np.flatnonzero(sizes == d)
            m = np.array([values[i] for i in at], dtype=float).reshape(len(at), d)
            self.by[d] = at, m, np.sqrt(ordered_sum(c * c for c in m.T) + np.zeros(len(at)))


def offer(best: Best, queries: Vectors, keys: np.ndarray, rows: Vectors, asked=None) -> None:
    """Offers rows to the queries by cosine, 0 for a vector without length; with ``asked`` (an array of query numbers) to these
    alone. Vectors of other lengths than the query's, or none, have no score: they come last. A product of matrices finds the
    candidates, whose scores are then summed in order."""
    for d, (qat, qm, qn) in queries.by.items():
        if d not in rows.by:
            continue
        mine = np.flatnonzero(np.isin(qat, asked)) if asked is not None else np.arange(len(qat))
        bat, bm, bn = rows.by[d]
        if not len(mine):
            continue
        q, m, n = qat[mine], qm[mine], qn[mine]
        step = max(1, CELLS // len(mine))
        for a in range(0, len(bat), step):
            b, length = bm[a : a + step], n[:, None] * bn[None, a : a + step]
            with np.errstate(all="ignore"):
                approx = np.where(length == 0, 0.0, m @ b.T / length)
            approx[np.isnan(approx)] = np.inf
            i, j = best.candidates(approx, q, 2 * 10.0**-PLACES)
            for c in range(0, len(i), CELLS):
                x, y = i[c : c + CELLS], j[c : c + CELLS]
                with np.errstate(all="ignore"):
                    size = n[x] * bn[a + y]
                    score = np.where(size == 0, 0.0, ordered_sum(m[x, e] * b[y, e] for e in range(d)) / size)
                best.add(q[x], np.where(np.isnan(score), np.inf, np.round(score, PLACES)), score, keys[bat[a + y]])
    if asked is None:
        for d, (qat, _, _) in [*queries.by.items(), (None, (np.flatnonzero(lengths_of(queries) < 0), None, None))]:
            # what has no score counts only while a query has not found enough
            few = qat[np.isneginf(best.floor[qat])]
            none = np.setdiff1d(np.arange(rows.count), rows.by[d][0] if d in rows.by else [])
            none = none[np.argsort(keys[none], kind="stable")][: best.k]
            if len(few) and len(none):
                best.add(np.repeat(few, len(none)), np.full(len(few) * len(none), -np.inf), np.full(len(few) * len(none), np.nan), np.tile(keys[none], len(few)))


def lengths_of(v: Vectors) -> np.ndarray:
    out = np.full(v.count, -1)
    for d, (at, _, _) in v.by.items():
        out[at] = d
    return out
