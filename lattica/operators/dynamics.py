"""Directed and joint dependence of series: a group is one pandas group. Neighbours are found without all pairs; the pairs of
cross mapping are taken in blocks (time grows with the square of the library, memory with a block). Too few samples give null
estimates."""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations
from math import erfc, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.operators.estimators import blocks
from lattica.operators.neighbours import count_within, kth_distance
from lattica.operators.stats import corr

#: The least samples of an estimate, and of a total correlation for each column.
LEAST, LEAST_PER_COLUMN = 50, 50


def digamma(m: np.ndarray) -> np.ndarray:
    """Of positive integers."""
    m = np.asarray(m)
    harmonic = np.concatenate([[0.0], np.cumsum(1 / np.arange(1, max(int(m.max()), 1) + 1))])
    return harmonic[m - 1] - 0.5772156649015329


def information(x: np.ndarray, y: np.ndarray, k: int = 3) -> float:
    """Mutual information in bits of two sets of columns by k nearest neighbours; it may be slightly negative."""
    n = len(x)
    e = kth_distance(np.hstack([x, y]), k)
    nx, ny = count_within(x, e) - 1, count_within(y, e) - 1
    ends = digamma(np.array([k]))[0] + digamma(np.array([n]))[0]
    return float((ends - (digamma(np.maximum(nx, 0) + 1) + digamma(np.maximum(ny, 0) + 1)).mean()) / np.log(2))


def entropy(a: np.ndarray, k: int = 3) -> float:
    """Differential entropy in bits by the distance to the k-th neighbour. More than k equal rows have none: that raises."""
    n, e = len(a), kth_distance(a, k)
    if not (e > 0).all():
        raise ValueError("more equal rows than neighbours")
    logs = float(np.log(e).sum())
    return float((digamma(np.array([n]))[0] - digamma(np.array([k]))[0] + a.shape[1] * (np.log(2) + logs / n)) / np.log(2))


def grouped(df: DataFrame, by: str, columns: list[str], run: Callable[[pd.DataFrame], list[dict]], schema: str) -> DataFrame:
    """Rows of ``run`` over each group's rows of finite numbers in ``columns``, each with its group's ``key``."""

    def work(part: pd.DataFrame) -> pd.DataFrame:
        a = part.drop(columns="_group").set_axis(columns, axis=1).replace([np.inf, -np.inf], np.nan).dropna()
        names = [f.split()[0] for f in schema.split(", ")]
        return pd.DataFrame([{"key": part["_group"].iloc[0]} | r for r in run(a)], columns=["key", *names])

    inner = [F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(columns)]
    return df.select(F.col(by).cast("string").alias("_group"), *inner).groupBy("_group").applyInPandas(work, f"key string, {schema}")


def lagged(a: dict, b: dict, lag: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The future of ``b`` with both pasts and with its own, wherever all three moments were observed."""
    found = [(b[t + lag], a[t], b[t + lag - 1]) for t in sorted(a) if t + lag in b and t + lag - 1 in b]
    m = np.array(found, dtype=float).reshape(-1, 3)
    return m[:, :1], m[:, 1:], m[:, 2:]


def flow(parts: tuple[np.ndarray, np.ndarray, np.ndarray], k: int) -> float:
    future, both, own = parts
    return max(0.0, information(future, both, k) - information(future, own, k))


def transfer_entropy(df: DataFrame, by: str, time: str, a: str, b: str, lags: list[int], k: int = 3, resamples: int = 0, seed: int = 52) -> DataFrame:
    """(key, lag, n, forward, backward, low, high): bits that a's value adds to b's own last one about b ``lag`` whole steps on,
    and the other way round; two rows of one time raise. With ``resamples`` the 95 % ends of the forward one over samples of
    half the rows, drawn without replacement."""

    def run(rows: pd.DataFrame) -> list[dict]:
        if rows[time].duplicated().any():
            raise ValueError("two values of one time")
        t = rows[time].astype("int64")
        va, vb = dict(zip(t, rows[a])), dict(zip(t, rows[b]))
        out = []
        for lag in lags:
            there, back = lagged(va, vb, lag), lagged(vb, va, lag)
            n = min(len(there[0]), len(back[0]))
            got = {"lag": lag, "n": n, "forward": None, "backward": None, "low": None, "high": None}
            if n >= LEAST:
                got |= {"forward": flow(there, k), "backward": flow(back, k)}
                rng = np.random.default_rng(seed)
                picks = (rng.choice(n, max(n // 2, k + 2), replace=False) for _ in range(resamples))
                drawn = [flow(tuple(p[i] for p in there), k) for i in picks]
                if drawn:
                    got |= {"low": float(np.quantile(drawn, 0.025)), "high": float(np.quantile(drawn, 0.975))}
            out.append(got)
        return out

    return grouped(df, by, [time, a, b], run, "lag int, n long, forward double, backward double, low double, high double")


def total_correlation(df: DataFrame, by: str, columns: list[str], k: int = 3) -> DataFrame:
    """(key, n, marginal, joint, total, effective): sum of the columns' entropies, their joint one, the difference (0 at the
    least), and the effective number of columns; null below 50 rows a column. Where more than k rows are equal an entropy has no
    estimate: it is null with what follows from it, and the other groups are unharmed."""

    def known(a: np.ndarray) -> float | None:
        try:
            return entropy(a, k)
        except ValueError:
            return None

    def run(rows: pd.DataFrame) -> list[dict]:
        m, c = rows.to_numpy(float), len(columns)
        if len(m) < LEAST_PER_COLUMN * c:
            return [{"n": len(m), "marginal": None, "joint": None, "total": None, "effective": None}]
        each, joint = [known(m[:, [i]]) for i in range(c)], known(m)
        marginal = None if None in each else sum(each)
        if marginal is None or joint is None:
            return [{"n": len(m), "marginal": marginal, "joint": joint, "total": None, "effective": None}]
        total = max(0.0, marginal - joint) if c > 1 else 0.0
        below = marginal if marginal > 1.2e-7 else max(total, 1.2e-7)
        return [{"n": len(m), "marginal": marginal, "joint": joint, "total": total, "effective": float(np.clip(c * (1 - total / below), 1, c)) if c > 1 else 1.0}]

    return grouped(df, by, columns, run, "n long, marginal double, joint double, total double, effective double")


def interaction_information(df: DataFrame, by: str, a: str, b: str, c: str, k: int = 3) -> DataFrame:
    """(key, n, bits): I(a; b) - I(a; b | c), positive where c makes them redundant, negative where it makes them synergistic;
    null below 150 rows."""

    def run(rows: pd.DataFrame) -> list[dict]:
        x, y, z = (rows[[v]].to_numpy(float) for v in (a, b, c))
        if len(x) < LEAST_PER_COLUMN * 3:
            return [{"n": len(x), "bits": None}]
        given = max(0.0, information(x, np.hstack([y, z]), k) - information(x, z, k))
        return [{"n": len(x), "bits": information(x, y, k) - given}]

    return grouped(df, by, [a, b, c], run, "n long, bits double")


def cross_map(x: np.ndarray, y: np.ndarray, dim: int, tau: int, size: int) -> float:
    """Correlation of y with its forecast from the dim + 1 nearest delay vectors of x among the first ``size``."""
    start = (dim - 1) * tau
    e = np.column_stack([x[start - i * tau : len(x) - i * tau] for i in range(dim)])[:size]
    target, guess = y[start:][:size], np.empty(size)
    for at in blocks(size):
        d = sqrt_sum(e, at)
        d[np.arange(len(d)), np.arange(size)[at]] = np.inf
        near = np.argsort(d, axis=1, kind="stable")[:, : dim + 1]
        far = np.take_along_axis(d, near, 1)
        first = far[:, :1]
        w = np.where(first <= 1e-12, (far <= 1e-12).astype(float), np.exp(-far / np.maximum(first, 1e-12)))
        guess[at] = (w * target[near]).sum(1) / w.sum(1)
    spread_ = guess.std() * target.std()
    return float(((guess - guess.mean()) * (target - target.mean())).mean() / spread_) if spread_ > 0 else 0.0


def sqrt_sum(e: np.ndarray, at: slice) -> np.ndarray:
    """Euclidean distances of a block of rows to all."""
    return np.sqrt(sum((e[at, None, c] - e[None, :, c]) ** 2 for c in range(e.shape[1])))


def convergent_cross_mapping(df: DataFrame, by: str, time: str, x: str, y: str, sizes: list[int], dim: int = 2, tau: int = 1, delta: float = 0.05, gap: float = 0.05) -> DataFrame:
    """(key, size, x_to_y, y_to_x, verdict): skill of the one's delay vectors at telling the other, for growing libraries. A
    direction converges if its skill grows by ``delta`` from the first to the last size; what x's vectors tell of y speaks for y
    driving x. Sizes beyond the series, or not above dim + 1, give null skills."""

    def run(rows: pd.DataFrame) -> list[dict]:
        rows = rows.sort_values([time, x, y], kind="stable")
        u, v = rows[x].to_numpy(float), rows[y].to_numpy(float)
        usable = len(u) - (dim - 1) * tau
        skills = [(s, cross_map(u, v, dim, tau, s), cross_map(v, u, dim, tau, s)) if dim + 1 < s <= usable else (s, None, None) for s in sizes]
        known = [s for s in skills if s[1] is not None]
        verdict = "too_few"
        if len(known) >= 2:
            up = [known[-1][i] - known[0][i] >= delta for i in (1, 2)]
            lead = known[-1][1] - known[-1][2]
            verdict = "none" if not any(up) else "y_drives_x" if up[0] and lead > gap else "x_drives_y" if up[1] and lead < -gap else "both"
        return [{"size": s, "x_to_y": p, "y_to_x": q, "verdict": verdict} for s, p, q in skills]

    return grouped(df, by, [time, x, y], run, "size int, x_to_y double, y_to_x double, verdict string")


def hawkes(df: DataFrame, by: str, process: str, time: str, decay: float = 2.0, iterations: int = 50) -> DataFrame:
    """(key, target, source, events, rate, branching): exponential self- and cross-excitation by expectation maximisation with a
    fixed decay. ``process`` holds numbers; times count from the group's first event, and observation ends with its last.

    Kernel sums are carried from event to event, so a group costs its events times its processes. A group that spans no time
    gives no rows.
    """

    def run(rows: pd.DataFrame) -> list[dict]:
        rows = rows.sort_values([time, process], kind="stable")
        names, who = np.unique(rows[process].to_numpy(), return_inverse=True)
        t = rows[time].to_numpy(float)
        if len(t) < 2 or t[-1] <= t[0]:
            return []
        t = t - t[0]
        d, end = len(names), t[-1]
        sums, now, last, i = np.zeros((len(t), d)), np.zeros(d), 0.0, 0
        while i < len(t):  # events of one moment do not excite one another
            j = i
            while j < len(t) and t[j] == t[i]:
                j += 1
            now *= np.exp(-decay * (t[i] - last))
            sums[i:j] = now * decay
            now, last, i = now + np.bincount(who[i:j], minlength=d), t[i], j
        counts = np.bincount(who, minlength=d)
        exposure = np.maximum(np.bincount(who, weights=1 - np.exp(-decay * (end - t)), minlength=d), 1e-12)
        rate, branch = 0.5 * counts / end, np.full((d, d), 0.05)
        for _ in range(iterations):
            part = branch[who] * sums
            all_ = rate[who] + part.sum(1)
            rate = np.bincount(who, weights=rate[who] / all_, minlength=d) / end
            caused = np.zeros((d, d))
            np.add.at(caused, who, part / all_[:, None])
            branch = caused / exposure[None, :]
        return [{"target": float(names[a]), "source": float(names[b]), "events": int(counts[a]), "rate": float(rate[a]), "branching": float(branch[a, b])} for a in range(d) for b in range(d)]

    return grouped(df, by, [process, time], run, "target double, source double, events long, rate double, branching double")


#: Costs of intervals that the division of a side holds at once: they should fit a core's cache.
COSTS = 32_768


def best_partition(labels: np.ndarray, clumps: np.ndarray, rows: int, parts: int) -> np.ndarray:
    """Largest mutual information (nats) of ``labels`` with 2..parts intervals whose ends are ends of ``clumps`` (sizes along the
    other axis), by dynamic programming over ends; a vector from 0 at one interval. The intervals' costs are made for a block of
    last ends at a time, for all numbers of intervals, so that memory is ``parts`` times the clumps."""
    ends = np.concatenate([[0], np.cumsum(clumps)])
    k, n = len(clumps), len(labels)
    cum = np.zeros((rows, k + 1), np.int64)
    cum[:, 1:] = np.cumsum(np.bincount(labels * k + np.repeat(np.arange(k), clumps), minlength=rows * k).reshape(rows, k), axis=1)
    counts = np.arange(n + 1)
    weight = counts * np.log(np.maximum(counts, 1))
    best = np.zeros((parts, k + 1))
    step = max(1, COSTS // (k + 1))
    for first in range(0, k + 1, step):
        last = min(first + step, k + 1)
        cost = np.zeros((last - first, last))  # [to, from]
        for c in cum:
            cost += weight[np.maximum(c[first:last, None] - c[None, :last], 0)]
        cost -= weight[np.maximum(ends[first:last, None] - ends[None, :last], 0)]
        cost[np.arange(last)[None, :] > np.arange(first, last)[:, None]] = -np.inf
        best[0, first:last] = cost[:, 0]
        through = np.empty_like(cost)
        for p in range(1, parts):
            np.add(cost, best[p - 1, :last], out=through)
            through.max(axis=1, out=best[p, first:last])
    whole = cum[:, -1][cum[:, -1] > 0] / n
    h = float(-(whole * np.log(whole)).sum())
    return np.maximum.accumulate(np.concatenate([[0.0], h + best[1:, -1] / n]))


def middle_ranks(v: np.ndarray) -> np.ndarray:
    """Rows before each one, equal values counted by half."""
    _, at, counts = np.unique(v, return_inverse=True, return_counts=True)
    return (np.concatenate([[0], np.cumsum(counts)[:-1]]) + (counts - 1) / 2)[at]


def equal_parts(ranks: np.ndarray, parts: int) -> np.ndarray:
    """Labels of about equal size by middle rank; equal values share one."""
    return np.minimum((ranks / len(ranks) * parts).astype(int), parts - 1)


def clumps_of(start: np.ndarray, labels: np.ndarray, most: int) -> np.ndarray:
    """Sizes of runs along sorted values, whose equal ones begin at ``start``, that no interval's end need split: equal values
    together, then runs of one label; joined to at most ``most`` about equal ones."""
    n = len(labels)
    ends = np.append(start[1:], n)
    low, high = np.minimum.reduceat(labels, start), np.maximum.reduceat(labels, start)
    pure = np.where(low == high, low, -1 - np.arange(len(ends)))
    ends = ends[np.append(pure[1:] != pure[:-1], True)]
    if len(ends) > most:
        slot = (ends * most / n).astype(int)
        ends = ends[np.append(slot[1:] != slot[:-1], True)]
    return np.diff(np.concatenate([[0], ends]))


def maximal_information(x: np.ndarray, y: np.ndarray, exponent: float = 0.6, clumps: int = 15) -> float:
    """Largest mutual information over the log of the smaller side, of grids of at most n ** exponent cells: one side in equal
    parts, the other divided best. Fewer than four rows or a constant raise."""
    n = len(x)
    if n < 4 or x.min() == x.max() or y.min() == y.max():
        raise ValueError("too few rows or a constant")
    cells, best = max(n**exponent, 4.0), 0.0
    for a, b in ((x, y), (y, x)):
        order = np.argsort(a, kind="stable")
        ranks, start = middle_ranks(b[order]), np.flatnonzero(np.append(True, np.diff(a[order]) != 0))
        for rows in range(2, int(cells // 2) + 1):
            parts = int(cells // rows)
            labels = equal_parts(ranks, rows)
            got = best_partition(labels, clumps_of(start, labels, clumps * parts), rows, parts)
            best = max(best, max(got[p - 1] / np.log(min(p, rows)) for p in range(2, parts + 1)))
    return min(1.0, best)


def maximal_information_by(df: DataFrame, by: str, x: str, y: str) -> DataFrame:
    """(key, n, mic) of each group's finite pairs."""
    return grouped(df, by, [x, y], lambda r: [{"n": len(r), "mic": maximal_information(r[x].to_numpy(float), r[y].to_numpy(float))}], "n long, mic double")


def skeleton(df: DataFrame, columns: list[str], alpha: float = 0.01, most: int = 2) -> DataFrame:
    """(a, b, kept, depth, given, p): the order-free skeleton of Gaussian columns. Correlations are one aggregation over the
    table; an edge goes if its partial correlation given up to ``most`` neighbours of either end is not significant by Fisher's
    transform. Edges kept have no depth. The search is the driver's, over column pairs."""
    d = len(columns)
    pairs = list(combinations(range(d), 2))
    row = df.dropna(subset=columns).agg(F.count("*"), *[corr(columns[i], columns[j]) for i, j in pairs]).first()
    n, m = row[0], np.eye(d)
    for (i, j), r in zip(pairs, row[1:]):
        if r is None or np.isnan(r):
            raise ValueError(f"{columns[i]} or {columns[j]} is constant")
        m[i, j] = m[j, i] = r

    def p_value(i: int, j: int, given: tuple) -> float:
        inverse = np.linalg.pinv(m[np.ix_([i, j, *given], [i, j, *given])])
        r = float(np.clip(-inverse[0, 1] / sqrt(inverse[0, 0] * inverse[1, 1]), -0.999999999, 0.999999999))
        free = n - len(given) - 3
        return erfc(abs(np.arctanh(r)) * sqrt(free) / sqrt(2)) if free > 0 else 1.0

    near = {i: set(range(d)) - {i} for i in range(d)}
    gone: dict[tuple, tuple] = {}
    for depth in range(most + 1):
        was = {i: set(s) for i, s in near.items()}
        for i, j in pairs:
            if j not in was[i]:
                continue
            sets = sorted({s for e, o in ((i, j), (j, i)) for s in combinations(sorted(was[e] - {o}), depth)})
            for s in sets:
                p = p_value(i, j, s)
                if p > alpha:
                    gone[i, j] = (depth, ",".join(columns[c] for c in s), p)
                    near[i].discard(j)
                    near[j].discard(i)
                    break
    rows = [(columns[i], columns[j], (i, j) not in gone, *gone.get((i, j), (None, None, None))) for i, j in pairs]
    return df.sparkSession.createDataFrame(rows, "a string, b string, kept boolean, depth int, given string, p double")
