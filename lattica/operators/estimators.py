"""Estimators of two columns: one group is one pandas group. None needs all pairs: distances are summed by sorting, kernels by
their Fourier series, neighbours are found box by box. Only a kernel far narrower than its group's range takes all pairs, in
blocks; a task then holds the group's two columns and a block, and time grows with the square of the group."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.operators.neighbours import count_within, kth_distance
#: Cells of a block of pairwise values that a group's task holds at once.
CELLS = 4_000_000


def blocks(n: int):
    """Slices of rows whose pairs with all ``n`` are about ``CELLS``."""
    step = max(1, CELLS // max(n, 1))
    return (slice(at, at + step) for at in range(0, n, step))


def centred_product(x: np.ndarray, y: np.ndarray, kx, ky) -> float:
    """Mean product of two doubly centred matrices kx(x_i, x_j) and ky(y_i, y_j), from sums over blocks of rows."""
    n, both = len(x), 0.0
    rx, ry = np.empty(n), np.empty(n)
    for at in blocks(n):
        a, b = kx(x[at, None] - x[None, :]), ky(y[at, None] - y[None, :])
        both += float((a * b).sum())
        rx[at], ry[at] = a.mean(1), b.mean(1)
    return both / n**2 - 2 * float((rx * ry).mean()) + float(rx.mean() * ry.mean())


def distance_products(x: np.ndarray, y: np.ndarray) -> float:
    """Sum of |x_i - x_j| |y_i - y_j| over all ordered pairs: along sorted x, what the pairs with y in order too give is
    counted twice as blocks are merged, and all pairs once without their signs."""
    n = len(x)
    at = np.argsort(x, kind="stable")
    rank = np.empty(n, np.int64)
    rank[np.argsort(y[at], kind="stable")] = np.arange(n)
    size = 1 << max(n - 1, 1).bit_length()
    u, v, w = np.zeros(size), np.zeros(size), np.zeros(size)  # rows added to fill up count nothing
    u[:n], v[:n], w[:n] = x[at], y[at], 1
    rank, agreed, width = np.concatenate([rank, np.arange(n, size)]), 0.0, 1
    while width < size:
        pairs = (-1, 2 * width)
        o = np.argsort(rank.reshape(pairs), axis=1)
        a, b, one = (np.take_along_axis(c.reshape(pairs), o, 1) for c in (u, v, w))
        left = np.where(o < width, one, 0)
        below, below_a, below_b, below_ab = (np.cumsum(left * c, axis=1) for c in (1, a, b, a * b))
        agreed += float(np.where(o >= width, one * (below * a * b - a * below_b - b * below_a + below_ab), 0).sum())
        width *= 2
    return 2 * (2 * agreed - (n * float((x * y).sum()) - float(x.sum()) * float(y.sum())))


def mean_distances(x: np.ndarray) -> np.ndarray:
    """Mean distance of each row to all."""
    n, at = len(x), np.argsort(x, kind="stable")
    s = x[at]
    before = np.cumsum(s) - s
    out = np.empty(n)
    out[at] = (s * (2 * np.arange(n) - n) + s.sum() - 2 * before) / n
    return out


def distance_covariance(x: np.ndarray, y: np.ndarray) -> float:
    """Mean product of the two doubly centred distance matrices."""
    n, rx, ry = len(x), mean_distances(x), mean_distances(y)
    both = 2 * (n * float((x * x).sum()) - float(x.sum()) ** 2) if x is y else distance_products(x, y)
    return both / n**2 - 2 * float((rx * ry).mean()) + float(rx.mean() * ry.mean())


def distance_correlation(x: np.ndarray, y: np.ndarray) -> float:
    if x.min() == x.max() or y.min() == y.max():
        return 0.0
    x, y = x - x.mean(), y - y.mean()
    v = np.sqrt(max(distance_covariance(x, x), 0) * max(distance_covariance(y, y), 0))
    return float(np.sqrt(max(distance_covariance(x, y), 0) / v)) if v > 0 else 0.0


def gap_at(x: np.ndarray, rank: int) -> float:
    """The ``rank``-th (from 1) smallest of the distances above 0 between two rows, found by halving its bits; memory is
    that of ``x``."""
    x = np.sort(x)
    ends = np.arange(len(x))

    def within(d: float) -> int:
        return int((np.searchsorted(x, x + d, "right") - 1 - ends).sum())

    zero = within(0.0)
    lo, hi = 0, int(np.float64(x[-1] - x[0]).view(np.int64))
    while lo < hi:
        mid = (lo + hi) // 2
        if within(float(np.int64(mid).view(np.float64))) - zero >= rank:
            hi = mid
        else:
            lo = mid + 1
    return float(np.int64(lo).view(np.float64))


def bandwidth(x: np.ndarray) -> float:
    """Median of the squared distances above 0, 1 without any."""
    n = len(x)
    _, counts = np.unique(x, return_counts=True)
    pairs = (n * n - int((counts.astype(np.int64) ** 2).sum())) // 2
    if pairs == 0:
        return 1.0
    # each pair counts twice, so the two middle values of an even number are the same pair unless pairs is even
    return (gap_at(x, (pairs + 1) // 2) ** 2 + gap_at(x, pairs // 2 + 1) ** 2) / 2


#: Frequencies of a kernel's series held at once.
FREQUENCIES = 1000


def frequencies(reach: float, width: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Frequencies and weights whose cosines sum to exp(-d * d / width) for distances up to ``reach``, to the last places of a
    double: the period is so long that its repetition, and the last frequency so high that the rest, is below 1e-17. None if
    there are more than 2 ** 22."""
    period = reach + 6.4 * np.sqrt(width)
    count = period / np.sqrt(width) * 6.4 / np.pi
    if not count < 2**22:
        return None
    f = 2 * np.pi / period * np.arange(int(np.ceil(count)) + 1)
    w = 2 * np.sqrt(np.pi * width) / period * np.exp(-f * f * width / 4)
    w[0] /= 2
    return f, w


def waves(x: np.ndarray, f: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weighted cosines and sines, whose products over columns are the kernel."""
    t = x[:, None] * f[None, :]
    return np.concatenate([np.cos(t), np.sin(t)], axis=1) * np.tile(np.sqrt(w), 2)


def hsic(x: np.ndarray, y: np.ndarray) -> float:
    """Mean product of two doubly centred Gaussian kernels."""
    mx, my, n = bandwidth(x), bandwidth(y), len(x)
    fx, fy = frequencies(x.max() - x.min(), mx), frequencies(y.max() - y.min(), my)
    if fx is None or fy is None or max(len(fx[0]), len(fy[0])) > FREQUENCIES or len(fx[0]) * len(fy[0]) > 100 * n:
        return centred_product(x, y, lambda d: np.exp(-d * d / mx), lambda d: np.exp(-d * d / my))
    x, y = x - x.mean(), y - y.mean()
    step = max(1, CELLS // (2 * FREQUENCIES))
    slices = [slice(at, at + step) for at in range(0, n, step)]
    mean_x, mean_y = (sum(waves(v[at], *f).sum(0) for at in slices) / n for v, f in ((x, fx), (y, fy)))
    both = sum((waves(x[at], *fx) - mean_x).T @ (waves(y[at], *fy) - mean_y) for at in slices) / n
    return float((both * both).sum())


def ksg(x: np.ndarray, y: np.ndarray, k: int = 3) -> float:
    """Mutual information in bits by nearest neighbours in the largest-coordinate metric, 0 at the least."""
    n = len(x)
    if n <= k:
        return 0.0
    e = kth_distance(np.column_stack([x, y]), k)
    nx, ny = count_within(x[:, None], e) - 1, count_within(y[:, None], e) - 1
    harmonic = np.concatenate([[0.0], np.cumsum(1 / np.arange(1, n + 1))])
    psi = lambda m: harmonic[m - 1] - 0.5772156649015329
    value = psi(np.array(k)) + psi(np.array(n)) - (psi(np.maximum(nx, 0) + 1) + psi(np.maximum(ny, 0) + 1)).mean()
    return max(0.0, float(value / np.log(2)))


def mmd(x: np.ndarray, y: np.ndarray) -> float:
    """Squared maximum mean discrepancy of two samples under one Gaussian kernel."""
    z = np.concatenate([x, y])
    width = bandwidth(z)
    found = frequencies(z.max() - z.min(), width)
    if found is None or len(found[0]) > len(z):
        mean = lambda a, b: sum(float(np.exp(-((a[at, None] - b[None, :]) ** 2) / width).sum()) for at in blocks(max(len(a), len(b)))) / (len(a) * len(b))
        return mean(x, x) + mean(y, y) - 2 * mean(x, y)
    x, y, total = x - z.mean(), y - z.mean(), 0.0
    for a in range(0, len(found[0]), FREQUENCIES):
        f, w = (v[a : a + FREQUENCIES] for v in found)
        step = max(1, CELLS // (2 * len(f)))
        gap = sum(waves(x[b : b + step], f, w).sum(0) for b in range(0, len(x), step)) / len(x)
        gap = gap - sum(waves(y[b : b + step], f, w).sum(0) for b in range(0, len(y), step)) / len(y)
        total += float((gap * gap).sum())
    return total


def periodogram_peak(t: np.ndarray, v: np.ndarray, grid: int = 500) -> float:
    """Period of the largest normalized least-squares power over evenly spaced frequencies."""
    span = t.max() - t.min()
    if len(t) < 4 or span <= 0:
        return float("nan")
    f = np.linspace(1 / span, len(t) / (2 * span), grid)
    w = 2 * np.pi * f[:, None] * t[None, :]
    tau = np.arctan2(np.sin(2 * w).sum(1), np.cos(2 * w).sum(1))[:, None] / 2
    c, s, u = np.cos(w - tau), np.sin(w - tau), v - v.mean()
    power = (c @ u) ** 2 / np.maximum((c * c).sum(1), 1e-12) + (s @ u) ** 2 / np.maximum((s * s).sum(1), 1e-12)
    return float(1 / f[power.argmax()])


PAIRWISE: dict[str, Callable[[np.ndarray, np.ndarray], float]] = {"distance_correlation": distance_correlation, "hsic": hsic, "ksg": ksg, "mmd": mmd, "period": periodogram_peak}


def estimate(df: DataFrame, by: str, x: str, y: str, names: list[str]) -> DataFrame:
    """(by, n, one column an estimator) of each group's finite pairs."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        a = part[["x", "y"]].replace([np.inf, -np.inf], np.nan).dropna().sort_values(["x", "y"], kind="stable")
        u, v = a["x"].to_numpy(float), a["y"].to_numpy(float)
        return pd.DataFrame({"key": [part["key"].iloc[0]], "n": [len(u)]} | {m: [PAIRWISE[m](u, v) if len(u) > 1 else float("nan")] for m in names})

    schema = "key string, n long, " + ", ".join(f"{m} double" for m in names)
    return df.select(F.col(by).cast("string").alias("key"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).groupBy("key").applyInPandas(run, schema)
