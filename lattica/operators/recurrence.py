"""Recurring series: occurrences, cadence-based prediction, hazard, change points and novelty."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.operators.aggregates import mode_with_confidence
from lattica.operators.relational import band_join


def occurrences(events: DataFrame, key: str, t: str) -> DataFrame:
    """Numbers occurrences by series in time order (id = running frequency)."""
    return events.withColumn("occurrence", F.row_number().over(Window.partitionBy(key).orderBy(t)))


def roll_oldest(events: DataFrame, key: str, t: str, value: str, keep: int) -> DataFrame:
    """Per series the newest ``keep`` stay; the rest become one summary (rolled, sum, min, max)."""
    r = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(t), F.desc(value)))
    old = F.col("_r") > keep
    return events.select(key, t, value, r.alias("_r")).groupBy(key).agg(
        F.count(F.when(~old, 1)).alias("kept"), F.count(F.when(old, 1)).alias("rolled"), F.coalesce(F.sum(F.when(old, F.col(value))), F.lit(0.0)).alias("rolled_sum"),
        F.min(F.when(old, F.col(value))).alias("rolled_min"), F.max(F.when(old, F.col(value))).alias("rolled_max"),
    )


def predict_next(events: DataFrame, key: str, t: str) -> DataFrame:
    """last + round(median gap) of series with 3 events or more; confidence = clamp(1 - MAD / median) * min(n / 12.5, 1)."""
    w = Window.partitionBy(key).orderBy(t)
    g = events.select(key, t, (F.col(t) - F.lag(t).over(w)).alias("gap"))
    m = F.percentile("gap", F.lit(0.5))
    base = g.where("gap is null or gap > 0").groupBy(key).agg(F.count("*").alias("n"), F.max(t).alias("last"), m.alias("median"))
    dev = g.where("gap > 0").join(base.select(key, "median"), key).groupBy(key).agg(F.percentile(F.abs(F.col("gap") - F.col("median")), F.lit(0.5)).alias("mad"))
    out = base.where("n >= 3").join(dev, key)
    conf = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("mad") / F.col("median"))) * F.least(F.col("n") / 12.5, F.lit(1.0))
    out = out.withColumn("confidence", conf)
    return out.select(key, "n", (F.col("last") + F.round("median").cast("long")).alias("next"), "confidence", F.greatest(F.col("mad"), F.col("median") * (1 - F.col("confidence"))).alias("half_width"))


def novelty(events: DataFrame, key: str, t: str, now: int) -> DataFrame:
    """non_recurring (one event), overdue (3 or more and now > last + 2 * cadence), else recurring."""
    w = Window.partitionBy(key).orderBy(t)
    g = events.select(key, t, (F.col(t) - F.lag(t).over(w)).alias("gap")).groupBy(key).agg(F.count("*").alias("n"), F.max(t).alias("last"), F.percentile("gap", F.lit(0.5)).alias("cadence"))
    state = F.when(F.col("n") <= 1, "non_recurring").when((F.col("n") >= 3) & (F.lit(now) > F.col("last") + 2 * F.col("cadence")), "overdue").otherwise("recurring")
    return g.select(key, "n", state.alias("state"))


def lead_lag(a: DataFrame, b: DataFrame, keys: list[str], ta: str, tb: str, width: float) -> DataFrame:
    """Median of tb - ta over pairs closer than ``width``; at least 3 pairs."""
    pairs = band_join(a, b, keys, ta, tb, width)
    return pairs.groupBy(*keys).agg(F.count("*").alias("pairs"), F.percentile(F.col("tb") - F.col("ta"), F.lit(0.5)).alias("lag")).where("pairs >= 3")


def uniform_bins(events: DataFrame, t: str, width: int) -> DataFrame:
    """(bin, n) from the first to the last bin, empty ones included."""
    counts = events.groupBy(F.floor(F.col(t) / width).alias("bin")).agg(F.count("*").alias("n"))
    ends = counts.agg(F.min("bin").alias("a"), F.max("bin").alias("b")).where("a is not null")
    every = ends.select(F.explode(F.sequence("a", "b")).alias("bin"))
    return every.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def _cusum(k: float, h: float, fraction: float, baseline: int):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("t", kind="stable")
        gap = part["t"].diff().dropna().to_numpy(float)
        alarm = onset = None
        if len(gap) > baseline:
            mu, sd = gap[:baseline].mean(), gap[:baseline].std()
            scale = max(sd, fraction * mu) or 1.0
            up = down = 0.0
            zu = zd = baseline
            for i in range(baseline, len(gap)):
                z = (gap[i] - mu) / scale
                up, down = max(0.0, up + z - k), max(0.0, down - z - k)
                zu, zd = (i + 1 if up == 0 else zu), (i + 1 if down == 0 else zd)
                if up > h or down > h:
                    alarm, onset = i, zu if up > h else zd
                    break
        return pd.DataFrame({"key": [part["key"].iloc[0]], "alarm": pd.array([alarm], "Int64"), "onset": pd.array([onset], "Int64")})

    return run


def change_points(events: DataFrame, key: str, t: str, k: float = 0.5, h: float = 5.0, fraction: float = 0.1, baseline: int = 10) -> DataFrame:
    """CUSUM of gaps against the baseline's mean and deviation: first crossing of ``h`` and the index after the last zero.
    Sequential by nature, so one series is one pandas group."""
    series = events.select(F.col(key).cast("string").alias("key"), F.col(t).cast("double").alias("t"))
    return series.groupBy("key").applyInPandas(_cusum(k, h, fraction, baseline), "key string, alarm long, onset long")


def in_window(df: DataFrame, t: str, start, end) -> DataFrame:
    """Half-open [start, end)."""
    return df.where((F.col(t) >= F.lit(start)) & (F.col(t) < F.lit(end)))


def last_seconds(df: DataFrame, t: str, now: int, span: int) -> DataFrame:
    """Events of the last ``span`` seconds, ``now`` included."""
    return df.where((F.col(t) > F.lit(now - span)) & (F.col(t) <= F.lit(now)))


def sequence_score(df: DataFrame, by: list[str], order: list) -> DataFrame:
    """1 - rank / total, rank from 0."""
    w = Window.partitionBy(*by)
    return df.withColumn("score", 1 - (F.row_number().over(w.orderBy(*order)) - 1) / F.count("*").over(w))


def hazard(events: DataFrame, key: str, t: str) -> DataFrame:
    """(key, n, shape, scale) of the Gamma renewal fit to gaps: shape = m^2 / v, scale = v / m with the population variance;
    a coefficient of variation of at most 1e-6 gives NULLs, the step function."""
    w = Window.partitionBy(key).orderBy(t)
    g = events.select(key, (F.col(t) - F.lag(t).over(w)).cast("double").alias("gap")).where("gap > 0")
    m, v = F.avg("gap"), F.var_pop("gap")
    ok = F.sqrt(v) / m > 1e-6
    return g.groupBy(key).agg(F.count("*").alias("n"), F.when(ok, m * m / v).alias("shape"), F.when(ok, v / m).alias("scale")).where("n >= 2")


def gamma_upper(shape: float, x: float) -> float:
    """The regularized upper incomplete gamma function Q(shape, x): a power series below the shape, a continued fraction above."""
    if x <= 0:
        return 1.0
    front = math.exp(shape * math.log(x) - x - math.lgamma(shape))
    if x < shape + 1:
        term = total = 1.0 / shape
        k = shape
        while abs(term) > abs(total) * 1e-15:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1.0 - front * total)
    tiny = 1e-300
    b = x + 1 - shape
    c, d = 1 / tiny, 1 / b
    value = d
    for i in range(1, 10_000):
        a = -i * (i - shape)
        b += 2
        d = 1 / (a * d + b or tiny)
        c = b + a / c or tiny
        value *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return min(1.0, front * value)


def overdue(events: DataFrame, key: str, t: str, now: float, alpha: float = 0.05) -> DataFrame:
    """(key, n, elapsed, survival, overdue): how likely a series' gap lasts as long as the time since its last event, by the
    Gamma renewal fit of :func:`hazard`; equal gaps give a step at their mean. Overdue at ``alpha`` or less."""
    fit = hazard(events, key, t)
    last = events.groupBy(key).agg(F.max(t).alias("_last"), F.min(t).alias("_first"), F.countDistinct(t).alias("_n"))
    rows = fit.join(last, key).select(key, "n", "shape", "scale", (F.lit(float(now)) - F.col("_last")).alias("elapsed"), ((F.col("_last") - F.col("_first")) / (F.col("_n") - 1)).alias("_mean"))

    @F.pandas_udf("double")
    def survival(shape: pd.Series, scale: pd.Series, elapsed: pd.Series, mean: pd.Series) -> pd.Series:
        return pd.Series([float(e < m) if pd.isna(a) else gamma_upper(a, max(e, 0.0) / s) for a, s, e, m in zip(shape, scale, elapsed, mean)], dtype=float)

    got = rows.select(key, "n", "elapsed", survival("shape", "scale", "elapsed", "_mean").alias("survival"))
    return got.withColumn("overdue", F.col("survival") <= alpha)


def periodic_recall(events: DataFrame, key: str, hour: Column, day: Column, target_hour: int | None = None, target_day: int | None = None) -> DataFrame:
    """(key, n) of the series of two events or more whose commonest hour, or day, is the target; with both targets their
    commonest hour of a day counts, not the two by themselves. A tie for the commonest matches nothing."""
    if target_hour is None and target_day is None:
        raise ValueError("no target")
    value = hour if target_day is None else day if target_hour is None else day * 24 + hour
    target = target_hour if target_day is None else target_day if target_hour is None else target_day * 24 + target_hour
    return mode_with_confidence(events, key, value).where(F.col("mode") == target).select(key, "n")


def cross_k(a: DataFrame, b: DataFrame, t: str, radii: list[float], start: float, end: float) -> DataFrame:
    """(radius, pairs, k, pair_correlation) of two event series: pairs at most ``radius`` apart over nA * lambdaB, and the ring
    since the last radius over what independence gives. Pairs meet by cells as wide as the largest radius and are summed
    where they meet."""
    wide = float(max(radii))
    x = a.select(F.col(t).cast("double").alias("ta"), F.explode(F.array(*[F.floor(F.col(t) / wide) + d for d in (-1, 0, 1)])).alias("_cell"))
    y = b.select(F.col(t).cast("double").alias("tb"), F.floor(F.col(t) / wide).alias("_cell"))
    apart = F.abs(F.col("ta") - F.col("tb"))
    ordered = sorted(radii)
    got = x.join(y, "_cell").agg(*[F.sum((apart <= r).cast("long")).alias(f"p{i}") for i, r in enumerate(ordered)])
    n = a.agg(F.count(t).alias("_a")).crossJoin(b.agg(F.count(t).alias("_b")))  # one row each
    rows = F.explode(F.array(*[F.struct(F.lit(float(r)).alias("radius"), F.coalesce(f"p{i}", F.lit(0)).alias("pairs"), (F.coalesce(f"p{i}", F.lit(0)) - (F.coalesce(f"p{i - 1}", F.lit(0)) if i else F.lit(0))).alias("ring"), F.lit(float(r - (ordered[i - 1] if i else 0))).alias("width")) for i, r in enumerate(ordered)]))
    span, both = float(end - start), F.col("_a") * F.col("_b")
    return got.crossJoin(n).select(rows.alias("x"), "_a", "_b").select("x.radius", "x.pairs", (F.col("x.pairs") * span / both).alias("k"), (F.col("x.ring") / (both * 2 * F.col("x.width") / span)).alias("pair_correlation"))
