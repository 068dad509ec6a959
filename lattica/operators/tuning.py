"""Holdout splits, replay sampling, comparisons, growth and quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions.vector import hash48


def group_holdout(df: DataFrame, group: str, label: str, share: float, seed: int) -> DataFrame:
    """``df`` with ``held_out``: whole groups go to one side, by a seeded hash within their class; at least one a class."""
    groups = df.groupBy(group).agg(F.min(label).alias("_c"))
    w = Window.partitionBy("_c")
    r = F.row_number().over(w.orderBy(hash48(F.col(group), F.lit(seed)), group))
    n = F.count("*").over(w)
    sides = groups.select(F.col(group).alias("_g"), ((n >= 2) & (r <= F.greatest(F.lit(1), F.floor(n * share)))).alias("held_out"))
    return df.join(sides, df[group].eqNullSafe(sides["_g"])).drop("_g")


def replay(df: DataFrame, key: str, surprise: str, k: int, seed: int) -> DataFrame:
    """Weighted sample of ``k`` without replacement: the smallest -log(u) / surprise, u a seeded hash of the key."""
    u = (hash48(F.col(key), F.lit(seed)) + 1) / F.lit(float((1 << 48) + 1))
    return df.where(F.col(surprise) > 0).orderBy(-F.log(u) / F.col(surprise), key).limit(k)


def compare_arms(df: DataFrame, arm: str, metric: str) -> DataFrame:
    return df.groupBy(arm).agg(F.count("*").alias("n"), F.avg(metric).alias("mean"), F.percentile(metric, F.lit(0.5)).alias("p50"), F.percentile(metric, F.lit(0.99)).alias("p99"))


def growth(df: DataFrame, by: list[str], step: str, metric: str) -> DataFrame:
    """Slope of a metric over its steps; rising if above 0."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.regr_slope(metric, step).alias("slope")).withColumn("rising", F.col("slope") > 0)


def quota(df: DataFrame, tenant: str, ts: str, amount: str, width: str, limit: float) -> DataFrame:
    """Tenants and windows over their quota."""
    used = df.groupBy(tenant, F.window(ts, width).alias("w")).agg(F.sum(amount).alias("used"))
    return used.where(F.col("used") > limit).select(tenant, F.col("w.start").alias("start"), "used")


def beta_posterior(df: DataFrame, by: list[str], success: Column, a: float = 1.0, b: float = 1.0) -> DataFrame:
    """Mean and variance of the Beta posterior of a rate."""
    s = F.sum(success.cast("int"))
    p, q = s + a, F.count("*") - s + b
    return df.groupBy(*by).agg(F.count("*").alias("n"), (p / (p + q)).alias("mean"), (p * q / ((p + q) * (p + q) * (p + q + 1))).alias("variance"))


def gamma_posterior(df: DataFrame, by: list[str], exposure: Column, shape: float = 1.0, rate: float = 1.0) -> DataFrame:
    """Mean of the Gamma posterior of an event rate per unit of exposure."""
    return df.groupBy(*by).agg(F.count("*").alias("events"), ((F.count("*") + shape) / (exposure + rate)).alias("mean"))


def stable_rank(cells: DataFrame, row: str, col: str, value: str) -> DataFrame:
    """trace^2 / sum of squares of a square matrix in long form; the zero matrix raises."""
    t = cells.agg(F.sum(F.when(F.col(row) == F.col(col), F.col(value)).otherwise(0.0)).alias("t"), F.sum(F.col(value) * F.col(value)).alias("s"))
    return t.select(F.when(F.col("s") > 0, F.col("t") * F.col("t") / F.col("s")).otherwise(F.raise_error(F.lit("zero matrix")).cast("double")).alias("n_eff"))


def table_difference(a: DataFrame, b: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, change): added, removed or changed rows between two versions, by a full outer join on the key."""
    x = a.select(key, F.struct(*columns).alias("_a"))
    y = b.select(key, F.struct(*columns).alias("_b"))
    j = x.join(y, key, "full")
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    return j.select(key, change.alias("change")).where("change is not null")
