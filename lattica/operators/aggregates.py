"""OLAP aggregates, rollups, modes, cadence and concentration measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GRAINS = {"1m": "1 minute", "1h": "1 hour", "1d": "1 day"}


def finite(x: Column) -> Column:
    """x as double; NaN and infinities raise."""
    d = x.cast("double")
    return F.when(F.isnan(d) | (F.abs(d) == float("inf")), F.raise_error(F.lit("non-finite value")).cast("double")).otherwise(d)


def five(column: str) -> list[Column]:
    x = finite(F.col(column))
    return [F.count(x).alias("count"), F.sum(x).alias("sum"), F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("avg")]


def olap(df: DataFrame, column: str) -> DataFrame:
    return df.agg(*five(column))


def olap_by(df: DataFrame, column: str, group: str, max_groups: int = 4096) -> DataFrame:
    """Grouped by the key's 32-bit pattern (so 0.0 and -0.0 differ); more than ``max_groups`` groups raise."""
    key = F.col(group).cast("float")
    minus = (key == 0) & (key.cast("string") == "-0.0")
    got = df.groupBy(key.alias("key"), minus.alias("minus_zero")).agg(*five(column))
    n = got.select("key").limit(max_groups + 1).agg(F.count("*").alias("_n"))  # one row
    checked = got.crossJoin(F.broadcast(n)).where(F.when(F.col("_n") > max_groups, F.raise_error(F.lit("too many groups")).cast("boolean")).otherwise(True))
    return checked.drop("_n")


def query_aggregates(df: DataFrame, column: str) -> DataFrame:
    """Sum and average of none are 0; smallest and largest of none are NULL."""
    x = F.col(column).cast("double")
    return df.agg(F.count("*").alias("count"), F.coalesce(F.sum(x), F.lit(0.0)).alias("sum"), F.min(x).alias("min"), F.max(x).alias("max"), F.coalesce(F.avg(x), F.lit(0.0)).alias("avg"))


def rollup(points: DataFrame, series: str, ts: str, value: str, grain: str) -> DataFrame:
    return points.groupBy(F.col(series).alias("series"), F.date_trunc(GRAINS[grain].split()[1], ts).alias("bucket")).agg(
        F.count(value).alias("count"), F.sum(value).alias("sum"), F.min(value).alias("min"), F.max(value).alias("max")
    )


def retention(points: DataFrame, ts: str, floor) -> DataFrame:
    """Points at or after the inclusive floor."""
    return points.where(F.col(ts) >= F.lit(floor))


def mode_with_confidence(df: DataFrame, key: str, value: Column) -> DataFrame:
    """(key, n, mode, confidence): the commonest value if it is the only one, its share of all; fewer than 2 rows: none and 0."""
    counts = df.groupBy(key, value.alias("_v")).agg(F.count("*").alias("c"))
    top = counts.groupBy(key).agg(F.sum("c").alias("n"), F.max("c").alias("top"), F.max_by("_v", "c").alias("v"), F.sort_array(F.collect_list("c"), False).alias("all"))
    alone = (F.size("all") < 2) | (F.get("all", F.lit(1)) < F.col("top"))
    return top.select(key, "n", F.when((F.col("n") >= 2) & alone, F.col("v")).alias("mode"), F.when(F.col("n") >= 2, F.col("top") / F.col("n")).otherwise(0.0).alias("confidence"))


def gaps(events: DataFrame, key: str, t: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(t)
    return events.select(key, t, (F.col(t) - F.lag(t).over(w)).alias("gap"))


def cadence(events: DataFrame, key: str, t: str) -> DataFrame:
    """Median gap between consecutive events; NULL for one event."""
    return gaps(events, key, t).groupBy(key).agg(F.count("*").alias("n"), F.percentile("gap", F.lit(0.5)).alias("cadence"))


def entropy_bits(df: DataFrame, by: list[str], label: str) -> DataFrame:
    counts = df.groupBy(*by, label).agg(F.count("*").alias("c"))
    return counts.groupBy(*by).agg((F.log2(F.sum("c")) - F.sum(F.col("c") * F.log2("c")) / F.sum("c")).alias("entropy"))


def concentration(df: DataFrame, by: list[str], column: str) -> DataFrame:
    """Herfindahl index and top share of the values above 0; none: 0."""
    x = F.when((F.col(column) > 0) & (F.col(column) < float("inf")), F.col(column).cast("double"))
    return df.groupBy(*by).agg(F.coalesce(F.sum(x * x) / (F.sum(x) * F.sum(x)), F.lit(0.0)).alias("hhi"), F.coalesce(F.max(x) / F.sum(x), F.lit(0.0)).alias("top_share"))


def volatility(df: DataFrame, by: list[str], column: str) -> DataFrame:
    return df.groupBy(*by).agg(F.when(F.count(column) >= 2, F.stddev_samp(column)).alias("volatility"))


def compression(df: DataFrame, by: list[str], item: str) -> DataFrame:
    """Occurrences over distinct items."""
    return df.groupBy(*by).agg(F.count("*").alias("occurrences"), F.countDistinct(item).alias("items"), (F.count("*") / F.countDistinct(item)).alias("ratio"))


def top_k(df: DataFrame, score: str, key: str, k: int) -> DataFrame:
    """Highest scores, ties by the smaller key, with ranks from 1; the rank window sees k rows only."""
    best = df.orderBy(F.desc(score), key).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), key)))
