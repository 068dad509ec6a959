"""Market-domain features, blends, screens and structural edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions.forecast import logit, sigmoid


def spread_features(bid: Column, ask: Column) -> Column:
    """struct(mid, spread, relative, distance): NULL where a side is missing or crossed."""
    ok = bid.isNotNull() & ask.isNotNull() & (ask >= bid)
    mid = (bid + ask) / 2
    return F.when(ok, F.struct(mid.alias("mid"), (ask - bid).alias("spread"), F.when(mid > 0, (ask - bid) / mid).alias("relative"), F.abs(mid - 0.5).alias("distance")))


def order_flow_imbalance(df: DataFrame, by: list[str], size: str, buy: Column) -> DataFrame:
    signed = F.when(buy, F.col(size)).otherwise(-F.col(size))
    return df.groupBy(*by).agg(F.sum(size).alias("volume"), (F.sum(signed) / F.sum(size)).alias("imbalance"))


def blend(df: DataFrame, by: list[str], p: str, reliability: str) -> DataFrame:
    """sigmoid of the reliability-weighted mean logit; components of reliability 0 or less are left out."""
    x = df.where(F.col(reliability) > 0)
    return x.groupBy(*by).agg(sigmoid(F.sum(F.col(reliability) * logit(F.col(p))) / F.sum(reliability)).alias("p"), F.count("*").alias("components"))


def mispricing(p: Column, market: Column, reliability: Column, threshold: float = 0.05) -> Column:
    """aligned, overpriced or underpriced; aligned too where the reliability is under 0.3."""
    far = (F.abs(market - p) > threshold) & (reliability >= 0.3)
    return F.when(~far, "aligned").when(market > p, "overpriced").otherwise("underpriced")


def wash_screen(fills: DataFrame, by: list[str], counterparty: str, size: str) -> DataFrame:
    """Volume of the largest fill with each distinct counterparty over all volume; none at all fails the screen."""
    each = fills.where(F.col(counterparty).isNotNull()).groupBy(*by, counterparty).agg(F.max(size).alias("_v"))
    all_ = fills.groupBy(*by).agg(F.sum(size).alias("volume"))
    got = all_.join(each.groupBy(*by).agg(F.sum("_v").alias("distinct_volume")), by, "left")
    return got.withColumn("share", F.when(F.col("volume") > 0, F.coalesce("distinct_volume", F.lit(0.0)) / F.col("volume")).otherwise(0.0))


#: Pairs that one task counts on average.
PAIRS = 1_000_000


def shared_entity_edges(df: DataFrame, item: str, entity: str) -> DataFrame:
    """(a, b, shared): items a < b that share entities, counted. Items of one entity are joined on it; entities name few items.
    Join and count are dealt over as many tasks as the pairs need, so that a task's memory does not grow with the table."""
    rows = df.select(F.col(item).alias("a"), F.col(entity).alias("_e")).dropna()
    n = F.count("*")
    pairs = rows.groupBy("_e").agg((n * (n - 1) / 2).alias("n")).agg(F.sum("n")).first()[0] or 0
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(-(-pairs // PAIRS)))
    x = rows.repartition(parts, "_e").distinct()
    both = x.join(x.withColumnRenamed("a", "b"), "_e").where("a < b").select("a", "b")
    return both.repartition(parts, "a", "b").groupBy("a", "b").agg(F.count("*").alias("shared"))


def knn_base_rate(neighbors: DataFrame, by: list[str], similarity: str, outcome: Column) -> DataFrame:
    """p = yes / k; reliability = mean clamped similarity * min(k / 20, 1)."""
    s = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(similarity)))
    return neighbors.groupBy(*by).agg(F.count("*").alias("k"), F.avg(outcome.cast("double")).alias("p"), (F.avg(s) * F.least(F.count("*") / 20, F.lit(1.0))).alias("reliability"))


def depth_shape(levels: DataFrame, by: list[str], price_rank: str, size: str) -> DataFrame:
    """Cumulative share of a book's size at each level."""
    w = Window.partitionBy(*by).orderBy(price_rank).rowsBetween(Window.unboundedPreceding, 0)
    return levels.select(*by, price_rank, (F.sum(size).over(w) / F.sum(size).over(Window.partitionBy(*by))).alias("depth"))


def structural_edges(markets: DataFrame, key: str, condition: str, event: str) -> DataFrame:
    """(kind, src, dst): ``yes_no`` between neighbouring outcomes of one event's condition, ``sibling`` between neighbouring
    conditions of one event, each named by its least key. Neighbours in order stand for all pairs of a group, which they
    join, so a large event makes as many edges as it has members."""
    w = Window.partitionBy(event, condition).orderBy(key)
    outcomes = markets.select(F.lit("yes_no").alias("kind"), F.col(key).alias("src"), F.lead(key).over(w).alias("dst"))
    first = markets.groupBy(event, condition).agg(F.min(key).alias("k"))
    w = Window.partitionBy(event).orderBy(condition)
    return outcomes.unionByName(first.select(F.lit("sibling").alias("kind"), F.col("k").alias("src"), F.lead("k").over(w).alias("dst"))).where("dst is not null")
