"""Cross-slot terms of items: agreement, deltas, blind spots, candidate pairs and tau calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions.vector import cosine, delta, hadamard, norm


def slot_pairs(slots: DataFrame, key: str, terms: bool = False) -> DataFrame:
    """(key, a, b, agreement): each item's slot pairs a < b of rows (key, slot, vec), by one shuffle on the item; with
    ``terms`` also delta, interaction and concatenation."""
    x = slots.select(key, F.col("slot").alias("a"), F.col("vec").alias("va"))
    y = slots.select(key, F.col("slot").alias("b"), F.col("vec").alias("vb"))
    out = x.join(y, key).where("a < b").withColumn("agreement", cosine(F.col("va"), F.col("vb")))
    if terms:
        out = out.withColumns({"delta": delta(F.col("va"), F.col("vb")), "interaction": hadamard(F.col("va"), F.col("vb")), "both": F.concat("va", "vb"), "apart": norm(delta(F.col("va"), F.col("vb")))})
    return out.drop("va", "vb")


def agreement_graph(pairs: DataFrame) -> DataFrame:
    """Mean agreement of each slot pair, its count, and the weight clamped to [0, 1]."""
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n"), F.avg("agreement").alias("mean")).withColumn("weight", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("mean"))))


def item_agreement(pairs: DataFrame, key: str) -> DataFrame:
    """Smallest agreement over an item's pairs, and the spread between largest and smallest."""
    return pairs.groupBy(key).agg(F.min("agreement").alias("agree"), (F.max("agreement") - F.min("agreement")).alias("disagree"), F.count("*").alias("pairs"))


def blind_spot(apart: Column) -> Column:
    return F.when(apart >= 0.8, "high").when(apart >= 0.65, "medium").when(apart >= 0.5, "low")


def neighborhood_mean(neighbors: DataFrame, by: list[str], vector: str) -> DataFrame:
    """Mean vector of each group as an array, dimension by dimension."""
    cells = neighbors.select(*by, F.posexplode(vector).alias("dim", "x")).groupBy(*by, "dim").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return cells.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "m"))), lambda s: s["m"]).alias("mean"))


#: Bins of a running count over all rows.
BINS = 4096


def calibrate_tau(scores: DataFrame, far: float) -> DataFrame:
    """(tau, far, frr): the smallest good-or-bad score at which the false accept rate of the bad is at most ``far``.

    Rates at every distinct score come from one running count over distinct values, grouped first. Fewer than 50 bad raise.
    """
    from pyspark.sql import Window

    n = scores.agg(F.sum(F.when(F.col("bad"), 1).otherwise(0)).alias("bad"), F.sum(F.when(F.col("bad"), 0).otherwise(1)).alias("good")).first()
    if (n["bad"] or 0) < 50:
        raise ValueError("calibration needs 50 bad scores")
    counts = scores.groupBy("score").agg(F.sum(F.when(F.col("bad"), 1).otherwise(0)).alias("b"), F.sum(F.when(F.col("bad"), 0).otherwise(1)).alias("g"))
    # running counts in two levels: within bins of equal width, and over the bins, of which there are BINS at most
    ends = scores.agg(F.min("score").alias("lo"), F.max("score").alias("hi")).first()
    width = (float(ends["hi"]) - float(ends["lo"])) / BINS or 1.0
    binned = counts.withColumn("bin", F.least(F.floor((F.col("score") - F.lit(float(ends["lo"]))) / F.lit(width)), F.lit(BINS - 1)))
    earlier = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = binned.groupBy("bin").agg(F.sum("b").alias("sb"), F.sum("g").alias("sg")).select("bin", F.coalesce(F.sum("sb").over(earlier), F.lit(0)).alias("b0"), F.coalesce(F.sum("sg").over(earlier), F.lit(0)).alias("g0"))
    w = Window.partitionBy("bin").orderBy("score")
    run = lambda c: F.col(f"{c}0") + F.sum(c).over(w)
    at = binned.join(F.broadcast(bins), "bin").select(F.col("score").alias("tau"), ((n["bad"] - run("b") + F.col("b")) / n["bad"]).alias("far"), ((run("g") - F.col("g")) / max(n["good"], 1)).alias("frr"))
    return at.where(F.col("far") <= far).orderBy("tau").limit(1)
