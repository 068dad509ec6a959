"""Panels of lenses: admission, strata, packing, abundance and what is materialized."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Least signal in bits, largest pairwise correlation, least gain of an interaction.
LEAST_BITS, MOST_CORRELATED, LEAST_GAIN = 0.05, 0.6, 0.05


def admitted(bits: Column, correlation: Column) -> Column:
    return (bits >= LEAST_BITS) & (correlation <= MOST_CORRELATED)


def stratified_bits(strata: DataFrame, by: str) -> DataFrame:
    """(by, effective): the larger of the global bits and the best stratum that a lens carries alone."""
    sole = F.max(F.when(F.col("sole_carrier"), F.col("bits")).otherwise(0.0))
    return strata.groupBy(by).agg(F.greatest(F.max("global_bits"), sole).alias("effective"))


def abundance(lenses: Column, inputs: Column, materialized: Column) -> tuple[Column, Column, Column]:
    """Largest number of cross terms, signals of all inputs, materialized signals an input (NaN without inputs)."""
    pairs = F.floor(lenses * F.greatest(lenses - 1, F.lit(0)) / 2)
    return pairs, inputs * (lenses + pairs + 1), F.when(inputs == 0, F.lit(float("nan"))).otherwise(materialized / inputs)


def materialization(pairs: DataFrame) -> DataFrame:
    """(a, b, agreement, delta, interaction) of slot pairs (a, b, gain): agreement eager, delta lazy, interaction by its gain."""
    return pairs.select("a", "b", F.lit("eager").alias("agreement"), F.lit("lazy").alias("delta"), F.when(F.col("gain") >= LEAST_GAIN, "eager").otherwise("lazy").alias("interaction"))


def pack(candidates: DataFrame, budget: float, most: int = 100_000) -> list:
    """Keys kept: admissible candidates (key, bits, correlation, cost) that fit the budget, by bits a cost and then by key,
    each taken if it still fits. A panel is small: more than ``most`` rows raise."""
    fit = candidates.where(admitted(F.col("bits"), F.col("correlation")) & (F.col("cost") <= budget) & (F.col("cost") > 0))
    rows = fit.select("key", "cost", (F.col("bits") / F.col("cost")).alias("d")).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} candidates")
    kept, used = [], 0.0
    for r in sorted(rows, key=lambda r: (-r["d"], r["key"])):
        if used + r["cost"] <= budget:
            kept.append(r["key"])
            used += r["cost"]
    return kept
