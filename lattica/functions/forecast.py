"""Probability expressions of the forecasting operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def logit(p: Column, floor: float = 1e-6) -> Column:
    q = F.greatest(F.lit(floor), F.least(F.lit(1 - floor), p))
    return F.log(q / (1 - q))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def horizon_bucket(secs: Column) -> Column:
    return F.when(secs.isNull() | (secs < 0), "unknown").when(secs < 3600, "lt_1h").when(secs < 86400, "1h_24h").when(secs <= 7 * 86400, "1d_7d").otherwise("gt_7d")


def confidence_ceiling(raw: Column, validity: Column, flakiness: Column, bits: Column, entropy: Column, hard_cap: float = 0.99) -> Column:
    """struct(confidence, binding): the smallest of raw, validity * (1 - flakiness), 0.5 + 0.5 * min(bits / entropy, 1) and the cap."""
    dpi = F.when(entropy > 0, 0.5 + 0.5 * F.least(bits / entropy, F.lit(1.0))).otherwise(0.5)
    terms = F.array(*[F.struct(v.cast("double").alias("confidence"), F.lit(n).alias("binding")) for n, v in (("raw", raw), ("validity", validity * (1 - flakiness)), ("dpi", dpi), ("hard_cap", F.lit(hard_cap)))])
    return F.array_min(terms)


def surprise_bits(frequency: Column, total: Column) -> Column:
    return -F.log2(F.greatest(frequency, F.lit(1)) / total)
