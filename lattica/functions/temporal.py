"""Temporal scores as column expressions; times are epoch seconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seconds(ts: Column) -> Column:
    return F.unix_seconds(ts.cast("timestamp"))


def hour_of(t: Column, offset: int = 0) -> Column:
    return F.floor(F.pmod(t + offset, F.lit(86400)) / 3600).cast("int")


def weekday_of(t: Column, offset: int = 0) -> Column:
    """Monday is 0."""
    return F.pmod(F.floor((t + offset) / 86400) + 3, F.lit(7)).cast("int")


def recency(age: Column, decay: str = "exponential", half_life: float = 3600.0, horizon: float = 86400.0) -> Column:
    """Exponential exp(-age * 0.693 / half-life), linear to ``horizon``, or step 0.8 / 0.5 / 0.1 at an hour and a day; future ages count as 0."""
    age = F.greatest(age.cast("double"), F.lit(0.0))
    if decay == "exponential":
        if half_life == 0:
            return F.when(age == 0, 1.0).otherwise(0.0)
        return F.least(F.lit(1.0), F.exp(-age * 0.693 / half_life))
    if decay == "linear":
        return F.greatest(F.lit(0.0), 1 - age / horizon)
    if decay == "step":
        return F.when(age < 3600, 0.8).when(age < 86400, 0.5).otherwise(0.1)
    raise ValueError(f"unknown decay {decay}")


def periodic_score(t: Column, hour: int | None, weekday: int | None, offset: int = 0) -> Column:
    """Half for the hour and half for the day of the week."""
    score = F.lit(0.0)
    if hour is not None:
        score = score + F.when(hour_of(t, offset) == hour, 0.5).otherwise(0.0)
    if weekday is not None:
        score = score + F.when(weekday_of(t, offset) == weekday, 0.5).otherwise(0.0)
    return score


def boosted(score: Column, fused: Column, recurrence: Column, alpha: float = 0.10) -> Column:
    """score + score * (clamped fused * alpha + recurrence) for scores above 0; alpha is at most 0.10."""
    if not 0 <= alpha <= 0.10:
        raise ValueError("alpha must lie in [0, 0.10]")
    f = F.greatest(F.lit(0.0), F.least(F.lit(1.0), fused))
    return F.when(score > 0, score + score * (f * alpha + recurrence)).otherwise(score)


def recurrence_boost(frequency: Column, weight: float = 0.05, cap: float = 0.05) -> Column:
    return F.least(F.lit(cap), F.log(frequency + 1) / F.log(F.lit(10001.0)) * weight)
