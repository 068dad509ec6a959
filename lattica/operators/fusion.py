"""Fusion strategies over ranked lists (slot, key, rank), the profiles that weigh them, and what is done to the fused list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.operators.search import restricted, rrf

#: The slots of each profile in order; a slot at place p (from 0) weighs 1 / (p + 1).
PROFILES = {
    "causal": (4, 8, 18), "code": (8, 9, 10, 11, 16), "entity": (3, 8, 18), "temporal": (8,), "speaker": (5, 8), "style": (6, 8), "civic": (1, 2, 3, 8),
    "media": (8, 9, 10), "bridge": (8, 14, 18), "kernel": (7, 8, 15), "semantic": (8,), "lexical": (1,), "multimodal": (8, 9, 10, 11), "general": (1, 8, 18),
}
#: Temporal slots, which only boost what others have retrieved.
TEMPORAL_SLOTS = (20, 21, 22)
#: Words that tell nothing about a case's name.
UNINFORMATIVE = ("in", "re", "no", "nos", "vs")


def profile_weights(spark: SparkSession, name: str) -> DataFrame:
    """(slot, weight) of a profile."""
    return spark.createDataFrame([(s, 1.0 / (p + 1)) for p, s in enumerate(PROFILES[name])], "slot long, weight double")


def primary(lists: DataFrame) -> DataFrame:
    """Ranked lists without the temporal slots."""
    return lists.where(~F.col("slot").isin(*TEMPORAL_SLOTS))


def single_lens(lists: DataFrame, slot, key: str, constant: int = 60) -> DataFrame:
    """One slot's list as it is ranked."""
    return lists.where(F.col("slot") == slot).select(key, (1 / (constant + F.col("rank"))).alias("score"), "rank")


def pipeline(lists: DataFrame, stage1: list, key: str, fall_back: bool = True) -> DataFrame:
    """Fusion of the other slots restricted to the candidates of the slots ``stage1``, by their original ranks; with ``fall_back``
    of all slots where the others have none of the candidates, without it empty there. No candidates: empty."""
    first = F.col("slot").isin(*stage1)
    candidates = lists.where(first).select(key).distinct()
    kept = restricted(lists, candidates, key)
    others = kept.where(~first)
    if not fall_back:
        return rrf(others, key)
    some = others.limit(1).agg((F.count("*") > 0).alias("_some"))
    chosen = kept.crossJoin(F.broadcast(some)).where(~F.col("_some") | ~first).drop("_some")  # one row
    return rrf(chosen, key)


def fuse(lists: DataFrame, strategy: str, key: str, slot=None, profile: str | None = None, stage1: list | None = None, fall_back: bool = True) -> DataFrame:
    """Runs a planned strategy: ``single``, ``rrf``, ``weighted`` (by ``profile``) or ``pipeline``."""
    if strategy == "single":
        return single_lens(lists, slot, key)
    if strategy == "pipeline":
        return pipeline(lists, stage1 or [], key, fall_back)
    if strategy == "weighted":
        return rrf(lists, key, profile_weights(lists.sparkSession, profile))
    if strategy == "rrf":
        return rrf(lists, key)
    raise ValueError(f"unknown strategy {strategy!r}")


def contributions(lists: DataFrame, key: str, constant: int = 60) -> DataFrame:
    """(key, score, parts): each key's score and what each slot gives to it, by slot."""
    part = F.struct("slot", "rank", (1 / (constant + F.col("rank"))).alias("part"))
    got = lists.groupBy(key).agg(F.array_sort(F.collect_list(part)).alias("parts"))
    return got.select(key, F.aggregate("parts", F.lit(0.0), lambda s, x: s + x["part"]).alias("score"), "parts")


def causal_gate(hits: DataFrame, key: str, passed: Column, provisional: Column, high: float, low: float) -> DataFrame:
    """Scores times ``high`` for a guard that passed for good, ``low`` for another verdict, 1 without one; ranked anew by
    score, old rank, key. ``hits``: (key, score, rank) of one result list, which the caller's k bounds."""
    times = F.when(passed.isNull(), 1.0).when(passed & ~provisional, high).otherwise(low)
    gated = hits.withColumn("score", F.col("score") * times)
    return gated.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "rank", key)))


def plain_terms(text: Column) -> Column:
    """Distinct lower-case runs of ASCII letters and digits."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), 0))


def metadata_match(query: Column, case_name: Column, docket: Column) -> tuple[Column, Column]:
    """Whether the query holds all informative words of the name (two at least), and all of the docket's words of four
    characters or more that have a digit (one at least)."""
    asked = plain_terms(query)
    name = F.filter(plain_terms(case_name), lambda w: (F.length(w) >= 2) & ~w.isin(*UNINFORMATIVE))
    number = F.filter(plain_terms(docket), lambda w: (F.length(w) >= 4) & w.rlike("[0-9]"))
    inside = lambda words: F.size(F.array_except(words, asked)) == 0
    return (F.size(name) >= 2) & inside(name), (F.size(number) >= 1) & inside(number)
