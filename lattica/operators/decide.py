"""Guards, predictions, backtests, deduplication decisions, ledgers and bandits."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def guard(scores: DataFrame, key: str, required: dict[str, float], k: int | None = None) -> DataFrame:
    """(key, passed, verdict) of rows (key, slot, cos): each required slot needs cos >= tau; all of them or ``k``."""
    if not required or k == 0:
        raise ValueError("no required slots")
    tau = F.create_map(*[F.lit(x) for kv in required.items() for x in kv])
    mine = scores.where(F.col("slot").isin(list(required)))
    ok = F.when(F.isnan("cos") | F.col("cos").isNull(), 0).otherwise((F.col("cos") >= F.get(F.map_values(F.map_filter(tau, lambda s, _: s == F.col("slot"))), F.lit(0))).cast("int"))
    return mine.groupBy(key).agg(F.sum(ok).alias("passed")).withColumn("verdict", F.col("passed") >= (len(required) if k is None else k))


def predict_outcome(df: DataFrame, by: list[str], outcome: str) -> DataFrame:
    """Modal outcome (ties: the smaller label), raw confidence (top/n) * ((top - second)/n) * (n/(n+2))."""
    c = df.groupBy(*by, outcome).agg(F.count("*").alias("c"))
    w = Window.partitionBy(*by).orderBy(F.desc("c"), outcome)
    r = c.withColumn("r", F.row_number().over(w)).withColumn("n", F.sum("c").over(Window.partitionBy(*by)))
    out = r.groupBy(*by).agg(F.max("n").alias("n"), F.max(F.when(F.col("r") == 1, F.col(outcome))).alias("outcome"), F.max(F.when(F.col("r") == 1, F.col("c"))).alias("top"), F.coalesce(F.max(F.when(F.col("r") == 2, F.col("c"))), F.lit(0)).alias("second"))
    n = F.col("n")
    return out.select(*by, "n", "outcome", (F.col("top") / n * ((F.col("top") - F.col("second")) / n) * (n / (n + 2))).alias("confidence"))


def backtest(df: DataFrame, by: list[str], p: Column, market: Column, y: Column) -> DataFrame:
    """Brier scores of model and market, their difference, and the slope and intercept of the outcome on p."""
    d = df.select(*by, p.alias("p"), market.alias("m"), y.cast("double").alias("y"))
    return d.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg((F.col("p") - F.col("y")) ** 2).alias("brier"), F.avg((F.col("m") - F.col("y")) ** 2).alias("brier_market"),
        (F.avg((F.col("m") - F.col("y")) ** 2) - F.avg((F.col("p") - F.col("y")) ** 2)).alias("improvement"), F.regr_slope("y", "p").alias("slope"), F.regr_intercept("y", "p").alias("intercept"),
    )


def reliability(df: DataFrame, p: Column, y: Column, bins: int = 10) -> DataFrame:
    b = F.least(F.floor(p * bins), F.lit(bins - 1))
    return df.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(y.cast("double")).alias("rate"))


def exact_duplicates(df: DataFrame, key: str, content: Column) -> DataFrame:
    """(key, keeper): the smallest key of equal content; the content travels as a digest."""
    d = df.select(key, F.sha2(content, 256).alias("_h"))
    first = d.groupBy("_h").agg(F.min(key).alias("keeper"))
    return d.join(first, "_h").select(key, "keeper")


def chain(entries: DataFrame, ledger: str, seq: str, payload: list[str]) -> DataFrame:
    """Entries with ``prev_hash`` and ``hash``, linked in sequence: SHA-256 of the previous entry's hash and the own content's.

    A ledger's hashes follow one from another, so a ledger is one task's work; what it holds is digests, not payloads.
    """
    own = F.sha2(F.concat_ws("\x1f", *[F.col(c).cast("string") for c in (seq, *payload)]), 256)
    d = entries.withColumn("_own", own)
    name, kinds = F.col(ledger).alias("ledger"), d.schema

    def link(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("seq", kind="stable")
        hashes, prev = [], "0" * 64
        for content in part["own"]:
            prev = hashlib.sha256((prev + content).encode()).hexdigest()
            hashes.append(prev)
        return part[["ledger", "seq"]].assign(prev_hash=["0" * 64, *hashes[:-1]], hash=hashes)

    made = d.select(name, F.col(seq).alias("seq"), F.col("_own").alias("own")).groupBy("ledger").applyInPandas(
        link, f"ledger {kinds[ledger].dataType.simpleString()}, seq {kinds[seq].dataType.simpleString()}, prev_hash string, hash string"
    )
    return d.drop("_own").join(made.withColumnsRenamed({"ledger": ledger, "seq": seq}), [ledger, seq])


def verify_chain(entries: DataFrame, ledger: str, seq: str, payload: list[str]) -> DataFrame:
    """(ledger, entries, first_break): the smallest sequence number whose step, link or hash is wrong, by the hashes that the
    entries carry; no task needs a whole ledger's payloads."""
    w = Window.partitionBy(ledger).orderBy(seq)
    own = F.sha2(F.concat_ws("\x1f", *[F.col(c).cast("string") for c in (seq, *payload)]), 256)
    link = F.col("prev_hash") == F.coalesce(F.lag("hash").over(w), F.lit("0" * 64))
    step = F.coalesce(F.col(seq) - F.lag(seq).over(w), F.lit(1)) == 1
    good = link & step & (F.col("hash") == F.sha2(F.concat("prev_hash", own), 256))
    return entries.withColumn("_good", F.coalesce(good, F.lit(False))).groupBy(ledger).agg(F.count("*").alias("entries"), F.min(F.when(~F.col("_good"), F.col(seq))).alias("first_break"))


def merkle_root(entries: DataFrame, seq: str, digest: str) -> str | None:
    """Root of the tree over hex digests in sequence: leaves H("leaf" digest), nodes H("node" left right), an odd last node
    paired with itself. A level is one aggregation by half the position; null without entries."""
    at = entries.select((F.col(seq) - entries.agg(F.min(seq)).first()[0]).cast("long").alias("i"), F.sha2(F.concat(F.lit("leaf"), F.col(digest)), 256).alias("h")) if not entries.isEmpty() else None
    if at is None:
        return None
    n = at.count()
    while n > 1:
        both = at.groupBy(F.floor(F.col("i") / 2).alias("i")).agg(F.min_by("h", "i").alias("a"), F.max_by("h", "i").alias("b"))
        at, n = both.select("i", F.sha2(F.concat(F.lit("node"), F.col("a"), F.col("b")), 256).alias("h")), (n + 1) // 2
    return at.first()["h"]


def arms(trials: DataFrame, arm: str, won: Column) -> DataFrame:
    """Win rate and mean of the Beta(1, 1) posterior of each arm."""
    w = F.sum(won.cast("int"))
    return trials.groupBy(arm).agg(F.count("*").alias("trials"), w.alias("wins"), (w / F.count("*")).alias("rate"), ((w + 1) / (F.count("*") + 2)).alias("posterior"))


def volume_buckets(fills: DataFrame, key: str, order: list[str], size: str, buy: Column, buckets: int = 3) -> DataFrame:
    """VPIN: fills in time order are cut into equal-volume buckets (a fill may be split); sum |imbalance| / volume."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    d = fills.select(key, F.col(size).alias("v"), F.when(buy, 1).otherwise(-1).alias("s"), F.sum(size).over(w).alias("hi"), F.sum(size).over(Window.partitionBy(key)).alias("all"))
    b = F.explode(F.sequence(F.lit(0), F.lit(buckets - 1)))
    d = d.withColumn("b", b).withColumn("part", F.least(F.col("hi"), (F.col("b") + 1) * F.col("all") / buckets) - F.greatest(F.col("hi") - F.col("v"), F.col("b") * F.col("all") / buckets))
    im = d.where("part > 0").groupBy(key, "b").agg(F.abs(F.sum(F.col("part") * F.col("s"))).alias("i"), F.max("all").alias("all"))
    return im.groupBy(key).agg((F.sum("i") / F.max("all")).alias("vpin"))


def checkpoints(entries: DataFrame, seq: str, every: int) -> DataFrame:
    """Entries that close a stretch of ``every`` sequence numbers (counted from 1), with the ``checkpoint``'s number from 0; their
    hash vouches for all before them."""
    if every < 1:
        raise ValueError("every must be 1 or more")
    return entries.where(F.col(seq) % every == 0).withColumn("checkpoint", F.floor((F.col(seq) - 1) / every))


def audit(entries: DataFrame, among: dict[str, list], time: str, start=None, end=None) -> DataFrame:
    """Entries whose columns hold one of the values named, from ``start`` to before ``end``; all are filters a scan can take."""
    for c, values in among.items():
        entries = entries.where(F.col(c).isin(values))
    if start is not None:
        entries = entries.where(F.col(time) >= F.lit(start).cast("timestamp"))
    return entries if end is None else entries.where(F.col(time) < F.lit(end).cast("timestamp"))
