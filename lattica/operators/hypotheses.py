"""Hypotheses, panels and watches: rankings, verdicts, drift and thresholds over rows of scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Shares of a hypothesis' rank.
NOVELTY, GROUNDING, DISTANCE, EVALUATOR = 0.25, 0.30, 0.20, 0.25
#: Shares of an evaluation's score.
VERDICT = {"plausible": 0.35, "novelty": 0.25, "testability": 0.25, "falsifiability": 0.15}
#: A lens is admitted from so many bits and up to such a correlation.
LEAST_BITS, MOST_CORRELATION = 0.05, 0.6
#: A frequency counts up to this one; a rejection rate drifts beyond this multiple of its bound.
FREQUENCY_TOP, DRIFT = 10_000, 1.5
#: Data density, cleanliness of outcomes, ease of backfill and edge of a domain.
DENSITY = {
    "crypto": (0.95, 0.90, 0.90, 0.45),
    "politics": (0.55, 0.70, 0.75, 0.95),
    "sports": (0.85, 0.85, 0.80, 0.55),
    "economics": (0.60, 0.85, 0.55, 0.65),
    "weather": (0.65, 0.80, 0.55, 0.60),
    "geopolitics": (0.40, 0.55, 0.50, 0.60),
    "culture": (0.35, 0.60, 0.45, 0.30),
    "mentions": (0.40, 0.65, 0.45, 0.35),
    "other": (0.30, 0.50, 0.40, 0.30),
}


def demand(ok: Column, value: Column, message: str) -> Column:
    """The value where ``ok``; anything else, null included, raises."""
    return F.when(ok, value).otherwise(F.raise_error(F.lit(message)).cast("double"))


def rank_hypotheses(df: DataFrame, key: str, most: int, review: int = 10, floor: float = 0.5) -> DataFrame:
    """The ``most`` best rows of (key, novelty, grounding, distance, plausibility) with rank_score, rank and ``review`` (among
    the first ``review`` and not below ``floor``). The distance counts as its share of the largest one. Ties: grounding,
    distance, then the key. Scores outside 0..1 and distances below 1 raise."""
    if most < 1:
        raise ValueError("most must be 1 or more")
    top = df.agg(F.greatest(F.max("distance"), F.lit(1)).alias("_top"))
    fit = F.col("distance") >= 1
    for c in ("novelty", "grounding", "plausibility"):
        fit = fit & F.col(c).between(0, 1)
    score = F.col("novelty") * NOVELTY + F.col("grounding") * GROUNDING + F.col("distance") / F.col("_top") * DISTANCE + F.col("plausibility") * EVALUATOR
    scored = df.crossJoin(F.broadcast(top)).withColumn("rank_score", demand(fit, score, "scores lie in 0..1, distances from 1")).drop("_top")  # one row
    order = [F.desc("rank_score"), F.desc("grounding"), F.desc("distance"), F.asc(key)]
    best = scored.orderBy(*order).limit(most).withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # ``most`` rows
    return best.withColumn("review", (F.col("rank") <= review) & (F.col("rank_score") >= floor))


def evaluate_hypotheses(runs: DataFrame, evidence: DataFrame, key: str, least: int = 2, floor: float = 0.6) -> DataFrame:
    """(key, runs, score, verdict) of evaluator runs (key, plausible, novelty, testability, falsifiability): ``more_evidence``
    below ``least`` distinct rows of ``evidence`` (key, evidence), else ``retain`` from the floor, else ``reject``. Scores are
    compared to 12 places, so that the order of a mean's sums decides nothing."""
    score = sum((F.avg(c) * w for c, w in VERDICT.items()), F.lit(0.0))
    means = runs.groupBy(key).agg(F.count("*").alias("runs"), F.round(score, 12).alias("score"))
    found = evidence.groupBy(key).agg(F.countDistinct("evidence").alias("_n"))
    verdict = F.when(F.coalesce("_n", F.lit(0)) < least, "more_evidence").when(F.col("score") >= floor, "retain").otherwise("reject")
    return means.join(found, key, "left").withColumn("verdict", verdict).drop("_n")


def refuted(hypotheses: DataFrame, evidence: DataFrame, key: str, ratio: float = 1.0) -> DataFrame:
    """Hypotheses with the weight for and against them in (key, weight, supports) and ``flag``: ``refuted`` where what is
    against outweighs ``ratio`` times what is for, ``contested`` where there is any, ``unsupported`` without either."""
    side = lambda yes: F.sum(F.when(F.col("supports") == yes, F.col("weight")).otherwise(0.0))
    sums = evidence.groupBy(key).agg(side(True).alias("pro"), side(False).alias("con"))
    pro, con = F.coalesce("pro", F.lit(0.0)), F.coalesce("con", F.lit(0.0))
    flag = F.when(con > pro * ratio, "refuted").when(con > 0, "contested").when(pro > 0, "supported").otherwise("unsupported")
    return hypotheses.join(sums, key, "left").withColumns({"pro": pro, "con": con, "flag": flag})


def novelty_split(df: DataFrame, known: Column, score: Column, floor: float) -> DataFrame:
    """Rows with ``part``: ``proof`` (known already, from the floor), ``lead`` (unknown, from the floor) or ``rest``."""
    return df.withColumn("part", F.when(F.coalesce(score, F.lit(0.0)) < floor, "rest").when(F.coalesce(known, F.lit(False)), "proof").otherwise("lead"))


def validation_gates(df: DataFrame, by: list[str], hit: Column, least: int, precision: float) -> DataFrame:
    """(by, n, precision, passed): groups of at least ``least`` rows with such a share of hits."""
    got = df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.coalesce(hit, F.lit(False)).cast("double")).alias("precision"))
    return got.withColumn("passed", (F.col("n") >= least) & (F.col("precision") >= precision))


def pack_panel(candidates: DataFrame, budget: dict[str, float], most: int = 10_000) -> DataFrame:
    """(lens, admitted, reason) of candidates (lens, bits, correlation, a column for each budgeted resource).

    Lenses too weak, too correlated or larger than the budget go first. The others are taken by bits for their dearest share
    of the budget (then bits, then name) as long as they fit; a single lens worth more bits than all taken replaces them.
    The greedy walk is the driver's, over candidates that passed; more than ``most`` raise.
    """
    share = F.greatest(*[F.col(c) / F.lit(float(b)) for c, b in budget.items()], F.lit(0.0))
    weak = ~F.coalesce((F.col("bits") >= LEAST_BITS) & (F.col("correlation") <= MOST_CORRELATION), F.lit(False))
    judged = candidates.withColumn("_share", share).withColumn("reason", F.when(weak, "inadmissible").when(F.col("_share") > 1, "over budget"))
    able = judged.where("reason is null").select("lens", "bits", "_share", *budget).limit(most + 1).collect()
    if len(able) > most:
        raise ValueError(f"more than {most} candidates")
    able.sort(key=lambda r: (-(r["bits"] / r["_share"]) if r["_share"] > 0 else float("-inf"), -r["bits"], r["lens"]))
    used, taken = dict.fromkeys(budget, 0.0), []
    for r in able:
        if all(used[c] + r[c] <= budget[c] for c in budget):
            used = {c: used[c] + r[c] for c in budget}
            taken.append(r)
    alone = max(able, key=lambda r: r["bits"], default=None)
    if alone is not None and alone["bits"] > sum(r["bits"] for r in taken) + 1e-9:
        taken = [alone]
    kept = F.col("lens").isin([r["lens"] for r in taken])
    return judged.select("lens", kept.alias("admitted"), F.when(~kept, F.coalesce("reason", F.lit("budget used up"))).alias("reason"))


def sole_carriers(df: DataFrame, by: list[str], threshold: float) -> DataFrame:
    """Rows (by, slot, bits, coverage) with ``sole``: the only slot of its group from the threshold with any coverage."""
    strong = F.coalesce((F.col("bits") >= threshold) & (F.col("coverage") > 0), F.lit(False))
    return df.withColumn("sole", strong & (F.sum(strong.cast("int")).over(Window.partitionBy(*by)) == 1))


def entropy_bits(df: DataFrame, by: list[str], label: str) -> DataFrame:
    """(by, n, entropy) of a label in bits."""
    c = df.groupBy(*by, label).agg(F.count("*").alias("_c"))
    return c.groupBy(*by).agg(F.sum("_c").alias("n"), (F.log2(F.sum("_c")) - F.sum(F.col("_c") * F.log2("_c")) / F.sum("_c")).alias("entropy"))


def sufficiency(bits: Column, entropy: Column) -> Column:
    """Whether a panel's bits reach the anchor's entropy, and how many it lacks."""
    return F.struct((bits >= entropy).alias("sufficient"), F.greatest(entropy - bits, F.lit(0.0)).alias("deficit"))


def required_slots(df: DataFrame, least: float) -> DataFrame:
    """(slot, bits): the most bits of each slot of rows (slot, bits, observed) that are observed and not below ``least``.
    Bits that are no number raise."""
    bits = demand(F.col("bits").isNotNull() & ~F.isnan("bits") & (F.abs("bits") < float("inf")), F.col("bits"), "bits must be finite")
    return df.select("slot", bits.alias("bits"), "observed").where(F.col("observed") & (F.col("bits") >= least)).groupBy("slot").agg(F.max("bits").alias("bits"))


def guard_drift(verdicts: DataFrame, slot: str, order: list[str], passed: Column, bounds: DataFrame, window: int = 500) -> DataFrame:
    """(slot, rate, far, drift): the share of rejections among each slot's last ``window`` verdicts, and whether it exceeds 1.5
    times its calibrated bound (slot, far); slots without a bound do not drift. Only ``window`` rows a slot leave a task."""
    last = verdicts.withColumn("_r", F.row_number().over(Window.partitionBy(slot).orderBy(*[F.desc(c) for c in order]))).where(F.col("_r") <= window)
    rates = last.groupBy(slot).agg(F.avg(F.when(passed, 0.0).otherwise(1.0)).alias("rate"))
    return rates.join(F.broadcast(bounds), slot, "left").withColumn("drift", F.coalesce(F.col("rate") > F.col("far") * DRIFT, F.lit(False)))


def tripwires(readings: DataFrame, metric: str, order: list[str], value: str, bound: Column, hysteresis: Column, above: Column) -> DataFrame:
    """Readings with ``crossed``: a wire trips beyond its bound and resets only once it is back by the hysteresis; in between the
    last of these two events holds. Values that are no number raise."""
    v = demand(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")), F.col(value).cast("double"), "readings must be finite")
    sign = F.when(above, 1.0).otherwise(-1.0)
    mark = F.when(v * sign > bound * sign + 1e-12, True).when(v * sign <= bound * sign - hysteresis + 1e-12, False)
    w = Window.partitionBy(metric).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return readings.withColumn("crossed", F.coalesce(F.last(mark, ignorenulls=True).over(w), F.lit(False)))


def frequency_bonus(n: Column) -> Column:
    """Logarithm of a frequency as a share of that of the largest that counts."""
    return F.when(n > 0, F.least(F.ln(F.least(n, F.lit(FREQUENCY_TOP)) + 1.0) / F.ln(F.lit(FREQUENCY_TOP + 1.0)), F.lit(1.0))).otherwise(0.0)


def schedule(frequency: Column, cadence: Column, last: Column) -> Column:
    """Importance, next expected second, refresh priority (hot below an hour, warm below a day, cold, or once without a cadence)
    and retention tier of a recurring record."""
    priority = F.when(cadence.isNull(), "once").when(cadence < 3600, "hot").when(cadence < 86400, "warm").otherwise("cold")
    tier = F.when(priority == "hot", "memory").when(priority == "warm", "table").otherwise("archive")
    return F.struct(frequency_bonus(frequency).alias("importance"), (last + F.ceil(cadence)).cast("long").alias("next"), priority.alias("priority"), tier.alias("tier"))


def goodhart(train: Column, held_out: Column, in_region: Column, lens: Column, gain: float = 0.5, region: float = 0.9, share: float = 0.8, weight: float = 1.0) -> Column:
    """Violations and penalty of an objective's change: held-out change at most ``gain`` of the training one (null: not
    checked), rows in region below ``region`` (null: 0), or one lens' change beyond ``share`` of the training one."""
    held = F.when(held_out <= train * gain, "held_out")
    inside = F.when(F.coalesce(in_region, F.lit(0.0)) < region, "region")
    one = F.when((F.abs(train) > 2.220446049250313e-16) & (F.abs(lens / train) > share), "lens")
    found = F.array_compact(F.array(held, inside, one))
    return F.struct(found.alias("violations"), F.when(F.size(found) > 0, F.abs(train) * weight).otherwise(0.0).alias("penalty"))


def build_priority(domain: Column) -> Column:
    """0.45 density + 0.25 backfill + 0.20 cleanliness + 0.10 edge of a domain; unknown ones are ``other``."""
    value = {d: 0.45 * a + 0.25 * c + 0.20 * b + 0.10 * e for d, (a, b, c, e) in DENSITY.items()}
    table = F.create_map(*[F.lit(x) for kv in value.items() for x in kv])
    return F.coalesce(F.try_element_at(table, domain), F.lit(value["other"]))


def signatures(df: DataFrame, content: list[str], time: str, key: str) -> DataFrame:
    """Rows with ``signature``: ``new`` content, or content seen before at the ``same_time`` or as a ``recurrence``. The row
    before it in time (then key) is the one compared."""
    before = F.lag(time).over(Window.partitionBy(*content).orderBy(time, key))
    return df.withColumn("signature", F.when(before.isNull(), "new").when(before == F.col(time), "same_time").otherwise("recurrence"))


def dedup_assign(df: DataFrame, key: str, content: Column, anchor: Column) -> DataFrame:
    """(key, keeper, contested): rows of one content go to its smallest key; where their anchors differ, each anchor's rows go to
    the smallest of theirs and all are contested (both are stored). Rows without an anchor go to the content's smallest
    keeper; rows without content stay by themselves. Content travels as a digest."""
    d = df.select(F.col(key).alias("_k"), F.sha2(content.cast("binary"), 256).alias("_h"), anchor.alias("_a"))
    mine = d.where("_h is not null").groupBy("_h", "_a").agg(F.min("_k").alias("_m"))
    anchors = mine.groupBy("_h").agg(F.min("_m").alias("_first"), F.count("_a").alias("_n"))
    named = mine.where("_a is not null").select("_h", "_a", "_m")
    got = d.join(anchors, "_h", "left").join(named, ["_h", "_a"], "left")
    keeper = F.when(F.col("_n") > 1, F.coalesce("_m", "_first")).otherwise(F.col("_first"))
    return got.select(F.col("_k").alias(key), F.coalesce(keeper, "_k").alias("keeper"), F.coalesce(F.col("_n") > 1, F.lit(False)).alias("contested"))


def dedup_series(assigned: DataFrame, key: str, times: DataFrame, time: str) -> DataFrame:
    """(keeper, occurrences, first, last) of each keeper's rows by their times (key, time)."""
    return assigned.join(times.select(key, time), key).groupBy("keeper").agg(F.count("*").alias("occurrences"), F.min(time).alias("first"), F.max(time).alias("last"))


def dedup_undo(assigned: DataFrame, key: str, undone: DataFrame) -> DataFrame:
    """Assignments with the rows of ``undone`` (key) kept by themselves again."""
    back = undone.select(key).distinct().withColumn("_back", F.lit(True))
    return assigned.join(back, key, "left").withColumn("keeper", F.when(F.col("_back"), F.col(key)).otherwise(F.col("keeper"))).drop("_back")


def resolve_pending(forecasts: DataFrame, resolutions: DataFrame, key: str) -> DataFrame:
    """Resolutions (key, resolved_at, outcome) with the last forecast (key, at, seq, p) made before each; those without one are
    left out. Ties in time: the larger sequence number."""
    pairs = resolutions.join(forecasts, key).where("at < resolved_at")
    best = pairs.groupBy(key, "resolved_at", "outcome").agg(F.max(F.struct("at", "seq", "p")).alias("_f"))
    return best.select(key, "resolved_at", "outcome", F.col("_f.at").alias("at"), F.col("_f.p").alias("p"))


#: Upper ends of Poisson(1) counts 0, 1, 2 ... (fixed values).
POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253)


def bootstrap_mean(df: DataFrame, by: list[str], key: str, value: str, replicates: int = 100) -> DataFrame:
    """(by, n, mean, low, high): Poisson bootstrap of a mean, 95 %. A row's weight in a replicate follows from its integer key
    alone, so that the result does not depend on partitions; sums are combined before the shuffle, which carries one row a
    group, replicate and task. The ends are the replicates' means at the rounded places of 2.5 and 97.5 %."""
    prime = 2147483647
    r = F.explode(F.sequence(F.lit(1), F.lit(replicates)))
    d = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"), F.pmod(F.col(key), F.lit(prime)).cast("long").alias("_k"), r.alias("_r"))
    x = F.pmod(F.col("_k") * 48271 + F.col("_r") * 69621 + 11, F.lit(prime))
    for add in (7, 13, 29):
        x = F.pmod(x * F.pmod(x + add, F.lit(prime)) + F.col("_r"), F.lit(prime))
    u = x / float(prime)
    d = d.withColumn("_w", sum((F.when(u > c, 1).otherwise(0) for c in POISSON), F.lit(0)))
    reps = d.groupBy(*by, "_r").agg(F.sum("_w").alias("_n"), F.sum(F.col("_w") * F.col("_v")).alias("_s"), F.count("*").alias("n"), F.avg("_v").alias("mean"))
    means = reps.groupBy(*by).agg(F.max("n").alias("n"), F.max("mean").alias("mean"), F.sort_array(F.collect_list(F.when(F.col("_n") > 0, F.col("_s") / F.col("_n")))).alias("_m"))
    at = lambda p: F.get("_m", F.round((F.size("_m") - 1) * F.lit(p)).cast("int"))
    return means.select(*by, "n", "mean", at(0.025).alias("low"), at(0.975).alias("high"))
