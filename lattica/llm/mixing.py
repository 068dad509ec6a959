"""Mixing to target weights by DataFrame functions alone: soft domain membership and projected-gradient least squares."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.store import fresh, save

BUCKETS = 4096
#: Domains that a labelled table may name; above it the model would not be small.
MOST_DOMAINS = 256
#: A text's evidence counts as that of so many words, so that memberships of long texts stay soft.
EVIDENCE = 32.0


def tokens(text: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[\\x20\\x09-\\x0D]+", " ")), " ")


def train(labelled: DataFrame, domain: str) -> tuple[list[str], DataFrame]:
    """Domains in order and (bucket, w): log-likelihood of a hashed word in each domain, from all rows of ``labelled``.

    Rows with a null domain are ignored. The table has ``BUCKETS`` rows at any size of the corpus.
    """
    words = labelled.where(F.col(domain).isNotNull()).select(F.col(domain).cast("string").alias("domain"), F.explode(tokens(F.col("text"))).alias("word")).where("word <> ''")
    counts = save(words.groupBy("domain", F.pmod(F.xxhash64("word"), F.lit(BUCKETS)).alias("bucket")).agg(F.count("*").alias("n")), "domain-counts")
    sizes = {r[0]: r[1] for r in counts.groupBy("domain").agg(F.sum("n")).limit(MOST_DOMAINS + 1).collect()}
    if len(sizes) > MOST_DOMAINS:
        raise ValueError(f"more than {MOST_DOMAINS} domains")
    names = sorted(sizes)
    if not names:
        return names, counts.select("bucket").where(F.lit(False))
    one = lambda d: F.log((F.coalesce(F.max(F.when(F.col("domain") == d, F.col("n"))), F.lit(0)) + 0.5) / F.lit(sizes[d] + 0.5 * BUCKETS))
    every = counts.sparkSession.range(BUCKETS).select(F.col("id").alias("bucket"))
    model = every.join(counts, "bucket", "left").groupBy("bucket").agg(*[one(d).alias(f"w{j}") for j, d in enumerate(names)])
    return names, model


def posteriors(docs: DataFrame, names: list[str], model: DataFrame) -> DataFrame:
    """(doc_id, tokens, p0 ...): the words of each row and its soft membership; without words or domains it is uniform.

    Words are looked up in the model, of ``BUCKETS`` rows and so broadcast, and summed within the task before the
    shuffle, which carries a row a document. Rows of one id count as one document.
    """
    words = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(tokens(F.col("text"))).alias("word"))
    looked = words.withColumn("bucket", F.when(F.col("word") != "", F.pmod(F.xxhash64("word"), F.lit(BUCKETS))))
    looked = looked.join(F.broadcast(model), "bucket", "left")
    sums = looked.groupBy("doc_id").agg(F.count("bucket").alias("tokens"), *[F.coalesce(F.sum(f"w{j}"), F.lit(0.0)).alias(f"l{j}") for j in range(len(names))])
    if not names:
        return sums
    scale = F.greatest(F.lit(1.0), F.col("tokens") / F.lit(EVIDENCE))
    top = F.greatest(*[F.col(f"l{j}") for j in range(len(names))]) if len(names) > 1 else F.col("l0")
    e = [F.exp((F.col(f"l{j}") - top) / scale) for j in range(len(names))]
    total = sum(e[1:], e[0])
    return sums.select("doc_id", "tokens", *[(x / total).alias(f"p{j}") for j, x in enumerate(e)])


def rates(member: DataFrame, names: list[str], targets: dict[str, float] | None, temperature: float = 0.7, steps: int = 30, tolerance: float = 1e-6) -> tuple[DataFrame, dict]:
    """``member`` with ``rate`` >= 0 such that sum(rate * tokens * p_j) meets the targets, all words kept in total.

    Projected gradient from rate 1 on |A rate - target|^2, in the metric in which a document weighs its tokens; the step
    is preconditioned by the domains' (small) Gram matrix. Each step is one distributed sum. ``targets`` are shares by
    domain (missing ones 0, of any total); by default the present shares to the power ``temperature``.
    """
    k = len(names)
    if k == 0:
        return member.withColumn("rate", F.lit(1.0)), {"steps": 0, "residual": 0.0}
    p = [F.col(f"p{j}") for j in range(k)]
    first = member.agg(F.sum("tokens"), *[F.sum(F.col("tokens") * x) for x in p], *[F.sum(F.col("tokens") * p[i] * p[j]) for i in range(k) for j in range(k)]).first()
    total = float(first[0] or 0)
    if total == 0:
        return member.withColumn("rate", F.lit(1.0)), {"steps": 0, "residual": 0.0}
    now, gram = np.array(first[1 : k + 1], float), np.array(first[k + 1 :], float).reshape(k, k)
    share = np.array([max(0.0, targets.get(n, 0.0)) for n in names]) if targets is not None else now**temperature
    if share.sum() <= 0:
        raise ValueError("no target weight is above 0")
    target = share / share.sum() * total
    inverse = np.linalg.pinv(gram + 1e-9 * np.trace(gram) / k * np.eye(k))
    rate, made, residual = F.lit(1.0), 0, 1.0
    for made in range(1, steps + 1):
        y = inverse @ (now - target)
        rate = F.greatest(F.lit(0.0), rate - sum((x * F.lit(float(v)) for x, v in zip(p[1:], y[1:])), p[0] * F.lit(float(y[0]))))
        if made % 8 == 0:  # keep the expression short
            member = save(member.drop("_rate").withColumn("_rate", rate), "rates")
            rate = F.col("_rate")
        now = np.array(member.agg(*[F.sum(F.col("tokens") * x * rate) for x in p]).first(), float)
        residual = float(np.abs(now - target).sum() / total)
        if residual <= tolerance:
            break
    return member.withColumn("rate", F.round(rate, 9)).drop("_rate"), {"steps": made, "residual": residual, "target": dict(zip(names, target.tolist())), "reached": dict(zip(names, now.tolist()))}


def mix(docs: DataFrame, labelled: DataFrame, domain: str, targets: dict[str, float] | None = None) -> tuple[DataFrame, list[str], dict]:
    """(doc_id, tokens, p0 ..., rate, copies) per id, the domains' names, and how near the targets are.

    ``copies`` rounds ``rate`` up or down by a hash of the id, so that its mean is the rate. Null ids count as one.
    """
    names, model = train(labelled, domain)
    member = save(posteriors(docs, names, model), "members")
    rated, report = rates(member, names, targets)
    part = F.pmod(F.xxhash64(F.lit("copies"), F.col("doc_id")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    copies = (F.floor("rate") + F.when(part < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("long")
    return save(rated.withColumn("copies", copies), "mixed"), names, report


def labelled_rows(docs: DataFrame, labels: DataFrame, bound: int = 20_000) -> DataFrame:
    """At most ``bound`` documents that the labelled table names, in the order of a hash of the id. Only the bounded id
    list is broadcast; texts are not shuffled at any size."""
    name = fresh("labelled", docs.columns)
    ids = labels.where("doc_id is not null").select(F.col("doc_id").cast("long").alias(name)).distinct()
    chosen = ids.orderBy(F.xxhash64(name), name).limit(bound)
    return docs.join(F.broadcast(chosen), docs["doc_id"].cast("long") == chosen[name], "left_semi")


def contract(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, tokens, domain (the likeliest), membership (its probability), rate, copies; a row per id."""
    own = docs.select("doc_id", "text", "lang")
    mixed, names, _ = mix(own, labelled_rows(own, labels), "lang")
    if not names:
        return mixed.select("doc_id", "tokens", F.lit(None).cast("string").alias("domain"), F.lit(0.0).alias("membership"), "rate", "copies")
    best = F.array_max(F.array(*[F.struct(F.col(f"p{j}").alias("p"), F.lit(n).alias("name")) for j, n in enumerate(names)]))
    return mixed.select("doc_id", "tokens", best["name"].alias("domain"), best["p"].alias("membership"), "rate", "copies")


def sample_mixture(docs: DataFrame, labels: DataFrame, domain: str = "lang", targets: dict[str, float] | None = None) -> DataFrame:
    """``docs`` with each row as often as its own ``copies`` (0: gone), all columns kept and one added, the ``rate``.

    Rows get a number, written once with the table, and are rated by it, so rows with a null or a repeated id share nothing.
    """
    row, rate, times, of = (fresh(n, docs.columns) for n in ("row", "rate", "copies", "of"))
    numbered = save(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    mixed, _, _ = mix(numbered.select(F.col(row).alias("doc_id"), "text"), labelled_rows(docs, labels).select("doc_id", "text", domain), domain, targets)
    mixed = mixed.select(F.col("doc_id").alias(of), F.col("rate").alias(rate), F.col("copies").alias(times))
    joined = numbered.join(mixed, numbered[row] == mixed[of]).drop(of, row).where(F.col(times) > 0)
    return joined.withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times).cast("int")))).drop(times)
