"""Text and vector retrieval, and rank fusion."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from lattica.functions.vector import doubles, norm
from lattica.operators.best import Best, Vectors, dealt, offer
from lattica.operators.graphs import cut

#: Keywords of the intents, in the order in which they are tried.
INTENTS = {
    "code": ("fn ", "rust", "stacktrace", "compile", "trait", "function"),
    "causal": ("because", "caused", "why", "causal", "leads to"),
    "entity": ("who", "entity", "person", "company", "organization"),
    "temporal": ("when", "recent", "yesterday", "recurring", "periodic"),
    "speaker": ("speaker", "voice", "said"),
    "style": ("style", "tone", "register"),
    "civic": ("polis", "vote", "civic", "policy"),
    "media": ("image", "audio", "video", "media"),
    "bridge": ("bridge", "connect", "between"),
    "kernel": ("kernel", "grounding", "anchor"),
    "lexical": ("exact", "keyword", "literal", "bm25"),
    "multimodal": ("multimodal", "cross modal"),
    "semantic": ("meaning", "semantic", "similar"),
}


def terms(text: Column) -> Column:
    """Lower-case maximal runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit("[\\p{L}\\p{N}]+"), 0)


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf, len): map-side combined within a document's task."""
    t = docs.select(key, terms(F.coalesce(F.col(text), F.lit(""))).alias("_t"))
    return t.select(key, F.size("_t").alias("len"), F.explode("_t").alias("term")).groupBy(key, "len", "term").agg(F.count("*").alias("tf"))


def statistics(docs: DataFrame, text: str) -> DataFrame:
    return docs.agg(F.count("*").alias("n"), F.avg(F.size(terms(F.coalesce(F.col(text), F.lit(""))))).alias("avg_len"))


def bm25(docs: DataFrame, key: str, text: str, query: list[str], k1: float = 1.2, b: float = 0.75, plus: bool = True, every: bool = False) -> DataFrame:
    """(key, score) of documents with a query term (``every``: with all). ``plus`` keeps the factor (k1 + 1) of the search
    index; the collection index has none. One scan, without a shuffle: it writes the counts of the documents that match to the
    shared folder and observes N, the mean length and the document frequencies on the way."""
    wanted = sorted(set(query))
    words = terms(F.coalesce(F.col(text), F.lit("")))

    def times(words: Column, q: str) -> Column:
        return F.size(F.filter(words, lambda x: x == q))

    # the words are bound to a variable, so a text is split once, not once for each count
    counts = F.transform(F.array(words), lambda t: F.struct(F.size(t).alias("len"), F.array(*[times(t, q) for q in wanted]).alias("tf")))[0]
    counted = docs.select(key, counts.alias("_c")).select(key, "_c.len", "_c.tf")
    places = range(len(wanted))
    corpus = Observation()
    counted = counted.observe(corpus, F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg_len"), *[F.sum((F.col("tf")[i] > 0).cast("long")).alias(f"df{i}") for i in places])
    found = cut(counted.where((F.array_min if every else F.array_max)("tf") > 0))
    n, mean = corpus.get["n"], corpus.get["avg_len"]
    ratio = F.col("len") / F.lit(float(mean)) if mean else F.lit(1.0)

    def part(i: int) -> Column:
        f, df = F.col("tf")[i], corpus.get[f"df{i}"] or 0
        idf = math.log((n - df + 0.5) / (df + 0.5) + 1)
        return F.when(f > 0, F.lit(idf) * f * (k1 + 1 if plus else 1.0) / (f + k1 * (1 - b + b * ratio))).otherwise(0.0)

    return found.select(key, sum((part(i) for i in places), F.lit(0.0)).alias("score"))


def intent(text: Column) -> Column:
    """The first intent with a keyword in the text, else ``general``."""
    low, out = F.lower(text), F.lit("general")
    for name, words in reversed(INTENTS.items()):
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w)
        out = F.when(hit, name).otherwise(out)
    return out


def nearest(queries: DataFrame, base: DataFrame, key: str, vector: str, k: int, bound: int = 20_000) -> DataFrame:
    """(qid, key, score, rank): exact top k by cosine, to nine decimals and then by the key, of each query (qid, qvec): the query
    set is sent out in as many blocks of about ``bound`` as it has, each against one scan of ``base``. Every pair is scored, by
    products of matrices; each task keeps its best k a query before the shuffle, so rows shuffled are tasks * queries * k.
    Vectors without a score (none, or of another length) come last."""
    parts = max(1, -(-queries.count() // bound))
    asked = queries.select("qid", whole(doubles(F.col("qvec"))).alias("_q"))
    out = None
    for i in range(parts):
        some = asked if parts == 1 else asked.where(F.pmod(F.xxhash64("qid"), F.lit(parts)) == i)
        got = best_by_cosine(query_block(some), queries.schema["qid"].dataType.simpleString(), base, key, vector, k)
        out = got if out is None else out.unionByName(got)
    return out


def whole(v: Column) -> Column:
    """The vector, or null if an element is."""
    return F.when(~F.exists(v, lambda x: x.isNull()), v)


def query_block(asked: DataFrame) -> tuple[np.ndarray, Vectors]:
    """The ids and vectors of (qid, vector) on the driver."""
    rows = asked.collect()
    return np.array([r[0] for r in rows], object), Vectors([r[1] for r in rows])


def best_by_cosine(block: tuple[np.ndarray, Vectors], kind: str, base: DataFrame, key: str, vector: str, k: int, probe=None) -> DataFrame:
    """(qid, key, score, rank) of a block of queries, whose ids are of type ``kind``. ``probe`` yields of a part's vectors
    (places, query numbers): the rows that these queries alone are to meet."""
    ids, asked = block

    def run(parts):
        best = Best(len(ids), k)
        for part in parts:
            keys, values = part[key].to_numpy(object), part[vector].to_numpy(object)
            if probe is None:
                offer(best, asked, keys, Vectors(values))
            else:
                for at, which in probe(values):
                    offer(best, asked, keys[at], Vectors(values[at]), which)
        got = best.settle()
        yield pd.DataFrame({"qid": ids[got["q"].to_numpy()], key: got["key"].to_numpy(), "_r": got["rank"].to_numpy(), "score": got["score"].to_numpy()})

    found = dealt(base.select(key, whole(F.col(vector)).alias(vector))).mapInPandas(run, f"qid {kind}, `{key}` {base.schema[key].dataType.simpleString()}, _r double, score double")
    w = Window.partitionBy("qid").orderBy(F.desc("_r"), key)
    found = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return found.select("qid", key, F.when(F.col("_r") > float("-inf"), F.col("score")).alias("score"), "rank")


def recall_at_k(found: DataFrame, truth: DataFrame, key: str) -> DataFrame:
    """(qid, recall): share of the true neighbours found."""
    both = truth.select("qid", key).join(found.select("qid", key, F.lit(1).alias("hit")), ["qid", key], "left")
    return both.groupBy("qid").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))


def ivf_assign(base: DataFrame, centroids: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, cell): nearest centroid (cell, centre) by L2 distance; centroids are a fitted, bounded table."""
    d = F.aggregate(F.zip_with(doubles(F.col(vector)), doubles(F.col("centre")), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    return base.crossJoin(F.broadcast(centroids)).groupBy(key).agg(F.min_by("cell", F.struct(d, "cell")).alias("cell"))


def rrf(lists: DataFrame, key: str, weights: DataFrame | None = None, constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion of (slot, key, rank): sum of weight / (60 + rank). Slots of weight 0 or less or without one
    are dropped where weights (slot, weight) are given."""
    x = lists
    w = F.lit(1.0)
    if weights is not None:
        x, w = lists.join(F.broadcast(weights.where("weight > 0")), "slot"), F.col("weight")
    return x.groupBy(key).agg(F.sum(w / (constant + F.col("rank"))).alias("score"), F.count("*").alias("slots"))


def restricted(lists: DataFrame, candidates: DataFrame, key: str) -> DataFrame:
    """Ranked lists cut to candidates; ranks stay as they were."""
    return lists.join(candidates.select(key).distinct(), key, "left_semi")


__all__ = ["bm25", "intent", "ivf_assign", "nearest", "norm", "postings", "recall_at_k", "restricted", "rrf", "statistics", "terms"]
