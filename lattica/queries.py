"""Registered queries of the library's own operators over the driver's tables, each with the SQL it is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions import forecast, temporal, vector
from lattica.operators import aggregates, decide, encode, estimators, graphs, markets, recurrence, relational, search, stats, tuning, weave

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers the function under its name; it gets a loader of tables."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def events(t) -> DataFrame:
    return t("events").withColumn("t", temporal.seconds(F.col("ts")))


T = "CAST(floor(epoch(ts)) AS BIGINT)"


# --- scans, predicates, joins -------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey >= 1000 AND o_orderkey < 5000")
def key_range(t):
    return relational.key_range(t("orders"), "o_orderkey", 1000, 5000).select("o_orderkey", "o_totalprice")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey > 50 ORDER BY c_custkey LIMIT 20")
def page_after(t):
    return relational.page(t("customer").select("c_custkey", "c_name"), "c_custkey", 50, 20)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey <= 777 ORDER BY o_orderkey DESC LIMIT 1")
def predecessor(t):
    return relational.predecessor(t("orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 777)


@query("SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders WHERE o_totalprice >= 1000 AND o_orderpriority <> '1-URGENT' AND contains(o_orderpriority, 'LOW')")
def predicates(t):
    found = relational.where_all(t("orders"), [("o_totalprice", "gte", 1000), ("o_orderpriority", "ne", "1-URGENT"), ("o_orderpriority", "contains", "LOW")])
    return found.select("o_orderkey", "o_totalprice", "o_orderpriority")


@query("SELECT count(*) AS n FROM nation WHERE false")
def missing_field_fails(t):
    return relational.where_all(t("nation"), [("no_such_field", "ne", 1)]).agg(F.count("*").alias("n"))


@query("SELECT user_id, max(ts) AS ts FROM events GROUP BY user_id")
def latest_version(t):
    return relational.latest(t("events").select("user_id", "ts"), ["user_id"], "ts")


@query("SELECT user_id, max(t) AS t FROM (SELECT user_id, " + T + " AS t FROM events) WHERE t <= (SELECT min(" + T + ") + 86400 * 5 FROM events) GROUP BY user_id")
def time_travel(t):
    e = events(t)
    at = e.agg((F.min("t") + 86400 * 5).alias("at")).first()["at"]
    return relational.latest(e.select("user_id", "t", F.col("t").alias("v")), ["user_id"], "v", at).select("user_id", "t")


@query("SELECT o_orderkey, c_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def join_by_reference(t):
    return relational.join_by_reference(t("orders"), t("customer"), "o_custkey", "c_custkey").select("o_orderkey", "c_name", "c_mktsegment")


@query("SELECT n_name, r_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name, r_name")
def reference_chain(t):
    j = relational.join_by_reference(relational.join_by_reference(t("customer"), t("nation"), "c_nationkey", "n_nationkey"), t("region"), "n_regionkey", "r_regionkey")
    return j.groupBy("n_name", "r_name").agg(F.count("*").alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("SELECT c.c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F')")
def candidate_restriction(t):
    o = t("orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return search.restricted(t("customer").select("c_custkey"), o, "c_custkey")


@query(
    "WITH e AS (SELECT user_id, event_type, " + T + " AS t FROM events), a AS (SELECT * FROM e WHERE event_type = (SELECT min(event_type) FROM events)), b AS (SELECT * FROM e WHERE event_type = (SELECT max(event_type) FROM events)) "
    "SELECT a.user_id, a.t AS ta, b.t AS tb FROM a JOIN b ON a.user_id = b.user_id AND abs(a.t - b.t) < 3600"
)
def co_occurrence(t):
    e = events(t)
    lo, hi = e.agg(F.min("event_type"), F.max("event_type")).first()
    return relational.band_join(e.where(F.col("event_type") == lo), e.where(F.col("event_type") == hi), ["user_id"], "t", "t", 3600)


@query(
    "WITH e AS (SELECT event_id, user_id, event_type, " + T + " AS t, value FROM events), a AS (SELECT * FROM e WHERE event_type = (SELECT max(event_type) FROM events)), b AS (SELECT * FROM e WHERE event_type = (SELECT min(event_type) FROM events)) "
    "SELECT a.event_id, max(b.t) AS bt FROM a LEFT JOIN b ON a.user_id = b.user_id AND b.t <= a.t GROUP BY a.event_id"
)
def as_of_join(t):
    e = events(t)
    lo, hi = e.agg(F.min("event_type"), F.max("event_type")).first()
    a = e.where(F.col("event_type") == hi).select("event_id", "user_id", "t")
    b = e.where(F.col("event_type") == lo).select("user_id", F.col("t").alias("b"), F.col("t").alias("bt"))
    return relational.as_of_join(a, b, ["user_id"], "t", "b", "bt").select("event_id", "bt")


@query("SELECT o_orderkey, l_linenumber FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE NOT (o_orderdate <= l_shipdate)")
def lookahead(t):
    j = t("orders").join(t("lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).withColumn("after", F.col("l_shipdate") + F.expr("interval 1 day"))
    return relational.lookahead(j, "o_orderdate", "l_shipdate", "after", "after").select("o_orderkey", "l_linenumber")


@query("SELECT n_nationkey FROM (SELECT c_nationkey AS n_nationkey FROM customer WHERE c_acctbal > 5000 INTERSECT SELECT s_nationkey FROM supplier)")
def scope_intersect(t):
    a = t("customer").where("c_acctbal > 5000").select(F.col("c_nationkey").alias("n_nationkey"))
    return relational.scope_intersect(a, t("supplier").select(F.col("s_nationkey").alias("n_nationkey")), edges(t))[0]


@query("SELECT k FROM (SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 UNION SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)")
def scope_union(t):
    a = t("customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("k"))
    b = t("supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("k"))
    return relational.scope_union((a, a), (b, b))[0]


# --- aggregates -----------------------------------------------------------------------------------------------------------


@query("SELECT count(l_quantity) AS count, round(sum(l_quantity), 4) AS sum, min(l_quantity) AS min, max(l_quantity) AS max, round(avg(l_quantity), 6) AS avg FROM lineitem")
def olap(t):
    return aggregates.olap(t("lineitem"), "l_quantity").withColumns({"sum": F.round("sum", 4), "avg": F.round("avg", 6)})


@query("SELECT CAST(l_linenumber AS FLOAT) AS key, false AS minus_zero, count(*) AS count, round(sum(l_discount), 4) AS sum, min(l_discount) AS min, max(l_discount) AS max, round(avg(l_discount), 6) AS avg FROM lineitem GROUP BY l_linenumber")
def olap_grouped(t):
    return aggregates.olap_by(t("lineitem"), "l_discount", "l_linenumber").withColumns({"sum": F.round("sum", 4), "avg": F.round("avg", 6)})


@query("SELECT count(*) AS count, 0.0::DOUBLE AS sum, CAST(NULL AS DOUBLE) AS min, CAST(NULL AS DOUBLE) AS max, 0.0::DOUBLE AS avg FROM orders WHERE false")
def aggregate_of_none(t):
    return aggregates.query_aggregates(t("orders").where("o_totalprice < -1"), "o_totalprice")


@query("SELECT event_type AS series, date_trunc('hour', ts) AS bucket, count(value) AS count, round(sum(value), 4) AS sum, min(value) AS min, max(value) AS max FROM events GROUP BY 1, 2")
def rollup_hour(t):
    return aggregates.rollup(t("events"), "event_type", "ts", "value", "1h").withColumn("sum", F.round("sum", 4))


@query("SELECT event_type AS series, CAST(date_trunc('day', ts) AS TIMESTAMP) AS bucket, count(value) AS count, round(sum(value), 4) AS sum, min(value) AS min, max(value) AS max FROM events GROUP BY 1, 2")
def rollup_day(t):
    return aggregates.rollup(t("events"), "event_type", "ts", "value", "1d").withColumn("sum", F.round("sum", 4))


@query(
    "WITH c AS (SELECT event_type, CAST((" + T + " % 86400) // 3600 AS INT) AS h, count(*) AS c FROM events GROUP BY 1, 2), m AS (SELECT event_type, sum(c) AS n, max(c) AS top FROM c GROUP BY 1) "
    "SELECT m.event_type, CAST(n AS BIGINT) AS n, CASE WHEN count(*) = 1 THEN max(h) END AS mode, round(max(top / n), 9) AS confidence FROM m JOIN c ON c.event_type = m.event_type AND c.c = m.top GROUP BY m.event_type, n"
)
def hour_mode(t):
    return aggregates.mode_with_confidence(events(t), "event_type", temporal.hour_of(F.col("t"))).withColumn("confidence", F.round("confidence", 9))


@query("WITH g AS (SELECT user_id, " + T + " - lag(" + T + ") OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events) SELECT user_id, count(*) AS n, CAST(quantile_cont(gap, 0.5) AS DOUBLE) AS cadence FROM g GROUP BY user_id")
def cadence(t):
    return aggregates.cadence(events(t), "user_id", "t")


@query("WITH c AS (SELECT l_returnflag, l_linestatus, count(*) AS c FROM lineitem GROUP BY 1, 2) SELECT l_returnflag, round(log2(sum(c)) - sum(c * log2(c)) / sum(c), 9) AS entropy FROM c GROUP BY 1")
def entropy(t):
    return aggregates.entropy_bits(t("lineitem"), ["l_returnflag"], "l_linestatus").withColumn("entropy", F.round("entropy", 9))


@query("SELECT c_nationkey, round(coalesce(sum(x * x) / (sum(x) * sum(x)), 0), 9) AS hhi, round(coalesce(max(x) / sum(x), 0), 9) AS top_share FROM (SELECT c_nationkey, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS x FROM customer) GROUP BY 1")
def concentration(t):
    return aggregates.concentration(t("customer"), ["c_nationkey"], "c_acctbal").withColumns({"hhi": F.round("hhi", 9), "top_share": F.round("top_share", 9)})


@query("SELECT user_id, round(stddev_samp(value), 6) AS volatility FROM events GROUP BY 1")
def volatility(t):
    return aggregates.volatility(t("events"), ["user_id"], "value").withColumn("volatility", F.round("volatility", 6))


@query("SELECT event_type, count(*) AS occurrences, count(DISTINCT user_id) AS items, round(count(*) / count(DISTINCT user_id), 9) AS ratio FROM events GROUP BY 1")
def compression(t):
    return aggregates.compression(t("events"), ["event_type"], "user_id").withColumn("ratio", F.round("ratio", 9))


@query("SELECT o_orderkey, o_totalprice, CAST(row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS INT) AS rank FROM (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25)")
def top_k(t):
    return aggregates.top_k(t("orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", 25)


# --- search and fusion ----------------------------------------------------------------------------------------------------

COS = "list_dot_product({0}, {1}) / (sqrt(list_dot_product({0}, {0})) * sqrt(list_dot_product({1}, {1})))"
EMB = "(SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)"


@query(f"SELECT a.vec_id AS qid, b.vec_id, round({COS.format('a.e', 'b.e')}, 6) AS score FROM {EMB} a JOIN {EMB} b ON a.vec_id % 20 = 0 QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY round({COS.format('a.e', 'b.e')}, 9) DESC, b.vec_id) <= 10")
def nearest_vectors(t):
    e = t("embeddings")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
    return search.nearest(q, e, "vec_id", "embedding", 10).select("qid", "vec_id", F.round("score", 6).alias("score"))


@query(f"WITH q AS (SELECT e FROM {EMB} WHERE vec_id = 0), d AS (SELECT v.vec_id, v.label, {COS.format('v.e', 'q.e')} AS c FROM {EMB} v, q) SELECT label, count(*) AS n, round(avg(c), 6) AS agreement, round(min(c), 6) AS least FROM d GROUP BY label")
def agreement_by_label(t):
    e = t("embeddings")
    q = e.where("vec_id = 0").select(F.col("embedding").alias("q"))
    d = e.crossJoin(F.broadcast(q)).select("label", vector.cosine(F.col("embedding"), F.col("q")).alias("c"))  # one row
    return d.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("c"), 6).alias("agreement"), F.round(F.min("c"), 6).alias("least"))


@query("SELECT label, CAST(i - 1 AS INT) AS dim, round(avg(embedding[i]::DOUBLE), 6) AS mean FROM (SELECT label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY 1, 2")
def centroids(t):
    return t("embeddings").select("label", F.posexplode("embedding").alias("dim", "x")).groupBy("label", "dim").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))


TERMS = "SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+')) AS term FROM documents"


@query(f"WITH p AS (SELECT doc_id, term, count(*) AS tf FROM ({TERMS}) GROUP BY 1, 2) SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM p GROUP BY 1")
def postings(t):
    return search.postings(t("documents"), "doc_id", "text").groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


BM25 = (
    f"WITH w AS ({TERMS}), l AS (SELECT doc_id, count(*) AS len FROM w GROUP BY 1), s AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT count(*) FROM w) / (SELECT count(*) FROM documents) AS avg_len), "
    "p AS (SELECT doc_id, term, count(*) AS tf FROM w WHERE term IN ('the', 'tion', 'de') GROUP BY 1, 2), f AS (SELECT term, count(*) AS df FROM p GROUP BY 1), "
    "x AS (SELECT p.doc_id, ln((n - df + 0.5) / (df + 0.5) + 1) * tf * FACTOR / (tf + 1.2 * (0.25 + 0.75 * len / avg_len)) AS part FROM p JOIN f USING (term) JOIN l USING (doc_id), s) "
    "SELECT doc_id, round(sum(part), 6) AS score FROM x GROUP BY 1 TAIL"
)


@query(BM25.replace("FACTOR", "2.2").replace("TAIL", ""))
def bm25_search(t):
    return search.bm25(t("documents"), "doc_id", "text", ["the", "tion", "de"]).withColumn("score", F.round("score", 6))


@query(BM25.replace("FACTOR", "1.0").replace("TAIL", "HAVING count(*) = 3"))
def bm25_all_terms(t):
    return search.bm25(t("documents"), "doc_id", "text", ["the", "tion", "de"], plus=False, every=True).withColumn("score", F.round("score", 6))


def ranked_lists(t) -> DataFrame:
    c = t("customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("s"))
    o = t("orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").cast("double").alias("s"))
    made = [aggregates.top_k(d, "s", "id", 50).select(F.lit(name).alias("slot"), "id", "rank") for name, d in (("balance", c), ("orders", o))]
    return made[0].unionByName(made[1])


LISTS = "WITH a AS (SELECT 'balance' AS slot, c_custkey AS id, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer QUALIFY rank <= 50), o AS (SELECT o_custkey AS id, count(*) AS s FROM orders GROUP BY 1), b AS (SELECT 'orders' AS slot, id, row_number() OVER (ORDER BY s DESC, id) AS rank FROM o QUALIFY rank <= 50), l AS (SELECT * FROM a UNION ALL SELECT * FROM b) "


@query(LISTS + "SELECT id, round(sum(1.0 / (60 + rank)), 9) AS score, count(*) AS slots FROM l GROUP BY id")
def rank_fusion(t):
    return search.rrf(ranked_lists(t), "id").withColumn("score", F.round("score", 9))


@query(LISTS + "SELECT id, round(sum(0.5::DOUBLE / (60 + rank)), 9) AS score, count(*) AS slots FROM l WHERE slot = 'orders' GROUP BY id")
def weighted_rank_fusion(t):
    lists = ranked_lists(t)
    w = lists.sparkSession.createDataFrame([("orders", 0.5), ("balance", 0.0)], "slot string, weight double")
    return search.rrf(lists, "id", w).withColumn("score", F.round("score", 9))


@query(f"SELECT a.vec_id, CAST(sum(CASE WHEN (x >= 0) <> (y >= 0) THEN 1 ELSE 0 END) AS INT) AS mismatches FROM (SELECT vec_id, unnest(embedding) AS x, unnest((SELECT embedding FROM embeddings WHERE vec_id = 0)) AS y FROM embeddings) a GROUP BY 1")
def binary_quantization(t):
    e = t("embeddings")
    q = e.where("vec_id = 0").select(F.col("embedding").alias("q"))
    return e.crossJoin(F.broadcast(q)).select("vec_id", vector.sign_mismatch(F.col("embedding"), F.col("q")).alias("mismatches"))


@query("SELECT vec_id, round(list_aggregate(list_transform(embedding, lambda x: abs(x::DOUBLE)), 'max') / 127, 9) AS scale FROM embeddings")
def int8_scale(t):
    return t("embeddings").select("vec_id", F.round(vector.int8_scale(F.col("embedding")), 9).alias("scale"))


# --- temporal and recurrence ----------------------------------------------------------------------------------------------


@query("SELECT event_id, round(exp(-(m - t) * 0.693 / 3600.0), 9) AS exponential, round(greatest(0, 1 - (m - t) / 86400.0), 9)::DOUBLE AS linear, (CASE WHEN m - t < 3600 THEN 0.8 WHEN m - t < 86400 THEN 0.5 ELSE 0.1 END)::DOUBLE AS step FROM (SELECT event_id, " + T + " AS t, (SELECT max(" + T + ") FROM events) AS m FROM events)")
def recency(t):
    e = events(t)
    age = e.agg(F.max("t")).first()[0] - F.col("t")
    return e.select("event_id", *[F.round(temporal.recency(age, d), 9).alias(d) for d in ("exponential", "linear")], temporal.recency(age, "step").alias("step"))


@query("SELECT event_id, ((CASE WHEN (t % 86400) // 3600 = 14 THEN 0.5 ELSE 0 END) + (CASE WHEN (t // 86400 + 3) % 7 = 1 THEN 0.5 ELSE 0 END))::DOUBLE AS score FROM (SELECT event_id, " + T + " AS t FROM events)")
def periodic_score(t):
    return events(t).select("event_id", temporal.periodic_score(F.col("t"), 14, 1).alias("score"))


@query("SELECT user_id, count(*) AS f, round(least(0.05, ln(count(*) + 1) / ln(10001) * 0.05), 9)::DOUBLE AS boost FROM events GROUP BY 1")
def recurrence_boost(t):
    return t("events").groupBy("user_id").agg(F.count("*").alias("f")).select("user_id", "f", F.round(temporal.recurrence_boost(F.col("f")), 9).alias("boost"))


@query("SELECT user_id, least(count(*), 5) AS kept, greatest(count(*) - 5, 0) AS rolled FROM events GROUP BY 1")
def roll_oldest(t):
    return recurrence.roll_oldest(events(t), "user_id", "t", "value", 5).select("user_id", "kept", "rolled")


GAPS = "WITH g AS (SELECT user_id, " + T + " AS t, " + T + " - lag(" + T + ") OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events), "


@query(
    GAPS + "b AS (SELECT user_id, count(*) AS n, max(t) AS last, quantile_cont(gap, 0.5) AS med FROM g WHERE gap IS NULL OR gap > 0 GROUP BY 1), d AS (SELECT user_id, quantile_cont(abs(gap - med), 0.5) AS mad FROM g JOIN b USING (user_id) WHERE gap > 0 GROUP BY 1), "
    "c AS (SELECT *, greatest(0, least(1, 1 - mad / med)) * least(n / 12.5, 1) AS conf FROM b JOIN d USING (user_id) WHERE n >= 3) SELECT user_id, n, last + CAST(round(med) AS BIGINT) AS next, round(conf, 6)::DOUBLE AS confidence, round(greatest(mad, med * (1 - conf)), 4)::DOUBLE AS half_width FROM c"
)
def predict_next(t):
    return recurrence.predict_next(events(t), "user_id", "t").withColumns({"confidence": F.round("confidence", 6), "half_width": F.round("half_width", 4)})


@query(GAPS + "a AS (SELECT user_id, count(*) AS n, max(t) AS last, quantile_cont(gap, 0.5) AS c FROM g GROUP BY 1) SELECT user_id, n, CASE WHEN n <= 1 THEN 'non_recurring' WHEN n >= 3 AND (SELECT max(t) FROM g) > last + 2 * c THEN 'overdue' ELSE 'recurring' END AS state FROM a")
def novelty(t):
    e = events(t)
    return recurrence.novelty(e, "user_id", "t", e.agg(F.max("t")).first()[0])


@query("WITH c AS (SELECT " + T + " // 86400 AS bin, count(*) AS n FROM events GROUP BY 1) SELECT bin, coalesce(n, 0) AS n FROM (SELECT unnest(range((SELECT min(bin) FROM c), (SELECT max(bin) + 1 FROM c))) AS bin) LEFT JOIN c USING (bin)")
def uniform_bins(t):
    return recurrence.uniform_bins(events(t), "t", 86400)


@query("SELECT event_type, round(-log2(count(*) / (SELECT count(*) FROM events)), 9) AS bits FROM events GROUP BY 1")
def surprise(t):
    e = t("events")
    n = e.count()
    return e.groupBy("event_type").agg(F.count("*").alias("f")).select("event_type", F.round(forecast.surprise_bits(F.col("f"), F.lit(n)), 9).alias("bits"))


@query()
def change_points(t):
    return recurrence.change_points(events(t), "user_id", "t")


# --- statistics -----------------------------------------------------------------------------------------------------------


@query("SELECT l_returnflag, count(*) AS n, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem GROUP BY 1")
def pearson(t):
    return stats.pearson(t("lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice").select("l_returnflag", "n", F.round("r", 6).alias("r"))


@query("WITH c AS (SELECT l_returnflag, corr(l_quantity, l_extendedprice) AS xy, corr(l_quantity, l_discount) AS xz, corr(l_extendedprice, l_discount) AS yz FROM lineitem GROUP BY 1) SELECT l_returnflag, round((xy - xz * yz) / sqrt((1 - xz ** 2) * (1 - yz ** 2)), 6) AS r FROM c")
def partial_correlation(t):
    return stats.partial_correlation(t("lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice", "l_discount").withColumn("r", F.round("r", 6))


@query("SELECT l_linestatus, round(corr(l_quantity, CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END), 6) AS r FROM lineitem GROUP BY 1")
def point_biserial(t):
    return stats.point_biserial(t("lineitem"), ["l_linestatus"], "l_quantity", F.col("l_returnflag") == "R").withColumn("r", F.round("r", 6))


@query("WITH r AS (SELECT c_mktsegment, rank() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_mktsegment, c_acctbal) - 1) / 2.0 AS a, rank() OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey) + (count(*) OVER (PARTITION BY c_mktsegment, c_nationkey) - 1) / 2.0 AS b FROM customer) SELECT c_mktsegment, round(corr(a::DOUBLE, b::DOUBLE), 6) AS rho FROM r GROUP BY 1")
def spearman(t):
    return stats.spearman(t("customer"), ["c_mktsegment"], "c_acctbal", "c_nationkey").withColumn("rho", F.round("rho", 6))


@query(
    "WITH o AS (SELECT l_returnflag AS a, l_linenumber AS b, count(*) AS o FROM lineitem GROUP BY 1, 2), ra AS (SELECT a, sum(o) AS ra FROM o GROUP BY 1), rb AS (SELECT b, sum(o) AS rb FROM o GROUP BY 1), n AS (SELECT sum(o) AS n FROM o), "
    "t AS (SELECT coalesce(o, 0) AS o, ra * rb / n AS e, n FROM ra CROSS JOIN rb LEFT JOIN o ON o.a = ra.a AND o.b = rb.b, n) SELECT CAST(max(n) AS BIGINT) AS n, round(sum((o - e) ** 2 / e), 5) AS chi2, round(2 * sum(CASE WHEN o > 0 THEN o * ln(o / e) END), 5) AS g FROM t"
)
def chi_square(t):
    return stats.categorical(t("lineitem"), "l_returnflag", "l_linenumber").select("n", F.round("chi2", 5).alias("chi2"), F.round("g", 5).alias("g"))


@query("WITH o AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS c FROM lineitem GROUP BY 1, 2), ha AS (SELECT log2(sum(k)) - sum(k * log2(k)) / sum(k) AS h FROM (SELECT sum(c) AS k FROM o GROUP BY a)), hb AS (SELECT log2(sum(k)) - sum(k * log2(k)) / sum(k) AS h FROM (SELECT sum(c) AS k FROM o GROUP BY b)), hab AS (SELECT log2(sum(c)) - sum(c * log2(c)) / sum(c) AS h FROM o) SELECT round((ha.h - (hab.h - hb.h)) / ha.h, 6) AS u FROM ha, hb, hab")
def theils_u(t):
    return stats.theils_u(t("lineitem"), "l_returnflag", "l_linestatus").select(F.round("u", 6).alias("u"))


@query(
    "WITH m AS (SELECT min(l_quantity) AS x0, max(l_quantity) AS x1, min(l_extendedprice) AS y0, max(l_extendedprice) AS y1 FROM lineitem), c AS (SELECT least(floor((l_quantity - x0) / (x1 - x0) * 8), 7) AS a, least(floor((l_extendedprice - y0) / (y1 - y0) * 8), 7) AS b, count(*) AS c FROM lineitem, m GROUP BY 1, 2), "
    "ha AS (SELECT log2(sum(k)) - sum(k * log2(k)) / sum(k) AS h FROM (SELECT sum(c) AS k FROM c GROUP BY a)), hb AS (SELECT log2(sum(k)) - sum(k * log2(k)) / sum(k) AS h FROM (SELECT sum(c) AS k FROM c GROUP BY b)), hab AS (SELECT log2(sum(c)) - sum(c * log2(c)) / sum(c) AS h FROM c) SELECT round((ha.h + hb.h - hab.h) / sqrt(ha.h * hb.h), 6) AS nmi FROM ha, hb, hab"
)
def histogram_nmi(t):
    return stats.histogram_nmi(t("lineitem"), "l_quantity", "l_extendedprice").select(F.round("nmi", 6).alias("nmi"))


@query("WITH w AS (SELECT user_id, value AS x, lead(value, 1) OVER (PARTITION BY user_id ORDER BY event_id) AS y1, lag(value, 1) OVER (PARTITION BY user_id ORDER BY event_id) AS y2 FROM events) SELECT user_id, CAST(1 AS INT) AS lag, count(y1) AS pairs, round(corr(x, y1), 6) AS r FROM w GROUP BY 1 HAVING count(y1) >= 3 UNION ALL SELECT user_id, -1, count(y2), round(corr(x, y2), 6) FROM w GROUP BY 1 HAVING count(y2) >= 3")
def autocorrelation(t):
    return stats.autocorrelation(t("events"), ["user_id"], "event_id", "value", [1, -1]).withColumn("r", F.round("r", 6))


@query("WITH c AS (SELECT user_id, event_type, count(*) AS c FROM events GROUP BY 1, 2) SELECT user_id, CAST(sum(c) AS BIGINT) AS n, round(sum(c * (c - 1)) / (sum(c) * (sum(c) - 1)), 9) AS agreement, sum(c * (c - 1)) / (sum(c) * (sum(c) - 1)) >= 0.75 AS consistent FROM c GROUP BY 1 HAVING sum(c) >= 3")
def outcome_agreement(t):
    return stats.outcome_agreement(t("events"), ["user_id"], "event_type").withColumn("agreement", F.round("agreement", 9))


# --- graphs ---------------------------------------------------------------------------------------------------------------


def edges(t) -> DataFrame:
    """Nations joined with the next two by key, and each region's ring: a small deterministic graph."""
    n = t("nation").select(F.col("n_nationkey").cast("long").alias("k"))
    return n.select(F.col("k").alias("src"), F.explode(F.array(F.pmod(F.col("k") + 1, F.lit(25)), F.pmod(F.col("k") * 2, F.lit(25)))).alias("dst")).where("src <> dst").withColumn("weight", 1 / (1 + F.pmod(F.col("dst"), F.lit(4))))


EDGES = "e AS (SELECT n_nationkey::BIGINT AS src, (n_nationkey + 1) % 25 AS dst FROM nation UNION ALL SELECT n_nationkey, (n_nationkey * 2) % 25 FROM nation WHERE n_nationkey <> (n_nationkey * 2) % 25)"


@query("WITH RECURSIVE " + EDGES + ", r(node, hop) AS (SELECT 3::BIGINT, 0 UNION SELECT e.dst, r.hop + 1 FROM r JOIN e ON e.src = r.node WHERE r.hop < 4) SELECT node, CAST(min(hop) AS INT) AS hop FROM r GROUP BY node")
def breadth_first(t):
    e = edges(t)
    return graphs.bfs(e, e.sparkSession.createDataFrame([(3,)], "node long"), 4)


@query(
    "WITH " + EDGES + ", x AS (SELECT src, dst, 1.0 / (1 + dst % 4) AS w FROM e), f1 AS (SELECT dst AS node, max(w) AS p FROM x WHERE src = 3 GROUP BY 1), "
    + ", ".join(f"f{h} AS (SELECT dst AS node, max(p * w) AS p FROM f{h - 1} JOIN x ON src = node GROUP BY 1)" for h in (2, 3, 4))
    + ", a AS (" + " UNION ALL ".join(f"SELECT node, {h} AS hop, round(p * power(0.9, {h}), 9) AS score FROM f{h}" for h in (1, 2, 3, 4)) + ") "
    "SELECT node, CAST(arg_min(hop, {'s': -score, 'h': hop}) AS INT) AS hop, max(score) AS score FROM a WHERE node <> 3 GROUP BY 1"
)
def reach_scored(t):
    return graphs.reach_scored(edges(t), 3, 4).withColumn("score", F.round("score", 9))


@query()
def label_propagation(t):
    e = edges(t)
    return graphs.label_propagation(e, e.sparkSession.createDataFrame([(0, 1.0), (13, 0.0)], "node long, value double"), tolerance=0.01)


@query("WITH " + EDGES + " SELECT node, count(*) AS degree FROM (SELECT src AS node FROM e UNION ALL SELECT dst FROM e) GROUP BY 1")
def degrees(t):
    return graphs.degree_scores(edges(t))


# --- decisions ------------------------------------------------------------------------------------------------------------


@query("SELECT c_custkey, CAST((CASE WHEN c_acctbal / 10000 >= 0.5 THEN 1 ELSE 0 END) + (CASE WHEN c_nationkey / 25.0 >= 0.4 THEN 1 ELSE 0 END) AS BIGINT) AS passed, c_acctbal / 10000 >= 0.5 AND c_nationkey / 25.0 >= 0.4 AS verdict FROM customer")
def guard(t):
    c = t("customer")
    s = c.select("c_custkey", F.explode(F.array(F.struct(F.lit("a").alias("slot"), (F.col("c_acctbal") / 10000).alias("cos")), F.struct(F.lit("b").alias("slot"), (F.col("c_nationkey") / 25.0).cast("double").alias("cos")))).alias("x")).select("c_custkey", "x.*")
    return decide.guard(s, "c_custkey", {"a": 0.5, "b": 0.4})


@query("WITH c AS (SELECT user_id, event_type, count(*) AS c FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY c DESC, event_type) AS r, sum(c) OVER (PARTITION BY user_id) AS n FROM c) SELECT user_id, CAST(max(n) AS BIGINT) AS n, max(CASE WHEN r = 1 THEN event_type END) AS outcome, round(max(CASE WHEN r = 1 THEN c END) / max(n) * ((max(CASE WHEN r = 1 THEN c END) - coalesce(max(CASE WHEN r = 2 THEN c END), 0)) / max(n)) * (max(n) / (max(n) + 2)), 9) AS confidence FROM r GROUP BY 1")
def predict_outcome(t):
    return decide.predict_outcome(t("events"), ["user_id"], "event_type").withColumn("confidence", F.round("confidence", 9))


@query("WITH d AS (SELECT l_returnflag, l_discount * 10 AS p, 0.5 AS m, CASE WHEN l_linestatus = 'F' THEN 1.0 ELSE 0.0 END AS y FROM lineitem) SELECT l_returnflag, count(*) AS n, round(avg((p - y) ** 2), 6) AS brier, round(avg((m - y) ** 2), 6)::DOUBLE AS brier_market, round(regr_slope(y, p), 6) AS slope FROM d GROUP BY 1")
def backtest(t):
    b = decide.backtest(t("lineitem"), ["l_returnflag"], F.col("l_discount") * 10, F.lit(0.5), (F.col("l_linestatus") == "F").cast("int"))
    return b.select("l_returnflag", "n", F.round("brier", 6).alias("brier"), F.round("brier_market", 6).alias("brier_market"), F.round("slope", 6).alias("slope"))


@query("SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS keeper FROM documents")
def exact_duplicates(t):
    return decide.exact_duplicates(t("documents"), "doc_id", F.col("text"))


LEDGER = ["event_type", "value"]


@query("SELECT event_type, count(*) AS trials, CAST(sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) AS BIGINT) AS wins, round(avg(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END), 9) AS rate, round((sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) + 1) / (count(*) + 2), 9) AS posterior FROM events GROUP BY 1")
def bandit_arms(t):
    return decide.arms(t("events"), "event_type", F.col("value") > 50).withColumns({"rate": F.round("rate", 9), "posterior": F.round("posterior", 9)})


@query(
    "WITH w AS (SELECT l_suppkey, l_quantity AS v, CASE WHEN l_returnflag <> 'R' THEN 1 ELSE -1 END AS s, sum(l_quantity) OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber ROWS UNBOUNDED PRECEDING) AS hi, sum(l_quantity) OVER (PARTITION BY l_suppkey) AS a FROM lineitem), "
    "p AS (SELECT *, least(hi, (b + 1) * a / 3) - greatest(hi - v, b * a / 3) AS part FROM w, range(3) r(b)), i AS (SELECT l_suppkey, b, abs(sum(part * s)) AS i, max(a) AS a FROM p WHERE part > 0 GROUP BY 1, 2) SELECT l_suppkey, round(sum(i) / max(a), 6) AS vpin FROM i GROUP BY 1"
)
def volume_buckets(t):
    return decide.volume_buckets(t("lineitem"), "l_suppkey", ["l_shipdate", "l_orderkey", "l_linenumber"], "l_quantity", F.col("l_returnflag") != "R").withColumn("vpin", F.round("vpin", 6))


@query("SELECT o_orderkey, CASE WHEN o_totalprice < 3600 THEN 'lt_1h' WHEN o_totalprice < 86400 THEN '1h_24h' WHEN o_totalprice <= 604800 THEN '1d_7d' ELSE 'gt_7d' END AS horizon FROM orders")
def horizon(t):
    return t("orders").select("o_orderkey", forecast.horizon_bucket(F.col("o_totalprice")).alias("horizon"))


# --- weave, encoders, markets, tuning, estimators ---------------------------------------------------------------------------

HALVES = f"(SELECT vec_id, e[1:len(e) // 3] AS s0, e[len(e) // 3 + 1:2 * (len(e) // 3)] AS s1, e[2 * (len(e) // 3) + 1:3 * (len(e) // 3)] AS s2 FROM {EMB})"
PAIRS = "p AS (SELECT vec_id, 's0' AS a, 's1' AS b, " + COS.format("s0", "s1") + f" AS agreement FROM {HALVES} UNION ALL SELECT vec_id, 's0', 's2', " + COS.format("s0", "s2") + f" FROM {HALVES} UNION ALL SELECT vec_id, 's1', 's2', " + COS.format("s1", "s2") + f" FROM {HALVES})"


def slots(t) -> DataFrame:
    """Three slots an item: the thirds of its embedding."""
    third = F.floor(F.size("embedding") / 3).cast("int")
    parts = [F.struct(F.lit(f"s{i}").alias("slot"), F.slice("embedding", F.lit(i) * third + 1, third).alias("vec")) for i in range(3)]
    return t("embeddings").select("vec_id", F.explode(F.array(*parts)).alias("x")).select("vec_id", "x.*")


@query("WITH " + PAIRS + " SELECT a, b, count(*) AS n, round(avg(agreement), 6) AS mean, round(greatest(0, least(1, avg(agreement))), 6) AS weight FROM p GROUP BY a, b")
def agreement_graph(t):
    return weave.agreement_graph(weave.slot_pairs(slots(t), "vec_id")).withColumns({"mean": F.round("mean", 6), "weight": F.round("weight", 6)})


@query("WITH " + PAIRS + " SELECT vec_id, round(min(agreement), 6) AS agree, round(max(agreement) - min(agreement), 6) AS disagree, count(*) AS pairs FROM p GROUP BY vec_id")
def item_agreement(t):
    return weave.item_agreement(weave.slot_pairs(slots(t), "vec_id"), "vec_id").withColumns({"agree": F.round("agree", 6), "disagree": F.round("disagree", 6)})


@query("WITH n AS (SELECT count(*) AS n FROM customer WHERE c_mktsegment <> 'BUILDING'), s AS (SELECT DISTINCT c_acctbal AS tau FROM customer) SELECT min(tau) AS tau FROM s, n WHERE (SELECT count(*) FROM customer WHERE c_mktsegment <> 'BUILDING' AND c_acctbal >= tau) / n.n <= 0.1")
def calibrate_tau(t):
    c = t("customer").select(F.col("c_acctbal").alias("score"), (F.col("c_mktsegment") != "BUILDING").alias("bad"))
    return weave.calibrate_tau(c, 0.1).select("tau")


@query("SELECT doc_id, length(text) - length(regexp_replace(text, '[a-z]', '', 'g')) AS lower, length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS upper, length(text) - length(regexp_replace(text, '[0-9]', '', 'g')) AS digit FROM documents")
def byte_features(t):
    v = encode.byte_features(F.col("text"))
    d = t("documents").select("doc_id", "text", v.alias("v"))
    share = lambda i: F.round(F.get("v", F.lit(i)) * F.length("text")).cast("long")
    return d.select("doc_id", share(0).alias("lower"), share(1).alias("upper"), share(2).alias("digit"))


@query("WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS w FROM documents) SELECT doc_id, CAST(count(*) AS INT) AS words, round(avg(length(w)), 6) AS word_length, round(count(DISTINCT w) / count(*), 6) AS distinct_share FROM w GROUP BY 1")
def stylometry(t):
    d = t("documents").select("doc_id", encode.stylometry(F.col("text")).alias("s")).where("s.words > 0")
    return d.select("doc_id", "s.words", F.round("s.word_length", 6).alias("word_length"), F.round("s.distinct", 6).alias("distinct_share"))


@query("SELECT doc_id, ('0x' || substr(md5(term), 1, 12))::BIGINT % 1024 AS idx, count(*)::DOUBLE AS val FROM (" + TERMS + ") GROUP BY 1, 2")
def hashed_terms(t):
    return encode.hashed_terms(t("documents"), "doc_id", search.terms(F.col("text")), 1024)


@query("SELECT l_suppkey, round(sum(l_quantity), 2) AS volume, round(sum(CASE WHEN l_returnflag <> 'R' THEN l_quantity ELSE -l_quantity END) / sum(l_quantity), 9) AS imbalance FROM lineitem GROUP BY 1")
def order_flow_imbalance(t):
    got = markets.order_flow_imbalance(t("lineitem"), ["l_suppkey"], "l_quantity", F.col("l_returnflag") != "R")
    return got.withColumns({"volume": F.round("volume", 2), "imbalance": F.round("imbalance", 9)})


@query("WITH x AS (SELECT l_suppkey, greatest(1e-6, least(1 - 1e-6, l_discount * 10)) AS p, l_tax AS r FROM lineitem WHERE l_tax > 0) SELECT l_suppkey, round(1 / (1 + exp(-(sum(r * ln(p / (1 - p))) / sum(r)))), 6) AS p, count(*) AS components FROM x GROUP BY 1")
def blend(t):
    got = markets.blend(t("lineitem").withColumn("p", F.col("l_discount") * 10), ["l_suppkey"], "p", "l_tax")
    return got.withColumn("p", F.round("p", 6))


@query("WITH e AS (SELECT l_suppkey, max(l_quantity) AS v FROM lineitem GROUP BY l_suppkey, l_partkey), d AS (SELECT l_suppkey, sum(v) AS dv FROM e GROUP BY 1), a AS (SELECT l_suppkey, sum(l_quantity) AS volume FROM lineitem GROUP BY 1) SELECT l_suppkey, round(dv / volume, 9) AS share FROM a JOIN d USING (l_suppkey)")
def wash_screen(t):
    return markets.wash_screen(t("lineitem"), ["l_suppkey"], "l_partkey", "l_quantity").select("l_suppkey", F.round("share", 9).alias("share"))


@query("WITH d AS (SELECT DISTINCT l_orderkey AS i, l_partkey AS e FROM lineitem) SELECT x.i AS a, y.i AS b, count(*) AS shared FROM d x JOIN d y ON x.e = y.e AND x.i < y.i GROUP BY 1, 2 HAVING count(*) > 1")
def shared_entity_edges(t):
    return markets.shared_entity_edges(t("lineitem"), "l_orderkey", "l_partkey").where("shared > 1")


@query("SELECT l_partkey, count(*) AS k, round(avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END), 9) AS p, round(avg(greatest(0, least(1, l_discount * 10))) * least(count(*) / 20, 1), 9) AS reliability FROM lineitem GROUP BY 1")
def knn_base_rate(t):
    got = markets.knn_base_rate(t("lineitem").withColumn("s", F.col("l_discount") * 10), ["l_partkey"], "s", F.col("l_returnflag") == "R")
    return got.withColumns({"p": F.round("p", 9), "reliability": F.round("reliability", 9)})


@query("SELECT o_orderkey, CASE WHEN NOT (abs(m - p) > 0.05 AND r >= 0.3) THEN 'aligned' WHEN m > p THEN 'overpriced' ELSE 'underpriced' END AS direction FROM (SELECT o_orderkey, (o_orderkey % 100) / 100.0::DOUBLE AS m, (o_custkey % 100) / 100.0::DOUBLE AS p, (o_orderkey % 7) / 7.0::DOUBLE AS r FROM orders)")
def mispricing(t):
    return t("orders").select("o_orderkey", markets.mispricing((F.col("o_custkey") % 100) / 100.0, (F.col("o_orderkey") % 100) / 100.0, (F.col("o_orderkey") % 7) / 7.0).alias("direction"))


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1")
def compare_arms(t):
    return tuning.compare_arms(t("events"), "event_type", "value").withColumns({c: F.round(c, 6) for c in ("mean", "p50", "p99")})


@query("SELECT event_type, count(*) AS n, round((w + 1) / (n + 2), 9) AS mean FROM (SELECT event_type, value, sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) OVER (PARTITION BY event_type) AS w, count(*) OVER (PARTITION BY event_type) AS n FROM events) GROUP BY event_type, w, n")
def beta_posterior(t):
    return tuning.beta_posterior(t("events"), ["event_type"], F.col("value") > 50).select("event_type", "n", F.round("mean", 9).alias("mean"))


@query("SELECT user_id, time_bucket(INTERVAL 1 DAY, ts) AS start, round(sum(value), 4) AS used FROM events GROUP BY 1, 2 HAVING sum(value) > 100")
def quota(t):
    return tuning.quota(t("events"), "user_id", "ts", "value", "1 day", 100.0).withColumn("used", F.round("used", 4))


@query("SELECT coalesce(a.c_custkey, b.c_custkey) AS c_custkey, CASE WHEN a.c_custkey IS NULL THEN 'added' WHEN b.c_custkey IS NULL THEN 'removed' ELSE 'changed' END AS change FROM (SELECT * FROM customer WHERE c_custkey % 7 <> 0) a FULL JOIN (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN -1 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_custkey % 3 <> 0) b ON a.c_custkey = b.c_custkey WHERE a.c_custkey IS NULL OR b.c_custkey IS NULL OR a.c_acctbal IS DISTINCT FROM b.c_acctbal")
def table_difference(t):
    c = t("customer")
    b = c.where("c_custkey % 3 <> 0").withColumn("c_acctbal", F.when(F.col("c_custkey") % 5 == 0, -1.0).otherwise(F.col("c_acctbal")))
    return tuning.table_difference(c.where("c_custkey % 7 <> 0"), b, "c_custkey", ["c_acctbal"])


@query("SELECT 1.0::DOUBLE * round(sum(CASE WHEN a = b THEN v END) ** 2 / sum(v * v), 6) AS n_eff FROM (SELECT n_regionkey AS a, c_nationkey % 5 AS b, count(*)::DOUBLE AS v FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)")
def stable_rank(t):
    j = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_regionkey").alias("a"), (F.col("c_nationkey") % 5).alias("b")).agg(F.count("*").cast("double").alias("v"))
    return tuning.stable_rank(j, "a", "b", "v").select(F.round("n_eff", 6).alias("n_eff"))


@query(
    "WITH g AS (SELECT o_custkey, min(o_orderstatus) AS c FROM orders GROUP BY 1), s AS (SELECT o_custkey, row_number() OVER (PARTITION BY c ORDER BY ('0x' || substr(md5(o_custkey || '|7'), 1, 12))::BIGINT, o_custkey) AS r, count(*) OVER (PARTITION BY c) AS n FROM g) "
    "SELECT o_orderkey, o_custkey, o_orderstatus, n >= 2 AND r <= greatest(1, floor(n * 0.2)) AS held_out FROM orders JOIN s USING (o_custkey)"
)
def group_holdout(t):
    return tuning.group_holdout(t("orders").select("o_orderkey", "o_custkey", "o_orderstatus"), "o_custkey", "o_orderstatus", 0.2, 7)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 0 ORDER BY -ln((('0x' || substr(md5(o_orderkey || '|7'), 1, 12))::BIGINT + 1) / 281474976710657.0::DOUBLE) / o_totalprice, o_orderkey LIMIT 100")
def replay(t):
    return tuning.replay(t("orders").select("o_orderkey", "o_totalprice"), "o_orderkey", "o_totalprice", 100, 7)


@query()
def pairwise_estimators(t):
    return estimators.estimate(t("customer"), "c_nationkey", "c_acctbal", "c_custkey", ["distance_correlation", "hsic", "ksg", "mmd"])


@query("SELECT event_type, count(*) AS n FROM events WHERE " + T + " >= (SELECT min(" + T + ") FROM events) + 86400 AND " + T + " < (SELECT min(" + T + ") FROM events) + 3 * 86400 GROUP BY 1")
def window_count(t):
    e = events(t)
    lo = e.agg(F.min("t")).first()[0]
    return recurrence.in_window(e, "t", lo + 86400, lo + 3 * 86400).groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT event_id FROM events WHERE " + T + " > (SELECT max(" + T + ") FROM events) - 7200")
def last_hours(t):
    e = events(t)
    return recurrence.last_seconds(e, "t", e.agg(F.max("t")).first()[0], 7200).select("event_id")


@query("SELECT event_id, round(1 - (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) / count(*) OVER (PARTITION BY user_id), 9) AS score FROM events")
def sequence_score(t):
    return recurrence.sequence_score(t("events"), ["user_id"], ["event_id"]).select("event_id", F.round("score", 9).alias("score"))


@query("WITH g AS (SELECT user_id, (" + T + " - lag(" + T + ") OVER (PARTITION BY user_id ORDER BY " + T + "))::DOUBLE AS gap FROM events) SELECT user_id, count(*) AS n, round(avg(gap) ** 2 / var_pop(gap), 6) AS shape, round(var_pop(gap) / avg(gap), 3) AS scale FROM g WHERE gap > 0 GROUP BY 1 HAVING count(*) >= 2")
def hazard(t):
    return recurrence.hazard(events(t), "user_id", "t").withColumns({"shape": F.round("shape", 6), "scale": F.round("scale", 3)})


@query(
    "WITH e AS (SELECT user_id, event_type, " + T + " AS t FROM events), a AS (SELECT * FROM e WHERE event_type = (SELECT min(event_type) FROM events)), b AS (SELECT * FROM e WHERE event_type = (SELECT max(event_type) FROM events)) "
    "SELECT a.user_id, count(*) AS pairs, quantile_cont(b.t - a.t, 0.5)::DOUBLE AS lag FROM a JOIN b ON a.user_id = b.user_id AND abs(a.t - b.t) < 86400 GROUP BY 1 HAVING count(*) >= 3"
)
def lead_lag(t):
    e = events(t)
    lo, hi = e.agg(F.min("event_type"), F.max("event_type")).first()
    return recurrence.lead_lag(e.where(F.col("event_type") == lo), e.where(F.col("event_type") == hi), ["user_id"], "t", "t", 86400)


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def erased(t):
    gone = t("customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return relational.erase(t("orders").select("o_orderkey", "o_custkey"), gone, "o_custkey").select("o_orderkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 1000)")
def consented(t):
    tags = t("orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("purpose"), F.col("o_totalprice").alias("expires_at"))
    return relational.consented(t("customer").select("c_custkey"), tags, "c_custkey", "1-URGENT", 1000)


@query("SELECT event_id, json_extract_string(props, '$.k') AS value FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def document_subtree(t):
    return relational.subtree(t("events"), "event_id", "props", ["k"])


@query("SELECT event_id FROM events WHERE json_extract_string(props, '$.k') = '69'")
def document_path(t):
    return t("events").where(relational.path_equals(F.col("props"), ["k"], 69)).select("event_id")


@query(
    "WITH d AS (SELECT l_returnflag AS g, l_linenumber AS x, CAST(l_quantity AS INT) AS y, count(*) AS c FROM lineitem GROUP BY 1, 2, 3), s AS (SELECT a.g, sum(sign(b.x - a.x) * sign(b.y - a.y) * a.c * b.c) / 2 AS s FROM d a JOIN d b ON a.g = b.g GROUP BY 1), "
    "n AS (SELECT g, sum(c) AS n FROM d GROUP BY 1), tx AS (SELECT g, sum(k * (k - 1) / 2) AS t FROM (SELECT g, x, sum(c) AS k FROM d GROUP BY 1, 2) GROUP BY 1), ty AS (SELECT g, sum(k * (k - 1) / 2) AS t FROM (SELECT g, y, sum(c) AS k FROM d GROUP BY 1, 2) GROUP BY 1) "
    "SELECT s.g AS l_returnflag, CAST(n AS BIGINT) AS n, round(s / sqrt((n * (n - 1) / 2 - tx.t) * (n * (n - 1) / 2 - ty.t)), 6) AS tau FROM s JOIN n USING (g) JOIN tx USING (g) JOIN ty USING (g)"
)
def kendall(t):
    l = t("lineitem").select("l_returnflag", "l_linenumber", F.col("l_quantity").cast("int").alias("q"))
    return stats.kendall(l, ["l_returnflag"], "l_linenumber", "q").withColumn("tau", F.round("tau", 6))


@query("SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem UNION ALL SELECT 'l_quantity', 'l_discount', round(corr(l_quantity, l_discount), 6) FROM lineitem UNION ALL SELECT 'l_extendedprice', 'l_discount', round(corr(l_extendedprice, l_discount), 6) FROM lineitem")
def correlation_matrix(t):
    return stats.covariance_matrix(t("lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]).withColumn("r", F.round("r", 6))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["rank_fusion"](spark, sf_dir)
