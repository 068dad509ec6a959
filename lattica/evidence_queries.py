"""Registered queries of hypotheses, panels, watches, duplicates, series dependence and further graph measures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions import temporal
from lattica.more_queries import TRADES, trades
from lattica.operators import decide, dynamics, encode, graphs, hypotheses
from lattica.queries import LEDGER, query

SECONDS = "CAST(floor(epoch(ts)) AS BIGINT)"


# --- hypotheses -------------------------------------------------------------------------------------------------------


@query(
    "WITH h AS (SELECT p_partkey AS id, p_size / 50::DOUBLE AS novelty, (p_partkey % 11) / 10::DOUBLE AS grounding, p_partkey % 5 + 1 AS distance, (p_partkey % 7) / 6::DOUBLE AS plausibility FROM part), "
    "s AS (SELECT *, novelty * 0.25::DOUBLE + grounding * 0.3::DOUBLE + distance / (SELECT greatest(max(distance), 1) FROM h)::DOUBLE * 0.2::DOUBLE + plausibility * 0.25::DOUBLE AS score FROM h) "
    "SELECT id, CAST(row_number() OVER (ORDER BY score DESC, grounding DESC, distance DESC, id) AS INT) AS rank, round(score, 9) AS rank_score, rank <= 10 AND score >= 0.5 AS review FROM s QUALIFY rank <= 100"
)
def rank_hypotheses(t):
    p = F.col("p_partkey")
    h = t("part").select(p.alias("id"), (F.col("p_size") / 50.0).alias("novelty"), ((p % 11) / 10.0).alias("grounding"), (p % 5 + 1).alias("distance"), ((p % 7) / 6.0).alias("plausibility"))
    return hypotheses.rank_hypotheses(h, "id", 100).select("id", F.col("rank").cast("int").alias("rank"), F.round("rank_score", 9).alias("rank_score"), "review")


@query(
    "WITH s AS (SELECT l_orderkey, count(*) AS runs, round(avg(l_discount * 10) * 0.35::DOUBLE + avg(l_tax * 10) * 0.25::DOUBLE + avg(l_quantity / 50) * 0.25::DOUBLE + avg(l_linenumber / 7) * 0.15::DOUBLE, 12) AS score, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1) "
    "SELECT l_orderkey, runs, round(score, 9) AS score, CASE WHEN n < 2 THEN 'more_evidence' WHEN score >= 0.6 THEN 'retain' ELSE 'reject' END AS verdict FROM s"
)
def evaluate_hypotheses(t):
    d = t("lineitem")
    runs = d.select("l_orderkey", (F.col("l_discount") * 10).alias("plausible"), (F.col("l_tax") * 10).alias("novelty"), (F.col("l_quantity") / 50).alias("testability"), (F.col("l_linenumber") / 7).alias("falsifiability"))
    got = hypotheses.evaluate_hypotheses(runs, d.select("l_orderkey", F.col("l_suppkey").alias("evidence")), "l_orderkey")
    return got.withColumn("score", F.round("score", 9))


@query(
    "WITH s AS (SELECT l_orderkey AS k, sum(CASE WHEN l_returnflag <> 'R' THEN l_quantity ELSE 0 END) AS pro, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS con FROM lineitem WHERE l_linenumber > 1 GROUP BY 1) "
    "SELECT o_orderkey, coalesce(pro, 0)::DOUBLE AS pro, coalesce(con, 0)::DOUBLE AS con, CASE WHEN coalesce(con, 0) > coalesce(pro, 0) THEN 'refuted' WHEN con > 0 THEN 'contested' WHEN pro > 0 THEN 'supported' ELSE 'unsupported' END AS flag FROM orders LEFT JOIN s ON k = o_orderkey"
)
def refuted(t):
    evidence = t("lineitem").where("l_linenumber > 1").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_quantity").alias("weight"), (F.col("l_returnflag") != "R").alias("supports"))
    return hypotheses.refuted(t("orders").select("o_orderkey"), evidence, "o_orderkey")


@query("SELECT o_orderkey, CASE WHEN o_totalprice < 150000 THEN 'rest' WHEN o_orderstatus = 'F' THEN 'proof' ELSE 'lead' END AS part FROM orders")
def novelty_split(t):
    return hypotheses.novelty_split(t("orders"), F.col("o_orderstatus") == "F", F.col("o_totalprice"), 150000.0).select("o_orderkey", "part")


@query("SELECT l_suppkey, count(*) AS n, round(avg(CASE WHEN l_returnflag = 'N' THEN 1.0 ELSE 0.0 END), 9) AS precision, count(*) >= 500 AND avg(CASE WHEN l_returnflag = 'N' THEN 1.0 ELSE 0.0 END) >= 0.3331 AS passed FROM lineitem GROUP BY 1")
def validation_gates(t):
    return hypotheses.validation_gates(t("lineitem"), ["l_suppkey"], F.col("l_returnflag") == "N", 500, 0.3331).withColumn("precision", F.round("precision", 9))


# --- panels and watches -----------------------------------------------------------------------------------------------


@query(
    "WITH RECURSIVE c AS (SELECT p_brand AS lens, avg(p_size) / 50 AS bits, count(*)::DOUBLE AS ram, CASE WHEN p_brand LIKE '%1' THEN 0.7 ELSE 0.5 END AS corr FROM part GROUP BY 1), b AS (SELECT count(*) * 0.4::DOUBLE AS ram FROM part), "
    "o AS (SELECT c.*, row_number() OVER (ORDER BY bits / (c.ram / b.ram) DESC, bits DESC, lens) AS i FROM c, b WHERE bits >= 0.05 AND corr <= 0.6 AND c.ram <= b.ram), "
    "w(i, used, lens, kept) AS (SELECT 0::BIGINT, 0::DOUBLE, NULL::VARCHAR, false UNION ALL SELECT o.i, CASE WHEN used + o.ram <= b.ram THEN used + o.ram ELSE used END, o.lens, used + o.ram <= b.ram FROM w JOIN o ON o.i = w.i + 1, b) "
    "SELECT c.lens, coalesce(kept, false) AS admitted, CASE WHEN kept THEN NULL WHEN corr > 0.6 OR bits < 0.05 THEN 'inadmissible' WHEN kept IS NULL THEN 'over budget' ELSE 'budget used up' END AS reason FROM c LEFT JOIN w ON w.lens = c.lens"
)
def pack_panel(t):
    p = t("part")
    lenses = p.groupBy(F.col("p_brand").alias("lens")).agg((F.avg("p_size") / 50).alias("bits"), F.count("*").cast("double").alias("ram")).withColumn("correlation", F.when(F.col("lens").endswith("1"), 0.7).otherwise(0.5))
    return hypotheses.pack_panel(lenses, {"ram": p.count() * 0.4})


@query(
    "WITH s AS (SELECT l_orderkey, l_suppkey AS slot, max(l_quantity) / 50 AS bits, sum(CASE WHEN l_returnflag <> 'R' THEN 1 ELSE 0 END) / count(*) AS coverage FROM lineitem GROUP BY 1, 2) "
    "SELECT l_orderkey, slot, bits >= 0.8 AND coverage > 0 AND sum(CASE WHEN bits >= 0.8 AND coverage > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey) = 1 AS sole FROM s"
)
def sole_carriers(t):
    s = t("lineitem").groupBy("l_orderkey", F.col("l_suppkey").alias("slot")).agg((F.max("l_quantity") / 50).alias("bits"), F.avg((F.col("l_returnflag") != "R").cast("double")).alias("coverage"))
    return hypotheses.sole_carriers(s, ["l_orderkey"], 0.8).select("l_orderkey", "slot", "sole")


@query(
    "WITH c AS (SELECT o_orderpriority AS k, o_orderstatus, count(*) AS c FROM orders GROUP BY 1, 2), b AS (SELECT k, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS bits FROM c GROUP BY 1), d AS (SELECT o_orderpriority AS k, year(o_orderdate) AS y, count(*) AS c FROM orders GROUP BY 1, 2), "
    "h AS (SELECT k, sum(c) AS n, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS entropy FROM d GROUP BY 1) SELECT k AS o_orderpriority, n::BIGINT AS n, round(bits, 9) AS bits, round(entropy, 9) AS entropy, bits >= entropy AS sufficient, round(greatest(entropy - bits, 0), 9) AS deficit FROM b JOIN h USING (k)"
)
def sufficiency(t):
    o = t("orders").withColumn("year", F.year("o_orderdate"))
    bits = hypotheses.entropy_bits(o, ["o_orderpriority"], "o_orderstatus").select("o_orderpriority", F.col("entropy").alias("bits"))
    both = hypotheses.entropy_bits(o, ["o_orderpriority"], "year").join(bits, "o_orderpriority").withColumn("s", hypotheses.sufficiency(F.col("bits"), F.col("entropy")))
    return both.select("o_orderpriority", "n", F.round("bits", 9).alias("bits"), F.round("entropy", 9).alias("entropy"), "s.sufficient", F.round("s.deficit", 9).alias("deficit"))


@query("SELECT l_suppkey AS slot, max(l_discount) AS bits FROM lineitem WHERE l_linestatus = 'F' AND l_discount >= 0.05 GROUP BY 1")
def required_slots(t):
    return hypotheses.required_slots(t("lineitem").select(F.col("l_suppkey").alias("slot"), F.col("l_discount").alias("bits"), (F.col("l_linestatus") == "F").alias("observed")), 0.05)


@query(
    "WITH v AS (SELECT l_suppkey AS slot, l_returnflag = 'N' AS pass, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_partkey DESC) AS r FROM lineitem), q AS (SELECT slot, avg(CASE WHEN pass THEN 0.0 ELSE 1.0 END) AS rate FROM v WHERE r <= 50 GROUP BY 1) "
    "SELECT slot, round(rate, 9) AS rate, CASE WHEN slot % 3 > 0 THEN 0.4123 + slot % 7 * 0.01 END::DOUBLE AS far, coalesce(rate > (0.4123 + slot % 7 * 0.01)::DOUBLE * 1.5 AND slot % 3 > 0, false) AS drift FROM q"
)
def guard_drift(t):
    v = t("lineitem").withColumnRenamed("l_suppkey", "slot")
    far = t("supplier").select(F.col("s_suppkey").alias("slot")).where("slot % 3 > 0").withColumn("far", 0.4123 + F.col("slot") % 7 * 0.01)
    got = hypotheses.guard_drift(v, "slot", ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"], F.col("l_returnflag") == "N", far, 50)
    return got.withColumns({"rate": F.round("rate", 9), "far": F.round("far", 9)})


@query(
    "WITH m AS (SELECT user_id, event_id, CASE WHEN value > 0.8 * v THEN true WHEN value <= 0.5 * v THEN false END AS mark FROM (SELECT *, max(value) OVER () AS v FROM events WHERE value IS NOT NULL)) "
    "SELECT user_id, event_id, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), false) AS crossed FROM m"
)
def tripwires(t):
    e = t("events").where("value is not null")
    top = e.agg(F.max("value")).first()[0]
    return hypotheses.tripwires(e, "user_id", ["event_id"], "value", F.lit(0.8 * top), F.lit(0.8 * top - 0.5 * top), F.lit(True)).select("user_id", "event_id", "crossed")


@query(
    f"WITH s AS (SELECT user_id, count(*) AS n, max({SECONDS}) AS last, CASE WHEN count(*) > 2 THEN (max({SECONDS}) - min({SECONDS})) / (count(*) - 1) END AS c FROM events GROUP BY 1) "
    "SELECT user_id, round(least(1, ln(least(n, 10000) + 1.0::DOUBLE) / ln(10001.0::DOUBLE)), 9) AS importance, CAST(last + ceil(c) AS BIGINT) AS next, CASE WHEN c IS NULL THEN 'once' WHEN c < 3600 THEN 'hot' WHEN c < 86400 THEN 'warm' ELSE 'cold' END AS priority, CASE WHEN c < 3600 THEN 'memory' WHEN c < 86400 THEN 'table' ELSE 'archive' END AS tier FROM s"
)
def recurrence_schedule(t):
    e = t("events").select("user_id", temporal.seconds(F.col("ts")).alias("t"))
    s = e.groupBy("user_id").agg(F.count("*").alias("n"), F.max("t").alias("last"), F.when(F.count("*") > 2, (F.max("t") - F.min("t")) / (F.count("*") - 1)).alias("c"))
    return s.select("user_id", hypotheses.schedule(F.col("n"), F.col("c"), F.col("last")).alias("s")).select("user_id", F.round("s.importance", 9).alias("importance"), "s.next", "s.priority", "s.tier")


@query(
    "WITH g AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity / 50 AS train, CASE WHEN l_linenumber > 1 THEN l_discount * 5 END AS held, l_tax * 12.5 AS region, l_extendedprice / 100000 AS lens FROM lineitem), "
    "v AS (SELECT *, coalesce(held <= train * 0.5, false) AS a, region < 0.9 AS b, abs(lens / train) > 0.8 AS c FROM g) "
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, concat_ws(',', CASE WHEN a THEN 'held_out' END, CASE WHEN b THEN 'region' END, CASE WHEN c THEN 'lens' END) AS violations, round(CASE WHEN a OR b OR c THEN train ELSE 0 END, 9) AS penalty FROM v"
)
def goodhart(t):
    d = t("lineitem")
    g = hypotheses.goodhart(F.col("l_quantity") / 50, F.when(F.col("l_linenumber") > 1, F.col("l_discount") * 5), F.col("l_tax") * 12.5, F.col("l_extendedprice") / 100000)
    return d.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", g.alias("g")).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.concat_ws(",", "g.violations").alias("violations"), F.round("g.penalty", 9).alias("penalty"))


NAMES = [*hypotheses.DENSITY, "unknown"]
DENSITIES = ", ".join(f"({i}, {a}, {b}, {c}, {e})" for i, (a, b, c, e) in enumerate([*hypotheses.DENSITY.values(), hypotheses.DENSITY["other"]]))


@query(f"SELECT p_partkey, round((0.45 * a + 0.25 * c + 0.2 * b + 0.1 * e)::DOUBLE, 9) AS priority FROM part JOIN (VALUES {DENSITIES}) AS v(i, a, b, c, e) ON i = p_partkey % {len(NAMES)}")
def build_priority(t):
    name = F.get(F.array(*[F.lit(n) for n in NAMES]), (F.col("p_partkey") % len(NAMES)).cast("int"))
    return t("part").select("p_partkey", F.round(hypotheses.build_priority(name), 9).alias("priority"))


# --- duplicates and forecasts -----------------------------------------------------------------------------------------


@query("WITH b AS (SELECT event_id, ts, lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS p FROM events) SELECT event_id, CASE WHEN p IS NULL THEN 'new' WHEN p = ts THEN 'same_time' ELSE 'recurrence' END AS signature FROM b")
def recurrence_signature(t):
    return hypotheses.signatures(t("events"), ["user_id", "event_type"], "ts", "event_id").select("event_id", "signature")


ASSIGNED = (
    "d AS (SELECT d.doc_id, d.text AS x, l.quality AS q FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id), m AS (SELECT x, q, min(doc_id) AS m FROM d GROUP BY 1, 2), f AS (SELECT x, min(m) AS first, count(q) AS n FROM m GROUP BY 1), "
    "a AS (SELECT d.doc_id, CASE WHEN d.x IS NULL THEN d.doc_id WHEN f.n > 1 THEN coalesce(CASE WHEN d.q IS NOT NULL THEN m.m END, f.first) ELSE f.first END AS keeper, d.x IS NOT NULL AND f.n > 1 AS contested FROM d JOIN f ON d.x IS NOT DISTINCT FROM f.x JOIN m ON m.x IS NOT DISTINCT FROM d.x AND m.q IS NOT DISTINCT FROM d.q)"
)


def assigned(t) -> DataFrame:
    docs = t("documents").select("doc_id", "text").join(t("labels").select("doc_id", "quality"), "doc_id", "left")
    return hypotheses.dedup_assign(docs, "doc_id", F.col("text"), F.col("quality"))


@query(f"WITH {ASSIGNED} SELECT * FROM a")
def dedup_assign(t):
    return assigned(t)


@query(f"WITH {ASSIGNED} SELECT keeper, count(*) AS occurrences, min(doc_id * 60) AS first, max(doc_id * 60) AS last FROM a GROUP BY 1")
def dedup_series(t):
    return hypotheses.dedup_series(assigned(t), "doc_id", t("documents").select("doc_id", (F.col("doc_id") * 60).alias("at")), "at")


@query(f"WITH {ASSIGNED} SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN doc_id ELSE keeper END AS keeper FROM a")
def dedup_undo(t):
    return hypotheses.dedup_undo(assigned(t), "doc_id", t("labels")).select("doc_id", "keeper")


@query(
    "WITH p AS (SELECT o_orderkey, o_orderdate + INTERVAL 40 DAY AS resolved_at, o_orderstatus AS outcome, l_shipdate AS \"at\", l_discount AS p, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC, l_discount DESC) AS r FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_shipdate < o_orderdate + INTERVAL 40 DAY) "
    "SELECT o_orderkey, resolved_at, outcome, \"at\", p FROM p WHERE r = 1"
)
def resolve_pending(t):
    made = t("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_shipdate").alias("at"), F.col("l_linenumber").alias("seq"), F.col("l_discount").alias("p"))
    done = t("orders").select("o_orderkey", (F.col("o_orderdate") + F.expr("INTERVAL 40 DAYS")).alias("resolved_at"), F.col("o_orderstatus").alias("outcome"))
    return hypotheses.resolve_pending(made, done, "o_orderkey")


MIX = "(x * ((x + {add}) % 2147483647) + r) % 2147483647"
WEIGHT = " + ".join(f"CASE WHEN x / 2147483647.0::DOUBLE > {c}::DOUBLE THEN 1 ELSE 0 END" for c in hypotheses.POISSON)


@query(
    "WITH a AS (SELECT l_returnflag AS k, l_quantity AS v, r, ((l_orderkey * 8 + l_linenumber) % 2147483647 * 48271 + r * 69621 + 11) % 2147483647 AS x FROM lineitem, range(1, 41) AS g(r)), "
    + ", ".join(f"{n} AS (SELECT k, v, r, {MIX.format(add=add)} AS x FROM {b})" for n, b, add in (("b", "a", 7), ("c", "b", 13), ("d", "c", 29)))
    + f", w AS (SELECT k, v, r, {WEIGHT} AS w FROM d), m AS (SELECT k, r, sum(w * v) / sum(w) AS m, count(*) AS n, avg(v) AS mean FROM w GROUP BY 1, 2), l AS (SELECT k, max(n) AS n, max(mean) AS mean, list(m ORDER BY m) AS l FROM m GROUP BY 1) "
    "SELECT k AS l_returnflag, n, round(mean, 9) AS mean, round(l[2], 9) AS low, round(l[39], 9) AS high FROM l"
)
def bootstrap_mean(t):
    d = t("lineitem").withColumn("key", F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    got = hypotheses.bootstrap_mean(d, ["l_returnflag"], "key", "l_quantity", 40)
    return got.withColumns({c: F.round(c, 9) for c in ("mean", "low", "high")})


# --- graphs -----------------------------------------------------------------------------------------------------------


@query(f"WITH RECURSIVE {TRADES}, r(node, hop) AS (SELECT c_custkey, 0 FROM customer WHERE c_acctbal > 9900 UNION SELECT e.dst, r.hop + 1 FROM r JOIN e ON e.src = r.node WHERE r.hop < 1) SELECT DISTINCT node FROM r")
def scope(t):
    return graphs.scope(trades(t), t("customer").where("c_acctbal > 9900").select(F.col("c_custkey").alias("node")), 1)


@query("SELECT c_custkey AS node, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS frequency FROM customer WHERE c_acctbal > 3000 AND c_mktsegment = 'BUILDING'")
def shared_members(t):
    c = t("customer").withColumnRenamed("c_custkey", "node")
    frequency = t("orders").groupBy(F.col("o_custkey").alias("node")).agg(F.count("*").alias("frequency"))
    return graphs.shared_members(c.where("c_acctbal > 3000"), c.where("c_mktsegment = 'BUILDING'"), frequency)


@query(
    f"WITH {TRADES}, x AS (SELECT dst AS node, max(0.7 * weight) AS p FROM e WHERE src = 1 GROUP BY 1 HAVING max(0.7 * weight) >= 0.05), y AS (SELECT e.dst AS node, max(x.p * 0.7 * e.weight) AS p FROM x JOIN e ON e.src = x.node WHERE x.p * 0.7 >= 0.05 AND e.dst <> 1 AND e.dst NOT IN (SELECT node FROM x) GROUP BY 1 HAVING max(x.p * 0.7 * e.weight) >= 0.05) "
    "SELECT node, CAST(1 AS INT) AS hop, round(p::DOUBLE, 9) AS confidence FROM x UNION ALL SELECT node, 2, round(p::DOUBLE, 9) FROM y"
)
def consequences(t):
    return graphs.consequences(trades(t).withColumnRenamed("weight", "ratio"), 1, 2).withColumn("confidence", F.round("confidence", 9))


def step_sql(k: int) -> str:
    return f"v{k + 1} AS MATERIALIZED (SELECT node, x / sqrt(sum(x * x) OVER ()) AS x FROM (SELECT a.node, a.x + coalesce((SELECT sum(s.w * b.x) FROM s JOIN v{k} b ON b.node = s.src WHERE s.dst = a.node), 0) AS x FROM v{k} a))"


@query(
    f"WITH {TRADES}, s AS MATERIALIZED (SELECT src, dst, sum(weight)::DOUBLE AS w FROM (SELECT src, dst, weight FROM e UNION ALL SELECT dst, src, weight FROM e) GROUP BY 1, 2), v0 AS MATERIALIZED (SELECT DISTINCT src AS node, 1 / sqrt((SELECT count(DISTINCT src) FROM s)::DOUBLE) AS x FROM s), "
    + ", ".join(step_sql(k) for k in range(4)) + " SELECT node, round(x, 9) AS centrality FROM v4"
)
def eigenvector_centrality(t):
    return graphs.eigenvector_centrality(trades(t), 4, None).withColumn("centrality", F.round("centrality", 9))


@query()
def feedback_vertices(t):
    return graphs.feedback_vertices(trades(t))


# --- ledgers, encoders ------------------------------------------------------------------------------------------------


@query("WITH s AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq FROM events) SELECT user_id, seq, CAST(floor((seq - 1) / 5) AS BIGINT) AS checkpoint, event_id FROM s WHERE seq % 5 = 0")
def ledger_checkpoints(t):
    e = t("events").withColumn("seq", F.row_number().over(decide.Window.partitionBy("user_id").orderBy("event_id")).cast("long"))
    return decide.checkpoints(decide.chain(e, "user_id", "seq", LEDGER), "seq", 5).select("user_id", "seq", "checkpoint", "event_id")


@query("SELECT event_id FROM events WHERE event_type IN ('click', 'purchase') AND user_id = 3 AND ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-15'")
def ledger_audit(t):
    return decide.audit(t("events"), {"event_type": ["click", "purchase"], "user_id": [3]}, "ts", "2024-01-01", "2024-01-15").select("event_id")


LINE = "'EventCode ' || (event_id % 300) || ' root ' || (event_id % 21) || ' quad ' || (event_id % 5) || ' Goldstein ' || (event_id % 23 - 11) || '.5 tone -' || (event_id % 150) || CASE WHEN event_id % 2 = 0 THEN ' Actor1 USA' ELSE '' END || CASE WHEN event_id % 3 = 0 THEN ' Actor2 GBR' ELSE '' END || ' | ActionGeo Paris'"


@query(
    f"WITH l AS (SELECT event_id, {LINE} AS s, (event_id % 23 - 11)::VARCHAR || '.5' AS g FROM events) SELECT event_id, round((event_id % 300) / 999, 6) AS code, round((event_id % 21) / 20, 6) AS root, round(greatest(least(g::DOUBLE / 10, 1), -1), 6) AS scale, round(greatest(-(event_id % 150) / 100, -1)::DOUBLE, 6) AS tone, (event_id % 5)::DOUBLE AS kind, "
    "CASE WHEN event_id % 21 >= 13 THEN 1.0 ELSE 0.0 END::DOUBLE AS hostile, CASE WHEN event_id % 2 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS actor1, round(('0x' || substr(sha256(s), 1, 8))::BIGINT / 4294967295::DOUBLE, 6) AS hash FROM l"
)
def event_codes(t):
    v = t("events").select("event_id", encode.event_codes(F.expr(LINE)).alias("v"))
    at = lambda i: F.get("v", F.lit(i))
    kind = sum((at(5 + k) * k for k in (1, 2, 3, 4)), F.lit(0.0))
    return v.select("event_id", F.round(at(1), 6).alias("code"), F.round(at(2), 6).alias("root"), F.round(at(4), 6).alias("scale"), F.round(at(5), 6).alias("tone"), kind.alias("kind"), at(11).alias("hostile"), at(12).alias("actor1"), F.round(at(15), 6).alias("hash"))


# --- dependence of series ---------------------------------------------------------------------------------------------


def daily(t) -> DataFrame:
    """Orders of each priority by day: their number and mean price."""
    day = F.datediff("o_orderdate", F.lit("1992-01-01")).cast("double")
    return t("orders").groupBy(F.col("o_orderpriority").alias("k"), day.alias("day")).agg(F.count("*").cast("double").alias("n"), F.avg("o_totalprice").alias("price"))


@query()
def transfer_entropy(t):
    return dynamics.transfer_entropy(daily(t), "k", "day", "price", "n", [1, 2])


@query()
def convergent_cross_mapping(t):
    return dynamics.convergent_cross_mapping(daily(t), "k", "day", "price", "n", [20, 50])


@query()
def total_correlation(t):
    return dynamics.total_correlation(t("customer").withColumn("key", F.ln(F.col("c_custkey") + 1.0)), "c_mktsegment", ["c_acctbal", "key"])


@query()
def interaction_information(t):
    c = t("customer").withColumns({"key": F.ln(F.col("c_custkey") + 1.0), "nation": F.col("c_nationkey").cast("double")})
    return dynamics.interaction_information(c, "c_mktsegment", "c_acctbal", "key", "nation")


@query()
def hawkes(t):
    kinds = F.ascii("event_type").cast("double")
    return dynamics.hawkes(t("events").select("user_id", kinds.alias("kind"), (temporal.seconds(F.col("ts")) / 3600).alias("t")), "user_id", "kind", "t")


@query()
def maximal_information(t):
    return dynamics.maximal_information_by(t("customer").withColumn("key", F.col("c_custkey").cast("double")), "c_mktsegment", "c_acctbal", "key")


@query(
    "WITH c AS (SELECT count(*) AS n, " + ", ".join(f"corr({a}, {b}) AS r{i}" for i, (a, b) in enumerate([("l_quantity", "l_extendedprice")])) + " FROM lineitem) "
    "SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, abs(atanh(r0)) * sqrt(n - 3) > 2.5758293035489004 AS kept FROM c"
)
def skeleton(t):
    got = dynamics.skeleton(t("lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return got.where("a = 'l_quantity' and b = 'l_extendedprice'").select("a", "b", "kept")
