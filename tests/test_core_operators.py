"""Edge rows and analytic facts of the operators."""

import struct

import pytest
from pyspark.sql import functions as F

from lattica.functions import forecast, temporal, vector
from lattica.operators import aggregates, decide, graphs, recurrence, relational, search, stats
from lattica.plans.search_plan import plan
from lattica.sources import vectors
from lattica.streaming import ingest


def test_predicates(spark):
    df = spark.createDataFrame([(1, 1.0, "ab"), (2, None, None), (3, float("nan"), "b")], "k long, x double, s string")
    keys = lambda *p: sorted(r.k for r in relational.where_all(df, list(p)).collect())
    assert keys(("x", "ne", 1)) == [2, 3]
    assert keys(("x", "ne", "text")) == [1, 2, 3]
    assert keys(("none", "ne", 1)) == []
    assert keys(("s", "contains", "a")) == [1]
    assert keys(("s", "gt", "ab")) == [3]
    with pytest.raises(ValueError):
        relational.where_all(df, [("x", "like", 1)])


def test_olap_fixture(spark):
    df = spark.createDataFrame([(10.0, 0.0), (20.0, 0.0), (30.0, 1.0), (-5.0, 1.0), (15.0, 1.0), (1.0, -0.0)], "v double, g float")
    total = aggregates.olap(df.where("v <> 1"), "v").first()
    assert tuple(total) == (5, 70.0, -5.0, 30.0, 14.0)
    groups = {(r.key, r.minus_zero): r["sum"] for r in aggregates.olap_by(df, "v", "g").collect()}
    assert groups[(1.0, False)] == 40.0
    with pytest.raises(Exception, match="non-finite"):
        aggregates.olap(spark.createDataFrame([(float("nan"),)], "v double"), "v").collect()
    with pytest.raises(Exception, match="too many groups"):
        aggregates.olap_by(df, "v", "g", 1).collect()


def test_mode_ties_and_single(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), ("b", 1), ("b", 2), ("c", 1)], "k string, v int")
    got = {r.k: (r["mode"], round(r.confidence, 3)) for r in aggregates.mode_with_confidence(df, "k", F.col("v")).collect()}
    assert got == {"a": (1, 0.667), "b": (None, 0.5), "c": (None, 0.0)}


def test_periodic_and_decay(spark):
    row = spark.range(1).select(
        temporal.periodic_score(F.lit(1_704_204_000), 14, 1).alias("p"), temporal.recency(F.lit(-5)).alias("future"), temporal.recency(F.lit(3600)).alias("half"), temporal.boosted(F.lit(0.0), F.lit(1.0), F.lit(1.0)).alias("zero")
    ).first()
    assert row.p == 1.0 and row.future == 1.0 and abs(row.half - 0.5) < 1e-3 and row.zero == 0.0


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0], [[1.0, 0.0]], [[1.0, 0.0], [0.0, 1.0]])], "a array<double>, z array<double>, q array<array<double>>, d array<array<double>>")
    r = df.select(vector.cosine(F.col("a"), F.col("z")).alias("c"), vector.cosine(F.col("a"), F.col("z"), None).alias("n"), vector.norm(F.col("a")).alias("norm"), vector.max_sim(F.col("q"), F.col("d")).alias("m"), vector.quantize_int8(F.col("z")).alias("i")).first()
    assert (r.c, r.n, r.norm, r.m, r.i) == (0.0, None, 5.0, 1.0, [0, 0])


def test_band_join_is_strict(spark):
    a = spark.createDataFrame([("s", 100), ("s", 200)], "k string, t long")
    b = spark.createDataFrame([("s", 110), ("s", 109), ("s", 90)], "k string, t long")
    assert sorted((r.ta, r.tb) for r in relational.band_join(a, b, ["k"], "t", "t", 10).collect()) == [(100, 109)]


def test_document_paths(spark):
    df = spark.createDataFrame([(1, '{"p":{"state":"active","n":null}}'), (2, '{"p":{}}'), (3, "no json")], "k int, j string")
    assert [r.k for r in df.where(relational.path_equals(F.col("j"), ["p", "state"], "active")).collect()] == [1]
    assert [r.k for r in df.where(relational.path_equals(F.col("j"), ["p", "n"], exists_only=True)).collect()] == [1]


def test_change_point_and_novelty(spark):
    times = [i * 10 for i in range(15)] + [140 + 60 * i for i in range(1, 10)]
    df = spark.createDataFrame([("a", t) for t in times] + [("b", 5)], "k string, t long")
    got = {r.key: r.alarm for r in recurrence.change_points(df, "k", "t").collect()}
    assert got["a"] is not None and got["a"] >= 14 and got["b"] is None
    assert {r.k: r.state for r in recurrence.novelty(df, "k", "t", 10_000).collect()} == {"a": "overdue", "b": "non_recurring"}


def test_ledger_break(spark):
    df = spark.createDataFrame([("l", i, f"x{i}") for i in range(6)], "l string, seq long, p string")
    good = decide.chain(df, "l", "seq", ["p"])
    bad = good.withColumn("p", F.when(F.col("seq") == 3, "forged").otherwise(F.col("p")))
    assert decide.verify_chain(good, "l", "seq", ["p"]).first().first_break is None
    assert decide.verify_chain(bad, "l", "seq", ["p"]).first().first_break == 3


def test_graph_steps(spark):
    e = spark.createDataFrame([(1, 2, 0.5), (2, 3, 0.5), (1, 3, 0.2)], "src long, dst long, weight double")
    got = {r.node: (r.hop, round(r.score, 4)) for r in graphs.reach_scored(e, 1, 3).collect()}
    assert got == {2: (1, 0.45), 3: (2, 0.2025)}
    seeds = spark.createDataFrame([(1, 1.0)], "node long, value double")
    assert all(v.value > 0.9 for v in graphs.label_propagation(e, seeds, 1e-4).collect())


def test_granger_and_correlation(spark):
    rows = [("g", i, float((i * 7919) % 13), float(((i - 1) * 7919) % 13) + 0.01 * ((i * 31) % 7)) for i in range(1, 60)]
    df = spark.createDataFrame(rows, "g string, i int, x double, y double")
    assert stats.granger_lag1(df, "i", "x", "y", ["g"]).first().f > 100
    r = {x.lag: x.r for x in stats.lagged(df, ["g"], "i", "x", "y", [0, 1]).collect()}
    assert r[1] > 0.99 > abs(r[0])


def test_guard_and_forecast(spark):
    s = spark.createDataFrame([(1, "a", 0.9), (1, "b", 0.1), (2, "a", None), (2, "b", 0.9)], "k int, slot string, cos double")
    assert {r.k: r.passed for r in decide.guard(s, "k", {"a": 0.7, "b": 0.7}).collect()} == {1: 1, 2: 1}
    with pytest.raises(ValueError):
        decide.guard(s, "k", {})
    r = spark.range(1).select(forecast.confidence_ceiling(F.lit(0.9), F.lit(0.8), F.lit(0.5), F.lit(1.0), F.lit(1.0)).alias("c"), forecast.sigmoid(forecast.logit(F.lit(0.3))).alias("p")).first()
    assert r.c.binding == "validity" and abs(r.p - 0.3) < 1e-9


def test_bm25_and_plan(spark):
    d = spark.createDataFrame([(1, "Apple pie"), (2, "apple"), (3, None)], "k int, t string")
    got = {r.k: r.score for r in search.bm25(d, "k", "t", ["apple"]).collect()}
    assert got[2] > got[1] and 3 not in got
    assert plan("why did it fail", 2).intent == "causal" and plan("x", 1).fusion == "single"
    with pytest.raises(ValueError):
        plan("x", 1, rows=10**9, indexed=False)


def test_vector_files_and_metrics(spark, tmp_path):
    (tmp_path / "a.fbin").write_bytes(struct.pack("<2I4f", 2, 2, 1.0, 2.0, 3.0, 4.0))
    got = vectors.read_vectors(spark, str(tmp_path / "a.fbin")).orderBy("row").collect()
    assert [list(r.embedding) for r in got] == [[1.0, 2.0], [3.0, 4.0]]
    (tmp_path / "m.txt").write_text("# HELP x\nup{a=\"b\"} 1\nreq_total 3.5\n")
    assert {(r.name, r.value) for r in vectors.read_metrics(spark, str(tmp_path / "m.txt")).collect()} == {("up", 1.0), ("req_total", 3.5)}


def test_streaming(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([("a", "2024-01-01 00:10:00", 1.0), ("a", "2024-01-01 00:20:00", 2.0), ("a", "2024-01-01 05:00:00", 3.0)], "k string, ts string, v double").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(src))
    stream = spark.readStream.schema("k string, ts timestamp, v double").parquet(str(src))
    q = ingest.rollup_stream(stream, "ts", "k", "v").writeStream.format("memory").queryName("rolled").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["sum"] for r in spark.sql("select * from rolled").collect()) == [3.0, 3.0]
    before = spark.createDataFrame([("a", 2)], "k string, frequency long")
    batch = spark.createDataFrame([("a",), ("b",)], "k string")
    assert [r.k for r in ingest.recurs(batch, before, "k", 3).collect()] == ["a"]


def test_chain_links_hash_to_hash(spark):
    rows = spark.createDataFrame([("a", i, f"p{i}") for i in range(1, 7)] + [("b", 1, "x")], "ledger string, seq long, body string")
    made = decide.chain(rows, "ledger", "seq", ["body"])
    first = lambda d: {r.ledger: r.first_break for r in decide.verify_chain(d, "ledger", "seq", ["body"]).collect()}
    assert first(made) == {"a": None, "b": None}
    assert first(made.withColumn("body", F.when(F.col("seq") == 4, "other").otherwise(F.col("body"))))["a"] == 4
    assert first(made.where("seq <> 3"))["a"] == 4
    # an entry altered with its own hash mended still breaks the link of the next one
    again = decide.chain(rows.withColumn("body", F.when((F.col("ledger") == "a") & (F.col("seq") == 2), "other").otherwise(F.col("body"))), "ledger", "seq", ["body"])
    mixed = made.where("seq <> 2").unionByName(again.where("seq = 2"))
    assert first(mixed)["a"] == 3


def test_merkle_root_pairs_an_odd_last_node_with_itself(spark):
    import hashlib

    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    digests = [h(str(i)) for i in range(5)]
    level = [h("leaf" + d) for d in digests]
    while len(level) > 1:
        level += level[-1:] * (len(level) % 2)
        level = [h("node" + level[i] + level[i + 1]) for i in range(0, len(level), 2)]
    df = spark.createDataFrame([(i + 10, d) for i, d in enumerate(digests)], "seq long, d string")
    assert decide.merkle_root(df, "seq", "d") == level[0]
    assert decide.merkle_root(df.limit(0), "seq", "d") is None


def test_paths_components_and_directions(spark):
    e = spark.createDataFrame([(1, 2, 0.5), (2, 3, 0.5), (3, 1, 1.0), (3, 4, 1.0), (4, 5, 0.2), (5, 4, 0.2), (6, 6, 1.0)], "src long, dst long, weight double")
    assert graphs.shortest_path(e, 1, 5, 4) == [1, 2, 3, 4, 5] and graphs.shortest_path(e, 1, 5, 3) is None and graphs.shortest_path(e, 5, 1, 9) is None
    got = {r.node: r.component for r in graphs.strong_components(e).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6}
    walk = {(r.direction, r.node): (r.hop, round(r.score, 6)) for r in graphs.traverse(e, 3, "both", 2).collect()}
    assert walk[("forward", 4)] == (1, 0.9) and walk[("backward", 1)] == (2, 0.2025) and ("forward", 3) not in walk
    with pytest.raises(ValueError):
        graphs.traverse(e, 3, "sideways", 2)
    with pytest.raises(ValueError):
        graphs.traverse(e, 3, "both", 11)
    with pytest.raises(ValueError):
        graphs.typed_hop(e.withColumn("kind", F.lit("a")), spark.createDataFrame([(1,)], "node long"), "b", 2)


def test_granger_against_least_squares(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    x, y = rng.normal(size=60), np.zeros(60)
    for i in range(2, 60):
        y[i] = 0.4 * y[i - 1] + 0.8 * x[i - 2] + 0.1 * rng.normal()
    df = spark.createDataFrame([("g", i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))] + [("flat", i, 1.0, 2.0) for i in range(20)], "k string, t int, x double, y double")
    got = {r.k: r for r in stats.granger(df, ["k"], "t", "x", "y", 2).collect()}

    def rss(cols):
        a = np.stack([np.ones(58), *cols], 1)
        return float(((y[2:] - a @ np.linalg.lstsq(a, y[2:], rcond=None)[0]) ** 2).sum())

    own, every = [y[1:-1], y[:-2]], [y[1:-1], y[:-2], x[1:-1], x[:-2]]
    want = (rss(own) - rss(every)) / 2 / (rss(every) / 53)
    assert got["g"].f == pytest.approx(want, rel=1e-6) and (got["g"].df1, got["g"].df2) == (2, 53)
    assert got["flat"].f is None or got["flat"].f != got["flat"].f


def test_ties_raise_in_copula(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 1.0, 3.0)], "k string, x double, y double")
    with pytest.raises(Exception, match="ties"):
        stats.copula_tails(df, ["k"], "x", "y").collect()


def test_panel_packing(spark):
    from lattica.operators import panel

    df = spark.createDataFrame([("a", 1.0, 0.1, 6.0), ("b", 0.5, 0.1, 5.0), ("c", 0.3, 0.1, 4.0), ("d", 9.0, 0.9, 1.0), ("e", 0.01, 0.0, 1.0), ("f", 9.0, 0.0, 99.0)], "key string, bits double, correlation double, cost double")
    assert panel.pack(df, 10.0) == ["a", "c"]


def test_pairwise_estimators_in_blocks(monkeypatch):
    import numpy as np

    from lattica.operators import estimators

    rng = np.random.default_rng(8)
    x = rng.normal(size=90)
    y = np.round(x * x + 0.3 * rng.normal(size=90), 1)

    def centre(d):
        return d - d.mean(0) - d.mean(1)[:, None] + d.mean()

    def kernel(v):
        d = (v[:, None] - v[None, :]) ** 2
        return np.exp(-d / np.median(d[d > 0]))

    a, b = (centre(np.abs(v[:, None] - v[None, :])) for v in (x, y))
    dcor = np.sqrt((a * b).mean() / np.sqrt((a * a).mean() * (b * b).mean()))
    whole = estimators.ksg(x, y)
    monkeypatch.setattr(estimators, "CELLS", 1000)
    assert estimators.distance_correlation(x, y) == pytest.approx(dcor, rel=1e-9)
    assert estimators.hsic(x, y) == pytest.approx((centre(kernel(x)) * centre(kernel(y))).sum() / 90**2, rel=1e-6)
    assert estimators.ksg(x, y) == pytest.approx(whole, rel=1e-12)
    assert estimators.bandwidth(np.array([1.0, 1.0])) == 1.0


def test_collections_read_the_last_change(spark):
    from lattica.operators import collections

    rows = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("b", 2, "z"), ("c", 4, None)], "k string, s long, v string")
    puts = collections.put(rows, F.col("s")).drop("s")
    gone = collections.delete(spark.createDataFrame([("b",), ("a",)], "k string"), puts, F.lit(5).cast("long"))
    now = {r.k: r.v for r in collections.current(puts.unionByName(gone), ["k"]).collect()}
    then = {r.k: r.v for r in collections.current(puts.unionByName(gone), ["k"], 4).collect()}
    assert now == {"c": None} and then == {"a": "y", "b": "z", "c": None}


def test_blobs_refuse_damage(spark):
    from lattica.operators import collections

    blobs = spark.createDataFrame([(1, bytearray(b"abcdefgh")), (2, bytearray(b"")), (3, None)], "k long, d binary")
    pieces = collections.chunks(blobs, "k", "d", 3)
    assert {(r.k, r.chunks, r.bytes) for r in collections.manifest(pieces, "k").collect()} == {(1, 3, 8), (2, 1, 0)}
    for bad in (pieces.where("k <> 1 or at <> 1"), pieces.withColumn("chunk", F.when(F.col("at") == 2, F.lit("xx").cast("binary")).otherwise(F.col("chunk")))):
        with pytest.raises(Exception, match="damaged"):
            collections.manifest(bad, "k").collect()


def test_survival_and_overdue(spark):
    import math

    for x in (0.0, 0.3, 1.0, 2.5, 9.0, 40.0):
        assert recurrence.gamma_upper(1.0, x) == pytest.approx(math.exp(-x), rel=1e-9)
        assert recurrence.gamma_upper(3.0, x) == pytest.approx(math.exp(-x) * (1 + x + x * x / 2), rel=1e-9)
    df = spark.createDataFrame([("even", 10 * i) for i in range(6)] + [("odd", t) for t in (0, 5, 30, 31, 50)], "k string, t long")
    got = {r.k: (r.survival, r.overdue) for r in recurrence.overdue(df, "k", "t", 61.0).collect()}
    assert got["even"] == (0.0, True) and 0.3 < got["odd"][0] < 0.9 and not got["odd"][1]
    with pytest.raises(ValueError):
        recurrence.periodic_recall(df, "k", F.col("t"), F.col("t"))


def test_quantized_search_takes_all_queries_in_blocks(spark):
    import numpy as np

    from lattica.operators import ann

    rng = np.random.default_rng(6)
    v = rng.normal(size=(120, 16))
    base = spark.createDataFrame([(i, [float(a) for a in x]) for i, x in enumerate(v)], "k long, v array<double>")
    asked = base.where("k % 10 = 0").select(F.col("k").alias("qid"), F.col("v").alias("qvec"))
    pq = ann.ProductQuantizer(base, "k", "v", parts=4, codes=32)
    got = pq.search(asked, base, pq.encode(base), 3, rescore=40, block=5).collect()
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = {(q, int(k)) for q in range(0, 120, 10) for k in np.argsort(-(u @ u[q]))[:3]}
    assert {(r.qid, r.k) for r in got} == want
    assert pq.search(asked.limit(0), base, pq.encode(base), 3).count() == 0


def test_pipeline_without_common_candidates(spark):
    from lattica.operators import fusion

    lists = spark.createDataFrame([(4, 1, 1), (4, 2, 2), (8, 3, 1)], "slot long, id long, rank int")
    assert {r.id for r in fusion.pipeline(lists, [4], "id").collect()} == {1, 2}
    assert fusion.fuse(lists, "pipeline", "id", stage1=[4], fall_back=False).isEmpty()
    met = lists.unionByName(spark.createDataFrame([(8, 2, 2)], lists.schema))
    for fall_back in (True, False):
        assert [r.id for r in fusion.fuse(met, "pipeline", "id", stage1=[4], fall_back=fall_back).collect()] == [2]


def no_pairs(*_):
    raise AssertionError("all pairs were taken")


def test_distance_correlation_without_pairs(monkeypatch):
    import numpy as np

    from lattica.operators import estimators

    rng = np.random.default_rng(12)
    cases = [(rng.normal(size=n), np.round(rng.normal(size=n), 1)) for n in (2, 3, 64, 301)]
    cases += [(1e6 + v, np.round(v * v, 2)) for v in (rng.normal(size=200),)]
    want = [estimators.centred_product(x, y, np.abs, np.abs) for x, y in cases]
    monkeypatch.setattr(estimators, "blocks", no_pairs)
    for (x, y), w in zip(cases, want):
        assert estimators.distance_covariance(x - x.mean(), y - y.mean()) == pytest.approx(w, rel=1e-8, abs=1e-10)
    assert estimators.distance_correlation(np.arange(50_000.0), np.arange(50_000.0) * 2) == pytest.approx(1)
    assert estimators.distance_correlation(np.ones(9), np.arange(9.0)) == 0


def test_pairwise_estimators_of_large_groups(spark, monkeypatch):
    import numpy as np

    from lattica.operators import estimators

    rng = np.random.default_rng(13)
    x, y = rng.normal(size=400), rng.normal(size=400) * 3 + 1
    z = np.concatenate([x, y])
    k = np.exp(-((z[:, None] - z[None, :]) ** 2) / estimators.bandwidth(z))
    gap = k[:400, :400].mean() + k[400:, 400:].mean() - 2 * k[:400, 400:].mean()
    mx, my = estimators.bandwidth(x), estimators.bandwidth(y)
    both = estimators.centred_product(x, y, lambda d: np.exp(-d * d / mx), lambda d: np.exp(-d * d / my))
    far = np.append(x, 1e9)  # too many frequencies: pairs
    assert estimators.frequencies(1e9, estimators.bandwidth(far)) is None
    assert estimators.mmd(far, far[::-1].copy()) == pytest.approx(0, abs=1e-12)
    monkeypatch.setattr(estimators, "blocks", no_pairs)
    assert estimators.mmd(x, y) == pytest.approx(gap, rel=1e-9) and estimators.hsic(x, y) == pytest.approx(both, rel=1e-8)
    df = spark.range(3000).select(F.lit("g").alias("k"), F.sin("id").alias("x"), (F.sin("id") + F.cos(F.col("id") * 3)).alias("y"))
    row = estimators.estimate(df, "k", "x", "y", ["distance_correlation", "hsic", "ksg", "mmd"]).first()
    assert row.n == 3000 and row.mmd > 0 and 0 < row.distance_correlation < 1 and row.hsic > 0 and row.ksg > 0


def test_nearest_in_blocks_of_a_task(spark, monkeypatch):
    import numpy as np

    from lattica.operators import best, search

    rng = np.random.default_rng(17)
    v = np.concatenate([rng.normal(size=(60, 5)), np.zeros((1, 5))])
    v = np.concatenate([v, v[::-1], v])  # equal scores go by the key
    monkeypatch.setattr(best, "CELLS", 40)
    keys = np.array([f"k{i:03}" for i in range(len(v))], object)
    values = [list(x) for x in v] + [None, [1.0, 2.0]]
    keys = np.append(keys, ["a", "b"])
    asked = best.Vectors([list(v[3]), list(v[60]), None, list(v[7] + v[9])])
    got = best.Best(4, 9)
    for part in np.array_split(np.arange(len(values)), 4):
        best.offer(got, asked, keys[part], best.Vectors([values[i] for i in part]))
    found = got.settle()
    n = np.linalg.norm(v, axis=1)
    for q, x in ((0, v[3]), (1, v[60]), (3, v[7] + v[9])):
        length = n * np.linalg.norm(x)
        score = np.where(length > 0, v @ x / np.where(length > 0, length, 1), 0)
        want = sorted(range(len(v)), key=lambda i: (-round(score[i], 9), keys[i]))[:9]
        assert list(found[found["q"] == q]["key"]) == [keys[i] for i in want]
    assert list(found[found["q"] == 2]["key"]) == sorted(keys)[:9] and found[found["q"] == 2]["score"].isna().all()
    near = best.Best(1, 200)
    best.offer(near, best.Vectors([list(v[3])]), keys, best.Vectors(values))
    assert list(near.settle()["key"])[-2:] == ["a", "b"] and len(near.kept) == len(values)

    def no_pairs(*_):
        raise AssertionError("pairs are joined")

    monkeypatch.setattr(type(spark.range(1)), "crossJoin", no_pairs)
    e = spark.range(50).select("id", F.array(F.sin("id"), F.cos("id")).alias("v"))
    rows = search.nearest(e.select(F.col("id").alias("qid"), F.col("v").alias("qvec")), e, "id", "v", 2, bound=20).collect()
    assert len(rows) == 100 and {r.qid for r in rows if r.rank == 1 and r.qid == r.id} == set(range(50))


def test_inverted_file_equals_scan_when_all_cells_are_probed(spark):
    from lattica.operators import ann, search

    e = spark.range(80).select("id", F.array(F.sin("id"), F.cos(F.col("id") * 2), F.sin(F.col("id") * 3)).alias("v")).unionByName(spark.createDataFrame([(99, None)], "id long, v array<double>"))
    asked = e.select(F.col("id").alias("qid"), F.col("v").alias("qvec"))
    found = ann.InvertedFile(e, "id", "v", cells=4).search(asked, e, 3, probes=4, bound=30)
    truth = search.nearest(asked.where("qvec is not null"), e, "id", "v", 3)
    rows = lambda d: sorted((r.qid, r.id, r.rank) for r in d.collect())
    assert rows(found) == rows(truth) and len(rows(truth)) == 240
    assert "Join" not in found._jdf.queryExecution().toString()


def test_shared_entities_are_dealt_by_their_pairs(spark, monkeypatch):
    from lattica.operators import markets

    monkeypatch.setattr(markets, "PAIRS", 100)
    df = spark.range(400).select((F.col("id") % 80).alias("i"), F.when(F.col("id") < 390, F.expr("(id * 7 + id div 80) % 20")).alias("e"))
    got = markets.shared_entity_edges(df, "i", "e")
    rows = {(r.i, r.e) for r in df.distinct().collect() if r.e is not None}
    want = {}
    for i, e in rows:
        for j, f in rows:
            if e == f and i < j:
                want[i, j] = want.get((i, j), 0) + 1
    assert {(r.a, r.b): r.shared for r in got.collect()} == want
    assert got.rdd.getNumPartitions() >= sum(want.values()) / 100 > 4


def test_quantized_search_breaks_equal_codes_by_key(spark):
    from lattica.operators import ann

    base = spark.range(40).select((39 - F.col("id")).alias("k"), F.array(F.lit(1.0), F.lit(2.0), F.lit(0.0), F.lit(1.0)).alias("v")).coalesce(1)
    pq = ann.ProductQuantizer(base, "k", "v", parts=2, codes=4)
    found = pq.search(spark.createDataFrame([(7, [1.0, 2.0, 0.0, 1.0])], "qid long, qvec array<double>"), base, pq.encode(base), 2, rescore=1)
    assert sorted((r.qid, r.k, r["rank"]) for r in found.collect()) == [(7, 0, 1), (7, 1, 2)]
