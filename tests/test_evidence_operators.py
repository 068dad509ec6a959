"""Hypotheses, watches, duplicates and series dependence on small planted cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.operators import decide, dynamics, encode, graphs, hypotheses


def noise(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).random(n)


def test_maximal_information_of_planted_cases():
    x = np.arange(40.0)
    assert dynamics.maximal_information(x, x) == pytest.approx(1)
    z = np.arange(-20.0, 21)
    assert dynamics.maximal_information(z, z * z) > 0.99
    u, v = noise(200, 1), noise(200, 2)
    alone, tied = dynamics.maximal_information(u, v), dynamics.maximal_information(u, u + 0.05 * (noise(200, 3) - 0.5))
    assert alone < 0.5 and tied > 0.7 and tied > alone + 0.2
    for bad in ((np.ones(5), np.arange(5.0)), (np.arange(3.0), np.arange(3.0))):
        with pytest.raises(ValueError):
            dynamics.maximal_information(*bad)


def test_best_partition_equals_trying_all():
    from itertools import combinations

    rng = np.random.default_rng(4)
    labels, clumps = rng.integers(0, 3, 24), np.full(8, 3)
    ends = np.concatenate([[0], np.cumsum(clumps)])

    def info(cuts):
        n, total = len(labels), 0.0
        edges = [0, *cuts, n]
        for r in range(3):
            pr = (labels == r).mean()
            for a, b in zip(edges, edges[1:]):
                p = (labels[a:b] == r).sum() / n
                total += p * math.log(p / (pr * (b - a) / n)) if p > 0 else 0
        return total

    got = dynamics.best_partition(labels, clumps, 3, 4)
    for parts in (2, 3, 4):
        assert got[parts - 1] == pytest.approx(max(info(c) for k in range(1, parts) for c in combinations(ends[1:-1], k)))


def test_series_dependence(spark):
    n = 400
    rng = np.random.default_rng(5)
    a = rng.normal(size=n)
    b = np.concatenate([[0.0], 0.9 * a[:-1] + 0.2 * rng.normal(size=n - 1)])
    df = spark.createDataFrame([("g", i, float(a[i]), float(b[i])) for i in range(n)] + [("few", i, 0.5 * i, 1.0) for i in range(5)], "k string, t long, a double, b double")
    got = {r.key: r for r in dynamics.transfer_entropy(df, "k", "t", "a", "b", [1], resamples=5).collect()}
    assert got["g"].forward > 0.8 > 0.2 > got["g"].backward and got["g"].low <= got["g"].high and got["few"].forward is None
    with pytest.raises(Exception, match="two values"):
        dynamics.transfer_entropy(df.union(df), "k", "t", "a", "b", [1]).collect()
    u, v = [0.4], [0.2]
    for _ in range(n - 1):
        x, y = u[-1], v[-1]
        u.append(x * (3.8 - 3.8 * x))
        v.append(y * (3.5 - 3.5 * y - 0.1 * x))
    pairs = spark.createDataFrame([("g", i, u[i], v[i]) for i in range(n)], "key string, t long, x double, y double")
    ccm = dynamics.convergent_cross_mapping(pairs, "key", "t", "x", "y", [20, 300, 4000]).collect()
    assert {r.verdict for r in ccm} == {"x_drives_y"} and [r.size for r in ccm if r.x_to_y is None] == [4000]


def test_joint_information(spark):
    rng = np.random.default_rng(6)
    a, e = rng.normal(size=600), rng.normal(size=600)
    df = spark.createDataFrame([("g", float(p), float(p + 0.5 * q), float(q), None if i else 1.0) for i, (p, q) in enumerate(zip(a, e))], "k string, a double, b double, c double, d double")
    got = dynamics.total_correlation(df, "k", ["a", "b"]).first()
    assert got.total == pytest.approx(0.5 * math.log2(1.25 / 0.25), abs=0.15) and 1 <= got.effective <= 2
    assert dynamics.total_correlation(df, "k", ["a", "d"]).first().total is None
    assert dynamics.interaction_information(df, "k", "a", "b", "c").first().bits < -0.5
    assert dynamics.hawkes(df.limit(1).select("k", "a", F.lit(1.0).alias("t")), "k", "a", "t").count() == 0


def test_excitation_runs_one_way(spark):
    rng = np.random.default_rng(7)
    cause = np.sort(rng.random(150) * 300)
    effect = cause + rng.exponential(0.5, 150)
    rows = [("g", 1, float(t)) for t in cause] + [("g", 2, float(t)) for t in effect]
    b = {(r.target, r.source): r.branching for r in dynamics.hawkes(spark.createDataFrame(rows, "k string, p int, t double"), "k", "p", "t").collect()}
    assert b[2.0, 1.0] > 0.6 and b[1.0, 2.0] < 0.25


def test_skeleton_of_a_chain(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=2000)
    y = x + 0.5 * rng.normal(size=2000)
    z = y + 0.5 * rng.normal(size=2000)
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(x, y, z)], "x double, y double, z double")
    got = {(r.a, r.b): (r.kept, r.given) for r in dynamics.skeleton(df, ["x", "y", "z"], 0.001).collect()}
    assert got == {("x", "y"): (True, None), ("x", "z"): (False, "y"), ("y", "z"): (True, None)}
    with pytest.raises(ValueError, match="constant"):
        dynamics.skeleton(df.withColumn("x", F.lit(1.0)), ["x", "y"])


def test_ranking_and_packing(spark):
    h = spark.createDataFrame([("a", 0.5, 0.5, 2, 0.5), ("b", 1.0, 1.0, 1, 1.0), ("c", 0.5, 0.5, 2, 0.5)], "id string, novelty double, grounding double, distance int, plausibility double")
    assert [(r.id, r.rank) for r in hypotheses.rank_hypotheses(h, "id", 3).orderBy("rank").collect()] == [("b", 1), ("a", 2), ("c", 3)]
    for bad in (h.withColumn("novelty", F.lit(1.5)), h.withColumn("distance", F.lit(0)), h.withColumn("grounding", F.lit(None).cast("double"))):
        with pytest.raises(Exception, match="scores lie"):
            hypotheses.rank_hypotheses(bad, "id", 3).collect()
    c = spark.createDataFrame([("small", 0.3, 0.1, 1.0), ("big", 2.0, 0.1, 10.0), ("huge", 9.0, 0.1, 99.0), ("weak", 0.01, 0.1, 1.0), ("odd", 1.0, None, 1.0)], "lens string, bits double, correlation double, ram double")
    got = {r.lens: (r.admitted, r.reason) for r in hypotheses.pack_panel(c, {"ram": 10.0}).collect()}
    assert got == {"small": (False, "budget used up"), "big": (True, None), "huge": (False, "over budget"), "weak": (False, "inadmissible"), "odd": (False, "inadmissible")}
    assert hypotheses.pack_panel(c.limit(0), {"ram": 10.0}).count() == 0


def test_tripwire_needs_the_hysteresis_to_reset(spark):
    rows = spark.createDataFrame([("m", i, float(v)) for i, v in enumerate((0, 11, 9.8, 9.4, 10.2, 9.6, 12))], "m string, i int, v double")
    got = hypotheses.tripwires(rows, "m", ["i"], "v", F.lit(10.0), F.lit(0.5), F.lit(True)).orderBy("i").collect()
    assert [r.crossed for r in got] == [False, True, True, False, True, True, True]
    below = hypotheses.tripwires(rows, "m", ["i"], "v", F.lit(10.0), F.lit(0.5), F.lit(False)).orderBy("i").collect()
    assert [r.crossed for r in below] == [True, False, True, True, True, True, False]
    with pytest.raises(Exception, match="finite"):
        hypotheses.tripwires(rows.withColumn("v", F.lit(float("nan"))), "m", ["i"], "v", F.lit(1.0), F.lit(0.1), F.lit(True)).collect()


def test_duplicates_keep_conflicting_anchors(spark):
    rows = [(1, "a", 1), (2, "a", 0), (3, "a", None), (4, "b", None), (5, "b", 1), (6, None, 1), (7, None, 1), (8, "a", 1)]
    df = spark.createDataFrame(rows, "k long, t string, q int")
    got = hypotheses.dedup_assign(df, "k", F.col("t"), F.col("q"))
    assert {r.k: (r.keeper, r.contested) for r in got.collect()} == {1: (1, True), 2: (2, True), 3: (1, True), 4: (4, False), 5: (4, False), 6: (6, False), 7: (7, False), 8: (1, True)}
    assert {r.k: r.keeper for r in hypotheses.dedup_undo(got, "k", df.where("k = 8")).collect()}[8] == 8
    assert hypotheses.dedup_assign(df.limit(0), "k", F.col("t"), F.col("q")).count() == 0


def test_bootstrap_does_not_depend_on_partitions(spark):
    df = spark.range(3000).select(F.lit("g").alias("g"), "id", (F.col("id") % 97).cast("double").alias("v"))
    a = hypotheses.bootstrap_mean(df.repartition(7), ["g"], "id", "v", 200).first()
    b = hypotheses.bootstrap_mean(df.coalesce(1), ["g"], "id", "v", 200).first()
    assert (a.n, a.low, a.high) == (b.n, b.low, b.high)
    half = 1.96 * 28.0 / math.sqrt(3000)
    assert a.mean - 1.5 * half < a.low < a.mean - half / 2 and a.mean + half / 2 < a.high < a.mean + 1.5 * half


def test_centrality_and_feedback(spark):
    edges = [(0, 1, 1.0), (1, 2, 1.0), (2, 0, 1.0), (2, 3, 2.0), (3, 4, 1.0), (4, 2, 1.0), (4, 4, 1.0), (5, 0, 1.0)]
    df = spark.createDataFrame(edges, "src long, dst long, weight double")
    m = np.eye(6)
    for a, b, w in edges:
        m[a, b] += w
        m[b, a] += w
    values, vectors = np.linalg.eigh(m)
    want = np.abs(vectors[:, values.argmax()])
    got = {r.node: r.centrality for r in graphs.eigenvector_centrality(df, 200, 1e-9).collect()}
    assert [got[i] for i in range(6)] == pytest.approx(list(want), abs=1e-6)
    gone = {r.node for r in graphs.feedback_vertices(df).collect()}
    left = df.where(~F.col("src").isin(list(gone)) & ~F.col("dst").isin(list(gone)))
    assert 4 in gone and len(gone) <= 2
    size = graphs.strong_components(left).groupBy("component").count().agg(F.max("count")).first()[0]
    assert size == 1 and left.where("src = dst").isEmpty()


def test_consequences_are_cut(spark):
    e = spark.createDataFrame([(1, 2, 1.0), (2, 3, 0.5), (3, 4, 0.2), (1, 3, 0.01), (2, 1, 1.0)], "src long, dst long, ratio double")
    got = {r.node: (r.hop, round(r.confidence, 6)) for r in graphs.consequences(e, 1).collect()}
    assert got == {2: (1, 0.7), 3: (2, 0.245)}


def test_event_codes_of_odd_lines(spark):
    lines = ["EventCode 190 root 19 quad 4 Goldstein -10.0 tone -250 | Actor1 USA Actor2 GBR ActionGeo X", "", None, "EventCode none root x"]
    got = [r.v for r in spark.createDataFrame([(i, s) for i, s in enumerate(lines)], "i int, s string").select(encode.event_codes(F.col("s")).alias("v"), "i").orderBy("i").collect()]
    assert got[0][:15] == pytest.approx([1, 190 / 999, 0.95, 1, -1, -1, 0, 0, 0, 1, 0, 1, 1, 1, 1]) and 0 <= got[0][15] <= 1
    assert all(len(v) == 16 for v in got) and got[2] == [0.0] * 16 and sum(got[1][:15]) == sum(got[3][:15]) == 0


def test_ledger_reads(spark):
    df = spark.createDataFrame([(i, "a" if i % 2 else "b", f"2024-01-0{i}") for i in range(1, 8)], "seq long, kind string, at string").withColumn("at", F.col("at").cast("timestamp"))
    assert [(r.seq, r.checkpoint) for r in decide.checkpoints(df, "seq", 3).orderBy("seq").collect()] == [(3, 0), (6, 1)]
    assert {r.seq for r in decide.audit(df, {"kind": ["a"]}, "at", "2024-01-02", "2024-01-05").collect()} == {3}


def test_correlations_of_a_constant_are_null(spark):
    from lattica.operators import stats

    df = spark.createDataFrame([("c", float(i), 1.0, float(i % 3)) for i in range(9)] + [("o", 1.0, 2.0, 3.0)], "g string, x double, y double, z double")
    assert all(r.r is None for r in stats.pearson(df, ["g"], "x", "y").collect())
    assert all(r.r is None for r in stats.partial_correlation(df, ["g"], "x", "y", "z").collect())
    assert all(r.rho is None for r in stats.spearman(df, ["g"], "x", "y").collect())
    tied = stats.pearson(df.withColumn("y", F.col("x") * 2), ["g"], "x", "y").where("g = 'c'").first()
    assert tied.r == pytest.approx(1)


def test_neighbours_equal_all_pairs():
    from lattica.operators import neighbours

    rng = np.random.default_rng(14)
    for d, n in ((1, 300), (2, 700), (3, 500), (4, 200)):
        a = rng.normal(size=(n, d))
        a[:, -1] = rng.integers(0, 4, n)
        a[: n // 4] = a[0]
        far = neighbours.largest(a, a)
        apart = far + np.diag(np.full(n, np.inf))
        e = np.sort(apart, axis=1)[:, 2]
        assert (neighbours.kth_distance(a, 3) == e).all()
        assert (neighbours.count_within(a, e) == (far < e[:, None]).sum(1)).all()


def test_information_without_pairs(spark, monkeypatch):
    def no_pairs(*_):
        raise AssertionError("all pairs were taken")

    monkeypatch.setattr(dynamics, "blocks", no_pairs)
    rng = np.random.default_rng(15)
    x = rng.normal(size=(20_000, 1))
    y = 0.8 * x + 0.6 * rng.normal(size=(20_000, 1))
    want = -0.5 * math.log2(1 - 0.64)
    assert dynamics.information(x, y) == pytest.approx(want, abs=0.03)
    assert dynamics.information(x, np.hstack([y, rng.normal(size=(20_000, 1))])) == pytest.approx(want, abs=0.06)
    assert dynamics.entropy(x) == pytest.approx(0.5 * math.log2(2 * math.pi * math.e), abs=0.03)


def test_total_correlation_of_equal_rows_is_null(spark):
    v = noise(300, 16)
    rows = [("tied", float(i // 5), float(v[i])) for i in range(300)] + [("free", float(v[i]), float(v[i] + v[i - 1])) for i in range(300)]
    got = {r.key: r for r in dynamics.total_correlation(spark.createDataFrame(rows, "k string, a double, b double"), "k", ["a", "b"]).collect()}
    assert got["tied"].n == 300 and got["tied"].marginal is None and got["tied"].total is None and got["tied"].joint is not None
    assert got["free"].total > 0


def test_feedback_of_more_edges(spark):
    rng = np.random.default_rng(18)
    pairs = {(int(a), int(b)) for a, b in rng.integers(0, 60, (300, 2))}

    def slow(edges):
        nodes, chosen = {v for e in edges for v in e}, []
        while True:
            edges = {(a, b) for a, b in edges if a in nodes and b in nodes}
            outs, ins = ({v: sum(e[i] == v for e in edges) for v in nodes} for i in (0, 1))
            idle = {v for v in nodes if not outs[v] or not ins[v]}
            if idle:
                nodes -= idle
                continue
            if not nodes:
                return sorted(chosen)
            chosen.append(min(nodes, key=lambda v: (-outs[v] * ins[v], v)))
            nodes.discard(chosen[-1])

    df = spark.createDataFrame([*pairs, (None, 3), (3, 4), (3, 4)], "src long, dst long")
    assert sorted(r.node for r in graphs.feedback_vertices(df).collect()) == slow(pairs | {(3, 4)})
    assert graphs.feedback_vertices(df.where("false")).isEmpty()
    every = spark.range(1_450 * 1_450).selectExpr("id % 1450 as src", "id div 1450 as dst")  # more than 2,000,000 edges, loops too
    assert sorted(r.node for r in graphs.feedback_vertices(every).collect()) == list(range(1_450))


def test_best_partition_holds_no_square_of_the_clumps():
    import tracemalloc

    labels = np.random.default_rng(19).integers(0, 2, 3000)
    tracemalloc.start()
    got = dynamics.best_partition(labels, np.ones(3000, int), 2, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 << 20 and (np.diff(got) >= 0).all() and got[-1] > 0
    x = np.array([3.0, 1.0, 1.0, 2.0, 2.0, 5.0])
    assert dynamics.middle_ranks(x).tolist() == [4.0, 0.5, 0.5, 2.5, 2.5, 5.0]
    assert dynamics.clumps_of(np.array([0, 2, 3, 5]), np.array([0, 0, 0, 1, 0, 1]), 9).tolist() == [3, 2, 1]
