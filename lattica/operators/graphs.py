"""Iterative graph operators on edge tables (src, dst, weight)."""

from __future__ import annotations

import atexit
import heapq
import re
import shutil
import tempfile
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """Lineage cut by a table in the folder the session names in ``spark.checkpoint.dir``. Only a local master that names none
    gets a temporary one, which goes with the process."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        made = tempfile.mkdtemp(prefix="lattica-graph-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(folder := f"file://{made}")
    path = f"{folder.rstrip('/')}/{uuid.uuid4().hex}-graph"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bfs(edges: DataFrame, sources: DataFrame, hops: int) -> DataFrame:
    """(node, hop): distance of every node within ``hops`` of a source; only the frontier is joined in each step."""
    seen = frontier = cut(sources.select(F.col(sources.columns[0]).alias("node")).distinct().withColumn("hop", F.lit(0)))
    for h in range(1, hops + 1):
        step = frontier.join(edges, frontier["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti")
        frontier = cut(step.withColumn("hop", F.lit(h)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def reach_scored(edges: DataFrame, source, hops: int, attenuation: float = 0.9) -> DataFrame:
    """(node, hop, score): best product of weights * attenuation ** hops; fewer hops win ties; the source is left out."""
    spark = edges.sparkSession
    frontier = spark.createDataFrame([(source, 1.0)], "node long, product double")
    parts = None
    for h in range(1, hops + 1):
        frontier = cut(frontier.join(edges, frontier["node"] == edges["src"]).groupBy(F.col("dst").alias("node")).agg(F.max(F.col("product") * F.col("weight")).alias("product")))
        part = frontier.select("node", F.lit(h).alias("hop"), (F.col("product") * attenuation**h).alias("score"))
        parts = part if parts is None else parts.unionByName(part)
    best = F.max(F.struct(F.col("score"), (-F.col("hop")).alias("neg")))
    return parts.where(F.col("node") != source).groupBy("node").agg(best.alias("b")).select("node", (-F.col("b.neg")).alias("hop"), F.col("b.score").alias("score"))


def label_propagation(edges: DataFrame, seeds: DataFrame, tolerance: float = 1e-3, most: int = 50) -> DataFrame:
    """(node, value): undirected Jacobi weighted means with fixed seeds (node, value); not converging raises."""
    both = cut(edges.select("src", "dst", "weight").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")))
    fixed = seeds.select("node", F.col("value").alias("seed"))
    value = cut(both.select(F.col("src").alias("node")).distinct().join(fixed, "node", "left").select("node", F.coalesce("seed", F.lit(0.0)).alias("value")))
    for _ in range(most):
        mean = both.join(value.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg((F.sum(F.col("weight") * F.col("value")) / F.sum("weight")).alias("mean"))
        new = cut(value.withColumnRenamed("value", "old").join(mean, "node", "left").join(fixed, "node", "left").select("node", F.coalesce("seed", "mean", "old").alias("value"), "old"))
        change = new.agg(F.max(F.abs(F.col("value") - F.col("old")))).first()[0] or 0.0
        value = new.select("node", "value")
        if change <= tolerance:
            return value
    raise ValueError(f"no convergence in {most} steps")


def hop_decay(values: DataFrame, hops: DataFrame) -> DataFrame:
    """(node, confidence): a propagated value times exp(-0.5 * hops) from the seeds; nodes that no seed reaches have 0."""
    return values.join(hops, "node", "left").select("node", F.coalesce(F.col("value") * F.exp(-0.5 * F.col("hop")), F.lit(0.0)).alias("confidence"))


def degree_scores(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node")))
    return both.groupBy("node").agg(F.count("*").alias("degree"))


def reverse(edges: DataFrame) -> DataFrame:
    return edges.withColumnsRenamed({"src": "_s", "dst": "src"}).withColumnRenamed("_s", "dst")


def typed_hop(edges: DataFrame, sources: DataFrame, kind: str, hops: int) -> DataFrame:
    """(node, hop): nodes within ``hops`` along edges (src, dst, kind) of one kind, over all sources; an unknown kind raises."""
    mine = edges.where(F.col("kind") == kind)
    if mine.isEmpty():
        raise ValueError(f"unknown edge kind {kind!r}")
    return bfs(mine, sources, hops)


def traverse(edges: DataFrame, anchor, direction: str, hops: int) -> DataFrame:
    """(node, direction, hop, score) of the nodes met 1..``hops`` (10 at most) from the anchor ``forward``, ``backward`` or
    ``both``, each at its first hop with its best product of weights * 0.9 ** hop over walks of so many hops. To be ordered
    by hop, score downwards, node and direction, which is the caller's sort."""
    if not 1 <= hops <= 10:
        raise ValueError("hops outside 1..10")
    out = None
    for name, e in (("forward", edges), ("backward", reverse(edges))):
        if direction in (name, "both"):
            start = edges.sparkSession.createDataFrame([(anchor, 0, 1.0)], "node long, hop int, product double")
            seen = frontier = cut(start)
            for h in range(1, hops + 1):
                step = frontier.join(e, frontier["node"] == e["src"]).groupBy(F.col("dst").alias("node")).agg(F.max(F.col("product") * F.col("weight")).alias("product"))
                frontier = cut(step.join(seen.select("node"), "node", "left_anti").select("node", F.lit(h).alias("hop"), "product"))
                if frontier.isEmpty():
                    break
                seen = seen.unionByName(frontier)
            part = seen.where("hop > 0").select("node", F.lit(name).alias("direction"), "hop", (F.col("product") * F.pow(F.lit(0.9), F.col("hop"))).alias("score"))
            out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError(f"unknown direction {direction!r}")
    return out


def shortest_path(edges: DataFrame, src, dst, hops: int) -> list | None:
    """Nodes of a path of fewest hops (of those the least by its nodes' predecessors), or none within ``hops``. Frontiers are
    tables; what comes to the driver is one row a hop."""
    if src == dst:
        return [src]
    seen = frontier = cut(edges.sparkSession.createDataFrame([(src, None, 0)], "node long, parent long, hop int"))
    for h in range(1, hops + 1):
        step = frontier.select("node").join(edges, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("next")).agg(F.min("src").alias("parent"))
        frontier = cut(step.join(seen.select(F.col("node").alias("next")), "next", "left_anti").select(F.col("next").alias("node"), "parent", F.lit(h).alias("hop")))
        if frontier.isEmpty():
            return None
        seen = seen.unionByName(frontier)
        if not frontier.where(F.col("node") == dst).isEmpty():
            path = [dst]
            for back in range(h, 0, -1):
                path.append(seen.where((F.col("node") == path[-1]) & (F.col("hop") == back)).first()["parent"])
            return path[::-1]
    return None


def strong_components(edges: DataFrame, most: int = 100) -> DataFrame:
    """(node, component): strongly connected components, named by their smallest node.

    Colours spread forward: each node takes the smallest node that reaches it. Backward from each colour's own node, along
    edges within the colour, lies its component; these nodes go, and the rest starts anew, until none is left. Every step
    is a join of a frontier; more than ``most`` rounds raise.
    """
    left = cut(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    nodes = cut(left.select(F.explode(F.array("src", "dst")).alias("node")).distinct())
    done = None
    for _ in range(most):
        if nodes.isEmpty():
            return done if done is not None else nodes.select("node", F.col("node").alias("component"))
        colour = cut(nodes.select("node", F.col("node").alias("c")))
        while True:
            came = left.join(colour.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("c").alias("m"))
            new = cut(colour.join(came, "node", "left").select("node", F.least("c", F.coalesce("m", "c")).alias("c"), (F.col("m") < F.col("c")).alias("moved")))
            colour = new.select("node", "c")
            if new.where("moved").isEmpty():
                break
        a, b = colour.select(F.col("node").alias("src"), F.col("c").alias("ca")), colour.select(F.col("node").alias("dst"), F.col("c").alias("cb"))
        inside = cut(left.join(a, "src").join(b, "dst").where("ca = cb").select("src", "dst"))
        found = frontier = cut(colour.where("node = c"))
        while not frontier.isEmpty():
            step = frontier.join(inside, frontier["node"] == inside["dst"]).select(F.col("src").alias("node"), "c").distinct()
            frontier = cut(step.join(found, "node", "left_anti"))
            found = found.unionByName(frontier)
        found = cut(found.select("node", F.col("c").alias("component")))
        done = found if done is None else done.unionByName(found)
        nodes = cut(nodes.join(found, "node", "left_anti"))
        gone = found.select("node")
        left = cut(left.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti"))
    raise ValueError(f"components not found in {most} rounds")


def betweenness(edges: DataFrame, pivots: int | None = None, exact: int = 2_000, bound: int = 2_000_000) -> DataFrame:
    """(node, betweenness) of the directed graph by hops, over (n - 1)(n - 2): from every node, or above ``exact`` nodes (or
    where ``pivots`` says so) from as many nodes chosen by hash (512 by default), scaled up.

    Sources are dealt over the tasks, each of which holds the graph: edges are broadcast, and more than ``bound`` raise.
    """
    e = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).dropna().distinct()
    rows = e.limit(bound + 1).toPandas()
    if len(rows) > bound:
        raise ValueError(f"more than {bound} edges")
    nodes = e.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    n = nodes.count()
    take = pivots if pivots is not None else (n if n <= exact else 512)
    scale = n / min(take, n) if n else 1.0
    spark = edges.sparkSession
    shared = spark.sparkContext.broadcast(rows)
    sources = nodes if take >= n else nodes.orderBy(F.xxhash64("node"), "node").limit(take)

    def run(parts):
        out: dict[int, list[int]] = {}
        for a, b in shared.value.itertuples(index=False):
            out.setdefault(a, []).append(b)
        total: dict[int, float] = {}
        for part in parts:
            for s in part["node"].tolist():
                hop, paths, before, order = {s: 0}, {s: 1.0}, {}, [s]
                for v in order:
                    for w in out.get(v, ()):
                        if w not in hop:
                            hop[w] = hop[v] + 1
                            order.append(w)
                        if hop[w] == hop[v] + 1:
                            paths[w] = paths.get(w, 0.0) + paths[v]
                            before.setdefault(w, []).append(v)
                share = dict.fromkeys(order, 0.0)
                for w in reversed(order):
                    for v in before.get(w, ()):
                        share[v] += paths[v] / paths[w] * (1 + share[w])
                    if w != s:
                        total[w] = total.get(w, 0.0) + share[w]
        yield pd.DataFrame({"node": pd.Series(list(total), dtype="int64"), "b": pd.Series(list(total.values()), dtype=float)})

    sums = sources.repartition(spark.sparkContext.defaultParallelism).mapInPandas(run, "node long, b double").groupBy("node").agg(F.sum("b").alias("b"))
    norm = float((n - 1) * (n - 2)) if n > 2 else 1.0
    return nodes.join(sums, "node", "left").select("node", (F.coalesce("b", F.lit(0.0)) * scale / norm).alias("betweenness"))


def normalized_weights(edges: DataFrame) -> DataFrame:
    """Weights over the largest one."""
    return edges.crossJoin(F.broadcast(edges.agg(F.max("weight").alias("_top")))).withColumn("weight", F.col("weight") / F.col("_top")).drop("_top")  # one row


def adjacency(edges: DataFrame) -> DataFrame:
    """(src, degree, targets): compressed rows, each sorted by target."""
    rows = edges.groupBy("src").agg(F.array_sort(F.collect_list(F.struct("dst", "weight"))).alias("targets"))
    return rows.select("src", F.size("targets").cast("long").alias("degree"), "targets")


def causes(edges: DataFrame, outcome, depth: int) -> DataFrame:
    """(node, depth, score): what leads to ``outcome`` within ``depth`` steps, each at its first depth, by its best product of
    weights without a second visit."""
    return traverse(edges, outcome, "backward", depth).where(F.col("node") != outcome).select("node", F.col("hop").alias("depth"), (F.col("score") / F.pow(F.lit(0.9), F.col("hop"))).alias("score"))


def grounding_gaps(edges: DataFrame, members: DataFrame, anchors: DataFrame, most: int) -> DataFrame:
    """(node): members that reach no anchor within ``most`` steps. The grounded share is 1 less their part of the members, and 0
    without members."""
    return members.select("node").distinct().join(bfs(reverse(edges), anchors, most).select("node"), "node", "left_anti")


def kernel(edges: DataFrame, anchors: DataFrame, fraction: float = 0.10) -> DataFrame:
    """Nodes of the highest 0.4 * degree / max + 0.4 * betweenness + 0.2 * (1 - min(d, 3) / 3), ceil(fraction * n) of them; d is
    the distance to the nearest anchor."""
    deg = degree_scores(edges)
    near = bfs(reverse(edges), anchors, 3)
    top = deg.agg(F.max("degree").alias("top"), F.count("*").alias("n"))
    score = 0.4 * F.col("degree") / F.col("top") + 0.4 * F.coalesce("betweenness", F.lit(0.0)) + 0.2 * (1 - F.least(F.coalesce("hop", F.lit(3)), F.lit(3)) / 3)
    scored = deg.join(near, "node", "left").join(betweenness(edges), "node", "left").crossJoin(F.broadcast(top)).select("node", score.alias("score"), "n")
    n = top.first()["n"] or 0
    return scored.orderBy(F.desc("score"), "node").limit(-(-int(n * fraction * 1_000_000) // 1_000_000)).select("node", "score")


def scope(edges: DataFrame, seeds: DataFrame, radius: int) -> DataFrame:
    """(node): the seeds and all within ``radius`` steps of one."""
    return bfs(edges, seeds, radius).select("node")


def shared_members(a: DataFrame, b: DataFrame, frequency: DataFrame) -> DataFrame:
    """(node, frequency): members of both kernels; to be ordered by frequency downwards, then node. Without one it is 0."""
    both = a.select("node").distinct().join(b.select("node").distinct(), "node")
    return both.join(frequency, "node", "left").select("node", F.coalesce("frequency", F.lit(0)).alias("frequency"))


def consequences(edges: DataFrame, root, depth: int = 4, attenuation: float = 0.7, floor: float = 0.05) -> DataFrame:
    """(node, hop, confidence): what follows from ``root`` by edges (src, dst, ratio), ratio the share of predictions that
    evidence bears out. A step multiplies by the attenuation and the ratio, 1 at the most; what falls below the floor is cut.
    A node is met once, at its first hop with its best confidence; the tree is walked by levels."""
    seen = frontier = cut(edges.sparkSession.createDataFrame([(root, 0, 1.0)], "node long, hop int, confidence double"))
    for h in range(1, depth + 1):
        able = frontier.where(F.col("confidence") * attenuation >= floor)
        child = F.col("confidence") * attenuation * F.greatest(F.least("ratio", F.lit(1.0)), F.lit(0.0))
        step = able.join(edges, able["node"] == edges["src"]).groupBy(F.col("dst").alias("node")).agg(F.max(child).alias("confidence")).where(F.col("confidence") >= floor)
        frontier = cut(step.join(seen.select("node"), "node", "left_anti").select("node", F.lit(h).alias("hop"), "confidence"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.where("hop > 0")


def eigenvector_centrality(edges: DataFrame, most: int = 100, tolerance: float | None = 1e-6) -> DataFrame:
    """(node, centrality): power iteration on the undirected weights plus the identity. Without a tolerance ``most`` steps are
    taken; with one, not converging within them raises. Each step is one join and one aggregation by node."""
    both = edges.select("src", "dst", "weight").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    both = cut(both.groupBy("src", "dst").agg(F.sum("weight").alias("weight")))
    v = cut(both.select(F.col("src").alias("node")).distinct().withColumn("x", F.lit(1.0)))
    n = v.count()
    if n < 2:
        raise ValueError("a centrality needs two nodes")
    norm = n**0.5
    for _ in range(most):
        push = both.join(v.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("weight") * F.col("x") / norm).alias("p"))
        new = cut(v.join(push, "node", "left").select("node", (F.col("x") / norm).alias("old"), (F.col("x") / norm + F.coalesce("p", F.lit(0.0))).alias("x")))
        norm = new.agg(F.sum(F.col("x") * F.col("x"))).first()[0] ** 0.5
        v = new.select("node", "x")
        if tolerance is not None and new.agg(F.sum((F.col("x") / norm - F.col("old")) ** 2)).first()[0] ** 0.5 < tolerance:
            break
    else:
        if tolerance is not None:
            raise ValueError(f"no convergence in {most} steps")
    return v.select("node", (F.col("x") / norm).alias("centrality"))


def feedback_vertices(edges: DataFrame) -> DataFrame:
    """(node): nodes whose removal leaves no cycle. Nodes without a way in or out go first; then the node of the largest in times
    out degree (ties: the smallest) is chosen, until none is left. Each choice depends on all before it, so the walk is one
    task's: it holds the distinct edges as two numbers each way and is linear in them but for a heap of the nodes."""
    rows = edges.select(F.col("src").cast("long"), F.col("dst").cast("long")).dropna().distinct()

    def walk(batches):
        parts = [(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)) for b in batches]
        yield pa.RecordBatch.from_arrays([pa.array(cycle_cuts(parts), pa.int64())], ["node"])

    return rows.repartition(1).mapInArrow(walk, "node long")


def cycle_cuts(parts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The nodes that ``feedback_vertices`` chooses, of distinct edges in parts (sources, targets), which it empties."""
    names, waiting, size = [np.zeros(0, np.int64)], [], 0
    for part in parts:
        waiting += part
        size += 2 * len(part[0])
        if size > 4_000_000:
            names, waiting, size = [np.unique(np.concatenate(names + waiting))], [], 0
    names = np.unique(np.concatenate(names + waiting))
    n, codes = len(names), ([], [])
    while parts:
        part = parts.pop()
        for kept, ends in zip(codes, part):
            kept.append(np.searchsorted(names, ends).astype(np.int32))
    if not n:
        return names
    src, dst = (np.concatenate(c) for c in codes)
    del codes
    ways = []
    for a, b in ((src, dst), (dst, src)):
        starts = np.concatenate([[0], np.cumsum(np.bincount(a, minlength=n))])
        ways.append((b[np.argsort(a, kind="stable")], starts.tolist(), np.diff(starts)))
    del src, dst
    (to, to_at, out), (by, by_at, into) = ways
    there, chosen = np.ones(n, bool), []
    idle = np.flatnonzero((out == 0) | (into == 0)).tolist()
    heap = (np.arange(n) - into * out * n).tolist()  # one number for the degree product and the node
    heapq.heapify(heap)

    def remove(v: int) -> None:
        there[v] = False
        for near, at, degree in ((to, to_at, into), (by, by_at, out)):
            w = near[at[v] : at[v + 1]]
            w = w[there[w]]
            left = degree[w] - 1
            degree[w] = left
            if not left.all():
                idle.extend(w[left == 0].tolist())

    while True:
        while idle:
            v = idle.pop()
            if there[v]:
                remove(v)
        if not heap:
            return names[np.array(chosen, np.int64)]
        v = heap[0] % n
        if not there[v]:
            heapq.heappop(heap)
            continue
        now = v - int(into[v]) * int(out[v]) * n
        if now != heap[0]:  # products only fall, so an entry that has fallen is put back
            heapq.heapreplace(heap, now)
            continue
        heapq.heappop(heap)
        chosen.append(v)
        remove(v)
