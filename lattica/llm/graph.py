"""Connected components of an edge table, by contraction with tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.store import save


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of ``edges`` (a, b): label is the smallest node reachable, itself included.

    Each round points every node at its smallest neighbour, follows the pointers twice and contracts; the longest path
    shrinks at least fourfold, so rounds grow with the logarithm of the diameter. Nothing is collected: only whether
    edges remain comes to the driver. Null ends and self loops are ignored.
    """
    left = save(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a is not null and b is not null and a <> b").distinct(), "edges")
    found = None
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        points = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("label"))
        points = follow(follow(save(points, "labels")))
        points = save(points, "labels")
        ends = points.select(F.col("node").alias("a"), F.col("label").alias("la"))
        other = points.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        moved = left.join(ends, "a").join(other, "b").where("la <> lb")
        left = save(moved.select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct(), "edges")
        found = points if found is None else save(relabel(found, points), "labels")
    if found is None:
        kind = edges.schema["a"].dataType
        return edges.select(F.col("a").cast(kind).alias("node"), F.col("a").cast(kind).alias("label")).where(F.lit(False))
    return found


def follow(points: DataFrame) -> DataFrame:
    """Every label replaced by its own label."""
    return relabel(points, points)


def relabel(found: DataFrame, points: DataFrame) -> DataFrame:
    step = points.select(F.col("node").alias("label"), F.col("label").alias("further"))
    return found.join(step, "label", "left").select("node", F.coalesce("further", "label").alias("label"))
