"""Scans, predicates, key lookups, reference joins and set operations over collections held as tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.NumericType, T.TimestampType, T.TimestampNTZType)


def predicate(df: DataFrame, field: str, op: str, value) -> Column:
    """eq ne gt gte lt lte contains. A missing field fails all; NULL or another type passes ``ne`` alone. Numbers and
    times compare as double, texts by bytes."""
    if field not in df.columns:
        return F.lit(False)
    col, kind = F.col(field), df.schema[field].dataType
    if isinstance(kind, NUMERIC):
        if not isinstance(value, (int, float)) or isinstance(value, bool):
            return F.lit(op == "ne")
        col = (F.unix_micros(col.cast("timestamp")) if not isinstance(kind, T.NumericType) else col).cast("double")
        value = float(value)
    elif isinstance(kind, T.StringType) and not isinstance(value, str) or isinstance(kind, T.BooleanType) and not isinstance(value, bool):
        return F.lit(op == "ne")
    made = {
        "eq": lambda: col == F.lit(value), "ne": lambda: ~col.eqNullSafe(F.lit(value)), "gt": lambda: col > F.lit(value), "gte": lambda: col >= F.lit(value),
        "lt": lambda: col < F.lit(value), "lte": lambda: col <= F.lit(value), "contains": lambda: col.contains(value) if isinstance(value, str) else F.lit(False),
    }
    if op not in made:
        raise ValueError(f"unknown operator {op}")
    return F.coalesce(made[op](), F.lit(False))


def where_all(df: DataFrame, predicates: list[tuple[str, str, object]]) -> DataFrame:
    return df.where(reduce(lambda a, b: a & b, (predicate(df, *p) for p in predicates), F.lit(True)))


def key_range(df: DataFrame, key: str, start, end, limit: int | None = None) -> DataFrame:
    """Half-open [start, end) in key order; an inverted range or limit 0 is empty."""
    if limit == 0 or start >= end:
        return df.where(F.lit(False))
    out = df.where((F.col(key) >= F.lit(start)) & (F.col(key) < F.lit(end)))
    return out.orderBy(key).limit(limit) if limit is not None else out


def page(df: DataFrame, key: str, after, limit: int) -> DataFrame:
    return (df if after is None else df.where(F.col(key) > F.lit(after))).orderBy(key).limit(limit)


def predecessor(df: DataFrame, key: str, bound) -> DataFrame:
    """The row of the last key at or below ``bound``."""
    return df.where(F.col(key) <= F.lit(bound)).orderBy(F.desc(key)).limit(1)


def latest(df: DataFrame, keys: list[str], version: str, as_of=None) -> DataFrame:
    """Last version of each key, at ``as_of`` if given; one aggregation with map-side combining, no sort."""
    seen = df if as_of is None else df.where(F.col(version) <= F.lit(as_of))
    rest = [c for c in df.columns if c not in keys]
    got = seen.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(version)).alias("_row"))
    return got.select(*keys, "_row.*").select(*df.columns)


def live_values(df: DataFrame, now) -> DataFrame:
    """Key-value rows whose ``expires_at`` is null or later than ``now``."""
    return df.where(F.col("expires_at").isNull() | (F.col("expires_at") > F.lit(now)))


def join_by_reference(a: DataFrame, b: DataFrame, reference: str, key: str) -> DataFrame:
    """Rows of ``a`` with the row of ``b`` that ``reference`` names; rows without one are left out."""
    if reference not in a.columns:
        raise ValueError(f"missing field {reference}")
    return a.join(b, a[reference] == b[key])


def path_equals(json: Column, path: list[str], value=None, exists_only: bool = False) -> Column:
    """A document's path exists (JSON null exists), or equals ``value``."""
    at = "$" + "".join(f"['{p}']" for p in path)
    found = F.try_variant_get(F.try_parse_json(json), at, "variant")
    return found.isNotNull() if exists_only else F.coalesce(F.try_variant_get(F.try_parse_json(json), at, "string") == F.lit(str(value)), F.lit(False))


def as_of_join(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, value: str) -> DataFrame:
    """For each row of ``left`` the last ``value`` of ``right`` at or before it: one shuffle of the union, a running last."""
    a = left.select(*keys, F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"), F.lit(None).cast(right.schema[value].dataType).alias("_v"))
    b = right.select(*keys, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), F.col(value).alias("_v"))
    w = Window.partitionBy(*keys).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    out = a.unionByName(b).withColumn("_v", F.last("_v", ignorenulls=True).over(w)).where("_side = 1")
    return out.select("_row.*", F.col("_v").alias(value))


def lookahead(df: DataFrame, feature: str, snapshot: str, resolution: str, backfill: str) -> DataFrame:
    """Rows that break feature <= snapshot < resolution <= backfill."""
    ok = (F.col(feature) <= F.col(snapshot)) & (F.col(snapshot) < F.col(resolution)) & (F.col(resolution) <= F.col(backfill))
    return df.where(~F.coalesce(ok, F.lit(False)))


def band_join(a: DataFrame, b: DataFrame, keys: list[str], ta: str, tb: str, width: float) -> DataFrame:
    """All pairs with |ta - tb| < width, by equal cells of that width and the two next to them: no cross product."""
    x = a.select(*keys, F.col(ta).alias("ta"), F.explode(F.array(*[F.floor(F.col(ta) / width) + d for d in (-1, 0, 1)])).alias("_cell"))
    y = b.select(*keys, F.col(tb).alias("tb"), F.floor(F.col(tb) / width).alias("_cell"))
    return x.join(y, [*keys, "_cell"]).where(F.abs(F.col("ta") - F.col("tb")) < width).drop("_cell")


def scope_union(a: tuple[DataFrame, DataFrame], b: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of both sides; edges between the sides are not added."""
    return a[0].union(b[0]).distinct(), a[1].union(b[1]).distinct()


def induced(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = nodes.select(F.col(nodes.columns[0]).alias("_n")).distinct()
    return edges.join(n, edges["src"] == n["_n"], "left_semi").join(n, edges["dst"] == n["_n"], "left_semi")


def scope_intersect(a: DataFrame, b: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Common nodes, and the edges that the full graph has between them."""
    nodes = a.intersect(b)
    return nodes, induced(nodes, edges)


def subtree(df: DataFrame, key: str, json: str, path: list[str]) -> DataFrame:
    """(key, value): the document's subtree at a path as JSON text; documents without it are left out."""
    at = "$" + "".join(f"['{p}']" for p in path)
    return df.select(key, F.to_json(F.try_variant_get(F.try_parse_json(F.col(json)), at, "variant")).alias("value")).where("value is not null")


def consented(df: DataFrame, tags: DataFrame, key: str, purpose: str, now: int) -> DataFrame:
    """Rows whose key has a tag (key, purpose, expires_at) for ``purpose`` that has not run out."""
    ok = live_values(tags.where(F.col("purpose") == purpose), now)
    return df.join(ok.select(key).distinct(), key, "left_semi")


def erase(df: DataFrame, tombstones: DataFrame, key: str) -> DataFrame:
    return df.join(tombstones.select(key).distinct(), key, "left_anti")
