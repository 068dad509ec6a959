"""The write side of collections as tables of changes: a read takes the last change of each key; nothing is updated in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def put(rows: DataFrame, seq: Column) -> DataFrame:
    """Rows as changes: ``seq`` orders them, ``deleted`` is false."""
    return rows.withColumn("seq", seq).withColumn("deleted", F.lit(False))


def delete(keys: DataFrame, like: DataFrame, seq: Column) -> DataFrame:
    """Tombstones of ``keys`` with the columns of the changes ``like``."""
    marked = keys.withColumn("seq", seq).withColumn("deleted", F.lit(True))
    return marked.select(*[F.col(f.name) if f.name in marked.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in like.schema])


def current(changes: DataFrame, keys: list[str], at: int | None = None) -> DataFrame:
    """The rows as of sequence ``at`` (default: all): the last change of each key, if it is no tombstone.

    One aggregation with a partial one before the shuffle, so a key that is written often is no hot one.
    """
    seen = changes if at is None else changes.where(F.col("seq") <= at)
    rest = [c for c in changes.columns if c not in keys and c != "seq"]
    last = seen.groupBy(*keys).agg(F.max_by(F.struct("seq", *rest), "seq").alias("_c"))
    return last.where(~F.col("_c.deleted")).select(*keys, F.col("_c.seq").alias("seq"), *[F.col(f"_c.{c}").alias(c) for c in rest if c != "deleted"])


def live(rows: DataFrame, written: Column, ttl: Column, now: Column) -> DataFrame:
    """Rows whose time to live has not passed; a null one never passes."""
    return rows.where(ttl.isNull() | (written + ttl > now))


def cells(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Wide rows as (row, column, value) cells in column order; null cells are absent."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]))
    return df.select(F.col(key).alias("row"), pairs.alias("c")).select("row", "c.column", "c.value").where("value is not null")


def chunks(blobs: DataFrame, key: str, data: str, size: int) -> DataFrame:
    """(key, at, chunk, digest): the blob in pieces of ``size`` bytes; an empty blob has one empty piece."""
    n = F.greatest(F.ceil(F.length(data) / size), F.lit(1))
    at = blobs.where(F.col(data).isNotNull()).select(key, F.col(data).cast("binary").alias("_d"), F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("at"))
    piece = F.substring("_d", 1 + F.col("at").cast("int") * size, F.lit(size))
    return at.select(key, "at", piece.alias("chunk")).withColumn("digest", F.sha2("chunk", 256))


def manifest(pieces: DataFrame, key: str) -> DataFrame:
    """(key, chunks, bytes, root): what a reader checks; the root is the digest of the digests in order. It refuses a blob
    of which a piece is missing or damaged."""
    got = pieces.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", "digest", (F.sha2("chunk", 256) == F.col("digest")).alias("whole")))).alias("p"), F.sum(F.length("chunk")).alias("bytes"))
    whole = F.forall("p", lambda x: x["whole"]) & (F.element_at("p", -1)["at"] == F.size("p") - 1)
    root = F.sha2(F.array_join(F.transform("p", lambda x: x["digest"]), ""), 256)
    return got.select(key, F.size("p").cast("long").alias("chunks"), "bytes", F.when(whole, root).otherwise(F.raise_error(F.lit("damaged blob")).cast("string")).alias("root"))
