"""Shared scratch tables, Arrow batch annotation and label sampling for the training-data operators."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (``spark.checkpoint.dir``). Only a local master that names none gets a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        made = tempfile.mkdtemp(prefix="lattica-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(found := f"file://{made}")
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder."""
    return f"{shared_dir(spark)}/lattica/{uuid.uuid4().hex}-{name}"


def save(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it again, so a lost executor costs no recomputation."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def save_dealt(df: DataFrame, name: str, key: str) -> DataFrame:
    """As :func:`save`, dealt by ``key`` over as many buckets as the session has shuffle partitions: a join by ``key`` reads
    it without a shuffle."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    table = f"lattica_{uuid.uuid4().hex}"
    df.write.format("parquet").bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).option("path", path).saveAsTable(table)
    return spark.table(table)


def fresh(name: str, taken: Sequence[str]) -> str:
    """``name``, or with underscores appended until no column of ``taken`` has it (Spark ignores case)."""
    used = {x.lower() for x in taken}
    while name.lower() in used:
        name += "_"
    return name


def annotate(docs: DataFrame, fn: Callable[[list], Sequence], fields: T.StructType, keep: Sequence[str], text: str = "text", block: int = 1000) -> DataFrame:
    """Columns ``keep`` of ``docs`` plus ``fields``, which ``fn`` computes from a list of at most ``block`` whole texts.

    ``fn`` returns one sequence (list, numpy or Arrow array) a field. Batches stream through, so memory is bounded by
    ``block`` texts. Nothing is shuffled. An empty table gives an empty result.
    """
    source = docs.select(*dict.fromkeys([*keep, text]))
    schema = T.StructType([source.schema[k] for k in keep] + list(fields))
    kinds = [to_arrow_type(f.dataType) for f in fields]
    names = [f.name for f in schema]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                made = fn(part.column(text).to_pylist())
                new = [pa.array(x, type=k) if not isinstance(x, pa.Array) else x.cast(k) for x, k in zip(made, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(k) for k in keep] + new, names=names)

    return source.mapInArrow(run, schema)


def fold(n: int, column: str = "doc_id"):
    """crc32 of the id as text, modulo ``n``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % F.lit(n)


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, keep, bound: int) -> DataFrame:
    """At most ``bound`` rows (doc_id, text, y) of documents with a 0/1 label, in the order of a hash of the id.

    Contradicting labels of one id count as the largest; null ids and null labels are ignored. The bound makes the
    id list small enough to broadcast at any size of the corpus.
    """
    ids = (
        labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull() & (F.lit(True) if keep is None else keep))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(column).cast("int")).alias("y"))
    )
    mine = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    chosen = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    return mine.join(F.broadcast(chosen), "doc_id")
