"""Vector files (fbin: uint32 rows, uint32 dimensions, float32 values; i8bin and i32bin alike) and text sources."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = {"fbin": np.float32, "i8bin": np.int8, "i32bin": np.int32}


def read_vectors(spark: SparkSession, path: str, kind: str = "fbin", block: int = 65_536) -> DataFrame:
    """(file, row, embedding) of every vector in the files at ``path``; a wrong length raises."""
    item = KINDS[kind]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for file, content in zip(part["path"], part["content"], strict=True):
                n, d = (int(x) for x in np.frombuffer(content, np.uint32, 2))
                if len(content) != 8 + n * d * np.dtype(item).itemsize:
                    raise ValueError(f"{file}: {len(content)} bytes do not hold {n} x {d} vectors")
                data = np.frombuffer(content, item, n * d, 8).reshape(n, d)
                for at in range(0, n, block):
                    rows = data[at : at + block].astype(np.float32)
                    yield pd.DataFrame({"file": file, "row": np.arange(at, at + len(rows)), "embedding": list(rows)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, row long, embedding array<float>")


def slot_columns(df: DataFrame, key: str, vector: str, dimensions: int) -> DataFrame:
    """A dense slot as a column a dimension."""
    return df.select(key, *[F.get(vector, F.lit(i)).alias(f"d{i}") for i in range(dimensions)])


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """(name, labels, value) of Prometheus text exposition; comments and blank lines are skipped."""
    pattern = r"^([A-Za-z_:][A-Za-z0-9_:]*)(\{.*\})?\s+(\S+)"
    lines = spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    cells = [F.regexp_extract("value", pattern, i) for i in (1, 2, 3)]
    return lines.select(cells[0].alias("name"), cells[1].alias("labels"), cells[2].try_cast("double").alias("value")).where("name <> ''")
