"""Vector expressions on array columns, evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Dot product in double; NULL if the lengths differ."""
    total = F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), total)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(a), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column, zero: float | None = 0.0) -> Column:
    """Cosine similarity; ``zero`` where a norm is 0."""
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(zero).cast("double")).otherwise(dot(a, b) / n)


def l2_squared(a: Column, b: Column) -> Column:
    total = F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), total)


def normalize(a: Column) -> Column:
    """Unit vector; the zero vector stays."""
    n = norm(a)
    return F.when(n == 0, doubles(a)).otherwise(F.transform(doubles(a), lambda x: x / n))


def hadamard(a: Column, b: Column) -> Column:
    return F.zip_with(doubles(a), doubles(b), lambda x, y: x * y)


def delta(a: Column, b: Column) -> Column:
    return F.zip_with(doubles(a), doubles(b), lambda x, y: x - y)


def max_sim(query: Column, document: Column) -> Column:
    """Late interaction: for each query vector its best cosine among the document's, summed."""
    best = F.transform(query, lambda q: F.array_max(F.transform(document, lambda d: cosine(q, d))))
    return F.aggregate(best, F.lit(0.0), lambda s, x: s + x)


def int8_scale(a: Column) -> Column:
    return F.array_max(F.transform(doubles(a), lambda x: F.abs(x))) / 127


def hash48(*values: Column) -> Column:
    """A hash below 2 ** 48 that other engines can compute as well: the first 12 hex digits of the values' MD5, joined by
    ``|``."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[v.cast("string") for v in values])), 1, 12), 16, 10).cast("long")


def quantize_int8(a: Column) -> Column:
    """Round half to even of x / scale, clamped to +-127; the zero vector gives zeros."""
    s = int8_scale(a)
    return F.when(s == 0, F.transform(doubles(a), lambda x: F.lit(0))).otherwise(
        F.transform(doubles(a), lambda x: F.greatest(F.lit(-127), F.least(F.lit(127), F.bround(x / s).cast("int"))))
    )


def sign_mismatch(a: Column, b: Column) -> Column:
    """Positions whose signs (>= 0) differ."""
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: F.when((x >= 0) != (y >= 0), 1).otherwise(0)), F.lit(0), lambda s, x: s + x)


def binary_dot_estimate(a: Column, b: Column) -> Column:
    return 1 - 2 * sign_mismatch(a, b) / F.size(a)


def signed_log(x: Column) -> Column:
    return F.signum(x) * F.log1p(F.abs(x))
