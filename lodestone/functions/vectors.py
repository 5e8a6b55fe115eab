"""Vectors as array Columns, in double precision and without Python on the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null where either vector is zero."""
    length = norm(a) * norm(b)
    return F.when(length > 0, dot(a, b) / length)


def literal(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def l1_normalised(v: Column, floor: float = 0.1) -> Column:
    """Components below ``floor`` in size become zero, the rest is divided by its absolute sum; zero stays zero."""
    kept = F.transform(doubles(v), lambda x: F.when(F.abs(x) < floor, 0.0).otherwise(x))
    size = total(F.transform(kept, lambda x: F.abs(x)))
    return F.when(size > 0, F.transform(kept, lambda x: x / size)).otherwise(kept)


def combined(a: Column, b: Column, weight: float = 0.8) -> Column:
    return F.zip_with(doubles(a), doubles(b), lambda x, y: x * weight + y * (1 - weight))


def residual_similarity(a: Column, b: Column, alpha: float = 0.45, *, rewards_alignment: bool = False) -> Column:
    """alpha (2 - cos) + (1 - alpha)(1 - |a - b| / |a|).

    The first part falls as vectors align; ``rewards_alignment`` puts the cosine itself in its place.
    """
    gap = F.zip_with(doubles(a), doubles(b), lambda x, y: x - y)
    direction = cosine(a, b) if rewards_alignment else 2 - cosine(a, b)
    return alpha * direction + (1 - alpha) * (1 - norm(gap) / norm(a))


def padded(v: Column, size: int) -> Column:
    """Cut or filled with zeros to ``size``."""
    return F.slice(F.concat(doubles(v), F.array_repeat(F.lit(0.0), size)), 1, size)


def parsed(text: Column) -> Column:
    return F.from_json(text, "array<double>")


def mean_by(df: DataFrame, keys: list[str], vector: str, name: str = "vector") -> DataFrame:
    """The mean vector of each group: components are averaged one by one, so that partial sums are all that moves."""
    parts = df.select(*keys, F.posexplode(doubles(F.col(vector))).alias("_i", "_x")).groupBy(*keys, "_i").agg(F.avg("_x").alias("_m"))
    return parts.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_m"))), lambda s: s["_m"]).alias(name))


def nearest(df: DataFrame, vector: str, query: list[float], k: int, id_col: str, threshold: float | None = None) -> DataFrame:
    """The k rows of largest cosine, ties to the smaller id; then those at ``threshold`` or more."""
    top = df.withColumn("similarity", cosine(F.col(vector), literal(query))).filter(F.col("similarity").isNotNull()).orderBy(F.col("similarity").desc(), id_col).limit(k)
    return top if threshold is None else top.filter(F.col("similarity") >= threshold)
