"""Vectors as arrays of double: Column expressions that stay in generated code."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def normalised(v: Column) -> Column:
    n = F.greatest(norm(v), F.lit(1e-12))
    return F.transform(v, lambda x: x / n)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.greatest(norm(a), F.lit(1e-12)) * F.greatest(norm(b), F.lit(1e-12)))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def truncated(v: Column, d: int) -> Column:
    return F.slice(v, 1, d)


def padded(v: Column, d: int) -> Column:
    return F.concat(v, F.array_repeat(F.lit(0.0), F.greatest(F.lit(d) - F.size(v), F.lit(0))))


def pooled(rows: DataFrame, key: str, vector: str, how: str = "mean") -> DataFrame:
    """key, vector: element-wise mean or median (of an even count the midpoint)."""
    if how not in ("mean", "median"):
        raise ValueError(f"unknown aggregation {how!r}")
    f = F.avg if how == "mean" else F.median
    cells = rows.select(key, F.posexplode(vector).alias("pos", "x")).groupBy(key, "pos").agg(f("x").alias("x"))
    return cells.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias(vector))


def squared_distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """rows x centres, for tasks: no array has all three of rows, centres and dimensions."""
    return np.einsum("ij,ij->i", x, x)[:, None] + np.einsum("ij,ij->i", centres, centres) - 2 * x @ centres.T
