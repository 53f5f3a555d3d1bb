"""Sinks of results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_results(df: DataFrame, path: str, fmt: str = "csv", mode: str = "errorifexists") -> None:
    if fmt not in ("csv", "json", "parquet"):
        raise ValueError(f"unknown format {fmt!r}")
    writer = df.write.mode(mode)
    (writer.option("header", True).csv if fmt == "csv" else writer.json if fmt == "json" else writer.parquet)(path)


def summary(df: DataFrame, by: list[str]) -> DataFrame:
    """Mean of each metric column by the given columns."""
    metrics = [c for c, t in df.dtypes if t in ("double", "float") and c not in by]
    return df.groupBy(*by).agg(*[F.avg(c).alias(c) for c in metrics])


def with_literals(df: DataFrame, **literals) -> DataFrame:
    """Columns that name the run: checkpoint, dataset, number of views, view."""
    return df.select("*", *[F.lit(v).alias(k) for k, v in literals.items()])
