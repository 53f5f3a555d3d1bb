"""Reports over result rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def statistics(rows: DataFrame, by: list[str], value: str, size: str | None = None) -> DataFrame:
    """mean, std (of a sample), low, high, count, spread; and qps where a batch size is named (milliseconds -> rows a second)."""
    v = F.col(value)
    out = rows.groupBy(*by).agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("low"), F.max(v).alias("high"), (F.max(v) - F.min(v)).alias("spread"), F.count(v).alias("n"))
    return out if size is None else out.withColumn("qps", F.col(size) / F.col("mean") * 1000)


def correlation(rows: DataFrame, x: str, y: str) -> DataFrame:
    return rows.dropna(subset=[x, y]).agg(F.corr(x, y).alias("r"), F.count("*").alias("n"))


def ranked(rows: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """A number for each row by value, largest first (ties by name)."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(value), name)))


def average_rank(rows: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    return ranked(rows, by, value, name).groupBy(name).agg(F.avg("rank").alias("average_rank"))


def pivoted(rows: DataFrame, by: str, metric: str, value: str, names: list[str]) -> DataFrame:
    return rows.groupBy(by).pivot(metric, names).agg(F.first(value))


def name_frequency(names: DataFrame, top: int | None = None) -> DataFrame:
    """names: name -> name, n, share; most frequent first."""
    counted = names.groupBy("name").agg(F.count("*").alias("n"))
    total = names.agg(F.count("*").alias("total"))
    out = counted.join(F.broadcast(total)).select("name", "n", (F.col("n") / F.col("total")).alias("share"))  # one row
    return out.orderBy(F.desc("n"), "name") if top is None else out.orderBy(F.desc("n"), "name").limit(top)


def with_density(summary: DataFrame, density: DataFrame) -> DataFrame:
    return summary.join(density, summary.exp_name == density.method, "left").drop("method")
