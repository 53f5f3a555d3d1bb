"""Splits of rows over sets and views."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from augsearch.operators.ranges import numbered


def check_fractions(fractions: list[float], n: int | None = None) -> None:
    if n is not None and len(fractions) != n:
        raise ValueError(f"{n} fractions are needed")
    if abs(sum(fractions) - 1) > 1e-9 or min(fractions) < 0:
        raise ValueError("fractions must sum to 1")


def split_counts(n: int, fractions: list[float]) -> list[int]:
    """Whole parts of n; what is left goes to the first parts that are not zero, one each."""
    check_fractions(fractions)
    counts = [int(f * n) for f in fractions]
    used = [i for i, f in enumerate(fractions) if f > 0]
    for i in range(n - sum(counts)):
        counts[used[i % len(used)]] += 1
    return counts


def split(rows: DataFrame, order: str, fractions: list[float], seed: int | None = None) -> DataFrame:
    """rows with split (the number of the part): ranges of the order, or of a seeded hash order. Cuts are found by counts, not by chance."""
    counts = split_counts(rows.count(), fractions)
    keyed = rows.withColumn("_key", F.struct(order) if seed is None else F.struct(F.xxhash64(order, F.lit(seed)), order))
    ends, total = [], 0
    for c in counts:
        total += c
        ends.append(total)
    # a cut is a value of the key: found once, then rows are compared with it where they are
    ranked = numbered(keyed.select("_key"), ["_key"], name="r").filter(F.col("r").isin([e for e in ends[:-1]])).orderBy("r").collect() if len(counts) > 1 else []
    expression = F.lit(len(counts) - 1)
    by_rank = {x.r: x._key for x in ranked}
    for i in range(len(counts) - 2, -1, -1):
        key = by_rank.get(ends[i])
        if key is None:  # the cut is at the end
            expression = F.lit(i)
            continue
        expression = F.when(F.col("_key") < F.struct(*[F.lit(v) for v in key]).cast(keyed.schema["_key"].dataType), i).otherwise(expression)
    return keyed.withColumn("split", expression).drop("_key")


def one_view(rows: DataFrame, view: int) -> DataFrame:
    """All rows through one view."""
    return rows.withColumn("view", F.lit(view))


def view_order(views: DataFrame, reference: str) -> DataFrame:
    """views: name, dim -> in order: the reference first, then by dimension and name; nth from 1."""
    w = Window.orderBy(F.desc(F.col("name") == reference), "dim", "name")
    return views.withColumn("nth", F.row_number().over(w))
