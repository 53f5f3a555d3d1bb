"""Connected components of a table of links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from augsearch.llm.common import written


#: Nodes that a task holds while it joins its own links.
HELD = 500_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links -> fewer ones that connect the same nodes: within a task, each node to the least of its tree."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    def out():
        pairs = [(r, x) for x in up if (r := root(x)) != x]
        up.clear()
        for i in range(0, len(pairs), 50_000):
            u, v = zip(*pairs[i : i + 50_000])
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    for b in batches:
        for x, y in np.unique(np.stack([np.asarray(b.column(0)), np.asarray(b.column(1))], 1), axis=0).tolist():
            up.setdefault(x, x)
            up.setdefault(y, y)
            if (x := root(x)) != (y := root(y)):
                up[max(x, y)] = min(x, y)
        if len(up) > HELD:
            yield from out()
    yield from out()


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """links: a, b (long). -> node, component: the least node reachable, for each node that has a link.

    Each task first joins its own links to trees. Then large and small stars alternate: each node's larger, then smaller neighbours are linked to the least
    one it knows. Stars come from an aggregation and a join, whose hot nodes Spark splits, and each round goes to a table,
    so no node's neighbours are gathered anywhere. Ends when a round changes nothing.
    """
    edges = written(links.select("a", "b").filter("a <> b").mapInArrow(_forest, "u long, v long").distinct(), f"{name}-0")
    state, rounds = None, 0
    while True:
        both = edges.select(F.col("u").alias("n"), F.col("v").alias("m")).union(edges.select("v", "u"))
        least = both.groupBy("n").agg(F.least(F.min("m"), F.col("n")).alias("least"))
        # large star: a larger neighbour m of n is linked to the least that n knows
        large = edges.select(F.col("u").alias("n"), F.col("v").alias("m")).join(least, "n").select(F.col("least").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # small star: n and its smaller neighbours are linked to the least of them
        below = large.groupBy("v").agg(F.min("u").alias("least"))
        small = large.join(below, "v").select(F.explode(F.array(F.struct(F.col("least").alias("u"), F.col("u").alias("v")), F.struct(F.col("least").alias("u"), F.col("v").alias("v")))).alias("e")).select("e.u", "e.v").filter("u <> v").distinct()
        rounds += 1
        edges = written(small, f"{name}-{rounds}")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    return edges.select(F.col("v").alias("node"), F.col("u").alias("component")).union(edges.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())
