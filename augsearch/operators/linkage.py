"""Agglomerative clustering by average linkage as joins and sums.

A table holds, for each pair of clusters, the sum of the distances between their members, which adds up when clusters merge (the
Lance-Williams update of average linkage). In a round all pairs that are each other's nearest merge at once: average linkage is reducible,
so these merges are part of the tree whatever else merges first. Pairs shrink by every round. The tree is then cut: its highest merges are left out.

Work grows with the square of the number of rows, as it does by definition: a view of n rows has n (n - 1) / 2 pairs of 32 bytes,
made by blocks. Rounds end in written tables, so a lost executor costs one round at most.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from augsearch.functions.storage import written
from augsearch.operators.ranges import numbered

#: Rows of a block of vectors.
BLOCK = 512


def _nodes(rows: DataFrame) -> DataFrame:
    """node (numbers in the order of column_id), column_id, v."""
    points = rows.select("column_id", F.col("embedding").cast("array<double>").alias("v"))
    return numbered(points, ["column_id"], name="node").select(F.col("node").cast("long").alias("node"), "column_id", "v")


def pair_distances(nodes: DataFrame, block: int = BLOCK) -> DataFrame:
    """a, b (a < b), sum: the Euclidean distance of every pair of nodes. Each pair of blocks is one group."""
    n = nodes.count()
    blocks = max(1, -(-n // block))
    mine = F.floor(F.col("node") / block).cast("int")
    dealt = nodes.select("node", "v", mine.alias("own"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other"))
    tiles = dealt.select("node", "v", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def distances(tile: pa.Table) -> pa.Table:
        tile = tile.sort_by("node").combine_chunks()
        node, own = tile["node"].to_numpy(), tile["own"].to_numpy()
        x = np.array(tile["v"].to_pylist(), np.float64)
        first, last = own == tile["i"][0].as_py(), own == tile["j"][0].as_py()
        # each coordinate is subtracted, so that near points lose no digits
        one, two = x[first], x[last]
        d = np.zeros((len(one), len(two)))
        for k in range(x.shape[1]):
            d += (one[:, k, None] - two[None, :, k]) ** 2
        i, j = np.nonzero(node[first][:, None] < node[last][None, :])
        return pa.table({"a": node[first][i], "b": node[last][j], "sum": np.sqrt(d[i, j])})

    return tiles.groupBy("i", "j").applyInArrow(distances, "a long, b long, sum double")


def merges(nodes: DataFrame, block: int = BLOCK) -> DataFrame:
    """low, high, height, round: the tree; the cluster of node `high` is absorbed by that of `low`, both named by their least node."""
    pairs = pair_distances(nodes, block).select("a", "b", "sum", F.lit(1).cast("long").alias("n_a"), F.lit(1).cast("long").alias("n_b"))
    out, step = None, 0
    while True:
        pairs = written(pairs, "linkage-pairs")
        height = F.round(F.col("sum") / (F.col("n_a") * F.col("n_b")), 12)
        ranked = pairs.select(F.struct(height.alias("height"), F.col("a").alias("low"), F.col("b").alias("high"), "n_a", "n_b").alias("pair"))
        nearest = ranked.select(F.explode(F.array("pair.low", "pair.high")).alias("node"), "pair").groupBy("node").agg(F.min("pair").alias("pair"))
        # of both it is the nearest
        mutual = nearest.groupBy("pair").count().filter("count = 2").select("pair.*")
        mutual = written(mutual.select("low", "high", "height", (F.col("n_a") + F.col("n_b")).alias("n"), F.lit(step).alias("round")), "linkage-merges")
        if not mutual.limit(1).count():
            return out
        out = mutual if out is None else out.unionByName(mutual)
        became = mutual.select(F.explode(F.array("low", "high")).alias("old"), F.col("low").alias("new"), "n")
        for side in ("a", "b"):
            names = became.select(F.col("old").alias(side), F.col("new").alias(f"new_{side}"), F.col("n").alias(f"more_{side}"))
            pairs = pairs.join(names, side, "left").withColumns({side: F.coalesce(f"new_{side}", side), f"n_{side}": F.coalesce(f"more_{side}", f"n_{side}")}).drop(f"new_{side}", f"more_{side}")
        ends = F.when(F.col("a") < F.col("b"), F.struct("a", "b", "n_a", "n_b")).otherwise(F.struct(F.col("b").alias("a"), F.col("a").alias("b"), F.col("n_b").alias("n_a"), F.col("n_a").alias("n_b")))
        pairs = pairs.filter("a <> b").select(ends.alias("ends"), "sum").groupBy("ends").agg(F.sum("sum").alias("sum")).select("ends.a", "ends.b", "sum", "ends.n_a", "ends.n_b")
        step += 1


def average_linkage(rows: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """column_id, cluster (0 to k - 1, by the least column_id of each). rows: column_id, embedding; no more clusters than rows.

    Heights are compared after rounding to 12 digits; ties go by the least column_ids."""
    nodes = written(_nodes(rows), "linkage-nodes")
    n = nodes.count()
    k = min(k, n)
    roots = nodes.select("node", F.col("node").alias("root"))
    if k < n:
        tree = merges(nodes, block)
        cut = tree.orderBy(F.desc("height"), F.desc("round"), F.desc("low")).limit(k - 1).select("high")  # k - 1 rows
        kept = tree.join(cut, "high", "left_anti")
        roots = nodes.select("node").join(kept.select(F.col("high").alias("node"), F.col("low").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("root"))
        while True:  # chains halve in each round
            roots = written(roots, "linkage-roots")
            onward = roots.filter("node <> root").select(F.col("node").alias("root"), F.col("root").alias("further"))
            nearer = roots.join(onward, "root", "left")
            if not nearer.filter("further is not null").limit(1).count():
                break
            roots = nearer.select("node", F.coalesce("further", "root").alias("root"))
    names = roots.select("root").distinct().withColumn("cluster", F.row_number().over(Window.orderBy("root")) - 1)  # k rows
    return nodes.select("node", "column_id").join(roots, "node").join(names, "root").select("column_id", F.col("cluster").cast("int").alias("cluster"))
