"""Similarity metrics of vectors that arrive as a stream, from accumulators that merge.

The cosines of all pairs of a set of unit vectors have sums that follow from a few sums over the vectors: their number, their sum, and the matrix of
their products. These are kept as keyed state (`transformWithStateInPandas`), dealt to `parts` keys so that no task has all rows. After each micro-batch the parts
that changed are appended to a table; `moments` adds up the last state of each. So the result after any split of the input into
batches is that of `alignment.similarity_moments` over all of it. Pairs of one label have states of their own: sums by label.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

STATE = "n long, own double, own2 double, total array<double>, products array<double>"
PARTS = 32


class Accumulated(StatefulProcessor):
    """State of a key: rows, sums of squared lengths and of their squares, sum of the vectors, and the upper triangle of the sum of their products."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("sums", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kept = self.state.get() if self.state.exists() else None
        n, own, own2, total, products = (kept[0], kept[1], kept[2], np.array(kept[3]), np.array(kept[4])) if kept else (0, 0.0, 0.0, 0.0, 0.0)
        for frame in rows:
            x = np.array(frame["vec"].tolist(), np.float64)
            if not len(x):
                continue
            x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
            q = (x * x).sum(1)
            n, own, own2 = n + len(x), own + q.sum(), own2 + (q * q).sum()
            total, products = total + x.sum(0), products + (x.T @ x)[np.triu_indices(x.shape[1])]
        if not n:
            return
        self.state.update((int(n), float(own), float(own2), total.tolist(), products.tolist()))
        yield pd.DataFrame({"kind": [key[0]], "key": [key[1]], "n": [n], "own": [own], "own2": [own2], "total": [total.tolist()], "products": [products.tolist()]})

    def close(self) -> None:
        pass


def accumulate(stream: DataFrame, target: str, checkpoint: str, parts: int = PARTS, available_now: bool = True) -> StreamingQuery:
    """stream: row, label, vec. Appends the states that each micro-batch changed to the table target. A batch that runs again replaces what it wrote."""
    every = F.struct(F.lit("all").alias("kind"), F.pmod(F.xxhash64("row"), F.lit(parts)).alias("key"))
    label = F.struct(F.lit("label").alias("kind"), F.col("label").cast("long").alias("key"))
    keyed = stream.select(F.explode(F.array(every, label)).alias("k"), F.col("vec").cast("array<double>").alias("vec")).select("k.kind", "k.key", "vec")
    states = keyed.groupBy("kind", "key").transformWithStateInPandas(statefulProcessor=Accumulated(), outputStructType=f"kind string, key long, {STATE}", outputMode="Update", timeMode="None")

    def append(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{target}/at={number}")

    writer = states.writeStream.foreachBatch(append).outputMode("update").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def moments(spark: SparkSession, target: str) -> DataFrame:
    """mean_cosine, stddev_cosine, mean_same_label, stddev_same_label of all that has arrived, as `alignment.similarity_moments` returns them."""
    states = spark.read.parquet(target)
    last = states.groupBy("kind", "key").agg(F.max_by(F.struct("n", "own", "own2", "total", "products"), "batch").alias("s")).select("kind", "key", "s.*")
    # a label is a group of its own; the parts of all rows are one group
    group = F.when(F.col("kind") == "label", F.col("key"))
    d2 = lambda at: F.transform("products", lambda x, i: F.struct((i + at).alias("at"), x.alias("x")))
    # by element: parts are added before anything is squared
    cells = last.select("kind", group.alias("group"), F.size("total").alias("d"), F.explode(F.concat(F.transform("total", lambda x, i: F.struct((-1 - i).alias("at"), x.alias("x"))), d2(0))).alias("e"))
    added = cells.groupBy("kind", "group", "d", "e.at").agg(F.sum("e.x").alias("x"))
    # where the diagonal of the triangle is: elements off it stand for two
    i = F.transform(F.sequence(F.lit(0), F.col("d") - 1), lambda r: r * F.col("d") - (r * (r - 1) / 2).cast("int"))
    weight = F.when(F.array_contains(i, F.col("at")), 1.0).otherwise(2.0)
    squares = added.groupBy("kind", "group").agg(F.sum(F.when(F.col("at") < 0, F.col("x") ** 2).otherwise(0.0)).alias("line"), F.sum(F.when(F.col("at") >= 0, weight * F.col("x") ** 2).otherwise(0.0)).alias("square"))
    counts = last.groupBy("kind", group.alias("group")).agg(*[F.sum(c).alias(c) for c in ("n", "own", "own2")])
    both = counts.join(squares.withColumnsRenamed({"kind": "k", "group": "g"}), (F.col("kind") == F.col("k")) & F.col("group").eqNullSafe(F.col("g")))
    sums = both.groupBy("kind").agg(F.sum(F.col("n") * (F.col("n") - 1)).alias("p"), F.sum(F.col("line") - F.col("own")).alias("s"), F.sum(F.col("square") - F.col("own2")).alias("q"))
    out = []
    for kind, names in (("all", ("mean_cosine", "stddev_cosine")), ("label", ("mean_same_label", "stddev_same_label"))):
        of = lambda c: F.coalesce(F.max(F.when(F.col("kind") == kind, F.col(c))), F.lit(0.0))  # noqa: B023, E731
        pairs, mean = of("p"), of("s") / F.greatest(of("p"), F.lit(1.0))
        deviation = F.sqrt(F.greatest(of("q") / F.greatest(pairs, F.lit(1.0)) - mean * mean, F.lit(0.0)))
        out += [mean.alias(names[0]), deviation.alias(names[1])]
    return sums.agg(*out)
