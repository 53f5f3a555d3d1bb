"""Curation: a small subset of columns that stands for all, and reports on its density."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from augsearch.functions.storage import written
from augsearch.functions.vectors import normalised, squared_distance, squared_distances
from augsearch.operators.retrieval import nearest
from augsearch.operators.vector_index import VectorIndex


def size_of(k: int | float, n: int) -> int:
    """A count, or (a float up to 1) a share of n."""
    if k <= 0:
        raise ValueError("k must be positive")
    out = int(k * n) if isinstance(k, float) and k <= 1 else int(k)
    if not 0 < out <= n:
        raise ValueError(f"k = {k} of {n} rows")
    return out


def _random(seed: int, id_: str = "column_id") -> Column:
    return F.xxhash64(F.col(id_), F.lit(seed))


@dataclass(frozen=True)
class RandomSampling:
    alias: str = "random"

    def curate(self, x: DataFrame, k: int, seed: int) -> DataFrame:
        """x: column_id, embedding -> column_id, sel_order (from 0)."""
        chosen = x.select("column_id", _random(seed).alias("r")).orderBy("r", "column_id").limit(k)
        return chosen.select("column_id", (F.row_number().over(Window.orderBy("r", "column_id")) - 1).alias("sel_order"))


def grid_cells(x: DataFrame, grid_size: int) -> DataFrame:
    """column_id, cell: each dimension cut to grid_size equal ranges."""
    if grid_size <= 0:
        raise ValueError("the grid size must be positive")
    points = x.select("column_id", F.posexplode("embedding").alias("pos", "v"))
    ends = points.groupBy("pos").agg(F.min("v").alias("low"), F.max("v").alias("high"))
    share = F.least(F.greatest((F.col("v") - F.col("low")) / F.greatest(F.col("high") - F.col("low"), F.lit(float(np.finfo(np.float64).eps))), F.lit(0.0)), F.lit(1 - 1e-12))
    bin_ = F.least(F.greatest(F.floor(share * grid_size), F.lit(0)), F.lit(grid_size - 1))
    binned = points.join(F.broadcast(ends), "pos").select("column_id", F.struct("pos", bin_.alias("bin")).alias("p"))  # a row for each dimension
    return binned.groupBy("column_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("p")), lambda p: p["bin"].cast("string")), ",").alias("cell"))


@dataclass(frozen=True)
class GridSampling:
    """Rounds over the occupied cells in random order; each round takes one more member of each cell."""

    alias: str = "grid"
    grid_size: int = 4

    def curate(self, x: DataFrame, k: int, seed: int) -> DataFrame:
        if self.grid_size == 1:
            return RandomSampling().curate(x, k, seed)
        cells = grid_cells(x, self.grid_size)
        turn = F.row_number().over(Window.partitionBy("cell").orderBy(_random(seed), "column_id"))
        order = [F.col("turn"), F.xxhash64("cell", F.col("turn"), F.lit(seed)), F.col("cell")]
        chosen = cells.withColumn("turn", turn).orderBy(*order).limit(k)
        return chosen.select("column_id", (F.row_number().over(Window.orderBy(*order)) - 1).alias("sel_order"))


#: Rows that come to the driver in a pass, about; chosen rows after which the state is written anew.
POOL, WRITTEN_AFTER = 2048, 256


def _distances(x: np.ndarray, c: np.ndarray, metric: str) -> np.ndarray:
    """Of each row to one choice; rounded, so that equal rows are equally far."""
    return np.round(1 - x @ c if metric == "cosine" else np.sqrt(((x - c) ** 2).sum(1)), 12)


def farthest_first(rows: DataFrame, k: int, first: tuple, metric: str = "euclidean", pool: int = POOL) -> tuple[list[str], int]:
    """The chosen column_ids in order, and how many passes over the rows that took. rows: column_id, v; first: (column_id, v) of the first choice.

    Each pass lowers the rows' distances by all choices since the one before, and each task gives its farthest rows and the distance of
    the next one. Rows that are not given are no farther than the largest of those, the bound. Choices are made among the given rows, whose
    distances are kept up to date, as long as the farthest of them is beyond the bound: then it is the farthest of all. So a pass
    yields many choices, and they are those of choosing one at a time.
    """
    spark = rows.sparkSession
    state, since, passes = written(rows.withColumn("d", F.lit(float("inf"))), "farthest"), [first], 0
    chosen = [first[0]]
    while len(chosen) < k:
        shared = spark.sparkContext.broadcast(([i for i, _ in since], np.array([c for _, c in since], np.float64)))  # WRITTEN_AFTER + pool rows at most

        def lowered(batches, shared=shared):
            for b in batches:
                if b.num_rows:
                    x, d = np.array(b.column(1).to_pylist(), np.float64), np.asarray(b.column(2)).copy()
                    for c in shared.value[1]:
                        np.minimum(d, _distances(x, c, metric), out=d)
                    d[np.isin(np.array(b.column(0).to_pylist(), object), shared.value[0])] = -np.inf  # chosen already
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(d)], names=["column_id", "v", "d"])

        now = state.mapInArrow(lowered, "column_id string, v array<double>, d double")
        if len(since) > WRITTEN_AFTER:
            state, since = written(now, "farthest"), []
            now = state
        most = max(1, pool // max(1, spark.sparkContext.defaultParallelism))

        def farthest(batches):
            kept = pa.table({"column_id": pa.array([], pa.string()), "v": pa.array([], pa.list_(pa.float64())), "d": pa.array([], pa.float64())})
            for b in batches:
                kept = pa.concat_tables([kept, pa.Table.from_batches([b]).cast(kept.schema)]).sort_by([("d", "descending"), ("column_id", "ascending")]).slice(0, most + 1)
            rest = pa.array([i == most for i in range(kept.num_rows)])  # one more, for the bound
            yield from kept.append_column("rest", rest).combine_chunks().to_batches()

        found = now.mapInArrow(farthest, "column_id string, v array<double>, d double, rest boolean").collect()  # about pool rows
        passes += 1
        bound = max((r.d for r in found if r.rest), default=-np.inf)
        given = sorted((r for r in found if not r.rest and r.d > -np.inf), key=lambda r: r.column_id)
        if not given:
            break
        x, d = np.array([r.v for r in given], np.float64), np.array([r.d for r in given])
        picked = 0
        while len(chosen) < k:
            at = int(d.argmax())  # of equals the first id
            if picked and d[at] <= bound or d[at] == -np.inf:
                break
            chosen.append(given[at].column_id)
            since.append((given[at].column_id, x[at]))
            d, picked = np.minimum(d, _distances(x, x[at], metric)), picked + 1
            d[at] = -np.inf
    return chosen, passes


@dataclass(frozen=True)
class FarthestFirst:
    """Greedy k-centre: always the row farthest from all that are chosen; ties by column_id. Many choices come from one pass (`farthest_first`)."""

    alias: str = "fft"
    metric: str = "euclidean"

    def curate(self, x: DataFrame, k: int, seed: int, start: str | None = None) -> DataFrame:
        spark = x.sparkSession
        v = normalised(F.col("embedding")) if self.metric == "cosine" else F.col("embedding").cast("array<double>")
        rows = written(x.select("column_id", v.alias("v")), "farthest-rows")
        first = rows.filter(F.col("column_id") == start).first() if start is not None else rows.orderBy(_random(seed), "column_id").first()
        chosen, _ = farthest_first(rows, k, (first.column_id, first.v), self.metric)
        return spark.createDataFrame([(c, i) for i, c in enumerate(chosen)], "column_id string, sel_order int")


@dataclass(frozen=True)
class KMedoids:
    """Voronoi iteration: assign to the nearest medoid, then take of each cluster the member of least total distance.

    The total distance to a cluster is a function of sums for the squared Euclidean and cosine metrics, so no cluster is gathered.
    """

    alias: str = "kmedoids"
    metric: str = "euclidean"
    max_iters: int = 100

    def curate(self, x: DataFrame, k: int, seed: int) -> DataFrame:
        spark = x.sparkSession
        v = normalised(F.col("embedding")) if self.metric == "cosine" else F.col("embedding").cast("array<double>")
        rows = x.select("column_id", v.alias("v")).cache()
        medoids = rows.orderBy(_random(seed), "column_id").limit(k).collect()  # k rows
        for _ in range(self.max_iters):
            centres = spark.sparkContext.broadcast((np.array([m.v for m in medoids]), self.metric))

            def assign(batches, centres=centres):
                c, metric = centres.value
                for b in batches:
                    if b.num_rows:
                        p = np.array(b.column(1).to_pylist())
                        d = 1 - p @ c.T if metric == "cosine" else squared_distances(p, c)
                        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(d.argmin(1).astype(np.int32))], names=["column_id", "v", "cluster"])

            assigned = rows.mapInArrow(assign, "column_id string, v array<double>, cluster int")
            sums = assigned.select("cluster", F.posexplode("v").alias("pos", "x")).groupBy("cluster", "pos").agg(F.avg("x").alias("x"))
            means = sums.groupBy("cluster").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("mean"))
            # least total (squared Euclidean or cosine) distance to the cluster = nearest to its mean, or of largest product with it
            badness = squared_distance(F.col("v"), F.col("mean")) if self.metric != "cosine" else -F.aggregate(F.zip_with("v", "mean", lambda a, b: a * b), F.lit(0.0), lambda s, p: s + p)
            best = assigned.join(F.broadcast(means), "cluster").groupBy("cluster").agg(F.min(F.struct(badness.alias("bad"), "column_id", "v")).alias("m")).orderBy("cluster").collect()
            new = [b.m for b in best]
            used = {m.column_id for m in new}
            if len(new) < k:  # an empty cluster gets a random row that is no medoid
                new += rows.filter(~F.col("column_id").isin(list(used))).orderBy(_random(seed + 1), "column_id").limit(k - len(new)).collect()
            if {m.column_id for m in new} == {m.column_id for m in medoids}:
                break
            medoids = new
        rows.unpersist()
        return spark.createDataFrame([(m.column_id, i) for i, m in enumerate(sorted(medoids, key=lambda m: m.column_id))], "column_id string, sel_order int")


def reduced(x: DataFrame, components: int | float) -> DataFrame:
    """Principal components of the centred vectors: so many, or enough for a share of the variance."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = x.select("column_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("raw"))
    centred = StandardScaler(inputCol="raw", outputCol="centred", withMean=True, withStd=False).fit(rows).transform(rows)
    d = len(x.first().embedding)
    k = d if isinstance(components, float) else components
    model = PCA(k=k, inputCol="centred", outputCol="pca").fit(centred)
    if isinstance(components, float):
        k = int(np.searchsorted(np.cumsum(model.explainedVariance.toArray()), components - 1e-12) + 1)
    return model.transform(centred).select("column_id", F.slice(vector_to_array("pca"), 1, k).alias("embedding"))


def density(reference: DataFrame, subset: DataFrame, k: int = 15, space: str = "l2", index: VectorIndex | None = None) -> DataFrame:
    """query_id, distance (to the k-th nearest reference row), density. Rows of the subset may find themselves. index: of the reference, if there is one."""
    asked = subset.select(F.col("column_id").alias("query_id"), "embedding")
    found = index.nearest(asked, k) if index else nearest(asked, reference.select(F.col("column_id").alias("candidate_id"), "embedding"), k, space)
    return found.filter(F.col("rank") == k).select("query_id", "distance", (1 / (F.col("distance") + 1e-12)).alias("density"))


def density_report(reference: DataFrame, subset: DataFrame, column: str = "density") -> DataFrame:
    """Mean, median and quantiles of both, the share of the subset at or below the reference's lowest tenth, and their distance."""
    r = reference.agg(F.avg(column).alias("ref_mean"), F.median(column).alias("ref_median"), F.percentile(column, 0.1).alias("ref_q10"), F.percentile(column, 0.9).alias("ref_q90"))
    s = subset.agg(F.avg(column).alias("mean"), F.median(column).alias("median"), F.percentile(column, 0.1).alias("q10"), F.percentile(column, 0.9).alias("q90"))
    outliers = subset.join(F.broadcast(r)).agg(F.avg((F.col(column) <= F.col("ref_q10")).cast("double")).alias("outlier_rate"))  # r is one row
    return r.join(s).join(outliers).join(wasserstein(reference.select(column), subset.select(column)))  # one row each


def wasserstein(a: DataFrame, b: DataFrame) -> DataFrame:
    """The 1-D Wasserstein distance of two samples: |F - G| over the sorted union of their distinct values."""
    one, two = a.toDF("x").filter("x is not null"), b.toDF("x").filter("x is not null")
    sizes = one.agg(F.count("*").alias("n_a")).join(two.agg(F.count("*").alias("n_b")))
    both = one.select("x", F.lit(1).alias("a"), F.lit(0).alias("b")).union(two.select("x", F.lit(0), F.lit(1))).groupBy("x").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    # running sums by ranges of about equal size: each range adds the totals of those before it
    edges = both.agg(F.percentile_approx("x", [i / 64 for i in range(1, 64)], 10_000)).first()[0] or []
    ranged = both.withColumn("range", sum((F.col("x") > e).cast("int") for e in sorted(set(edges))) if edges else F.lit(0))
    ends = ranged.groupBy("range").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.min("x").alias("first"))  # 64 rows at most
    w = Window.orderBy("range")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("range", F.coalesce(F.sum("a").over(before), F.lit(0)).alias("a0"), F.coalesce(F.sum("b").over(before), F.lit(0)).alias("b0"), F.lead("first").over(w).alias("next"))
    own = Window.partitionBy("range").orderBy("x")
    upto = own.rowsBetween(Window.unboundedPreceding, 0)
    steps = ranged.join(F.broadcast(ends), "range").withColumns({"f": F.sum("a").over(upto) + F.col("a0"), "g": F.sum("b").over(upto) + F.col("b0"), "width": F.coalesce(F.lead("x").over(own), F.col("next")) - F.col("x")})
    return steps.join(F.broadcast(sizes)).agg(F.coalesce(F.sum(F.abs(F.col("f") / F.col("n_a") - F.col("g") / F.col("n_b")) * F.col("width")), F.lit(0.0)).alias("wasserstein"))
