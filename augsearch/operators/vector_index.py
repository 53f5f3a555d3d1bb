"""An inverted-file index for exact nearest-neighbour search.

Vectors are dealt to cells by their nearest centre (k-means over a bounded sample; every vector is in the index). The index is two Parquet
tables: the vectors, packed in blocks of neighbouring cells, and the cells with centre, radius and size. A search has two rounds:

1. Each block of queries meets the blocks that hold the cells nearest to its queries, as many as have enough vectors. The k-th distance found bounds the answer.
2. It meets those blocks that may hold a vector within the bound. A cell can't where the distance to its centre less its
   radius is above the bound, or the distance to the plane between its centre and the query's own is: vectors of a cell are on its side of
   every such plane. (Of inner products, the first alone: no product exceeds that with the centre by more than radius times length.)

Queries are never collected: they are packed too, those of near cells together, and meet vectors as `blocks.crossed` does it, which shuffles no vector for a visit.
No task compares more than `PART` vectors and `BLOCK` queries at once; blocks that no query visits don't leave the reader. Answers are those of comparing everything; ties go by candidate_id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from augsearch.functions.storage import scratch, written
from augsearch.functions.vectors import normalised, squared_distances
from augsearch.operators.blocks import Best, Block, Meeting, binary, crossed, matrix, packed

#: Rows that the centres are fitted on, cells, and bytes of their centres (which are broadcast), at most.
SAMPLE, MAX_CELLS, MAX_BYTES = 65_536, 4096, 64 << 20
#: Vectors and queries that a task compares, at most; rows of a matrix product.
PART, BLOCK, SLICE = 2048, 2048, 1024
#: Cells that the first round visits, at least.
PROBES = 2


def _unit(x: np.ndarray, space: str) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12) if space == "cosine" else x


def _in_order(x: np.ndarray) -> np.ndarray:
    """The rows' numbers, near ones near each other: halved along the widest dimension again and again."""
    done, todo = [], [np.arange(len(x))]
    while todo:
        at = todo.pop()
        if len(at) < 3:
            done.append(at)
            continue
        at = at[np.argsort(x[at, np.ptp(x[at], axis=0).argmax()], kind="stable")]
        todo += [at[len(at) // 2 :], at[: len(at) // 2]]
    return np.concatenate(done)


@dataclass
class Cells:
    """What is broadcast: centres, radii and sizes of the cells, by cell number."""

    centres: np.ndarray
    radius: np.ndarray
    size: np.ndarray

    def __post_init__(self):
        self.between = np.sqrt(np.maximum(squared_distances(self.centres, self.centres), 0.0))

    def probes(self, q: np.ndarray, k: int, space: str) -> np.ndarray:
        """queries x cells: the nearest cells, enough of them to hold k vectors."""
        away = -q @ self.centres.T if space == "ip" else squared_distances(q, self.centres)
        away = np.where(self.size > 0, away, np.inf)
        order = np.argsort(away, axis=1, kind="stable")
        before = np.cumsum(self.size[order], axis=1) - self.size[order]
        out = np.zeros(away.shape, bool)
        np.put_along_axis(out, order, (before < k) | (np.arange(away.shape[1]) < PROBES), 1)
        return out & (self.size > 0)

    def own(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each query's nearest cell, and the squared distance to its centre."""
        found = [(d2.argmin(1), np.maximum(d2.min(1), 0.0)) for i in range(0, len(q), SLICE) for d2 in [squared_distances(q[i : i + SLICE], self.centres)]]
        return tuple(np.concatenate(x) for x in zip(*found))

    def lower_bounds(self, q: np.ndarray, space: str, own: tuple[np.ndarray, np.ndarray], at: np.ndarray | slice = slice(None)) -> np.ndarray:
        """queries x cells (those at `at`): no vector of the cell is nearer, in the distance that the search returns. own: as `own` returns it."""
        if space == "ip":
            return 1 - q @ self.centres[at].T - np.linalg.norm(q, axis=1)[:, None] * self.radius[at]
        d2 = np.maximum(squared_distances(q, self.centres[at]), 0.0)
        ball = np.sqrt(d2) - self.radius[at]
        between = self.between[own[0][:, None], np.arange(len(self.centres))[at]]  # 0 to the own centre and its copies
        plane = np.where(between == 0, 0.0, (d2 - own[1][:, None]) / np.maximum(2 * between, 1e-300))
        bound = np.maximum(np.maximum(ball, plane), 0.0) ** 2
        return bound / 2 if space == "cosine" else bound

    def slack(self, q: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """What distances and bounds may be wrong by, for each query."""
        return 1e-9 * (1 + np.abs(np.where(np.isfinite(bound), bound, 0.0)) + np.einsum("ij,ij->i", q, q) + (self.centres**2).sum(1).max())

    def visits(self, q: np.ndarray, bound: np.ndarray, space: str) -> np.ndarray:
        """queries x cells: those that may hold a vector within each query's bound."""
        return (self.size > 0) & (self.lower_bounds(q, space, self.own(q)) <= (bound + self.slack(q, bound))[:, None])


def best_of(q: np.ndarray, x: np.ndarray, allowed, k: int, space: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row of x, distance): the k nearest rows of each query, of equal distances the first rows."""
    q2, found = np.einsum("ij,ij->i", q, q)[:, None], []
    for at in range(0, len(x), SLICE):
        part = x[at : at + SLICE]
        d = np.maximum(q2 + np.einsum("ij,ij->i", part, part) - 2 * q @ part.T, 0.0) if space == "l2" else 1 - q @ part.T
        d = np.round(d, 12)  # equal vectors are equally far, whatever the order of their sums
        if allowed is not None:
            d[~allowed(at, at + len(part))] = np.inf
        most = np.partition(d, k - 1, axis=1)[:, k - 1 : k] if k < d.shape[1] else np.inf
        i, j = np.nonzero((d <= most) & np.isfinite(d))
        found.append((i, j + at, d[i, j]))
    i, j, d = (np.concatenate([f[n] for f in found]) for n in range(3))
    order = np.lexsort((j, d, i))
    i, j, d = i[order], j[order], d[order]
    nth = np.arange(len(i)) - np.searchsorted(i, i)
    return i[nth < k], j[nth < k], d[nth < k]


@dataclass
class VectorIndex:
    path: str
    space: str
    spark: SparkSession

    def __post_init__(self):
        rows = self.spark.read.parquet(f"{self.path}/cells").orderBy("cell").collect()  # MAX_CELLS rows at most
        self.cells = Cells(np.array([r.centre for r in rows], np.float64), np.array([r.radius for r in rows], np.float64), np.array([r.size for r in rows], np.int64))
        self.vectors = self.spark.read.parquet(f"{self.path}/vectors")  # packed

    @classmethod
    def build(cls, candidates: DataFrame, space: str = "cosine", path: str | None = None, n_cells: int | None = None, seed: int = 42) -> VectorIndex:
        """candidates: candidate_id, embedding (and table_id, which searches of other tables need). Null vectors are left out."""
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        if space not in ("ip", "cosine", "l2"):
            raise ValueError(f"unknown space {space!r}")
        spark, path = candidates.sparkSession, path or scratch(candidates.sparkSession, "index")
        v = F.col("embedding").cast("array<double>")
        table = F.col("table_id") if "table_id" in candidates.columns else F.lit(None)
        points = candidates.filter("embedding is not null").select("candidate_id", table.cast("string").alias("table_id"), v.alias("v"))
        n, d = points.agg(F.count("*"), F.max(F.size("v"))).first()
        d = d or 1
        most = max(1, min(MAX_CELLS, MAX_BYTES // (8 * d)))
        k = max(1, min(n_cells or int(2 * np.sqrt(n)), most, n))
        h = F.xxhash64("candidate_id", F.lit(seed))
        some = points.filter(F.pmod(h, F.lit(1 << 30)) < F.lit(int(min(1.0, SAMPLE / max(1, n)) * (1 << 30)))) if n > SAMPLE else points
        if k > 1:
            model = KMeans(k=k, seed=seed, maxIter=10, initMode="random", solver="row", featuresCol="f").fit(some.limit(2 * SAMPLE).select(array_to_vector(normalised(F.col("v")) if space == "cosine" else F.col("v")).alias("f")))
            centres = np.array(model.clusterCenters())
            centres = centres[_in_order(centres)]  # so that blocks have cells that are near each other
        else:
            centres = np.zeros((1, d))
        rows = _dealt(points, "candidate_id", centres, space)
        distinct = lambda own, x: {"cells": np.unique(own["cell"].to_numpy())}
        _sorted(rows, "candidate_id", -(-n // PART)).transform(packed, "candidate_id", "v", PART, distinct, "cells array<int>").write.parquet(f"{path}/vectors")
        cells = spark.read.parquet(f"{path}/vectors").select(F.explode(F.arrays_zip("cell", "away")).alias("c"))
        stats = cells.groupBy("c.cell").agg(F.count("*").alias("size"), F.max("c.away").alias("radius"))
        names = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>")
        names.join(stats, "cell", "left").select("cell", "centre", F.coalesce("radius", F.lit(0.0)).alias("radius"), F.coalesce("size", F.lit(0)).alias("size")).write.parquet(f"{path}/cells")
        return cls(path, space, spark)

    def _asked(self, queries: DataFrame, k: int) -> DataFrame:
        """The queries, packed, with the cells that the first round visits."""
        table = F.col("table_id") if "table_id" in queries.columns else F.lit(None)
        asked = queries.filter("embedding is not null").select("query_id", table.cast("string").alias("table_id"), F.col("embedding").cast("array<double>").alias("v"))
        shared, space = self.spark.sparkContext.broadcast(self.cells), self.space

        def probed(own, x):
            q = _unit(x, space)
            return {"probes": np.flatnonzero(np.any([shared.value.probes(q[i : i + SLICE], k, space).any(0) for i in range(0, len(q), SLICE)], axis=0)).astype(np.int32)}

        rows = _dealt(asked, "query_id", self.cells.centres, space).drop("away")
        return written(packed(_sorted(rows, "query_id", -(-asked.count() // BLOCK)), "query_id", "v", BLOCK, probed, "probes array<int>"), "queries")

    def _bounds(self, asked: DataFrame, k: int, other_tables: bool) -> DataFrame:
        """The first round. block, bound (of each of its queries, the k-th distance found, or infinity), visits (cells that may hold something nearer to one of them)."""
        shared, space = self.spark.sparkContext.broadcast(self.cells), self.space

        def begin(own: Block) -> Meeting:
            return _First(own, k, space, other_tables, shared.value)

        near = F.arrays_overlap("own.probes", "other.cells")
        return written(crossed(asked, self.vectors, begin, "block long, bound array<double>, visits array<int>", "v", near), "first-round")

    def _bounded(self, queries: DataFrame, k: int, other_tables: bool) -> DataFrame:
        asked = self._asked(queries if self.cells.size.any() else queries.limit(0), k)
        n = max(1, min(asked.count(), int(self.spark.conf.get("spark.sql.shuffle.partitions"))))
        return asked.repartition(n, "block").join(self._bounds(asked, k, other_tables).repartition(n, "block"), "block")

    def visits(self, queries: DataFrame, k: int, other_tables: bool = False) -> DataFrame:
        """query_id, cell: the cells that hold each query's answer, as far as the search can tell."""
        shared, space, kind = self.spark.sparkContext.broadcast(self.cells), self.space, queries.schema["query_id"].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(b.num_rows):
                    own = Block(dict(zip(b.schema.names, b.columns)), i, "v")
                    q = _unit(own.x, space)
                    for at in range(0, len(q), SLICE):
                        rows, cell = np.nonzero(shared.value.probes(q[at : at + SLICE], k, space) | shared.value.visits(q[at : at + SLICE], own.numbers("bound")[at : at + SLICE], space))
                        yield pa.RecordBatch.from_arrays([own["query_id"].take(pa.array(rows + at)), pa.array(cell.astype(np.int32))], names=["query_id", "cell"])

        return self._bounded(queries, k, other_tables).drop("cell", "probes", "block", "visits", "table_id").mapInArrow(run, f"query_id {kind}, cell int")

    def nearest(self, queries: DataFrame, k: int, exclude_same_table: bool = False) -> DataFrame:
        """query_id, candidate_id, distance, rank, as `retrieval.nearest` returns them. Each query_id is taken to be one query."""
        kinds = queries.schema["query_id"].dataType.simpleString(), self.vectors.schema["candidate_id"].dataType.elementType.simpleString()
        shared, space = self.spark.sparkContext.broadcast(self.cells), self.space

        def begin(own: Block) -> Meeting:
            return _Second(own, k, space, exclude_same_table, shared.value)

        near = F.arrays_overlap("own.visits", "other.cells")
        return crossed(self._bounded(queries, k, exclude_same_table), self.vectors, begin, f"query_id {kinds[0]}, candidate_id {kinds[1]}, distance double, rank int", "v", near)


def _dealt(points: DataFrame, id_: str, centres: np.ndarray, space: str) -> DataFrame:
    """points: an id, table_id, v (array<double>) -> the same with v narrowed, d, cell and away, the distance to its centre."""
    shared, kind = points.sparkSession.sparkContext.broadcast(centres), points.schema[id_].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(i, SLICE) for i in range(0, whole.num_rows, SLICE)):
                x = matrix(b.column(2))
                u = _unit(x, space)
                cell = squared_distances(u, shared.value).argmin(1)
                away = np.linalg.norm(u - shared.value[cell], axis=1)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), binary(x), pa.array(np.full(len(x), x.shape[1], np.int32)), pa.array(cell.astype(np.int32)), pa.array(away)], names=[id_, "table_id", "v", "d", "cell", "away"])

    return points.mapInArrow(run, f"{id_} {kind}, table_id string, v binary, d int, cell int, away double")


def _sorted(rows: DataFrame, id_: str, blocks: int) -> DataFrame:
    n = max(1, min(blocks, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return rows.repartitionByRange(n, "cell", id_).sortWithinPartitions("cell", id_)


class _Search(Meeting):
    """A block of queries and what it has found."""

    def __init__(self, own: Block, k: int, space: str, other_tables: bool, cells: Cells):
        super().__init__(own)
        self.k, self.space, self.other_tables, self.cells = k, space, other_tables, cells
        self.q = _unit(own.x, space)
        self.squares = np.einsum("ij,ij->i", self.q, self.q)
        self.best = Best(len(self.q), k, 0.0 if space == "l2" else 1.0, space == "l2")

    def compare(self, other: Block, rows: np.ndarray) -> None:
        x, q = _unit(other.x, self.space), self.q[rows]
        if self.space == "l2":  # one product has 2 q x - q q - x x
            x = np.column_stack([2 * x, -np.einsum("ij,ij->i", x, x), -np.ones(len(x))])
            q = np.column_stack([q, np.ones(len(q)), self.squares[rows]])
        score = q @ x.T
        if self.other_tables:
            codes = pa.concat_arrays([self.own["table_id"], other["table_id"]]).dictionary_encode().indices.fill_null(-1).to_numpy()
            score[codes[: len(self.q)][rows][:, None] == codes[len(self.q) :]] = -np.inf
        self.best.add(score, other.ids("candidate_id"), rows=rows)


class _First(_Search):
    def __init__(self, own, k, space, other_tables, cells):
        super().__init__(own, k, space, other_tables, cells)
        self.probes = np.concatenate([cells.probes(self.q[i : i + SLICE], k, space) for i in range(0, len(self.q), SLICE)])

    def add(self, other, same):
        rows = np.flatnonzero(self.probes[:, other.numbers("cells")].any(1))
        if len(rows):
            self.compare(other, rows)

    def result(self):
        self.best.merged()
        bound = self.best.worst
        visits = np.any([self.cells.visits(self.q[i : i + SLICE], bound[i : i + SLICE], self.space).any(0) for i in range(0, len(self.q), SLICE)], axis=0)
        yield pa.RecordBatch.from_arrays([self.own.fields["block"].slice(self.own.at, 1), pa.array([bound], pa.list_(pa.float64())), pa.array([np.flatnonzero(visits)], pa.list_(pa.int32()))], names=["block", "bound", "visits"])


class _Second(_Search):
    def __init__(self, own, k, space, other_tables, cells):
        super().__init__(own, k, space, other_tables, cells)
        bound = own.numbers("bound")
        self.best.worst = bound + cells.slack(self.q, bound)
        self.nearest_cell = cells.own(self.q)

    def add(self, other, same):
        least = self.cells.lower_bounds(self.q, self.space, self.nearest_cell, other.numbers("cells")).min(1)
        rows = np.flatnonzero(least <= self.best.worst + self.cells.slack(self.q, self.best.worst))
        if len(rows):
            self.compare(other, rows)

    def result(self):
        found = self.best.merged()
        if found is not None:
            i, d, ids = found
            yield pa.RecordBatch.from_arrays([self.own["query_id"].take(pa.array(i)), pa.array(ids.tolist() if ids.dtype == object else ids), pa.array(d), pa.array(self.best.ranks())], names=["query_id", "candidate_id", "distance", "rank"])
