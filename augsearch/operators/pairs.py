"""Metrics over all pairs of rows, computed together in one pass of tiles.

Rows are dealt to blocks, and each block meets every block, itself included, in one tile (`blocks.crossed`), which every metric sees. A metric is an
aggregate in two phases: `partial` turns a tile into a few rows of numbers where the tile is, `final` adds them up as a DataFrame; with `adds`, a
block's rows are added up before they leave its task, so that they are as many as keys and not as tiles. Tiles never leave their task. A new metric is a
subclass of PairMetric; `evaluate` runs any number of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from augsearch.functions.storage import written
from augsearch.functions.vectors import normalised
from augsearch.operators.blocks import Best, Block, Meeting, crossed, narrowed, packed, plain

#: Rows of a block, at most about: a tile has as many squared similarities.
BLOCK = 2048
OUT = "metric int, row long, label long, other long, other_label long, value array<double>"
_NAMES = ["metric", "row", "label", "other", "other_label", "value"]


@dataclass
class Tile:
    """The similarities of some rows to others. Pairs of a row with itself are not valid, and their similarity is the least possible, -inf."""

    row: np.ndarray
    label: np.ndarray
    best: np.ndarray
    other: np.ndarray
    other_label: np.ndarray
    sim: np.ndarray

    @property
    def valid(self) -> np.ndarray:
        return np.isfinite(self.sim)

    @property
    def same(self) -> np.ndarray:
        """Valid pairs of one label."""
        return (self.label[:, None] == self.other_label[None, :]) & self.valid


class PairMetric:
    """name: of the result's column. top: how many nearest rows `final` wants in `near`. best: whether tiles have each row's best similarity to its own label.
    adds: "sum" or "max", where rows of one key may be put together so before `final`."""

    name = ""
    top = 0
    best = False
    adds: str | None = None

    def partial(self, tile: Tile) -> tuple[np.ndarray, np.ndarray] | None:
        """(keys, numbers: a row for each key) of the tile; None for nothing."""
        return None

    def final(self, partials: DataFrame, near: DataFrame | None, rows: DataFrame) -> DataFrame:
        """One row with the column `name`. partials: key, value (array). near: row, label, other, other_label, sim, rank. rows: row, label, vec."""
        raise NotImplementedError


def tiled(rows: DataFrame, f: Callable[[pa.Table, pa.Table, bool], Iterator[pa.RecordBatch]], schema: str, by: Column | None = None, block: int = BLOCK) -> DataFrame:
    """f over each unordered pair of blocks of the rows that share `by` (of all rows by default); its last argument says that both sides are one block.
    rows need a column row, which deals them to blocks. Rows of a group of at most `block` rows are one block."""
    names = rows.columns
    keyed = rows.withColumn("_by", by if by is not None else F.lit(0)).filter("_by is not null")
    large = keyed.groupBy("_by").count().filter(F.col("count") > block).select("_by", F.ceil(F.col("count") / block).alias("_n"))  # a row for each `block` rows at most
    dealt = keyed.join(F.broadcast(large), "_by", "left").withColumn("_n", F.coalesce("_n", F.lit(1).cast("long"))).withColumn("_own", F.pmod(F.xxhash64("row"), F.col("_n")))
    dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    key = ["_by", "_i", "_j"]
    placed = dealt.select(*names, "_by", F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j"), (F.col("_own") > F.col("_other")).cast("int").alias("_side"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held).combine_chunks()
            side, one = table["_side"].to_numpy(), table["_i"][0] == table["_j"][0]
            cut = int(np.searchsorted(side, 1))
            left, right = (t.select(names).combine_chunks() for t in (table.slice(0, cut), table.slice(cut)))
            if one or (cut and cut < len(side)):
                yield from f(left, left if one else right, one)

        for b in batches:
            if not b.num_rows:
                continue
            keys = [b.column(b.schema.get_field_index(k)) for k in key]
            change = reduce(np.logical_or, [np.asarray(k.slice(1)) != np.asarray(k.slice(0, len(k) - 1)) for k in keys])
            cuts = [0, *(np.flatnonzero(change) + 1).tolist(), b.num_rows]
            if held and any(h.column(h.schema.get_field_index(k))[0] != c[0] for h in held[:1] for k, c in zip(key, keys)):
                yield from done()
                held = []
            for start, end in zip(cuts, cuts[1:]):
                if start:
                    yield from done()
                    held = []
                held.append(b.slice(start, end - start))
        if held:
            yield from done()

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartition(n, *key).sortWithinPartitions(*key, "_side", "row").mapInArrow(run, schema)


def _side(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return t["row"].to_numpy(), t["label"].to_numpy(), unit(plain(t["vec"].to_pylist(), t["d"][0].as_py())), np.full(len(t), np.nan)


def tile_views(left: pa.Table, right: pa.Table, one: bool) -> Iterator[Tile]:
    """The tile of two tables of `_bare` rows from each side; once where both are one block."""
    (r1, l1, x, b1), (r2, l2, y, b2) = _side(left), _side(right)
    sim = x @ y.T
    sim[r1[:, None] == r2[None, :]] = -np.inf
    yield Tile(r1, l1, b1, r2, l2, sim)
    if not one:
        yield Tile(r2, l2, b2, r1, l1, sim.T)


def prepared(rows: DataFrame) -> DataFrame:
    """row, label, vec with vec of length one."""
    return rows.select(F.col("row").cast("long").alias("row"), F.col("label").cast("long").alias("label"), normalised(F.col("vec").cast("array<double>")).alias("vec"))


def best_of_label(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """row, best: the similarity of the best other row of the same label, for rows that have one. Only pairs of one label are compared."""

    def run(left, right, one):
        for t in tile_views(left, right, one):
            best = t.sim.max(1)
            ok = np.isfinite(best)
            yield pa.RecordBatch.from_arrays([pa.array(t.row[ok]), pa.array(best[ok])], names=["row", "best"])

    return tiled(_bare(rows), run, "row long, best double", F.col("label"), block).groupBy("row").agg(F.max("best").alias("best"))


def _bare(rows: DataFrame) -> DataFrame:
    """row, label and vec, narrowed."""
    return rows if "d" in rows.columns else narrowed(rows.select(F.col("row").cast("long").alias("row"), F.col("label").cast("long").alias("label"), F.col("vec").cast("array<double>").alias("vec")), "vec")


def unit(x: np.ndarray) -> np.ndarray:
    """The rows at length one."""
    return x / np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x))[:, None], 1e-12)


def in_blocks(rows: DataFrame, block: int, best: DataFrame | None = None) -> DataFrame:
    """rows (row, label, vec) packed and written: by the hash of row, in blocks of about `block`. best: row, best, for rows that have one."""
    n = max(1, -(-rows.count() // block))
    dealt = _bare(rows).repartition(n, "row")
    if best is not None:
        dealt = dealt.join(best.repartition(n, "row"), "row", "left")
    return written(packed(dealt, "row", "vec", 2 * block), "pair-blocks")


class _Passing(Meeting):
    def __init__(self, own: Block, metrics: list[PairMetric], top: int):
        super().__init__(own)
        self.row, self.label, self.x = own.numbers("row"), own.numbers("label"), unit(own.x)
        self.best = own.numbers("best") if "best" in own.fields else np.full(len(self.x), np.nan)
        self.metrics, self.near, self.held = metrics, Best(len(self.x), top) if top else None, [[] for _ in metrics]

    def add(self, other, same):
        row, label = other.numbers("row"), other.numbers("label")
        sim = self.x @ unit(other.x).T
        if same or np.isin(self.row, row).any():
            sim[self.row[:, None] == row[None, :]] = -np.inf
        if self.near:
            self.near.add(sim, row, label)
        if not self.metrics:
            return
        tile = Tile(self.row, self.label, self.best, row, label, sim)
        for i, m in enumerate(self.metrics):
            found = m.partial(tile)
            if found is not None and len(found[0]):
                keys, values = np.asarray(found[0], np.int64), np.asarray(found[1], np.float64).reshape(len(found[0]), -1)
                if not m.adds:
                    yield _partials(i, keys, values)
                    continue
                self.held[i].append((keys, values))
                if sum(len(k) for k, _ in self.held[i]) > 16 * len(self.x):
                    self.held[i] = [_added(self.held[i], m.adds)]

    def result(self):
        for i, m in enumerate(self.metrics):
            if self.held[i]:
                yield _partials(i, *_added(self.held[i], m.adds))
        found = self.near.merged() if self.near else None
        if found is not None:
            at, d, other, label = found
            value = np.stack([-d, self.near.ranks()], 1)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), -1, np.int32)), *map(pa.array, (self.row[at], self.label[at], other, label)), _lists(value)], names=_NAMES)


def _lists(values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array((np.arange(len(values) + 1) * values.shape[1]).astype(np.int32)), pa.array(values.ravel()))


def _partials(metric: int, keys: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    none = pa.nulls(len(keys), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), metric, np.int32)), pa.array(keys), none, none, none, _lists(values)], names=_NAMES)


def _added(held: list[tuple[np.ndarray, np.ndarray]], adds: str) -> tuple[np.ndarray, np.ndarray]:
    """One row for each key."""
    keys, values = (np.concatenate(x) for x in zip(*held))
    keys, at = np.unique(keys, return_inverse=True)
    out = np.full((len(keys), values.shape[1]), 0.0 if adds == "sum" else -np.inf)
    (np.add if adds == "sum" else np.maximum).at(out, at, values)
    return keys, out


def passed(rows: DataFrame, metrics: list[PairMetric], block: int = BLOCK, best: DataFrame | None = None) -> DataFrame:
    """The one pass: OUT, rows of each metric by its number, and of number -1 the nearest rows of each row, value being similarity and rank."""
    top = max((m.top for m in metrics), default=0)
    partial = [m for m in metrics if type(m).partial is not PairMetric.partial]
    at = [i for i, m in enumerate(metrics) if type(m).partial is not PairMetric.partial]
    table = in_blocks(rows, block, best)
    out = crossed(table, table, lambda own: _Passing(own, partial, top), OUT, "vec")
    return out.withColumn("metric", F.when(F.col("metric") < 0, F.col("metric")).otherwise(F.element_at(F.array(*map(F.lit, at)), F.col("metric") + 1))) if at and at != list(range(len(at))) else out


def nearest_others(rows: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """row, label, other, other_label, sim, rank: the k most similar other rows, of equals those of the least number."""
    out = passed(rows, [TopKPrecision(k)], block)
    return out.select("row", "label", "other", "other_label", F.col("value")[0].alias("sim"), F.col("value")[1].cast("int").alias("rank"))


def evaluate(rows: DataFrame, metrics: list[PairMetric], block: int = BLOCK) -> DataFrame:
    """One row with a column for each metric. rows: row, label, vec."""
    if len({m.name for m in metrics}) < len(metrics):
        raise ValueError("metrics need names of their own")
    bare = written(_bare(rows), "pair-rows")
    best = best_of_label(bare, block) if any(m.best for m in metrics) else None
    out = written(passed(bare, metrics, block, best), "pair-partials")
    near = out.filter("metric = -1").select("row", "label", "other", "other_label", F.col("value")[0].alias("sim"), F.col("value")[1].cast("int").alias("rank"))
    results = []
    for i, m in enumerate(metrics):
        partials = out.filter(F.col("metric") == i).select(F.col("row").alias("key"), "value")
        results.append(m.final(partials, near.filter(F.col("rank") <= m.top) if m.top else None, rows))
    return reduce(lambda a, b: a.join(b), results)  # one row each


@dataclass(frozen=True)
class TopKPrecision(PairMetric):
    k: int = 5
    name: str = "top_k_precision"

    @property
    def top(self) -> int:
        return self.k

    def final(self, partials, near, rows):
        from augsearch.operators.alignment import top_k_precision

        return top_k_precision(near, rows, self.k).toDF(self.name)


@dataclass(frozen=True)
class TopKAccuracy(PairMetric):
    k: int = 5
    name: str = "top_k_accuracy"

    @property
    def top(self) -> int:
        return self.k

    def final(self, partials, near, rows):
        from augsearch.operators.alignment import top_k_accuracy

        return top_k_accuracy(near, rows).toDF(self.name)


@dataclass(frozen=True)
class EntityStability(PairMetric):
    k: int = 5
    scaled: bool = True
    name: str = "entity_stability"

    @property
    def top(self) -> int:
        return self.k

    def final(self, partials, near, rows):
        from augsearch.operators.alignment import entity_stability

        return entity_stability(near, self.k, self.scaled).toDF(self.name)


@dataclass(frozen=True)
class MeanRelativeRank(PairMetric):
    name: str = "mean_relative_rank"
    best: bool = True
    adds: str = "sum"

    def partial(self, tile):
        ok = np.isfinite(tile.best)
        return tile.row[ok], (tile.sim[ok] > tile.best[ok, None] + 1e-12).sum(1)

    def final(self, partials, near, rows):
        nearer = partials.groupBy("key").agg(F.sum(F.col("value")[0]).alias("nearer"))
        n = rows.agg(F.greatest(F.count("*") - 2, F.lit(1)).alias("n"))
        return nearer.join(F.broadcast(n)).agg(F.coalesce(F.avg(1 - F.col("nearer") / F.col("n")), F.lit(0.0)).alias(self.name))
