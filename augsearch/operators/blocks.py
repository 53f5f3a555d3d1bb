"""Every row against every other without copies of the rows.

Rows are packed: a row of a packed table is a block of many, with their ids as arrays and their vectors as one binary value. `crossed` lets blocks meet:
a task keeps a few blocks of its own, and the others are read past them, as often as there are tasks, by Spark's nested-loop join. So disk has the
packed tables and what the blocks return, in proportion to the rows, however many pairs there are; a task has its own blocks and one batch of pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

#: Blocks of its own that a task keeps, about at most, where that makes more tasks than a shuffle has.
OWN_BLOCKS = 32


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as the rows of a matrix of doubles."""
    sizes = np.asarray(column.value_lengths().fill_null(-1))
    if len(sizes) and (sizes != sizes[0]).any():
        raise ValueError("vectors differ in length")
    return np.asarray(column.flatten(), np.float64).reshape(len(sizes), -1)


def narrowed(rows: DataFrame, vector: str) -> DataFrame:
    """The vector (array<double>) as binary, and d, its length. In floats where these lose nothing, which halves what is shuffled and written."""
    at = rows.columns.index(vector)
    schema = StructType([*[StructField(f.name, BinaryType()) if f.name == vector else f for f in rows.schema], StructField("d", IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column(at))
            if not x.size:
                continue
            yield pa.RecordBatch.from_arrays([*[c if i != at else binary(x) for i, c in enumerate(b.columns)], pa.array(np.full(len(x), x.shape[1], np.int32))], names=schema.names)

    return rows.mapInArrow(run, schema)


def binary(x: np.ndarray) -> pa.Array:
    """Each row of the matrix as a binary value."""
    with np.errstate(over="ignore"):
        short = x.astype(np.float32)
    x = short if (short == x).all() else x
    width = x.shape[1] * x.itemsize
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer((np.arange(len(x) + 1) * width).astype(np.int32).tobytes()), pa.py_buffer(x.tobytes())])


def plain(values: list[bytes], d: int) -> np.ndarray:
    """The vectors that `binary` made, as a matrix of doubles."""
    if len({len(v) for v in values}) > 1:
        return np.array([np.frombuffer(v, f"f{len(v) // d}") for v in values], np.float64)
    return np.frombuffer(b"".join(values), f"f{len(values[0]) // d}").reshape(-1, d).astype(np.float64)


def packed(rows: DataFrame, order: str, vector: str, most: int, more: Callable[[dict, np.ndarray], dict] | None = None, kinds: str = "") -> DataFrame:
    """block, an array for each other column, d and vector: blocks of at most `most` rows of a partition, one after the other, each by `order`.

    rows: as `narrowed` returns them. more: further columns, of the types `kinds`, from the columns and the matrix of a block. Write the result, so that blocks keep their numbers.
    """
    fields = [StructField(f.name, ArrayType(f.dataType)) for f in rows.schema if f.name not in (vector, "d")]
    extra = [] if more is None else list(StructType.fromDDL(kinds))
    schema = StructType([*fields, StructField("d", IntegerType()), StructField(vector, BinaryType()), *extra])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def block(t: pa.Table) -> pa.RecordBatch:
            t = t.sort_by(order).combine_chunks()
            d = t["d"][0].as_py()
            if t["d"].to_numpy().max() != t["d"].to_numpy().min():
                raise ValueError("vectors differ in length")
            x, own = plain(t[vector].to_pylist(), d), {f.name: t[f.name].chunk(0) for f in fields}
            out = {k: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for k, v in own.items()}
            out |= {"d": pa.array([d], pa.int32()), vector: pa.array([binary(x.reshape(1, -1))[0].as_py()], pa.binary())}
            out |= {k: pa.array([v]) for k, v in more(own, x).items()} if more else {}
            return pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

        for b in batches:
            while b.num_rows:
                held.append(b.slice(0, most - n))
                n, b = n + held[-1].num_rows, b.slice(held[-1].num_rows)
                if n == most:
                    yield block(pa.Table.from_batches(held))
                    held, n = [], 0
        if n:
            yield block(pa.Table.from_batches(held))

    return rows.mapInArrow(run, schema).withColumn("block", F.monotonically_increasing_id())


class Block:
    """One row of a packed table, decoded: the columns by name, lists as Arrow arrays, `x` the matrix of doubles."""

    def __init__(self, fields: dict[str, pa.Array], at: int, vector: str):
        self.fields, self.at = fields, at
        d = fields["d"][at].as_py()
        raw = fields[vector][at].as_buffer()
        n = next(len(f[at]) for f in fields.values() if pa.types.is_list(f.type))
        self.x = np.frombuffer(raw, f"f{raw.size // (n * d)}").reshape(n, d).astype(np.float64)

    def __getitem__(self, name: str) -> pa.Array:
        return self.fields[name][self.at].values

    def numbers(self, name: str) -> np.ndarray:
        return self[name].to_numpy(zero_copy_only=False)

    def ids(self, name: str) -> np.ndarray:
        """Numbers as they are, others as objects."""
        return self.numbers(name) if pa.types.is_integer(self[name].type) else np.array(self[name].to_pylist(), object)


class Meeting:
    """What a task knows of one block of its own."""

    def __init__(self, own: Block):
        self.own = own

    def add(self, other: Block, same: bool) -> Iterator[pa.RecordBatch]:
        """Called once for each block that this one meets, in any order. same: the other has this one's number."""
        raise NotImplementedError

    def result(self) -> Iterator[pa.RecordBatch]:
        """What is returned once all have been met."""
        raise NotImplementedError


def crossed(own: DataFrame, others: DataFrame, begin: Callable[[Block], Meeting], schema: str | StructType, vector: str, where: Column | None = None) -> DataFrame:
    """begin(own) meets each block of the others, or those for which `where` (of own.* and other.*) holds. Both tables are packed and written.
    A block that meets none has no result."""
    spark, n = own.sparkSession, own.count()
    tasks = max(1, min(n, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // OWN_BLOCKS))))
    ours = own.select(F.struct(*own.columns).alias("own")).repartition(tasks)
    theirs = others.select(F.struct(*others.columns).alias("other")).coalesce(1)  # not one task: each of them reads it in a stream
    pairs = theirs.hint("shuffle_replicate_nl").crossJoin(ours)
    pairs = (pairs if where is None else pairs.filter(where)).select("own", "other")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[int, Meeting] = {}
        for b in batches:
            one, two = ({f.name: c for f, c in zip(column.type, column.flatten())} for column in b.columns)
            keys, their_keys, last = one["block"].to_pylist(), two["block"].to_pylist(), None
            for i, (key, their) in enumerate(zip(keys, their_keys)):
                if key not in met:
                    kept = {k: pa.array(c.slice(i, 1).to_pylist(), c.type) for k, c in one.items()}  # a copy, which doesn't hold the batch
                    met[key] = begin(Block(kept, 0, vector))
                if last is None or last[0] != their:
                    last = their, Block(two, i, vector)
                yield from met[key].add(last[1], key == their) or ()
        for meeting in met.values():
            yield from meeting.result()

    return pairs.mapInArrow(run, schema)


class Best:
    """The k others of least distance for each of n rows, of equals those of least id, as blocks of others go by.

    Distances are base - score, rounded to 12 digits, so that equal vectors are equally far, whatever the order of their sums; with `floor` 0 at least.
    """

    def __init__(self, n: int, k: int, base: float = 0.0, floor: bool = False):
        self.n, self.k, self.base, self.floor = n, k, base, floor
        self.worst, self.last, self.full = np.full(n, np.inf), None, np.zeros(n, bool)  # worst may be set to bounds that are known
        self.kept: tuple[np.ndarray, ...] | None = None
        self.held: list[tuple[np.ndarray, ...]] = []

    def distance(self, score: np.ndarray) -> np.ndarray:
        d = np.round(self.base - score, 12)
        return np.maximum(d, 0.0) if self.floor else d

    def add(self, score: np.ndarray, ids: np.ndarray, *more: np.ndarray, rows: np.ndarray | None = None) -> None:
        """score: rows x others, -inf for pairs that don't count. ids and more: of the others, by ascending id. rows: places of the score's rows, all by default."""
        rows = np.arange(self.n) if rows is None else rows
        worst = self.worst[rows]
        with np.errstate(invalid="ignore"):
            least = np.where(np.isfinite(worst), self.base - worst - 1e-11 * (1 + np.abs(worst)), -np.inf)
        at = np.flatnonzero((score >= least[:, None]).ravel())
        if len(at) > 4 * self.k * len(rows) and self.k < score.shape[1]:
            d = self.distance(score)
            bound = np.partition(d, self.k - 1, axis=1)[:, self.k - 1 : self.k]
            under, tie = d < bound, (d == bound)
            tie &= np.cumsum(tie, axis=1, dtype=np.int32) <= self.k - under.sum(1, keepdims=True)
            at = np.flatnonzero((under | tie).ravel())
        i, j = np.divmod(at, score.shape[1])
        d = self.distance(score.ravel()[at])
        good = np.isfinite(d) & (d <= worst[i])
        if self.last is not None:
            tie = np.flatnonzero(good & (d == worst[i]))
            good[tie] = (ids[j[tie]] < self.last[rows[i[tie]]]).astype(bool) | ~self.full[rows[i[tie]]]
        i, j, d = i[good], j[good], d[good]
        if len(i):
            self.held.append((rows[i], d, ids[j], *[m[j] for m in more]))
            if self.kept is None or sum(len(h[0]) for h in self.held) > self.k * self.n:
                self.merged()

    def merged(self) -> tuple[np.ndarray, ...] | None:
        """(row, distance, id, more): of each row the best so far, nearest first; None if there are none."""
        if self.held:
            i, d, ids, *more = (np.concatenate(x) for x in zip(*([self.kept] if self.kept else []), *self.held))
            place = ids if ids.dtype != object else np.unique(ids, return_inverse=True)[1]
            order = np.lexsort((place, d, i))
            order = order[np.arange(len(i)) - np.searchsorted(i[order], i[order]) < self.k]
            self.kept, self.held = tuple(c[order] for c in (i, d, ids, *more)), []
            counts = np.bincount(self.kept[0], minlength=self.n)
            full = np.flatnonzero(counts == self.k)
            self.full[full] = True
            ends = np.cumsum(counts)[full] - 1
            self.worst[full] = self.kept[1][ends]
            self.last = np.zeros(self.n, ids.dtype) if self.last is None else self.last
            self.last[full] = self.kept[2][ends]
        return self.kept

    def ranks(self) -> np.ndarray:
        """The rank of each row of `merged`, from 1."""
        i = self.kept[0]
        return (np.arange(len(i)) - np.searchsorted(i, i) + 1).astype(np.int32)
