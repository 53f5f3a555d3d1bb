"""Work in order over a whole table without one task that has all of it: rows are dealt to ranges of their order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from augsearch.functions.storage import written


def in_ranges(rows: DataFrame, keys: list[str], name: str = "_range") -> DataFrame:
    """Adds the number of the range that a row's keys are in: as many ranges as a shuffle has partitions, in the keys' order (nulls first).

    The rows are dealt to ranges once and written to the shared folder with their range, so it is the same whoever reads it. Rows of equal keys share a range.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(rows.repartitionByRange(n, *keys).withColumn(name, F.spark_partition_id()), "ranges")


def numbered(rows: DataFrame, order: list[str], by: list[str] | None = None, name: str = "nth") -> DataFrame:
    """Adds the row's number in the order, from 0, within its group of equal `by`. A group may span many ranges: each of them
    starts at the count of the group's rows in those before it, so that at most one such count is needed a range."""
    by = by or []
    ranged = in_ranges(rows, [*by, *order])
    own = Window.partitionBy("_range", *by).orderBy(*order)
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy("_range", *by).agg(F.count("*").alias("_n"))
    starts = counts.select("_range", *by, F.sum("_n").over(before).alias("_start")).filter("_start > 0")
    starts = starts.select(F.col("_range").alias("_of"), F.struct(F.lit(0), *by).alias("_by"), "_start")
    joined = ranged.join(F.broadcast(starts), (F.col("_range") == F.col("_of")) & F.struct(F.lit(0), *by).eqNullSafe(F.col("_by")), "left")  # a row for each range at most
    return joined.withColumn(name, F.row_number().over(own) - 1 + F.coalesce("_start", F.lit(0))).drop("_range", "_of", "_by", "_start")


def _leaps(sizes: np.ndarray, most: int, most_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Running totals of the sizes; and for a request opened at each row, how many more are opened after it and where the last of them starts."""
    total, m = np.concatenate([[0], np.cumsum(sizes)]), len(sizes)
    at = np.arange(m)
    then = np.maximum(at + 1, np.minimum(np.searchsorted(total, total[:-1] + most, "right") - 1, at + most_rows))
    more, last = [0] * m, list(range(m))
    for i, t in zip(range(m - 1, -1, -1), then[::-1].tolist()):
        if t < m:
            more[i], last[i] = more[t] + 1, last[t]
    return total, np.array(more, np.int64), np.array(last, np.int64)


def _advance(sizes: np.ndarray, state: np.ndarray, most: int, most_rows: int) -> np.ndarray:
    """state: a row for each case: number of the open request, its size, its rows (0: none is open). -> the same after the rows of those sizes."""
    total, more, last = _leaps(sizes, most, most_rows)
    number, size, n = state.T
    first = np.maximum(0, np.minimum(np.searchsorted(total, most - size, "right") - 1, most_rows - n))
    first = np.where(n == 0, 0, first)
    stays = first >= len(sizes)
    at = np.where(stays, 0, first)
    return np.where(stays[:, None], np.stack([number, size + total[-1], n + len(sizes)], 1), np.stack([number + 1 + more[at], total[-1] - total[last[at]], len(sizes) - last[at]], 1))


def greedy_batches(rows: DataFrame, by: str, order: str, size: Column, most: int, most_rows: int, name: str) -> DataFrame:
    """Adds the number (from 0 in each part of equal `by`) of the batch that a row goes to in a greedy fold over the part's order: a row
    opens a new one when it would pass `most` in size or `most_rows`. Null sizes count as 0.

    A part may span many ranges. Each range first tells, for each of the at most most_rows places where its first new batch can start,
    which batch is open at its end; these short tables are chained from range to range, and then each range numbers its rows.
    """
    spark = rows.sparkSession
    ranged = in_ranges(rows.withColumn("_size", F.coalesce(size.cast("long"), F.lit(0).cast("long"))), [by, order])
    dealt = lambda df: df.repartition("_range").sortWithinPartitions("_range", by, order)

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of the first and last part of each range: the first sizes, and what is open at the end for each place of the first start."""
        names = ["range", "part", "head", "state"]
        pending: list = []  # first and last part of the current range, still without its end

        def told(p):
            number, part, head, state, _ = p
            head = np.concatenate(head) if head else np.zeros(0, np.int64)
            if state is None:
                total, more, last = _leaps(head, most, most_rows)
                state = np.stack([more, total[-1] - total[last], len(head) - last], 1)
            return number, part, head.tolist(), state.ravel().tolist()

        def feed(p, sizes):
            while len(sizes):
                if p[3] is None:
                    held = sum(map(len, p[2]))
                    now, sizes = sizes[: most_rows - held], sizes[most_rows - held :]
                    p[2].append(now)
                    if len(sizes):  # the head is full, and more follows
                        p[2], p[3] = [np.concatenate(p[2])], np.array(told(p)[3], np.int64).reshape(-1, 3)
                else:
                    p[3], sizes = _advance(sizes, p[3], most, most_rows), sizes[:0]

        def out(ps):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*map(told, ps)), (pa.int32(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())))], names=names)

        for b in batches:
            numbers, parts, sizes = b.column(0).to_pylist(), b.column(1).to_pylist(), np.asarray(b.column(2))
            cuts = [0, *[i for i in range(1, len(sizes)) if numbers[i] != numbers[i - 1] or parts[i] != parts[i - 1]], len(sizes)]
            for start, stop in zip(cuts, cuts[1:]):
                if start == stop:
                    continue
                if pending and pending[-1][0] != numbers[start]:
                    yield out(pending)
                    pending = []
                if not pending or pending[-1][1] != parts[start]:
                    pending = [*pending[:1], [numbers[start], parts[start], [], None, None]]
                feed(pending[-1], sizes[start:stop])
        if pending:
            yield out(pending)

    narrow = dealt(ranged.select("_range", by, order, "_size")).select("_range", F.col(by).cast("string"), "_size")
    tables = narrow.mapInArrow(tell, "range int, part string, head array<long>, state array<long>")
    opened: dict[int, tuple] = {}  # range -> its first part, and the batch that is open at its start
    now: tuple | None = None
    for r in sorted(tables.collect(), key=lambda r: r.range):  # two rows a range at most, a part's own order within a range
        state = np.array(r.state, np.int64).reshape(-1, 3)
        if now is not None and now[0] == r.part:
            opened[r.range] = now
            total = np.concatenate([[0], np.cumsum(r.head)])
            first = max(0, min(int(np.searchsorted(total, most - now[2], "right")) - 1, most_rows - now[3]))
            if first >= len(r.head):
                now = (r.part, now[1], now[2] + int(total[-1]), now[3] + len(r.head))
            else:
                now = (r.part, now[1] + 1 + int(state[first, 0]), *map(int, state[first, 1:]))
        else:
            now = (r.part, *map(int, state[0]))
    shared = spark.sparkContext.broadcast(opened)
    at_range, at_by, at_size = (ranged.columns.index(c) for c in ("_range", by, "_size"))
    with_text = ranged.withColumn("_part", F.col(by).cast("string"))
    kept = [c for c in ranged.columns if c not in ("_range", "_size")]
    places = [ranged.columns.index(c) for c in kept]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, batch, held, n = (None,), -1, 0, 0
        for b in batches:
            numbers = []
            for key in zip(b.column(at_range).to_pylist(), b.column(b.num_columns - 1).to_pylist(), b.column(at_size).to_pylist()):
                if last != key[:2]:
                    came = shared.value.get(key[0])
                    # only a range's first part can have begun before it
                    batch, held, n = came[1:] if came and came[0] == key[1] and last[0] != key[0] else (-1, 0, 0)
                    last = key[:2]
                if n == 0 or held + key[2] > most or n >= most_rows:
                    batch, held, n = batch + 1, 0, 0
                held, n = held + key[2], n + 1
                numbers.append(batch)
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in places], pa.array(numbers, pa.int32())], names=[*kept, name])

    ddl = rows.select(*kept).withColumn(name, F.lit(0).cast("int")).schema
    return dealt(with_text).mapInArrow(number, ddl)
