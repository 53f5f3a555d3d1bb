"""Files of a collection that are too large for one task, read in ranges of bytes.

Parquet: a range has the row groups whose middle is in it; footers tell their first rows. CSV and TSV: a range has the records that begin in
it. Whether a line break ends a record depends on all quotes before it, so the work has three steps, each a job over the ranges: quotes are
counted, which gives the state at the start of each range; ranges are parsed for types and numbers of records, which are put together
for each file; and ranges are parsed with the file's types, their rows numbered from the sum of those before. No file is in one task.

Quotes are those of RFC 4180: a field with quotes begins and ends with them, and doubles those inside.
"""

from __future__ import annotations

import io
import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import csv
from pyarrow import fs as pafs
from pyarrow import parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from augsearch.functions.storage import written

#: Bytes that are read at a time where a record goes on beyond its range.
AHEAD = 1 << 20
RANGE = "path string, table_id string, length long, start long, end long"


def opened(path: str) -> pa.NativeFile:
    """path: as Spark names it."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = f"file://{path.removeprefix('file:')}"
    where, at = pafs.FileSystem.from_uri(path)
    return where.open_input_file(at)


def ranges(files: DataFrame, split_bytes: int) -> DataFrame:
    """files: path, table_id, length -> RANGE, no range longer than split_bytes."""
    n = F.greatest(F.lit(1), F.ceil(F.col("length") / split_bytes))
    cut = files.select("path", "table_id", "length", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("i"))
    cut = cut.select("path", "table_id", "length", (F.col("i") * split_bytes).alias("start"), F.least((F.col("i") + 1) * split_bytes, "length").alias("end"))
    tasks = max(1, min(cut.count(), 100_000))
    return cut.repartition(tasks, "path", "start")


def _ends(data: bytes, quoted: bool) -> np.ndarray:
    """Where records end: places behind the line breaks outside quotes. quoted: whether the data begin inside."""
    points = np.frombuffer(data, np.uint8)
    breaks = np.flatnonzero(points == 10)
    quotes = np.flatnonzero(points == 34)
    inside = (np.searchsorted(quotes, breaks) + quoted) % 2 == 1
    return breaks[~inside] + 1


def records(file: pa.NativeFile, start: int, end: int, length: int, quoted: bool) -> bytes:
    """The records that begin in start:end. quoted: whether the byte before start is inside quotes (of the state before that byte)."""
    at = max(0, start - 1)  # a record begins at start if a break is just before it
    file.seek(at)
    data = file.read(end - at)
    first = 0
    if start:
        ends = _ends(data, quoted)
        if not len(ends):
            return b""
        first = int(ends[0])
        if at + first >= end:
            return b""
    # the last of them may go on
    read = end
    while read < length and not (data.endswith(b"\n") and len(e := _ends(data, quoted)) and e[-1] == len(data)):
        before = len(data)
        more = file.read(min(AHEAD, length - read))
        read += len(more)
        data += more
        further = _ends(data, quoted)
        further = further[further > before]
        if len(further):
            data = data[: int(further[0])]
            break
    return data[first:]


def _quotes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the number of quotes in the bytes before the one before the range's start, back to that of the range before."""
    for b in batches:
        out = []
        for path, start, end in zip(*(b.column(i).to_pylist() for i in (0, 3, 4))):
            with opened(path) as f:
                f.seek(max(0, start - 1))
                data = f.read(max(0, end - 1) - max(0, start - 1))
            out.append(data.count(b'"'))
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int64())], names=[*b.schema.names, "quotes"])


def _options(path: str, **more) -> dict:
    from augsearch.sources.collection import NULL

    convert = csv.ConvertOptions(null_values=[NULL, ""], strings_can_be_null=True, quoted_strings_can_be_null=False, **more)
    return {"parse_options": csv.ParseOptions(delimiter="\t" if path.endswith(".tsv") else ",", newlines_in_values=True, invalid_row_handler=lambda row: "skip"), "convert_options": convert}


def _header(path: str, length: int) -> tuple[list[str], bytes]:
    """Names, and the bytes of the first record."""
    with opened(path) as f:
        first = records(f, 0, 1, length, False)
    return csv.read_csv(io.BytesIO(first), **_options(path)).column_names, first


def _parsed(path: str, start: int, end: int, length: int, quoted: bool, types: dict | None = None) -> pa.Table:
    """The records of a range as a table with the names of the file's header."""
    names, first = _header(path, length)
    with opened(path) as f:
        data = records(f, start, end, length, quoted)
    if start == 0:
        data = data[len(first) :]
    if not data:
        return pa.table({n: pa.array([], (types or {}).get(n, pa.null())) for n in names})
    return csv.read_csv(io.BytesIO(data), read_options=csv.ReadOptions(column_names=names, block_size=64 << 20), **_options(path, column_types=types or {}))


#: Names of the types that CSV columns get; a column whose ranges differ gets the wider of two numbers or times, or else text.
_TYPES = {str(t): t for t in (pa.null(), pa.bool_(), pa.int64(), pa.float64(), pa.date32(), pa.time32("s"), pa.timestamp("s"), pa.timestamp("ns"), pa.string())}
_WIDER = ((str(pa.int64()), str(pa.float64())), (str(pa.date32()), str(pa.timestamp("s"))), (str(pa.timestamp("s")), str(pa.timestamp("ns"))), (str(pa.date32()), str(pa.timestamp("ns"))))


def merged(names: list[str]) -> str:
    kinds = {n for n in names if n != "null"}
    if len(kinds) <= 1:
        return kinds.pop() if kinds else "null"
    return next((wide for narrow, wide in _WIDER if kinds == {narrow, wide}), "string")


def _looked_at(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds rows, and the type of each column, of each range."""
    for b in batches:
        rows, types = [], []
        for path, length, start, end, quoted in zip(*(b.column(i).to_pylist() for i in (0, 2, 3, 4, 5))):
            table = _parsed(path, start, end, length, quoted)
            rows.append(table.num_rows)
            types.append([str(t) if str(t) in _TYPES else "string" for t in table.schema.types])
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rows, pa.int64()), pa.array(types, pa.list_(pa.string()))], names=[*b.schema.names, "rows", "types"])


def column_cells(name: str, table: pa.Table, before: int, column_types: str, order: list[int] | None = None) -> Iterator[pa.RecordBatch]:
    from augsearch.sources.collection import as_text

    for i, (header, column) in enumerate(zip(table.column_names, table.columns)):
        if column_types == "string" and not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type) or pa.types.is_dictionary(column.type)):
            continue
        for start in range(0, len(column), 65_536):
            part = as_text(column.slice(start, 65_536))
            n = len(part)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * n), pa.array([i if order is None else order[i]] * n, pa.int32()), pa.array([header] * n), pa.array(range(before + start, before + start + n), pa.int64()), pa.array(part, pa.string())],
                names=["table_id", "col_ord", "col_name", "row_ord", "value"],
            )


def text_cells(files: DataFrame, split_bytes: int, column_types: str, cell: str) -> DataFrame:
    """The cells of CSV and TSV files."""
    own = Window.partitionBy("path").orderBy("start")  # a row for each range of a file
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    counted = written(ranges(files, split_bytes).mapInArrow(_quotes, f"{RANGE}, quotes long"), "quotes")
    states = counted.withColumn("quoted", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1).drop("quotes")
    tasks = max(1, min(counted.count(), 100_000))
    looked = written(states.repartition(tasks, "path", "start").mapInArrow(_looked_at, f"{RANGE}, quoted boolean, rows long, types array<string>"), "looked-at")
    merge = F.udf(lambda kinds: [merged(list(k)) for k in zip(*kinds)], "array<string>")  # once a file
    types = looked.groupBy("path").agg(merge(F.collect_list("types")).alias("file_types"))
    placed = looked.withColumn("before", F.coalesce(F.sum("rows").over(before), F.lit(0))).drop("rows", "types").join(types, "path").repartition(tasks, "path", "start")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, name, length, start, end, quoted, at, kinds in zip(*(c.to_pylist() for c in b.columns)):
                names, _ = _header(path, length)
                yield from column_cells(name, _parsed(path, start, end, length, quoted, {n: _TYPES[k] for n, k in zip(names, kinds)}), at, column_types)

    return placed.select("path", "table_id", "length", "start", "end", "quoted", "before", "file_types").mapInArrow(read, cell)


def parquet_cells(files: DataFrame, split_bytes: int, column_types: str, cell: str) -> DataFrame:
    """The cells of Parquet files; a task reads one row group and one column at a time."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, name, start, end in zip(*(b.column(i).to_pylist() for i in (0, 1, 3, 4))):
                with opened(path) as f:
                    file = pq.ParquetFile(f)
                    row = 0
                    for g in range(file.metadata.num_row_groups):
                        group = file.metadata.row_group(g)
                        # offset of dictionary page, if there is one, of the first column
                        first = group.column(0)
                        begin = min(x for x in (first.dictionary_page_offset, first.data_page_offset) if x)
                        size = sum(group.column(c).total_compressed_size for c in range(group.num_columns))
                        if start <= begin + size // 2 < end:
                            for i, column in enumerate(file.schema_arrow.names):
                                yield from column_cells(name, file.read_row_group(g, columns=[column]), row, column_types, [i])
                        row += group.num_rows

    return ranges(files, split_bytes).mapInArrow(read, cell)


def footer_names(path: str) -> list[str]:
    with opened(path) as f:
        return pq.read_schema(f).names


def readable(path: str) -> bool:
    """Whether tasks can open the file at any place: not in stores that only Spark reads."""
    try:
        with opened(path):
            return True
    except (OSError, pa.ArrowException) as e:
        warnings.warn(f"{path} can't be read in ranges: {e}", stacklevel=1)
        return False
