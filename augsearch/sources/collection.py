"""Collections of tables as one long DataFrame of cells.

A collection is a flat folder of .csv, .tsv, .parquet and .pq files with any headers. Millions of files of
different schemas are read without merging schemas: one pass of the paths, and each task unpivots the
files that it gets. Values are text; a null stays null.
"""

from __future__ import annotations

import io
import warnings
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from augsearch.functions.text import sanitize_str
from augsearch.operators.ranges import numbered
from augsearch.sources import large_files

SUFFIXES = ("csv", "tsv", "parquet", "pq")
CELL = "table_id string, col_ord int, col_name string, row_ord long, value string"
NULL = "--"
#: Files of more bytes are read in ranges.
SPLIT = 64 << 20


def discover(spark: SparkSession, folder: str, max_datasets: int | None = None) -> DataFrame:
    """path, table_id (the file name), size; in order of name. ValueError where there is none."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{csv,tsv,parquet,pq}").load(folder)
    found = files.select("path", F.element_at(F.split("path", "/"), -1).alias("table_id"), F.col("length").alias("size")).orderBy("table_id")
    if max_datasets is not None:
        found = found.limit(max_datasets)
    if found.isEmpty():
        raise ValueError(f"no {', '.join(SUFFIXES)} file in {folder}")
    return found


def in_batches(found: DataFrame, batch_size: int | None) -> DataFrame:
    """found with the number of the batch that each file is in; None: one batch."""
    if batch_size is not None and batch_size <= 0:
        raise ValueError("the batch size must be positive")
    if batch_size is None:
        return found.withColumn("batch", F.lit(0))
    return numbered(found, ["table_id", "path"], name="batch").withColumn("batch", F.floor(F.col("batch") / batch_size))


def _table(name: str, content: bytes) -> pa.Table:
    from pyarrow import csv
    from pyarrow import parquet as pq

    if name.endswith((".parquet", ".pq")):
        return pq.read_table(io.BytesIO(content))
    options = csv.ConvertOptions(null_values=[NULL, ""], strings_can_be_null=True, quoted_strings_can_be_null=False)
    return csv.read_csv(io.BytesIO(content), parse_options=csv.ParseOptions(delimiter="\t" if name.endswith(".tsv") else ",", invalid_row_handler=lambda row: "skip"), convert_options=options)


def as_text(column: pa.ChunkedArray) -> list[str | None]:
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        return column.to_pylist()
    text = lambda x: None if x is None else str(x).lower() if isinstance(x, bool) else str(x)
    return [text(x) for x in column.to_pylist()]


def cells(spark: SparkSession, folder: str, column_types: str = "all", max_datasets: int | None = None, split_bytes: int = SPLIT) -> DataFrame:
    """All cells of a collection. column_types "string" keeps text columns alone. Files that can't be read, and tables without rows, are left out.
    Files of more than split_bytes are read in ranges of that size (`large_files`)."""
    if column_types not in ("all", "string"):
        raise ValueError("column_types is 'all' or 'string'")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{csv,tsv,parquet,pq}").load(folder)
    files = files.withColumn("table_id", F.element_at(F.split("path", "/"), -1))
    if max_datasets is not None:
        files = files.join(discover(spark, folder, max_datasets).select("table_id"), "table_id", "left_semi")
    large = files.filter(F.col("length") > split_bytes).select("path", "table_id", "length")
    some = large.first()
    if some is None or not large_files.readable(some.path):
        return _small(files.select("table_id", "content"), column_types)
    is_text = F.col("table_id").rlike(r"\.(csv|tsv)$")
    out = _small(files.filter(F.col("length") <= split_bytes).select("table_id", "content"), column_types)
    out = out.unionByName(large_files.text_cells(large.filter(is_text), split_bytes, column_types, CELL))
    return out.unionByName(large_files.parquet_cells(large.filter(~is_text), split_bytes, column_types, CELL))


def _small(files: DataFrame, column_types: str) -> DataFrame:
    """The cells of files (table_id, content) that are read whole, each by one task."""

    def unpivot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1)):
                try:
                    table = _table(name, content.as_py())
                except (pa.ArrowInvalid, OSError, UnicodeDecodeError) as e:
                    warnings.warn(f"{name} is left out: {e}", stacklevel=1)
                    continue
                yield from large_files.column_cells(name, table, 0, column_types)

    return files.mapInArrow(unpivot, CELL)


def cells_of(table: DataFrame, table_id: str, order: list[str], column_types: str = "all") -> DataFrame:
    """The cells of one DataFrame; rows are numbered in the order of the given columns, by ranges, without one task that sees all."""
    kept = [(i, f.name) for i, f in enumerate(table.schema) if column_types == "all" or f.dataType.typeName() == "string"]
    ordered = table.orderBy(*order)
    numbered = ordered.withColumn("row_ord", F.monotonically_increasing_id())
    pairs = ", ".join(f"{i}, '{name}', cast(`{name}` as string)" for i, name in kept)
    return numbered.select("row_ord", F.expr(f"stack({len(kept)}, {pairs}) as (col_ord, col_name, value)")).select(F.lit(table_id).alias("table_id"), "col_ord", "col_name", "row_ord", "value")


def collection_of(spark: SparkSession, sf_dir: str, tables: dict[str, str], column_types: str = "all") -> DataFrame:
    """The cells of tables in a folder; tables: name -> key column."""
    return reduce(DataFrame.unionByName, (cells_of(spark.read.parquet(f"{sf_dir}/{t}.parquet"), f"{t}.parquet", [key], column_types) for t, key in tables.items()))


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """A table of queries or ground truth by its suffix."""
    suffix = path.rsplit(".", 1)[-1].lower()
    if suffix in ("csv", "tsv"):
        return spark.read.option("header", True).option("sep", "\t" if suffix == "tsv" else ",").option("nullValue", NULL).csv(path)
    if suffix in ("parquet", "pq"):
        return spark.read.parquet(path)
    raise ValueError(f"can't read a .{suffix} file")


def require_columns(df: DataFrame, columns: list[str], what: str) -> DataFrame:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"{what} lacks {missing}")
    return df


def sanitized_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*map(sanitize_str, df.columns))


def parquet_schemas(spark: SparkSession, folder: str) -> DataFrame:
    """path, col_ord, col_name of all Parquet files below the folder; of each file the footer alone is read, where tasks can open it."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{pq,parquet}").option("recursiveFileLookup", True).load(folder)
    some = files.select("path").first()
    footers = some is not None and large_files.readable(some.path)

    def run(batches):
        from pyarrow import parquet as pq

        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1)):
                names = large_files.footer_names(path) if footers else pq.read_schema(io.BytesIO(content.as_py())).names
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(names)), pa.array(range(len(names)), pa.int32()), pa.array(names, pa.string())], names=["path", "col_ord", "col_name"])

    content = F.lit(None).cast("binary").alias("content") if footers else F.col("content")  # which Spark then doesn't read
    return files.select("path", content).mapInArrow(run, "path string, col_ord int, col_name string")


def write_curated(cells_: DataFrame, selected: DataFrame, path: str) -> None:
    """The cells of the selected columns (column_id), a folder for each table."""
    from augsearch.functions.text import column_id

    kept = cells_.withColumn("column_id", column_id(F.col("table_id"), F.col("col_name"))).join(selected.select("column_id").distinct(), "column_id", "left_semi")
    kept.write.partitionBy("table_id").parquet(path)


def csv_to_parquet(spark: SparkSession, source: str, target: str, overwrite: bool = False) -> None:
    """Each CSV file below source as a Parquet file of text columns below target, in the same folders; tables without rows are left out."""
    from pyarrow import fs as pafs

    root = source.rstrip("/")

    def convert(batches):
        from pyarrow import parquet as pq

        where, base = pafs.FileSystem.from_uri(target if "://" in target else f"file://{target}")
        for b in batches:
            done = []
            for path, content in zip(b.column(0).to_pylist(), b.column(1)):
                to = f"{base}/{path.split(root.split('://')[-1], 1)[-1].lstrip('/').removesuffix('.csv')}.pq"
                if not overwrite and where.get_file_info(to).type != pafs.FileType.NotFound:
                    continue
                table = _table(path, content.as_py())
                if table.num_rows < 1:
                    continue
                where.create_dir(to.rsplit("/", 1)[0], recursive=True)
                pq.write_table(table, to, filesystem=where)
                done.append(to)
            yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], names=["path"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").option("recursiveFileLookup", True).load(source)
    files.select("path", "content").mapInArrow(convert, "path string").write.format("noop").mode("overwrite").save()
