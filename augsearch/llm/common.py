"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts of one Arrow batch are worked on in slices of about this many bytes.
SLICE_BYTES = 8 << 20
_OWNER: ContextVar[list[str] | None] = ContextVar("owner", default=None)


@contextmanager
def tables() -> Iterator[list[str]]:
    """Collects the paths that scratch gives out inside, so that whoever opened it can delete them. What is still listed at the end
    belongs to the next one out."""
    outer, paths = _OWNER.get(), []
    token = _OWNER.set(paths)
    try:
        yield paths
    finally:
        _OWNER.reset(token)
        if outer is not None:
            outer.extend(paths)


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which all machines of a cluster share. Only a session of one machine may leave that unset."""
    base, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
    if not base:
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that all machines share")
        base = f"file://{tempfile.gettempdir()}/augsearch-checkpoints"
    return base.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that the cluster shares."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if (owner := _OWNER.get()) is not None:
        owner.append(path)
    return path


def written(df: DataFrame, name: str, level: int = 3, page_bytes: int = 1 << 20) -> DataFrame:
    """df, cut from its lineage by a table in the shared folder; executors may be lost after this."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", level).option("parquet.page.size", page_bytes).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def columns(df: DataFrame) -> list[Column]:
    """The columns of df, whatever characters their names have."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in df.columns]


def numbered(df: DataFrame) -> DataFrame:
    """df with the names c0, c1 ..., so that no name clashes and Python functions take any; toDF(*df.columns) undoes it."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def n_tasks(spark: SparkSession, least: int = 1) -> int:
    """Tasks that a shuffle deals its rows to: the session's setting, never fewer than least."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices whose texts hold about `most` bytes; a longer text has a slice of its own."""
    import numpy as np
    import pyarrow.compute as pc

    if batch.num_rows == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
    ends = np.cumsum(np.asarray(sizes, dtype=np.int64))
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def record_batches(schema: pa.Schema, columns: list, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Arrow batches of at most `rows` rows from full columns."""
    table = pa.Table.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
    yield from table.to_batches(max_chunksize=rows)


def freed(spark: SparkSession, times: int = 1) -> None:
    """Lets Spark delete the shuffle files of plans that nothing refers to any more; call it after a large `written`.

    Spark's cleaner follows the collector of the driver's JVM, which alone runs too seldom to keep disks free. The event queues refer to the last
    execution until another one ends, so an empty one, without a job, comes first.
    """
    for _ in range(times):
        spark.sql("VALUES 0").isEmpty()
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2 if times == 1 else 0.5)


def _qualified(spark: SparkSession, path: str, encoded: bool = False) -> str:
    """The path as Hadoop writes it in full: scheme, authority, absolute path."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(path)) if encoded else jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString()


def discard(paths: list[str], still_read: DataFrame) -> list[str]:
    """Deletes the paths that still_read doesn't read; returns the others. Nothing else may be about to read them."""
    kept, spark = [], still_read.sparkSession
    folders = {_qualified(spark, f, encoded=True) for f in {f.rpartition("/")[0] for f in still_read.inputFiles()}}
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for path in paths:
        table = _qualified(spark, path)
        if any(f == table or f.startswith(f"{table}/") for f in folders):
            kept.append(path)
        else:
            at = hadoop.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    return kept


def forget(*written_tables: DataFrame) -> None:
    """Deletes tables that `written` returned, once all that reads them is written itself."""
    for table in written_tables:
        spark = table.sparkSession
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:  # the files of one table
            at = hadoop.Path(_qualified(spark, folder, encoded=True))
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
