"""Embedding views: column_id and vector, a folder for each pipeline, with a metadata file."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_view(view: DataFrame, path: str, pipeline: str, append: bool = False, **provenance) -> None:
    """view: column_id, embedding. An existing target is an error unless rows are appended to it."""
    view.select("column_id", "embedding").write.mode("append" if append else "errorifexists").parquet(f"{path}/{pipeline}/rows")
    rows = view.sparkSession.read.parquet(f"{path}/{pipeline}/rows")
    n, d = rows.agg(F.count("*"), F.max(F.size("embedding"))).first()
    meta = {"pipeline": pipeline, "embedding_shape": [n, d], "embedding_dtype": "float32", **provenance}
    view.sparkSession.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{pipeline}/metadata")


def read_view(spark: SparkSession, path: str, pipeline: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{pipeline}/rows")


def metadata(spark: SparkSession, path: str, pipeline: str) -> dict:
    return json.loads(spark.read.text(f"{path}/{pipeline}/metadata").first()[0])


def read_views(spark: SparkSession, path: str, pipelines: list[str], verify_ids: bool = True) -> DataFrame:
    """column_id, view, pipeline, embedding. The views must hold the same ids."""
    if not pipelines:
        raise ValueError("no view is named")
    views = None
    for i, p in enumerate(pipelines):
        rows = read_view(spark, path, p).select("column_id", F.lit(i).alias("view"), F.lit(p).alias("pipeline"), "embedding")
        views = rows if views is None else views.unionByName(rows)
    if verify_ids and not (bad := misaligned(views, len(pipelines))).isEmpty():
        raise ValueError(f"the views differ in ids, such as {bad.first()[0]}")
    return views


def misaligned(views: DataFrame, n_views: int) -> DataFrame:
    """Ids that some view lacks or has more than once."""
    return views.groupBy("column_id").agg(F.count("*").alias("n"), F.count_distinct("view").alias("views")).filter((F.col("views") != n_views) | (F.col("n") != n_views))


def resolve(available: list[str], wanted: list[str]) -> list[str] | None:
    """The available views of the wanted pipelines, in that order; None unless all are there."""
    by = {a.lower().replace(".", "_"): a for a in available}
    found = [by.get(w.lower().replace(".", "_")) for w in wanted]
    return None if None in found else found


def read_npy_view(spark: SparkSession, folder: str) -> DataFrame:
    """A folder with embeddings.npy and column_ids.npy, read in blocks of rows by the tasks."""
    import numpy as np
    import pyarrow as pa

    ids = np.load(f"{folder}/column_ids.npy", mmap_mode="r", allow_pickle=False)
    n, block = len(ids), 8192

    def rows(batches):
        vectors = np.load(f"{folder}/embeddings.npy", mmap_mode="r", allow_pickle=False)
        names = np.load(f"{folder}/column_ids.npy", mmap_mode="r", allow_pickle=False)
        if len(vectors) != len(names):
            raise ValueError("as many vectors as ids are needed")
        for b in batches:
            for i in b.column(0).to_pylist():
                part = slice(i * block, min(n, (i + 1) * block))
                yield pa.RecordBatch.from_arrays([pa.array([str(x) for x in names[part]]), pa.array(list(np.asarray(vectors[part], np.float32)), pa.list_(pa.float32()))], names=["column_id", "embedding"])

    return spark.range(-(-n // block)).mapInArrow(rows, "column_id string, embedding array<float>")


def read_hdf5_view(*_):
    raise NotImplementedError("HDF5 views need h5py; write them as Parquet or .npy views")
