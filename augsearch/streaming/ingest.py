"""An extension: columns that arrive as a stream are embedded as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def ingest(spark: SparkSession, folder: str, schema: str, strategy, encoder, target: str, checkpoint: str):
    """Cells (Parquet files that arrive in folder, each column whole in one file) -> rows of column_id, embedding appended to target. Returns the query."""

    def append(cells: DataFrame, batch: int) -> None:
        prompts = strategy.prompts(cells)
        strategy.pooled(encoder.embed(prompts)).write.mode("overwrite").parquet(f"{target}/batch={batch}")  # a batch that runs again replaces itself

    stream = spark.readStream.schema(schema).parquet(folder)
    return stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
