"""Experiment logs: `date | severity | module:line | message`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LINE = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}) \| (\w+)\s*\| ([\w.]+):(\d+) \| (.*)$"
START = "Experiment configuration: "
EPOCH = r"^Epoch (\d+)[:,]? (.*)$"
METRIC = r"(\w+): (-?(?:\d+(?:\.\d*)?(?:[eE][+-]?\d+)?|inf|nan))"


def parse_lines(lines: DataFrame) -> DataFrame:
    """lines: path, line_no, value -> records with the experiment that each belongs to (0: before the first). Other lines are skipped."""
    part = lambda i: F.regexp_extract("value", LINE, i)
    rows = lines.filter(F.col("value").rlike(LINE)).select("path", "line_no", part(1).alias("date"), part(2).alias("severity"), part(3).alias("module"), part(4).cast("int").alias("source_line"), part(5).alias("message"))
    is_start = F.col("message").startswith(START)
    experiment = F.sum(is_start.cast("int")).over(Window.partitionBy("path").orderBy("line_no"))
    when = F.coalesce(F.try_to_timestamp("date", F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp("date", F.lit("yyyy-MM-dd'T'HH:mm:ss")))
    return rows.select("*", when.alias("at"), experiment.alias("experiment"), F.when(is_start, F.substring("message", len(START) + 1, 1 << 30)).alias("config"))


def metrics(records: DataFrame) -> DataFrame:
    """path, experiment, epoch, kind (test or epoch), name, value of each metric that an epoch line reports."""
    found = records.filter(F.col("message").rlike(EPOCH)).select("path", "experiment", F.regexp_extract("message", EPOCH, 1).cast("int").alias("epoch"), F.explode(F.regexp_extract_all(F.regexp_extract("message", EPOCH, 2), F.lit(METRIC), F.lit(0))).alias("pair"))
    name, value = F.substring_index("pair", ": ", 1), F.substring_index("pair", ": ", -1).cast("double")
    test = name.startswith("test_")
    return found.select("path", "experiment", "epoch", F.when(test, "test").otherwise("epoch").alias("kind"), F.when(test, F.substring(name, 6, 1 << 20)).otherwise(name).alias("name"), value.alias("value"))


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """Lines keep their order within a file: each file is one row here."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return parse_lines(files.select("path", F.posexplode(F.split("value", "\r?\n")).alias("line_no", "value")))
