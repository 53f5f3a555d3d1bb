"""Text serialisation: cells -> one prompt for each column (or cell).

cells: table_id, col_ord, col_name, row_ord, value. All strategies return prompt_id and prompt. Values are counted per
column before anything is gathered, so a column of any length with few distinct values costs what its distinct values
do; where a budget of characters is given, only the values that can reach it are gathered.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from augsearch.functions.text import column_id, n_tokens, sanitize, strip, two_decimals


def columns(cells: DataFrame) -> DataFrame:
    """Non-null cells with prompt_id and the sanitized name; of two columns of one id the first stays."""
    present = cells.filter("value is not null").withColumn("prompt_id", column_id(F.col("table_id"), F.col("col_name"))).withColumn("name", sanitize(F.col("col_name")))
    first = present.groupBy("prompt_id").agg(F.min("col_ord").alias("first"))
    return present.join(first, "prompt_id").filter(F.col("col_ord") == F.col("first")).drop("first")


def _joined(values: DataFrame, order: list[Column], by: str, sep: str, max_length: int | None, text: str = "text") -> DataFrame:
    """by, text: the values (by, value) in order, joined and cut to max_length characters."""
    w = Window.partitionBy(by).orderBy(*order)
    ranked = values.withColumn("nth", F.row_number().over(w))
    if max_length is not None:  # values that begin beyond the budget can't show
        before = F.coalesce(F.sum(F.char_length("value") + len(sep)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        ranked = ranked.withColumn("before", before).filter(F.col("before") < max_length + len(sep))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("nth", "value"))), lambda s: s["value"])
    out = ranked.groupBy(by).agg(F.array_join(parts, sep).alias(text))
    return out if max_length is None else out.withColumn(text, F.substring(text, 1, max_length))


def str_cat(cols: DataFrame, sep: str = ", ", max_length: int | None = None) -> DataFrame:
    """prompt_id, text: distinct values in order of first sight."""
    first = cols.groupBy("prompt_id", "value").agg(F.min("row_ord").alias("at"))
    return _joined(first, [F.col("at"), F.col("value")], "prompt_id", sep, max_length)


def freq_cat(cols: DataFrame, sep: str = ", ", max_length: int | None = None) -> DataFrame:
    """prompt_id, text: distinct values by count, most frequent first, then by value."""
    counted = cols.groupBy("prompt_id", "value").agg(F.count("*").alias("n"))
    return _joined(counted, [F.desc("n"), F.col("value")], "prompt_id", sep, max_length)


COLLATE = {"str_cat": str_cat, "freq_cat": freq_cat}


def collate_fn(name: str):
    try:
        return COLLATE[name]
    except KeyError:
        raise AttributeError(f"no collate function {name!r}") from None


@dataclass(frozen=True)
class ColumnStrategy:
    """One prompt per column: a collate function over its values."""

    alias: str = "column"
    collate: str = "freq_cat"
    sep: str = ", "
    max_length: int | None = None

    def prompts(self, cells: DataFrame) -> DataFrame:
        return collate_fn(self.collate)(columns(cells), self.sep, self.max_length).withColumnRenamed("text", "prompt")

    def pooled(self, embedded: DataFrame) -> DataFrame:
        return embedded.withColumnRenamed("prompt_id", "column_id")


@dataclass(frozen=True)
class DeepJoinStrategy(ColumnStrategy):
    """Name, count and lengths of the values, then the values by frequency. max_length cuts the values alone."""

    alias: str = "dj_adpt"
    mode: str = "adapted"

    def __post_init__(self):
        if self.mode not in ("adapted", "original"):
            raise ValueError(f"unknown prompt mode {self.mode!r}")

    def prompts(self, cells: DataFrame) -> DataFrame:
        cols = columns(cells)
        size = F.char_length("value")
        stats = cols.groupBy("prompt_id", "table_id", "name").agg(F.count("*").alias("n"), F.min(size).alias("low"), F.max(size).alias("high"), F.avg(size).alias("mean"))
        text = freq_cat(cols, self.sep, self.max_length)
        mean = two_decimals(F.col("mean"))
        if self.mode == "adapted":
            prompt = F.format_string("Column '%s' contains %d values with lengths (min, max, mean): (%d, %d, %s). Values: %s", "name", "n", "low", "high", mean, "text")
        else:
            prompt = F.format_string("%s. %s contains %d values (%d, %d, %s): %s", "table_id", "name", "n", "low", "high", mean, "text")
        return stats.join(text, "prompt_id").select("prompt_id", prompt.alias("prompt"))


@dataclass(frozen=True)
class CellStrategy:
    """One prompt per non-null cell; the vectors of a column are averaged, or their median taken."""

    alias: str = "cell"
    aggregation: str = "mean"

    def prompts(self, cells: DataFrame) -> DataFrame:
        nth = F.row_number().over(Window.partitionBy("prompt_id").orderBy("row_ord")) - 1
        return columns(cells).select(F.concat_ws("::", "prompt_id", nth.cast("string")).alias("prompt_id"), F.col("value").alias("prompt"))

    def pooled(self, embedded: DataFrame) -> DataFrame:
        from augsearch.functions.vectors import pooled

        named = embedded.select(F.regexp_extract("prompt_id", "(?s)^(.*)::", 1).alias("column_id"), "embedding")
        return pooled(named, "column_id", "embedding", self.aggregation)


@dataclass(frozen=True)
class RankedStrategy(ColumnStrategy):
    """Terms by TF-IDF or BM25 of the column among the columns of its table; whole terms up to the budget.

    A term is a value without white space at its ends; its frequency is that of its most frequent spelling.
    """

    alias: str = "ranked"
    method: str = "bm25"
    k1: float = 1.5
    b: float = 0.75
    epsilon: float = 0.25

    def __post_init__(self):
        if self.method not in ("bm25", "tf_idf"):
            raise ValueError(f"unknown method {self.method!r}")

    def scores(self, cells: DataFrame) -> DataFrame:
        """prompt_id, term, score."""
        # all columns of a table count, those without any value too
        tables = cells.select("table_id", "col_ord").distinct().groupBy("table_id").agg(F.count("*").alias("columns"))
        cols = columns(cells).withColumn("term", strip(F.col("value")))
        spelled = cols.groupBy("table_id", "prompt_id", "term", "value").agg(F.count("*").alias("n"))
        tf = spelled.groupBy("table_id", "prompt_id", "term").agg(F.max("n").alias("tf"), F.sum("n").alias("cells"))
        df = F.count("*").over(Window.partitionBy("table_id", "term"))
        length = F.sum("cells").over(Window.partitionBy("prompt_id"))
        rows = tf.withColumns({"df": df, "length": length}).join(tables, "table_id")
        if self.method == "tf_idf":
            return rows.select("prompt_id", "term", tf_idf(F.col("tf"), F.col("df"), F.col("columns")).alias("score"))
        total = cols.groupBy("table_id").agg(F.count("*").alias("total"))
        rows = rows.join(total, "table_id").withColumn("average", F.col("total") / F.col("columns"))
        return rows.select("prompt_id", "term", bm25(F.col("tf"), F.col("df"), F.col("columns"), F.col("length"), F.col("average"), self.k1, self.b, self.epsilon).alias("score"))

    def prompts(self, cells: DataFrame) -> DataFrame:
        return score_cat(self.scores(cells), self.sep, self.max_length).withColumnRenamed("text", "prompt")


def tf_idf(tf: Column, df: Column, n: Column) -> Column:
    return tf * (F.log((n + 1) / (df + 1)) + 1)


def bm25(tf: Column, df: Column, n: Column, length: Column, average: Column, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + epsilon) * (tf * (k1 + 1)) / (tf + k1 * (1 - b + b * length / average))


def score_cat(scores: DataFrame, sep: str = ", ", max_length: int | None = None) -> DataFrame:
    """prompt_id, text: terms by score (ties by term), whole terms until the first that doesn't fit."""
    w = Window.partitionBy("prompt_id").orderBy(F.desc("score"), "term")
    ranked = scores.withColumn("nth", F.row_number().over(w))
    if max_length is not None:
        upto = F.sum(F.char_length("term") + len(sep)).over(w.rowsBetween(Window.unboundedPreceding, 0)) - len(sep)
        ranked = ranked.withColumn("upto", upto).filter(F.col("upto") <= max_length)
    parts = F.transform(F.sort_array(F.collect_list(F.struct("nth", "term"))), lambda s: s["term"])
    some = ranked.groupBy("prompt_id").agg(F.array_join(parts, sep).alias("text"))
    return scores.select("prompt_id").distinct().join(some, "prompt_id", "left").select("prompt_id", F.coalesce("text", F.lit("")).alias("text"))


def token_summary(prompts: DataFrame, pipeline: str) -> DataFrame:
    """pipeline, and sum, min, max and mean of the tokens of its prompts."""
    n = n_tokens(F.col("prompt"))
    return prompts.agg(F.sum(n).alias("total"), F.min(n).alias("low"), F.max(n).alias("high"), F.avg(n).alias("mean")).select(F.lit(pipeline).alias("pipeline"), "*")
