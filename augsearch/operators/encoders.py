"""Encoders, and pipelines of encoders and prompt strategies."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from augsearch.functions.storage import written
from augsearch.functions.vectors import normalised, truncated
from augsearch.operators.ranges import greedy_batches


@dataclass(frozen=True)
class HashingEncoder:
    """Signed feature hashing of character n-grams, all in built-in functions: needs no model."""

    alias: str = "hash"
    dim: int = 64
    n: int = 3

    def embed(self, prompts: DataFrame, truncate_dim: int | None = None) -> DataFrame:
        """prompt_id, embedding (unit length; all zeros for a prompt without an n-gram)."""
        text = F.lower(F.concat(F.lit(" "), "prompt", F.lit(" ")))
        starts = F.when(F.char_length(text) >= self.n, F.sequence(F.lit(1), F.char_length(text) - self.n + 1)).otherwise(F.array().cast("array<int>"))
        grams = F.explode(F.transform(starts, lambda i: F.xxhash64(F.substring(text, i, F.lit(self.n)))))
        sign = F.when(F.shiftrightunsigned("gram", 40).bitwiseAND(F.lit(1)) == 1, 1.0).otherwise(-1.0)
        sums = prompts.select("prompt_id", grams.alias("gram")).groupBy("prompt_id", F.pmod("gram", F.lit(self.dim)).alias("pos")).agg(F.sum(sign).alias("x"))
        filled = sums.groupBy("prompt_id").agg(F.map_from_entries(F.collect_list(F.struct("pos", "x"))).alias("m"))
        vector = F.transform(F.sequence(F.lit(0), F.lit(self.dim - 1)), lambda i: F.coalesce(F.try_element_at("m", i.cast("long")), F.lit(0.0)))
        out = prompts.select("prompt_id").join(filled, "prompt_id", "left").select("prompt_id", F.when(F.col("m").isNull(), F.array_repeat(F.lit(0.0), self.dim)).otherwise(vector).alias("v"))
        v = F.col("v") if truncate_dim is None else truncated(F.col("v"), truncate_dim)
        return out.select("prompt_id", normalised(v).alias("embedding"))


@dataclass(frozen=True)
class FunctionEncoder:
    """Any function list of texts -> matrix; `load` is called once for each task."""

    alias: str
    dim: int
    load: Callable

    def __post_init__(self):
        if "/" in self.alias:
            raise ValueError("an alias holds no '/'")

    def embed(self, prompts: DataFrame, truncate_dim: int | None = None) -> DataFrame:
        load = self.load

        def run(frames):
            model = load()
            for f in frames:
                f["embedding"] = list(model(f.prompt.tolist()))
                yield f[["prompt_id", "embedding"]]

        raw = prompts.select("prompt_id", "prompt").mapInPandas(run, "prompt_id string, embedding array<double>")
        v = F.col("embedding") if truncate_dim is None else truncated(F.col("embedding"), truncate_dim)
        return raw.select("prompt_id", normalised(v).alias("embedding"))


@dataclass(frozen=True)
class Pipelines:
    """Every encoder with every strategy; prompts are made once for each strategy."""

    encoders: tuple
    strategies: tuple

    def names(self) -> list[str]:
        return [f"{e.alias}-{s.alias}" for s in self.strategies for e in self.encoders]

    def embed(self, cells: DataFrame) -> DataFrame:
        """column_id, pipeline, embedding."""
        out = None
        for s in self.strategies:
            prompts = s.prompts(cells)
            if len(self.encoders) > 1:
                prompts = written(prompts, "prompts")
            for e in self.encoders:
                part = s.pooled(e.embed(prompts)).select("column_id", F.lit(f"{e.alias}-{s.alias}").alias("pipeline"), "embedding")
                out = part if out is None else out.unionByName(part)
        return out

    def count_tokens(self, cells: DataFrame) -> DataFrame:
        from augsearch.operators.prompts import token_summary

        parts = [token_summary(s.prompts(cells), f"{e.alias}-{s.alias}") for s in self.strategies for e in self.encoders]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out


def request_batches(prompts: DataFrame, by: str, order: str, max_tokens: int = 300_000, max_prompts: int = 2048) -> DataFrame:
    """Greedy requests: a prompt opens a new one when it would pass either bound. by splits the stream to parts that pack alone.

    Adds request, from 0 in each part. Parts of any size: see greedy_batches.
    """
    return greedy_batches(prompts, by, order, F.col("n_tokens"), max_tokens, max_prompts, "request")


def rate_windows(events: DataFrame, key: str, at: str, cost: str, seconds: int = 60) -> DataFrame:
    """Replays a limiter: for each event the requests and cost of the `seconds` up to it."""
    w = Window.partitionBy(key).orderBy(F.col(at).cast("timestamp").cast("double")).rangeBetween(-seconds, 0)
    return events.withColumns({"requests": F.count("*").over(w), "spent": F.sum(cost).over(w)})
