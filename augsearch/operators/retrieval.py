"""Search: nearest columns, candidate tables, bipartite table scores and retrieval metrics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from augsearch.functions.vectors import dot, normalised
from augsearch.operators.ranges import numbered
from augsearch.operators.vector_index import VectorIndex, best_of

#: Query vectors that are broadcast at once, at most; more queries are joined with an index.
QUERY_BLOCK = 4096
SPACES = ("ip", "cosine", "l2")
#: Fixed values of the table matching: similarities below the threshold don't match.
THRESHOLD = 0.1
NEIGHBOURS = 50
#: Candidates that are compared at once: bounds the memory of a task.
CANDIDATE_BLOCK = 1024
K_VALUES = (1, 5, 10, 15, 20, 25, 30, 35, 40, 45, 50)


def nearest(queries: DataFrame, candidates: DataFrame, k: int, space: str = "cosine", exclude_same_table: bool = False) -> DataFrame:
    """query_id, candidate_id, distance, rank: the k nearest candidates, exactly; ties by candidate_id.

    queries: query_id, embedding (and table_id). candidates: candidate_id, embedding (and table_id). Distances: 1 - dot, 1 - cosine,
    or the squared Euclidean. Up to QUERY_BLOCK queries are broadcast: each task compares its candidates with them by matrix products and keeps the k best
    for each query; those are merged by a window over k rows a task and query. More queries go through a `VectorIndex` of the candidates
    and are joined with its cells; the answers are the same.
    """
    if space not in SPACES:
        raise ValueError(f"unknown space {space!r}")
    spark = candidates.sparkSession
    ids = queries.select("query_id", F.col("table_id") if exclude_same_table else F.lit(None).cast("string").alias("table_id"), "embedding")
    if ids.limit(QUERY_BLOCK + 1).count() > QUERY_BLOCK:
        return VectorIndex.build(candidates, space).nearest(ids, k, exclude_same_table)
    rows = ids.orderBy("query_id").collect()  # QUERY_BLOCK rows at most
    if not rows:
        best = queries.select("query_id").limit(0).crossJoin(candidates.select("candidate_id").limit(0)).withColumn("distance", F.lit(0.0))
    else:
        q = np.array([r.embedding for r in rows], np.float64)
        if space == "cosine":
            q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-12)
        shared = spark.sparkContext.broadcast((q, [r.query_id for r in rows], np.array([r.table_id for r in rows], object)))
        table = F.col("table_id") if exclude_same_table else F.lit(None).cast("string").alias("table_id")
        best = candidates.select("candidate_id", table, "embedding").mapInArrow(_scan(shared, k, space, exclude_same_table), f"query_id {queries.schema['query_id'].dataType.simpleString()}, candidate_id {candidates.schema['candidate_id'].dataType.simpleString()}, distance double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "candidate_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k)


def _scan(shared, k: int, space: str, exclude: bool):
    """The k best of a task's candidates for each query; more than twice as many are never held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, query_ids, query_tables = shared.value
        kept: list[tuple] = []  # of each slice: query, candidate_id, distance

        def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            i, ids, d = (np.concatenate([x[n] for x in kept]) for n in range(3))
            place = np.unique(ids, return_inverse=True)[1]
            order = np.lexsort((place, d, i))
            i, ids, d = i[order], ids[order], d[order]
            first = np.arange(len(i)) - np.searchsorted(i, i) < k
            return i[first], ids[first], d[first]

        held = 0
        for whole in batches:
            for b in (whole.slice(at, CANDIDATE_BLOCK) for at in range(0, whole.num_rows, CANDIDATE_BLOCK)):
                ids, tables = np.array(b.column(0).to_pylist(), object), np.array(b.column(1).to_pylist(), object)
                order = np.argsort(ids, kind="stable")
                x = np.array(b.column(2).to_pylist(), np.float64)[order]
                ids, tables = ids[order], tables[order]
                if space == "cosine":
                    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
                allowed = (lambda start, end, t=tables: query_tables[:, None] != t[None, start:end]) if exclude else None
                i, j, d = best_of(q, x, allowed, k, space)
                kept.append((i, ids[j], d))
                held += len(i)
                if held > 2 * k * max(1, len(q)):
                    kept = [merged()]
                    held = len(kept[0][0])
        if kept:
            i, ids, d = merged()
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array([query_ids[r] for r in i]), pa.array(ids.tolist()), pa.array(d)], names=["query_id", "candidate_id", "distance"])

    return run


def reachable(ground_truth: DataFrame, candidates: DataFrame, on: str = "candidate_id") -> DataFrame:
    """Ground truth whose candidate is there."""
    return ground_truth.join(candidates.select(on).distinct(), on, "left_semi")


def unreachable(ground_truth: DataFrame, candidates: DataFrame, on: str = "candidate_id") -> DataFrame:
    return ground_truth.join(candidates.select(on).distinct(), on, "left_anti")


def view_of(rows: DataFrame, order: str, n_views: int, view: int | str = "iterate", by: str | None = None) -> DataFrame:
    """Adds view: a fixed one, or the row's number modulo the number of views."""
    if view == "iterate":
        nth = numbered(rows, [order], [by] if by else None, "view")
        return nth.withColumn("view", F.pmod("view", F.lit(n_views)))
    if not 0 <= view < n_views:
        raise ValueError(f"view {view} is out of range")
    return rows.withColumn("view", F.lit(view))


def metrics(results: DataFrame, ground_truth: DataFrame, k_values=K_VALUES, keep_unanswered: bool = True) -> DataFrame:
    """results: query_id, candidate_id, rank. ground_truth: query_id, candidate_id. -> query_id, k and the seven metrics.

    Queries are those of the ground truth; without results (and keep_unanswered) all metrics of a query are 0.
    """
    truth = ground_truth.select("query_id", "candidate_id").distinct()
    size = truth.groupBy("query_id").agg(F.count("*").alias("relevant"))
    hits = results.join(truth, ["query_id", "candidate_id"], "left_semi").select("query_id", F.col("rank").alias("pos"))
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy("pos"))
    hits = hits.withColumn("nth", nth)
    ks = F.explode(F.array(*map(F.lit, k_values))).alias("k")
    asked = size.join(results.select("query_id").distinct(), "query_id", "left" if keep_unanswered else "left_semi").select("query_id", "relevant", ks)
    found = asked.join(hits, (hits.query_id == asked.query_id) & (F.col("pos") <= F.col("k")), "left").groupBy(asked.query_id, "k", "relevant")
    k, g = F.col("k"), F.col("relevant")
    n = F.count("pos")
    return found.agg(
        (n / k).alias("precision"), (n / g).alias("recall"), (F.least(k, g) / k).alias("max_precision"), F.least(F.lit(1.0), k / g).alias("max_recall"),
        F.when(n > 0, 1.0).otherwise(0.0).alias("hits"), F.coalesce(1 / F.min("pos"), F.lit(0.0)).alias("mrr"), F.coalesce(F.sum(F.col("nth") / F.col("pos")) / g, F.lit(0.0)).alias("ap"),
    ).drop("relevant")


METRICS = ("precision", "recall", "max_precision", "max_recall", "hits", "mrr", "ap")


def wide(long: DataFrame, k_values=K_VALUES) -> DataFrame:
    """One row per query, with columns such as precision@10."""
    cells = [F.max(F.when(F.col("k") == k, F.col(m))).alias(f"{m}@{k}") for m in METRICS for k in k_values]
    return long.groupBy("query_id").agg(*cells)


def match_statistics(results: DataFrame, ground_truth: DataFrame) -> DataFrame:
    """query_id, match_positions, n_predictions, n_ground_truth."""
    truth = ground_truth.select("query_id", "candidate_id").distinct()
    sizes = truth.groupBy("query_id").agg(F.count("*").alias("n_ground_truth"))
    marked = results.join(truth.withColumn("hit", F.lit(True)), ["query_id", "candidate_id"], "left")
    got = marked.groupBy("query_id").agg(F.sort_array(F.collect_list(F.when(F.col("hit"), F.col("rank")))).alias("match_positions"), F.count("*").alias("n_predictions"))
    return got.join(sizes, "query_id", "left").withColumn("n_ground_truth", F.coalesce("n_ground_truth", F.lit(0)))


def join_discovery(queries: DataFrame, candidates: DataFrame, k: int, space: str = "cosine", exclude_self: bool = True) -> DataFrame:
    """Columns that join with each query column, of other tables where exclude_self. Vectors are normalised first."""
    q, c = (d.withColumn("embedding", normalised(F.col("embedding"))) for d in (queries, candidates))
    return nearest(q, c, k, space, exclude_self)


def candidate_tables(query_columns: DataFrame, columns: DataFrame, per_column: int = NEIGHBOURS, space: str = "cosine") -> DataFrame:
    """query_table, candidate_table: the tables of each query column's nearest columns; the query's own table is not left out."""
    near = nearest(query_columns.select(F.col("column_id").alias("query_id"), "table_id", "embedding"), columns.select(F.col("column_id").alias("candidate_id"), "table_id", "embedding"), per_column, space)
    q = query_columns.select(F.col("column_id").alias("query_id"), F.col("table_id").alias("query_table"))
    c = columns.select(F.col("column_id").alias("candidate_id"), F.col("table_id").alias("candidate_table"))
    return near.join(q, "query_id").join(c, "candidate_id").select("query_table", "candidate_table").distinct()


def assignment(cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the assignment of least total cost: shortest augmenting paths, O(n^2 m) for n rows."""
    if cost.shape[0] > cost.shape[1]:
        c, r = assignment(cost.T)
        order = np.argsort(r)
        return r[order], c[order]
    n, m = cost.shape
    u, v, match = np.zeros(n), np.zeros(m), np.full(m, -1)
    for row in range(n):
        least, back, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        i, at = row, -1
        while True:
            reduced = cost[i] - u[i] - v
            better = ~done & (reduced < least - 0.0) if at < 0 else ~done & (reduced + offset < least)
            least = np.where(better, reduced + (0.0 if at < 0 else offset), least)
            back[better] = at
            open_ = np.where(done, np.inf, least)
            j = int(open_.argmin())
            offset = open_[j]
            done[j] = True
            at = j
            if match[j] < 0:
                break
            i = match[j]
        closed = np.flatnonzero(done)
        u[row] += offset
        for j in closed:
            if match[j] >= 0:
                u[match[j]] += offset - least[j]
            v[j] -= offset - least[j]
        while True:
            previous = back[at]
            match[at] = row if previous < 0 else match[previous]
            if previous < 0:
                break
            at = previous
    columns = np.flatnonzero(match >= 0)
    order = np.argsort(match[columns])
    return match[columns][order], columns[order]


def table_score(sims: np.ndarray, threshold: float = THRESHOLD) -> float:
    """As many pairs over the threshold as can be matched, of the largest total, over the smaller number of columns."""
    valid = sims >= threshold
    if not valid.any():
        return 0.0
    # pairs below the threshold cost more than any others together
    rows, columns = assignment(np.where(valid, sims.max() - sims, 1e9))
    return float((sims * valid)[rows, columns].sum() / min(sims.shape))


def union_scores(pairs: DataFrame, query_columns: DataFrame, columns: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """query_id, candidate_id (tables), score, rank: each candidate table by the best matching of its columns.

    A group is one pair of tables: as many rows as their columns have pairs.
    """
    q = query_columns.select(F.col("table_id").alias("query_table"), F.col("column_id").alias("a"), normalised(F.col("embedding")).alias("x"))
    c = columns.select(F.col("table_id").alias("candidate_table"), F.col("column_id").alias("b"), normalised(F.col("embedding")).alias("y"))
    sims = pairs.join(q, "query_table").join(c, "candidate_table").select("query_table", "candidate_table", "a", "b", dot(F.col("x"), F.col("y")).alias("sim"))

    def score(key, frame):
        import pandas as pd

        return pd.DataFrame([(*key, table_score(frame.pivot(index="a", columns="b", values="sim").to_numpy(), threshold))])

    scored = sims.groupBy("query_table", "candidate_table").applyInPandas(score, "query_id string, candidate_id string, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "candidate_id"))
    return scored.withColumn("rank", rank)


def union_discovery(query_columns: DataFrame, columns: DataFrame, per_column: int = NEIGHBOURS, threshold: float = THRESHOLD) -> DataFrame:
    return union_scores(candidate_tables(query_columns, columns, per_column), query_columns, columns, threshold)
