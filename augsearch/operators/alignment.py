"""How well views are aligned: similarity metrics over rows (row, label, vec), where a label is one entity seen in several views.

All pairs of rows are the definition of these metrics; those that need them compared go through the tiles of `pairs`, which return sums or a few
best per row, never pairs, and copy no row. `report` has all of them in one pass.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from augsearch.functions.storage import written
from augsearch.functions.vectors import dot, norm
from augsearch.operators.blocks import Block, Meeting, crossed, narrowed, packed
from augsearch.operators.pairs import BLOCK, EntityStability, MeanRelativeRank, TopKAccuracy, TopKPrecision, evaluate, nearest_others, prepared, tiled


def _arrays(side) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    v = np.array([r["vec"] for r in side])
    return np.array([r["row"] for r in side]), np.array([r["label"] for r in side]), v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


#: Rows of one label that a task takes; a larger label is split, and its parts' matrices of dimension by dimension are added.
LABEL_ROWS = 65_536


def _squares(x: np.ndarray) -> float:
    """The sum of the squared products of all pairs of rows, themselves included."""
    g = x @ x.T if len(x) < x.shape[1] else x.T @ x
    return float((g * g).sum())


def similarity_moments(rows: DataFrame, label_rows: int = LABEL_ROWS) -> DataFrame:
    """mean_cosine, stddev_cosine, mean_same_label, stddev_same_label over ordered pairs of different rows; 0 where there is none.

    No pair is compared: the cosines of a group of unit vectors add up to the squared length of their sum, and their squares to that of
    the matrix of their products. So all rows need one pass, and rows of one label one more, for which they are brought together.
    """
    from augsearch.operators.projection import _added

    unit = prepared(rows)
    total = _added(unit.select("vec"), lambda x: np.vstack([np.append(x.sum(0), [len(x), (q := (x * x).sum(1)).sum(), (q * q).sum()]), np.pad(x.T @ x, ((0, 0), (0, 3)))]))
    if total is None:
        return rows.sparkSession.createDataFrame([(0.0,) * 4], "mean_cosine double, stddev_cosine double, mean_same_label double, stddev_same_label double")
    d = total.shape[1] - 3
    n, own, own2 = total[0, d:]
    everything = (n * (n - 1), total[0, :d] @ total[0, :d] - own, (total[1:, :d] ** 2).sum() - own2)

    parts = F.ceil(F.col("count") / label_rows)
    sizes = unit.groupBy("label").count().filter(F.col("count") > label_rows).select("label", parts.alias("parts"))  # a row for each `label_rows` rows at most
    dealt = unit.filter("label is not null").join(F.broadcast(sizes), "label", "left").withColumn("parts", F.coalesce("parts", F.lit(1).cast("long"))).withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")))

    def run(batches):
        at, held, kept, small = None, [], None, np.zeros(3)

        def closed():
            """Adds a whole label to the sums; gives the matrices of a part of one."""
            nonlocal small
            x = np.concatenate(held) if held else np.zeros((0, d))
            if at[2] == 1:
                q = (x * x).sum(1)
                small = small + [len(x) * (len(x) - 1), x.sum(0) @ x.sum(0) - q.sum(), _squares(x) - (q * q).sum()]
                return None
            q = (x * x).sum(1)
            return np.concatenate([[len(x), q.sum(), (q * q).sum()], x.sum(0), (x.T @ x).ravel()])

        for b in batches:
            label, part, count = (np.asarray(b.column(i)) for i in range(3))
            x = np.asarray(b.column(3).flatten(), np.float64).reshape(len(label), -1)
            cuts = [0, *(np.flatnonzero((np.diff(label) != 0) | (np.diff(part) != 0)) + 1).tolist(), len(label)]
            for start, end in zip(cuts, cuts[1:]):
                if start == end:
                    continue
                now = (label[start], part[start], count[start])
                if at is not None and now != at:
                    kept = closed()
                    if kept is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([int(at[0])]), pa.array([kept], pa.list_(pa.float64()))], names=["label", "sums"])
                    held = []
                at = now
                held.append(x[start:end])
        if at is not None:
            kept = closed()
            if kept is not None:
                yield pa.RecordBatch.from_arrays([pa.array([int(at[0])]), pa.array([kept], pa.list_(pa.float64()))], names=["label", "sums"])
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([small], pa.list_(pa.float64()))], names=["label", "sums"])

    sums = dealt.select("label", "part", "parts", "vec").repartition("label", "part").sortWithinPartitions("label", "part").mapInArrow(run, "label long, sums array<double>")
    added = sums.select("label", F.posexplode("sums").alias("pos", "x")).groupBy("label", "pos").agg(F.sum("x").alias("x"))
    x, at = F.col("x"), F.col("pos")
    one = lambda i: F.sum(F.when(at == i, x).otherwise(0.0))
    by_label = added.groupBy("label").agg(one(0).alias("p"), one(1).alias("q"), one(2).alias("r"), F.sum(F.when((at >= 3) & (at < 3 + d), x * x).otherwise(0.0)).alias("line"), F.sum(F.when(at >= 3 + d, x * x).otherwise(0.0)).alias("square"))
    whole = F.col("label").isNull()
    same = by_label.agg(*[F.coalesce(F.sum(F.when(whole, F.col(a)).otherwise(b)), F.lit(0.0)).alias(c) for a, b, c in (("p", F.col("p") * (F.col("p") - 1), "n_same"), ("q", F.col("line") - F.col("q"), "s_same"), ("r", F.col("square") - F.col("r"), "q_same"))])
    sums = same.select(*[F.lit(float(v)).alias(c) for v, c in zip(everything, ("n", "s", "q"))], "*")
    mean = lambda k: F.when(F.col(f"n{k}") > 0, F.col(f"s{k}") / F.col(f"n{k}")).otherwise(0.0)
    std = lambda k: F.when(F.col(f"n{k}") > 0, F.sqrt(F.greatest(F.col(f"q{k}") / F.col(f"n{k}") - mean(k) ** 2, F.lit(0.0)))).otherwise(0.0)
    return sums.select(mean("").alias("mean_cosine"), std("").alias("stddev_cosine"), mean("_same").alias("mean_same_label"), std("_same").alias("stddev_same_label"))


def top_k(rows: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """row, label, other, other_label, sim, rank: the k most similar other rows, ties by row. A row is never its own neighbour."""
    return nearest_others(rows, k, block)


def top_k_precision(near: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    hits = near.agg(F.sum((F.col("label") == F.col("other_label")).cast("long")).alias("hits"))
    return rows.agg(F.count("*").alias("n")).join(hits).select((F.coalesce("hits", F.lit(0)) / (F.col("n") * k)).alias("top_k_precision"))


def top_k_accuracy(near: DataFrame, rows: DataFrame) -> DataFrame:
    hits = near.filter("label = other_label").agg(F.count_distinct("row").alias("hits"))
    return rows.agg(F.count("*").alias("n")).join(hits).select((F.col("hits") / F.col("n")).alias("top_k_accuracy"))


def entity_stability(near: DataFrame, k: int, scaled: bool = True) -> DataFrame:
    """How much the neighbours of the rows of one label agree, over unordered pairs of them."""
    sets = near.groupBy("row", "label").agg(F.collect_set("other").alias("near"))
    a, b = sets.select("label", F.col("row").alias("a"), F.col("near").alias("x")), sets.select("label", F.col("row").alias("b"), F.col("near").alias("y"))
    pairs = a.join(b, "label").filter("a < b").select(F.size(F.array_intersect("x", "y")).alias("common"))
    return pairs.agg(F.coalesce(F.sum("common") / (F.count("*") * F.lit(k - 1 if scaled else k)), F.lit(0.0)).alias("entity_stability"))


def mean_relative_rank(rows: DataFrame, block: int | None = None) -> DataFrame:
    """1 - share of the other rows that are nearer than the best row of the same label, averaged over rows that have one.

    Over all rows by default; with `block` within chunks of that many columns, as a row's number says.
    """
    chunk = F.lit(0) if block is None else F.floor(F.col("row") / block)
    dealt = rows.select("row", "label", "vec", chunk.alias("chunk"))

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                (r1, l1, x), (r2, l2, y) = (_arrays(b.column(c)[i].as_py()) for c in (0, 1))
                s, other = x @ y.T, r1[:, None] != r2[None, :]
                same = other & (l1[:, None] == l2[None, :])
                best = np.where(same, s, -np.inf).max(1)
                ok = np.isfinite(best)
                nearer = ((s > best[:, None]) & other).sum(1)
                share = 1 - nearer / np.maximum(other.sum(1) - 1, 1)
                yield pa.RecordBatch.from_arrays([pa.array([float(share[ok].sum())]), pa.array([int(ok.sum())])], names=["s", "n"])

    if block is None:
        return evaluate(rows, [MeanRelativeRank()])
    groups = dealt.groupBy("chunk").agg(F.collect_list(F.struct("row", "label", F.col("vec").cast("array<double>").alias("vec"))).alias("right"))
    blocks = rows.select("row", "label", F.col("vec").cast("array<double>").alias("vec"), F.pmod(F.xxhash64("row"), F.lit(max(1, -(-rows.count() // BLOCK)))).alias("b")).groupBy("b").agg(F.collect_list(F.struct("row", "label", "vec")).alias("left"))
    n_chunks = groups.count()
    pairs = blocks.select("left", F.explode(F.sequence(F.lit(0), F.lit(n_chunks - 1))).alias("chunk")).join(groups, "chunk").select("left", "right")
    return pairs.mapInArrow(run, "s double, n long").agg(F.coalesce(F.sum("s") / F.sum("n"), F.lit(0.0)).alias("mean_relative_rank"))


def report(rows: DataFrame, k: int = 5, block: int = BLOCK) -> DataFrame:
    """One row: the moments of the similarities, and precision, accuracy, stability and relative rank from one pass over the pairs."""
    metrics = [TopKPrecision(k), TopKAccuracy(k), EntityStability(k), MeanRelativeRank()]
    return similarity_moments(rows).join(evaluate(rows, metrics, block))  # one row each


def residual_norm(pairs: DataFrame) -> DataFrame:
    """pairs: aligned, target. sqrt(sum |a - t|^2 / N)."""
    from augsearch.functions.vectors import squared_distance

    return pairs.agg(F.sqrt(F.avg(squared_distance(F.col("aligned"), F.col("target")))).alias("residual_norm"))


class _Distances(Meeting):
    """query_id, x, y: the distances of each row of a block to its neighbours, of the first `split` numbers of the vectors and of the others."""

    def __init__(self, own: Block, split: int):
        super().__init__(own)
        near = own["near"]
        self.at, self.near, self.split = np.repeat(np.arange(len(own.x)), near.value_lengths().fill_null(0).to_numpy()), near.flatten(), split
        self.near = self.near.to_numpy() if pa.types.is_integer(self.near.type) else np.array(self.near.to_pylist(), object)
        self.x, self.y = np.zeros(len(self.at)), np.full(len(self.at), -1.0)

    def add(self, other, same):
        ids, known = other.ids("row"), other["known"].to_numpy(zero_copy_only=False)
        place = np.minimum(np.searchsorted(ids, self.near), len(ids) - 1)
        found = np.flatnonzero(ids[place] == self.near)
        if len(found):
            square = (self.own.x[self.at[found]] - other.x[place[found]]) ** 2
            self.x[found] = np.sqrt(square[:, : self.split].sum(1))
            both = known[place[found]] & self.own["known"].to_numpy(zero_copy_only=False)[self.at[found]]
            self.y[found] = np.where(both, np.sqrt(square[:, self.split :].sum(1)), -1.0)
        return iter(())

    def result(self):
        yield pa.RecordBatch.from_arrays([self.own["row"].take(pa.array(self.at)), pa.array(self.x), pa.array(self.y, mask=self.y < 0)], names=["query_id", "x", "y"])


def local_distance_correlation(pairs: DataFrame, k: int = 5, block: int = BLOCK) -> DataFrame:
    """pairs: row, source, aligned. |r| of the distances to the k nearest rows in the source space, before and after, averaged.

    The rows' neighbours are ids; their vectors come past them in blocks, so that none is shuffled for each row that it is near to."""
    from augsearch.operators.retrieval import nearest

    rows = pairs.select("row", F.col("source").alias("embedding"), F.col("row").cast("string").alias("table_id"))  # so a row isn't its own neighbour
    near = nearest(rows.withColumnRenamed("row", "query_id"), rows.withColumnRenamed("row", "candidate_id"), k, "l2", True)
    near = near.groupBy(F.col("query_id").alias("row")).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "candidate_id"))), lambda x: x["candidate_id"]).alias("near"))
    n, source, aligned = pairs.agg(F.count("*"), F.max(F.size("source")), F.max(F.size("aligned"))).first()
    none = F.array_repeat(F.lit(0.0), F.lit(max(aligned or 0, 0)))
    both = F.concat(F.col("source").cast("array<double>"), F.coalesce(F.col("aligned").cast("array<double>"), none)).alias("vec")
    vectors = narrowed(pairs.filter("source is not null").select("row", F.col("aligned").isNotNull().alias("known"), both), "vec")
    tasks = max(1, -(-n // block))
    table = written(packed(vectors.repartition(tasks, "row").join(near.repartition(tasks, "row"), "row", "left"), "row", "vec", 2 * block), "neighbours")
    kind = pairs.schema["row"].dataType.simpleString()
    d = crossed(table, table, lambda own: _Distances(own, source), f"query_id {kind}, x double, y double", "vec")
    r = d.groupBy("query_id").agg(F.corr("x", "y").alias("r"), F.stddev_samp("x").alias("sx"), F.stddev_samp("y").alias("sy"), F.count("*").alias("n"))
    return r.filter((F.col("n") == k) & (F.col("sx") > 1e-8) & (F.col("sy") > 1e-8)).agg(F.coalesce(F.avg(F.abs("r")), F.lit(0.0)).alias("local_distance_correlation"))


def alignment_consistency(views: DataFrame) -> DataFrame:
    """views: sample, view, vec. The mean |cosine| over pairs of views of a sample."""
    from augsearch.functions.vectors import cosine

    a, b = views.select("sample", F.col("view").alias("v1"), F.col("vec").alias("x")), views.select("sample", F.col("view").alias("v2"), F.col("vec").alias("y"))
    pairs = a.join(b, "sample").filter("v1 < v2")
    return pairs.agg(F.coalesce(F.avg(F.abs(cosine(F.col("x"), F.col("y")))), F.lit(0.0)).alias("alignment_consistency"))


def procrustes_error(source: DataFrame, target: DataFrame) -> float:
    """sqrt(sum |residual|^2 / N) after the best rotation (no reflection) of the centred source."""
    from augsearch.operators.projection import _sums, paired

    n, s, t, st, ss, tt, _ = _sums(paired(source, target))[0]
    u, sv, vt = np.linalg.svd(st - np.outer(s, t) / n)
    if np.linalg.det(u @ vt) < 0:
        sv[-1] *= -1
    return float(np.sqrt(max(0.0, (ss - s @ s / n) + (tt - t @ t / n) - 2 * sv.sum()) / n))


def nt_xent(views: DataFrame, tau: float = 0.1, masked: bool = False) -> DataFrame:
    """views: batch, sample, view, vec. The mean loss of each batch; a batch is one group by definition.

    masked: the diagonal stays in the softmax at -10000 (InfoNCE) instead of being left out.
    """

    def run(key, frame):
        import pandas as pd

        v = np.array(frame.vec.tolist(), np.float64)
        v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        s, label = v @ v.T / tau, frame["sample"].to_numpy()
        me = np.eye(len(v), dtype=bool)
        positive = (label[:, None] == label[None, :]) & ~me
        if not positive.any(1).all():
            raise ValueError("two views are needed")
        s[me] = -1e4 if masked else -np.inf
        top = s.max(1, keepdims=True)
        log_p = s - top - np.log(np.exp(s - top).sum(1, keepdims=True))
        loss = -log_p[positive].mean() if masked else -(np.where(positive, np.where(me, 0, log_p), 0).sum(1) / positive.sum(1)).mean()
        return pd.DataFrame([(*key, float(loss))])

    return views.groupBy("batch").applyInPandas(run, "batch long, loss double")


def vec2vec(samples: DataFrame, weight_rec: float = 1.0, weight_vsp: float = 1.0, weight_cc: float = 1.0) -> DataFrame:
    """batch, rec_loss, vsp_loss, cc_trans_loss, cc_vsp_loss: the losses of translating between spaces through a shared one.

    samples: batch, sample, and lists of vectors: inputs and recons (one of each space), from_inverted (of space 0, gone to each other
    space and back) and to_inverted (of each other space, gone to space 0 and back). Reconstruction and cycle losses compare a sample with itself, by cosine;
    those of the vector space compare the cosines of all pairs of samples of a batch, before with after and before with across (over the
    dimensions that both have). Pairs go through tiles, so a batch may be of any size.
    """
    vectors = ("inputs", "recons", "from_inverted", "to_inverted")
    lists = [F.col(c).cast("array<array<double>>").alias(c) for c in vectors]
    samples = written(samples.select(F.col("batch").cast("long").alias("batch"), F.col("sample").cast("long").alias("row"), *lists), "samples")

    def loss(kind: str, ones: Column, others: Column) -> DataFrame:
        """The mean cosine loss of each place of two lists."""
        at = samples.select("batch", F.posexplode(F.arrays_zip(ones.alias("x"), others.alias("y"))).alias("at", "p"))
        cosine = dot(F.col("p.x"), F.col("p.y")) / F.greatest(norm(F.col("p.x")) * norm(F.col("p.y")), F.lit(1e-8))
        return at.groupBy("batch", "at").agg((1 - (F.avg(cosine) + 1e-8)).alias("loss")).groupBy("batch").agg(F.avg("loss").alias(kind))

    others = F.slice("inputs", F.lit(2), F.greatest(F.size("inputs") - 1, F.lit(0)))
    first = F.transform("from_inverted", lambda _: F.col("inputs")[0])
    own = loss("rec", F.col("inputs"), F.col("recons")).join(loss("cc", F.concat(first, others), F.concat("from_inverted", "to_inverted")), "batch", "left")

    def units(side: pa.Table, column: str, at: int) -> np.ndarray:
        x = np.array([v[at] for v in side[column].to_pylist()], np.float64)
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def compared(left, right, one):
        """(kind, place, sum over the tile's ordered pairs, pairs)"""
        n = len(left["inputs"][0].as_py())
        both = [("vsp", "inputs", i, "recons", i) for i in range(n)]
        both += [("cycle", "inputs", 0, "to_inverted", i) for i in range(n - 1)] + [("cycle", "inputs", i + 1, "from_inverted", i) for i in range(n - 1)]
        for place, (kind, before, b, after, a) in enumerate(both):
            total = pairs = 0.0
            for rows, columns in ((left, right),) if one else ((left, right), (right, left)):
                x, y = units(rows, before, b), units(columns, before, b)
                z, w = units(rows, after, a), units(columns, after, a)
                d = min(x.shape[1], z.shape[1])
                sims = x @ y.T
                total += np.abs(sims - z @ w.T).sum() + np.abs(sims - z[:, :d] @ y[:, :d].T).sum()
                pairs += sims.size
            yield pa.RecordBatch.from_arrays([pa.array([left["batch"][0].as_py()]), pa.array([kind]), pa.array([place], pa.int32()), pa.array([float(total)]), pa.array([float(pairs)])], names=["batch", "kind", "place", "total", "pairs"])

    spread = tiled(samples, compared, "batch long, kind string, place int, total double, pairs double", F.col("batch"))
    means = spread.groupBy("batch", "kind", "place").agg((F.sum("total") / F.sum("pairs")).alias("loss"))
    spaces = means.groupBy("batch").agg(*[F.avg(F.when(F.col("kind") == k, F.col("loss"))).alias(k) for k in ("vsp", "cycle")])
    return own.join(spaces, "batch").select("batch", (F.col("rec") * weight_rec).alias("rec_loss"), (F.col("vsp") * weight_vsp).alias("vsp_loss"), (F.col("cc") * weight_cc).alias("cc_trans_loss"), (F.col("cycle") * weight_cc).alias("cc_vsp_loss"))
