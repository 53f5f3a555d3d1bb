"""Models that project several views into one space.

Fits make one pass of sums over the rows (means, cross products, squares) in the tasks; only matrices of the vectors' dimension
come to the driver. `project` is a function of rows with a broadcast of the parameters.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from augsearch.functions.storage import written
from augsearch.functions.vectors import normalised, padded, squared_distances, truncated
from augsearch.operators.contrastive import ACTIVATIONS, ContrastiveHeads
from augsearch.operators.linkage import average_linkage

OUT = "column_id string, embedding array<double>"


def mapped(rows: DataFrame, f, shared=None) -> DataFrame:
    """column_id, embedding with f applied to the matrix of each batch."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                y = f(np.array(b.column(1).to_pylist(), np.float64), shared.value if shared is not None else None)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(y), pa.list_(pa.float64()))], names=["column_id", "embedding"])

    return rows.select(F.col("column_id").cast("string").alias("column_id"), "embedding").mapInArrow(run, OUT)


@dataclass
class Naive:
    """Cuts all views to the least dimension, or pads them with zeros to the largest."""

    dims: list[int]
    mode: str = "truncate"

    @property
    def output_dim(self) -> int:
        return min(self.dims) if self.mode == "truncate" else max(self.dims)

    def expression(self, v: Column) -> Column:
        return truncated(v, self.output_dim) if self.mode == "truncate" else padded(v, self.output_dim)

    def project(self, rows: DataFrame, view: int) -> DataFrame:
        return rows.select("column_id", self.expression(F.col("embedding").cast("array<double>")).alias("embedding"))


def paired(source: DataFrame, target: DataFrame) -> DataFrame:
    return source.select("column_id", F.col("embedding").alias("s")).join(target.select("column_id", F.col("embedding").alias("t")), "column_id")


def _sums(pairs: DataFrame, by: str | None = None) -> dict:
    """key -> n, sums of s and t, of s t', of |s|^2, |t|^2 and of s s' over the rows; one row of matrices a task and key."""
    key = F.col(by).cast("int") if by else F.lit(0)

    def part(batches):
        acc: dict = {}
        for b in batches:
            if not b.num_rows:
                continue
            k, s, t = np.asarray(b.column(0)), np.array(b.column(1).to_pylist(), np.float64), np.array(b.column(2).to_pylist(), np.float64)
            for g in np.unique(k):
                x, y = s[k == g], t[k == g]
                now = [np.array([float(len(x))]), x.sum(0), y.sum(0), x.T @ y, np.array([(x * x).sum()]), np.array([(y * y).sum()]), x.T @ x]
                acc[g] = now if g not in acc else [p + q for p, q in zip(acc[g], now)]
        if acc:
            yield pa.RecordBatch.from_arrays([pa.array([int(g) for g in acc], pa.int32()), pa.array([np.concatenate([m.ravel() for m in v]) for v in acc.values()], pa.list_(pa.float64())), pa.array([[len(v[1]), len(v[2])] for v in acc.values()], pa.list_(pa.int32()))], names=["key", "sums", "dims"])

    cells = pairs.select(key.alias("key"), "s", "t").mapInArrow(part, "key int, sums array<double>, dims array<int>")
    # tasks' matrices are added element by element before anything comes to the driver
    total = cells.select("key", "dims", F.posexplode("sums").alias("pos", "x")).groupBy("key", "dims", "pos").agg(F.sum("x").alias("x"))
    rows = total.groupBy("key", "dims").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda c: c["x"]).alias("sums")).collect()
    out = {}
    for r in rows:
        ds, dt = r.dims
        v, at, parts = np.array(r.sums), 0, []
        for shape in ((), (ds,), (dt,), (ds, dt), (), (), (ds, ds)):
            size = int(np.prod(shape, dtype=int))
            parts.append(v[at : at + size].reshape(shape))
            at += size
        out[r.key] = parts
    return out


def _added(rows: DataFrame, f) -> np.ndarray:
    """The sum over the tasks of f(columns as matrices), whose shape all batches share; None without rows. Tasks' matrices are added before they come to the driver."""

    def part(batches):
        total = None
        for b in batches:
            if b.num_rows:
                now = f(*[np.array(c.to_pylist(), np.float64) for c in b.columns])
                total = now if total is None else total + now
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64())), pa.array([total.shape], pa.list_(pa.int32()))], names=["sums", "shape"])

    cells = rows.mapInArrow(part, "sums array<double>, shape array<int>").select("shape", F.posexplode("sums").alias("pos", "x"))
    total = cells.groupBy("shape", "pos").agg(F.sum("x").alias("x")).groupBy("shape").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda c: c["x"]).alias("sums")).first()
    return np.array(total.sums).reshape(total.shape) if total else None


def low_rank(pairs: DataFrame, rank: int, oversampling: int = 10, iterations: int = 4, seed: int = 0) -> tuple:
    """n, means, squared norms, and the leading singular vectors and values (u, sv, vt) of the centred cross product of pairs (s, t).

    A randomised range finder: the D x D product is never formed. Each half iteration is one pass in which every task multiplies its rows
    by a thin matrix of rank + oversampling columns; only such matrices come to the driver, where they are made orthogonal.
    """
    pairs = pairs.select("s", "t")
    first = _added(pairs, lambda s, t: np.concatenate([[len(s), (s * s).sum(), (t * t).sum()], s.sum(0), t.sum(0)]))
    d_s = len(pairs.first().s)
    n, ss, tt = first[:3]
    ms, mt = first[3 : 3 + d_s] / n, first[3 + d_s :] / n
    width = min(rank + oversampling, len(ms), len(mt))
    spark = pairs.sparkSession

    def product(w: np.ndarray, forth: bool) -> np.ndarray:
        """The centred product (or its transpose) with w."""
        shared, swap = spark.sparkContext.broadcast(w), not forth
        total = _added(pairs, lambda s, t: (t.T @ (s @ shared.value)) if swap else (s.T @ (t @ shared.value)))
        return total - n * (np.outer(mt, ms @ w) if swap else np.outer(ms, mt @ w))

    q = np.linalg.qr(product(np.random.default_rng(seed).standard_normal((len(mt), width)), True))[0]
    for _ in range(iterations):
        q = np.linalg.qr(product(np.linalg.qr(product(q, False))[0], True))[0]
    u, sv, vt = np.linalg.svd(product(q, False).T, full_matrices=False)
    return n, ms, mt, ss, tt, (q @ u)[:, :rank], sv[:rank], vt[:rank]


@dataclass
class Procrustes:
    """An orthogonal map of each view to view 0 after centring; scales are the norms of the uncentred data.

    rank: so many singular vectors, by a randomised range finder, where that is less than both dimensions; None for all of them."""

    rotation: bool = True
    maps: dict = field(default_factory=dict)
    rank: int | None = None

    def fit(self, views: list[DataFrame]) -> Procrustes:
        for i, v in enumerate(views[1:], 1):
            pairs = paired(v, views[0])
            dims = pairs.select(F.size("s"), F.size("t")).first()
            if self.rotation and self.rank is not None and self.rank < min(dims):
                _, ms, mt, ss, tt, u, _, vt = low_rank(pairs, self.rank)
                self.maps[i] = (ms, mt, float(np.sqrt(ss)), float(np.sqrt(tt)), u @ vt)
                continue
            n, s, t, st, ss, tt, _ = _sums(pairs)[0]
            ms, mt, ns, nt = s / n, t / n, np.sqrt(ss), np.sqrt(tt)
            m = (st - n * np.outer(ms, mt)) / (ns * nt)
            if self.rotation:
                u, _, vt = np.linalg.svd(m, full_matrices=False)
                r = u @ vt
            else:
                r = np.eye(len(s), len(t))
            self.maps[i] = (ms, mt, float(ns), float(nt), r)
        return self

    def project(self, rows: DataFrame, view: int) -> DataFrame:
        if view == 0:
            return rows.select(F.col("column_id").cast("string").alias("column_id"), F.col("embedding").cast("array<double>").alias("embedding"))
        if view not in self.maps:
            raise ValueError(f"unknown view {view}")
        shared = rows.sparkSession.sparkContext.broadcast(self.maps[view])
        return mapped(rows, lambda x, p: (x - p[0]) / p[2] @ p[4] * p[3] + p[1], shared)

    def expression(self, v: Column, view: int) -> Column:
        """The same as a Column, for small dimensions."""
        ms, mt, ns, nt, r = self.maps[view]
        x = F.zip_with(v, F.array(*map(F.lit, ms.tolist())), lambda a, m: (a - m) / ns)
        columns = F.array(*[F.array(*map(F.lit, c)) for c in r.T.tolist()])
        return F.zip_with(F.transform(columns, lambda c: F.aggregate(F.zip_with(x, c, lambda a, b: a * b), F.lit(0.0), lambda s, y: s + y) * nt), F.array(*map(F.lit, mt.tolist())), lambda a, m: a + m)


@dataclass
class Components:
    """Principal components of centred vectors: at most as many as dimensions or rows."""

    mean: np.ndarray | None = None
    axes: np.ndarray | None = None

    def fit(self, rows: DataFrame, most: int) -> Components:
        v = F.col("embedding").cast("array<double>")
        sums = _added(rows.select(v), lambda x: np.concatenate([[np.append(len(x), x.sum(0))], np.pad(x.T @ x, ((0, 0), (1, 0)))]))
        n, self.mean = sums[0, 0], sums[0, 1:] / sums[0, 0]
        values, vectors = np.linalg.eigh(sums[1:, 1:] / n - np.outer(self.mean, self.mean))
        axes = vectors[:, ::-1][:, : min(most, len(values), max(1, int(n)))]
        self.axes = axes * np.where(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])] < 0, -1.0, 1.0)  # the same signs in every run
        return self

    def project(self, rows: DataFrame) -> DataFrame:
        shared = rows.sparkSession.sparkContext.broadcast((self.mean, self.axes))
        return mapped(rows, lambda x, p: (x - p[0]) @ p[1], shared)


@dataclass
class LocalIsometry:
    """Clusters of each view are mapped to view 0 one by one: centred, rotated and scaled.

    clustering: "kmeans" or "avg_linkage". reduced_dim: views are first reduced to so many principal components each; 0 for none."""

    clusters: int = 8
    seed: int = 0
    maps: dict = field(default_factory=dict)
    clustering: str = "kmeans"
    reduced_dim: int = 0
    components: dict = field(default_factory=dict)

    def _labels(self, rows: DataFrame) -> DataFrame:
        """column_id, cluster"""
        if self.clustering == "avg_linkage":
            return average_linkage(rows, self.clusters)
        if self.clustering != "kmeans":
            raise ValueError(f"unknown clustering {self.clustering!r}")
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        rows = rows.select("column_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
        k = min(self.clusters, rows.count())
        model = KMeans(k=k, seed=self.seed, maxIter=20).fit(rows) if k > 1 else None
        return model.transform(rows).select("column_id", F.col("prediction").alias("cluster")) if model else rows.select("column_id", F.lit(0).alias("cluster"))

    def fit(self, views: list[DataFrame]) -> LocalIsometry:
        if self.reduced_dim > 0:
            self.components = {i: Components().fit(v, self.reduced_dim) for i, v in enumerate(views)}
            views = [written(self.components[i].project(v), "reduced-view") for i, v in enumerate(views)]
        for i, v in enumerate(views[1:], 1):
            pairs = paired(v, views[0]).join(self._labels(v), "column_id")
            centres, parts = [], []
            for _, (n, s, t, st, ss, _, _) in sorted(_sums(pairs, "cluster").items()):
                ms, mt = s / n, t / n
                u, sv, vt = np.linalg.svd(st - n * np.outer(ms, mt), full_matrices=False)
                spread = ss - n * ms @ ms
                scale = np.linalg.norm(sv) / spread if spread > 0 else np.nan
                centres.append(ms)
                parts.append((ms, mt, u @ vt, 1.0 if np.isnan(scale) else float(scale)))
            self.maps[i] = (np.array(centres), parts)
        return self

    def project(self, rows: DataFrame, view: int) -> DataFrame:
        if self.reduced_dim > 0 and view in self.components:
            rows = self.components[view].project(rows)
        if view == 0:
            return Procrustes().project(rows, 0)
        if view not in self.maps:
            raise ValueError(f"unknown view {view}")
        shared = rows.sparkSession.sparkContext.broadcast(self.maps[view])

        def f(x, p):
            centres, parts = p
            near = squared_distances(x, np.asarray(centres)).argmin(1)
            out = np.zeros((len(x), parts[0][2].shape[1]))
            for g in np.unique(near):
                ms, mt, r, scale = parts[g]
                out[near == g] = scale * (x[near == g] - ms) @ r + mt
            return out

        return mapped(rows, f, shared)


@dataclass
class TranslatorHeads:
    """Inference of per-view encoders and decoders around a shared residual network; outputs have unit length and lie in view 0."""

    encoders: list
    shared: list
    decoders: list

    def project(self, rows: DataFrame, view: int, target: int = 0) -> DataFrame:
        parts = rows.sparkSession.sparkContext.broadcast((self.encoders[view], self.shared, self.decoders[target]))

        def f(x, p):
            encoder, shared, decoder = p
            x = ACTIVATIONS["silu"](x @ encoder[0] + encoder[1])
            for w, b in shared:
                x = x + ACTIVATIONS["silu"](x @ w + b)
            y = x @ decoder[0] + decoder[1]
            return y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)

        return mapped(rows, f, parts)


def project_collection(views: list[DataFrame], model, splits: DataFrame) -> DataFrame:
    """column_id, view, embedding: each row of splits (column_id, view) through its view, normalised."""
    out = None
    for i, v in enumerate(views):
        mine = v.join(splits.filter(F.col("view") == i).select("column_id"), "column_id", "left_semi")
        part = model.project(mine, i).select("column_id", F.lit(i).alias("view"), normalised(F.col("embedding")).alias("embedding"))
        out = part if out is None else out.unionByName(part)
    return out


KINDS = {"naive": Naive, "procrustes": Procrustes, "local_isometry": LocalIsometry, "contrastive": ContrastiveHeads, "translator": TranslatorHeads}


def _plain(x):
    if isinstance(x, Components):
        return {"components": [_plain(x.mean), _plain(x.axes)]}
    if isinstance(x, np.ndarray):
        return {"array": x.tolist()}
    if isinstance(x, dict):
        return {"dict": [[k, _plain(v)] for k, v in x.items()]}
    if isinstance(x, (list, tuple)):
        return [_plain(v) for v in x]
    return x


def _back(x):
    if isinstance(x, dict) and "components" in x:
        return Components(*map(_back, x["components"]))
    if isinstance(x, dict):
        return np.array(x["array"]) if "array" in x else {k: _back(v) for k, v in x["dict"]}
    return [_back(v) for v in x] if isinstance(x, list) else x


def save_model(model, path: str) -> None:
    kind = next(k for k, c in KINDS.items() if type(model) is c)
    with open(path, "w") as f:
        json.dump({"model_type": kind, "state": _plain(vars(model))}, f)


def load_model(path: str):
    with open(path) as f:
        saved = json.load(f)
    if saved["model_type"] not in KINDS:
        raise TypeError(f"unknown model type {saved['model_type']!r}")
    model = KINDS[saved["model_type"]].__new__(KINDS[saved["model_type"]])
    vars(model).update(_back(saved["state"]))
    return model
