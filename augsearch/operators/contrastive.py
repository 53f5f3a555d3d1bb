"""Projection heads for each view, trained so that the views of a row come together (NT-Xent over the whole batch).

Training is synchronous over minibatches. An epoch is one barrier job: each task has its share of every batch's rows, streams them in the
order of batches, and takes part in every step. What a step needs of the other tasks is gathered between them (`Peers`):
statistics of batch norms (forward and backward), projections and their log-sums for the loss, gradients of the weights. So a
step is that of the whole batch on one machine, whatever the number of tasks, and all tasks hold the same weights after it.
The first task returns weights and optimizer state, from which the driver starts the next epoch; losing an executor costs that epoch.

An epoch's order is a permutation of the rows' numbers (a * number + c modulo their count, drawn for each epoch), so batches are composed anew by one shuffle.
"""

from __future__ import annotations

import math
import secrets
import socket
import struct
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from augsearch.functions.storage import written
from augsearch.operators.ranges import numbered

EPS, MOMENTUM = 1e-5, 0.1
#: Tasks of a barrier job, at most, unless said otherwise: all of them need a core at the same time.
TASKS = 16
_ROOT = math.sqrt(2 / math.pi)


def _gelu(x):
    return 0.5 * x * (1 + np.tanh(_ROOT * (x + 0.044715 * x**3)))


def _gelu_slope(x):
    t = np.tanh(_ROOT * (x + 0.044715 * x**3))
    return 0.5 * (1 + t) + 0.5 * x * (1 - t * t) * _ROOT * (1 + 3 * 0.044715 * x * x)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


ACTIVATIONS = {"relu": lambda x: np.maximum(x, 0), "silu": lambda x: x * _sigmoid(x), "gelu": _gelu}
SLOPES = {"relu": lambda x: (x > 0).astype(float), "silu": lambda x: (s := _sigmoid(x)) * (1 + x * (1 - s)), "gelu": _gelu_slope}
#: What a layer learns, in the order in which it is laid out; those of one dimension don't decay.
LEARNT = ("w", "b", "gamma", "beta")

Gather = Callable[[np.ndarray], list[np.ndarray]]


def alone(x: np.ndarray) -> list[np.ndarray]:
    """The all-gather of a single task."""
    return [x]


class Peers:
    """All-gather among the tasks of a barrier job, all of which run at the same time: the first collects what the others send and
    sends everything to all. The barrier's own all-gather waits a second each time, so it only tells where the first task listens. A lost peer
    breaks the connection, which fails the tasks, and Spark starts the job again."""

    def __init__(self, context):
        hosts = [i.address.rsplit(":", 1)[0] for i in context.getTaskInfos()]
        self.rank, self.links = context.partitionId(), []
        if len(hosts) == 1:
            return
        server = socket.create_server(("", 0), backlog=len(hosts)) if self.rank == 0 else None
        port, secret = context.allGather(f"{server.getsockname()[1]} {secrets.token_hex(16)}" if server else "")[0].split()
        if server:
            server.settimeout(300)
            by_rank = {}
            while len(by_rank) < len(hosts) - 1:
                link = server.accept()[0]
                link.settimeout(300)
                said, rank = struct.unpack("<32sq", self._bytes(link, 40))
                if secrets.compare_digest(said, secret.encode()):
                    by_rank[rank] = link
            self.links = [by_rank[r] for r in sorted(by_rank)]
            server.close()
        else:
            link = socket.create_connection((hosts[0], int(port)), timeout=300)
            link.sendall(struct.pack("<32sq", secret.encode(), self.rank))
            self.links = [link]
        for link in self.links:
            link.setsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY, 1)

    @staticmethod
    def _bytes(link: socket.socket, n: int) -> bytes:
        out = bytearray()
        while len(out) < n:
            if not (part := link.recv(min(1 << 20, n - len(out)))):
                raise ConnectionError("a task of the job is gone")
            out += part
        return bytes(out)

    def _received(self, link: socket.socket) -> bytes:
        return self._bytes(link, struct.unpack("<q", self._bytes(link, 8))[0])

    def __call__(self, x: np.ndarray) -> list[np.ndarray]:
        """What each task passed, in the tasks' order; arrays of one dimension."""
        if not self.links:
            return [x]
        own = np.ascontiguousarray(x, np.float64).tobytes()
        if self.rank == 0:
            parts = [own, *map(self._received, self.links)]
            message = b"".join([struct.pack("<q", len(p)) + p for p in parts])
            for link in self.links:
                link.sendall(struct.pack("<q", len(message)) + message)
        else:
            self.links[0].sendall(struct.pack("<q", len(own)) + own)
            message, parts, at = self._received(self.links[0]), [], 0
            while at < len(message):
                (n,) = struct.unpack_from("<q", message, at)
                parts.append(message[at + 8 : at + 8 + n])
                at += 8 + n
        return [np.frombuffer(p, np.float64) for p in parts]

    def close(self) -> None:
        for link in self.links:
            link.close()


def _flat(heads: list) -> np.ndarray:
    return np.concatenate([layer[p].ravel() for head in heads for layer in head for p in LEARNT if p in layer])


def _shaped(flat: np.ndarray, like: list) -> list:
    """Heads with the flat weights, and everything else as in `like`."""
    at, out = 0, []
    for head in like:
        out.append([])
        for layer in head:
            new = dict(layer)
            for p in LEARNT:
                if p in layer:
                    new[p] = flat[at : at + layer[p].size].reshape(layer[p].shape)
                    at += layer[p].size
            out[-1].append(new)
    return out


def _kept(seed: int, step: int, view: int, layer: int, rows: np.ndarray, width: int, share: float) -> np.ndarray:
    """Dropout's mask, a function of the row and the unit: the same however rows are dealt to tasks."""
    salt = np.uint64(hash((seed, step, view, layer)) & (2**64 - 1))
    with np.errstate(over="ignore"):
        x = rows.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(width, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03) + salt
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / 2.0**53 < share


def _moments(xs: list[np.ndarray], gather: Gather) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """Mean, variance and rows of each view over all tasks, by merging those of the tasks."""
    parts = []
    for x in xs:
        mean = x.mean(0) if len(x) else np.zeros(x.shape[1])
        parts.append(np.concatenate([[len(x)], mean, ((x - mean) ** 2).sum(0)]))
    out, at = [], 0
    every = gather(np.concatenate(parts))
    for x in xs:
        d = x.shape[1]
        n, means, squares = (np.array([p[at:][s] for p in every]) for s in (0, slice(1, 1 + d), slice(1 + d, 1 + 2 * d)))
        total = max(1.0, n.sum())
        mean = (n[:, None] * means).sum(0) / total
        out.append((mean, (squares.sum(0) + (n[:, None] * (means - mean) ** 2).sum(0)) / total, n.sum()))
        at += 1 + 2 * d
    return out


def forward(heads: list, xs: list[np.ndarray], activation: str, normalization: str | None, train: dict | None = None, gather: Gather = alone) -> tuple[list[np.ndarray], list]:
    """Projections of each view, and what the way back needs. train: seed, step, rows (their numbers) and dropout; batch norms then use the batch and renew their running statistics."""
    tape, depth = [], len(heads[0])
    for k in range(depth):
        last = k == depth - 1
        note = [{"x": x} for x in xs]
        ys = [x @ h[k]["w"] + h[k].get("b", 0.0) for x, h in zip(xs, heads)]
        if normalization == "batch":
            if train is not None:
                moments = _moments(ys, gather)
                for h, (mean, variance, n) in zip(heads, moments):
                    h[k]["mean"] = (1 - MOMENTUM) * h[k]["mean"] + MOMENTUM * mean
                    h[k]["var"] = (1 - MOMENTUM) * h[k]["var"] + MOMENTUM * variance * n / max(1, n - 1)
            else:
                moments = [(h[k]["mean"], h[k]["var"], 1) for h in heads]
            for t, y, (mean, variance, n) in zip(note, ys, moments):
                t.update(std=np.sqrt(variance + EPS), n=n)
                t["hat"] = (y - mean) / t["std"]
        elif normalization == "layer" and not last:
            for t, y in zip(note, ys):
                t["std"] = np.sqrt(y.var(1, keepdims=True) + EPS)
                t["hat"] = (y - y.mean(1, keepdims=True)) / t["std"]
        if "hat" in note[0]:
            ys = [t["hat"] * h[k]["gamma"] + h[k]["beta"] for t, h in zip(note, heads)]
        if not last:
            for v, t in enumerate(note):
                t["before"] = ys[v]
                ys[v] = ACTIVATIONS[activation](ys[v])
                if train is not None and train["dropout"] > 0:
                    share = 1 - train["dropout"]
                    t["mask"] = _kept(train["seed"], train["step"], v, k, train["rows"], ys[v].shape[1], share) / share
                    ys[v] = ys[v] * t["mask"]
        tape.append(note)
        xs = ys
    return xs, tape


def backward(heads: list, tape: list, gs: list[np.ndarray], activation: str, normalization: str | None, gather: Gather = alone) -> np.ndarray:
    """This task's part of the gradients of all weights, laid out as _flat does."""
    found = [[{} for _ in h] for h in heads]
    for k in range(len(tape) - 1, -1, -1):
        note = tape[k]
        for v, t in enumerate(note):
            if "mask" in t:
                gs[v] = gs[v] * t["mask"]
            if "before" in t:
                gs[v] = gs[v] * SLOPES[activation](t["before"])
            if "hat" in t:
                found[v][k].update(gamma=(gs[v] * t["hat"]).sum(0), beta=gs[v].sum(0))
                gs[v] = gs[v] * heads[v][k]["gamma"]
        if normalization == "batch":
            sums = np.sum(gather(np.concatenate([np.concatenate([g.sum(0), (g * t["hat"]).sum(0)]) for g, t in zip(gs, note)])), 0)
            at = 0
            for v, t in enumerate(note):
                d = gs[v].shape[1]
                gs[v] = (gs[v] - (sums[at : at + d] + t["hat"] * sums[at + d : at + 2 * d]) / max(1.0, t["n"])) / t["std"]
                at += 2 * d
        elif "hat" in note[0]:
            gs = [(g - g.mean(1, keepdims=True) - t["hat"] * (g * t["hat"]).mean(1, keepdims=True)) / t["std"] for g, t in zip(gs, note)]
        for v, t in enumerate(note):
            found[v][k]["w"] = t["x"].T @ gs[v]
            if "b" in heads[v][k]:
                found[v][k]["b"] = gs[v].sum(0)
            gs[v] = gs[v] @ heads[v][k]["w"].T
    return _flat(found)


def nt_xent(zs: list[np.ndarray], tau: float, gather: Gather = alone, rank: int = 0, block: int = 1024) -> tuple[float, list[np.ndarray], int]:
    """This task's part of the loss over the batch of all tasks, its gradient by this task's projections, and the batch's rows. zs: of each view, the same rows. rank: this task's place among all."""
    v, b = len(zs), len(zs[0])
    z = np.concatenate(zs)
    size = np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
    u = z / size
    parts = [p.reshape(-1, z.shape[1]) for p in gather(u.ravel())]
    every = np.concatenate(parts)
    counts = [len(p) // v for p in parts]
    label = np.concatenate([np.tile(np.arange(c), v) + before for c, before in zip(counts, np.cumsum([0, *counts]))])
    start, total = sum(len(p) for p in parts[:rank]), len(every)
    own = np.arange(start, start + len(u))  # where this task's rows are among all
    lse, loss = np.zeros(len(u)), 0.0
    positives = max(1, v - 1)

    def similar(rows: slice) -> tuple[np.ndarray, np.ndarray]:
        s = u[rows] @ every.T / tau
        s[np.arange(len(s)), own[rows]] = -np.inf
        same = label[own[rows]][:, None] == label[None, :]
        same[np.arange(len(s)), own[rows]] = False
        return s, same

    for at in range(0, len(u), block):
        s, same = similar(rows := slice(at, at + block))
        top = np.maximum(s.max(1), -1e300)
        lse[rows] = top + np.log(np.exp(s - top[:, None]).sum(1))
        loss += (lse[rows] - np.where(same, s, 0.0).sum(1) / positives).sum()
    all_lse = np.concatenate(gather(lse))
    du = np.zeros_like(u)
    for at in range(0, len(u), block):
        s, same = similar(rows := slice(at, at + block))
        # by both places that a pair stands in: this row's softmax, and the other's
        d = np.exp(s - lse[rows][:, None]) + np.exp(s - all_lse[None, :]) - 2 * same / positives
        du[rows] = d @ every / (total * tau)
    dz = (du - u * (du * u).sum(1, keepdims=True)) / size
    return loss / max(1, total), [dz[i * b : (i + 1) * b] for i in range(v)], total // v


def _rate(schedule: str, base: float, epoch: int, epochs: int, step: int, steps: int) -> float:
    if schedule == "constant":
        return base
    if schedule == "cosine":
        return base * 0.5 * (1 + math.cos(math.pi * epoch / epochs))
    # one cycle over all steps: up to the base over three tenths of them, then down to almost nothing
    up = max(1.0, 0.3 * steps - 1)
    low, high, share = (base / 25, base, step / up) if step <= up else (base, base / 25e4, (step - up) / max(1.0, steps - up - 1))
    return high + (low - high) * 0.5 * (1 + math.cos(math.pi * min(1.0, share)))


@dataclass
class ContrastiveHeads:
    """hidden: widths of the hidden layers, [2 * out_dim] by default. normalization: "batch" (also after the last layer), "layer" or None."""

    out_dim: int = 32
    hidden: list[int] | int | None = None
    activation: str = "relu"
    heads: list = field(default_factory=list)
    normalization: str | None = None
    dropout: float = 0.0
    history: list = field(default_factory=list)

    def start(self, dims: list[int], seed: int = 0) -> ContrastiveHeads:
        if self.activation not in ACTIVATIONS or self.normalization not in (None, "batch", "layer"):
            raise ValueError(f"unknown activation {self.activation!r} or normalization {self.normalization!r}")
        r = np.random.default_rng(seed)
        hidden = [self.hidden] if isinstance(self.hidden, int) else list(self.hidden or [2 * self.out_dim])
        self.heads = []
        for d in dims:
            self.heads.append([])
            for k, (a, b) in enumerate(zip([d, *hidden], [*hidden, self.out_dim])):
                last, bound = k == len(hidden), 1 / math.sqrt(a)
                layer = {"w": r.uniform(-bound, bound, (a, b))}
                if self.normalization != "batch":  # whose mean would take it away
                    layer["b"] = r.uniform(-bound, bound, b)
                if self.normalization == "batch" or self.normalization == "layer" and not last:
                    layer |= {"gamma": np.ones(b), "beta": np.zeros(b)}
                if self.normalization == "batch":
                    layer |= {"mean": np.zeros(b), "var": np.ones(b)}
                self.heads[-1].append(layer)
        return self

    def forward(self, x: np.ndarray, head: list) -> np.ndarray:
        return forward([head], [x], self.activation, self.normalization)[0][0]

    def fit(
        self, views: list[DataFrame], epochs: int = 20, rate: float = 1e-2, decay: float = 0.01, tau: float = 0.1, batch: int = 256, seed: int = 0,
        schedule: str = "cosine", validation: list[DataFrame] | None = None, patience: int | None = None, tasks: int | None = None,
    ) -> ContrastiveHeads:
        """views: column_id, embedding each; rows that all of them have are trained on, AdamW with decay of the matrices alone.

        With `validation` (views too) the weights of the epoch of least validation loss stay, and training ends after `patience` epochs without a
        lower one. `history` has the losses, rates and seconds of each epoch. tasks: of the barrier jobs, all of which need a core at the same time."""
        if len(views) < 2:
            raise ValueError("two views are needed")
        if schedule not in ("cosine", "constant", "one_cycle"):
            raise ValueError(f"unknown schedule {schedule!r}")
        spark = views[0].sparkSession
        rows, n = self._rows(views, seed)
        checked = self._rows(validation, seed) if validation else None
        tasks = max(1, min(tasks or min(TASKS, spark.sparkContext.defaultParallelism), n))
        self.start([len(r) for r in rows.select(*[f"v{i}" for i in range(len(views))]).first()], seed)
        size = len(_flat(self.heads))
        state = {"heads": self.heads, "m": np.zeros(size), "s": np.zeros(size), "step": 0}
        random, best, waited, self.history = np.random.default_rng(seed), None, 0, []
        steps = epochs * -(-n // batch)
        for epoch in range(epochs):
            began = time.perf_counter()
            rates = [_rate(schedule, rate, epoch, epochs, state["step"] + i, steps) for i in range(-(-n // batch))]
            order = self._dealt(rows, n, tasks, random)
            state, loss = self._epoch(order, n, state, tau, batch, {"rates": rates, "decay": decay, "seed": seed})
            note = {"epoch": epoch, "train_loss": loss, "rate": rates[-1]}
            if checked:
                note["val_loss"] = self._epoch(self._dealt(*checked, tasks, None), checked[1], state, tau, batch, None)[1]
                if best is None or note["val_loss"] < best[0]:
                    best, waited = (note["val_loss"], state["heads"]), 0
                else:
                    waited += 1
            self.history.append(note | {"seconds": time.perf_counter() - began})
            if patience is not None and waited >= patience:
                break
        self.heads = best[1] if best else state["heads"]
        return self

    def evaluate(self, views: list[DataFrame], tau: float = 0.1, batch: int = 256, seed: int = 0, tasks: int | None = None) -> float:
        """The mean loss of these views' rows in batches."""
        rows, n = self._rows(views, seed)
        tasks = max(1, min(tasks or min(TASKS, rows.sparkSession.sparkContext.defaultParallelism), n))
        return self._epoch(self._dealt(rows, n, tasks, None), n, {"heads": self.heads}, tau, batch, None)[1]

    @staticmethod
    def _rows(views: list[DataFrame], seed: int) -> tuple[DataFrame, int]:
        """nth (in random order), v0, v1 ...: a table, and its rows."""
        rows = views[0].select("column_id", F.col("embedding").cast("array<double>").alias("v0"))
        for i, w in enumerate(views[1:], 1):
            rows = rows.join(w.select("column_id", F.col("embedding").cast("array<double>").alias(f"v{i}")), "column_id")
        mixed = rows.withColumn("h", F.xxhash64("column_id", F.lit(seed)))
        table = written(numbered(mixed, ["h", "column_id"], name="nth").select(F.col("nth").cast("long").alias("nth"), *[f"v{i}" for i in range(len(views))]), "training-rows")
        n = table.count()
        if not n:
            raise ValueError("no row is in all views")
        return table, n

    @staticmethod
    def _dealt(rows: DataFrame, n: int, tasks: int, random: np.random.Generator | None) -> DataFrame:
        """The rows in the order of an epoch, each batch dealt to all tasks."""
        a = c = 0
        while random is not None and math.gcd(a, n) != 1:
            a, c = int(random.integers(1, n + 1)), int(random.integers(n))
        nth = F.col("nth") if random is None else F.pmod(F.col("nth") * F.lit(a) + F.lit(c), F.lit(n))
        placed = rows.withColumn("nth", nth.cast("long"))
        return placed.repartitionById(tasks, F.pmod("nth", F.lit(tasks)).cast("int")).sortWithinPartitions("nth")

    def _epoch(self, rows: DataFrame, n: int, state: dict, tau: float, batch: int, learn: dict | None) -> tuple[dict, float]:
        """The state after an epoch and its mean loss. learn: rates of the steps, decay and seed; None to look only."""
        shared = rows.sparkSession.sparkContext.broadcast(state)
        activation, normalization, dropout, n_batches = self.activation, self.normalization, self.dropout, -(-n // batch)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import BarrierTaskContext

            gather = Peers(BarrierTaskContext.get())
            now = shared.value
            heads, loss, seen = [[dict(layer) for layer in h] for h in now["heads"]], 0.0, 0
            decays = np.concatenate([np.full(layer[p].size, float(p == "w")) for h in heads for layer in h for p in LEARNT if p in layer])
            stream = _by_batch(batches, batch, n_batches, [h[0]["w"].shape[0] for h in heads])
            m, s, step = (now["m"].copy(), now["s"].copy(), now["step"]) if learn else (None, None, 0)
            for i, (nth, xs) in enumerate(stream):
                train = {"seed": learn["seed"], "step": step, "rows": nth, "dropout": dropout} if learn else None
                zs, tape = forward(heads, xs, activation, normalization, train, gather)
                part, gs, size = nt_xent(zs, tau, gather, gather.rank)
                if learn:
                    gradient = np.sum(gather(np.append(backward(heads, tape, gs, activation, normalization, gather), part)), 0)
                    gradient, part = gradient[:-1], gradient[-1]
                    step += 1
                    m, s = 0.9 * m + 0.1 * gradient, 0.999 * s + 0.001 * gradient**2
                    w = _flat(heads)
                    w = w - learn["rates"][i] * (m / (1 - 0.9**step) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8) + learn["decay"] * decays * w)
                    heads = _shaped(w, heads)
                else:
                    part = float(np.sum(gather(np.array([part]))))
                loss, seen = loss + part * size, seen + size
            gather.close()
            if gather.rank == 0:
                running = np.concatenate([layer[p] for h in heads for layer in h for p in ("mean", "var") if p in layer] or [np.zeros(0)])
                values = [_flat(heads), m, s, running] if learn else [np.zeros(0)] * 4
                yield pa.RecordBatch.from_arrays([pa.array([loss / max(1, seen)]), pa.array([step], pa.int64()), *[pa.array([x], pa.list_(pa.float64())) for x in values]], names=["loss", "step", "w", "m", "s", "running"])

        row = rows.mapInArrow(run, "loss double, step long, w array<double>, m array<double>, s array<double>, running array<double>", barrier=True).collect()[0]
        if not learn:
            return state, row.loss
        heads, running, at = _shaped(np.array(row.w), state["heads"]), np.array(row.running), 0
        for h in heads:
            for layer in h:
                for p in ("mean", "var"):
                    if p in layer:
                        layer[p] = running[at : at + len(layer[p])]
                        at += len(layer[p])
        return {"heads": heads, "m": np.array(row.m), "s": np.array(row.s), "step": row.step}, row.loss

    def project(self, rows: DataFrame, view: int) -> DataFrame:
        from augsearch.operators.projection import mapped

        if not 0 <= view < len(self.heads):
            raise ValueError(f"unknown view {view}")
        shared = rows.sparkSession.sparkContext.broadcast(self.heads[view])
        return mapped(rows, lambda x, head: self.forward(x, head), shared)


def _by_batch(batches: Iterator[pa.RecordBatch], size: int, n_batches: int, dims: list[int]) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """This task's rows of each batch in turn, none where it has none: numbers, and a matrix for each view."""
    held, at = [], 0

    def joined() -> tuple[np.ndarray, list[np.ndarray]]:
        if not held:
            return np.zeros(0, np.int64), [np.zeros((0, d)) for d in dims]
        return np.concatenate([h[0] for h in held]), [np.concatenate([h[1][i] for h in held]) for i in range(len(dims))]

    for b in batches:
        nth = np.asarray(b.column(0))
        xs = [np.asarray(c.flatten(), np.float64).reshape(len(nth), -1) for c in b.columns[1:]]
        start = 0
        while start < len(nth):
            while nth[start] // size > at:
                yield joined()
                held, at = [], at + 1
            end = int(np.searchsorted(nth, (at + 1) * size))
            held.append((nth[start:end], [x[start:end] for x in xs]))
            start = end
    while at < n_batches:
        yield joined()
        held, at = [], at + 1
