"""Sparse linear models trained with follow-the-regularised-leader (FTRL-proximal)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


class Ftrl:
    """Weights (features x classes) with an elastic-net penalty; each coordinate has its own rate."""

    def __init__(self, features: int, classes: int, alpha: float, beta: float, l1: float, l2: float):
        self.z = np.zeros((features, classes))
        self.n = np.zeros((features, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) > self.l1, w, 0.0)

    def update(self, at: np.ndarray, gradient: np.ndarray, weights: np.ndarray) -> None:
        """at: distinct features; weights: those that the gradient was taken at."""
        n = self.n[at]
        sigma = (np.sqrt(n + gradient**2) - np.sqrt(n)) / self.alpha
        self.z[at] += gradient - sigma * weights
        self.n[at] = n + gradient**2


@dataclass
class Rows:
    """Sparse rows: the features of row i are index[ends[i - 1]:ends[i]]."""

    index: np.ndarray
    value: np.ndarray
    ends: np.ndarray

    @classmethod
    def of(cls, indexes: list[np.ndarray], values: list[np.ndarray]) -> Rows:
        return cls(np.concatenate([*indexes, np.zeros(0, np.int64)]).astype(np.int64), np.concatenate([*values, np.zeros(0)]).astype(float), np.cumsum(np.array([len(x) for x in indexes], np.int64)))

    def __len__(self) -> int:
        return len(self.ends)

    def take(self, rows: np.ndarray) -> Rows:
        starts = np.concatenate([[0], self.ends[:-1]])[rows]
        sizes = self.ends[rows] - starts
        at = np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        return Rows(self.index[at], self.value[at], np.cumsum(sizes))

    def only(self, features: np.ndarray) -> Rows:
        """Without the features that the mask has not."""
        keep = features[self.index]
        return Rows(self.index[keep], self.value[keep], np.concatenate([[0], np.cumsum(keep)])[self.ends])

    def followed_by(self, other: Rows) -> Rows:
        return Rows(np.concatenate([self.index, other.index]), np.concatenate([self.value, other.value]), np.concatenate([self.ends, len(self.index) + other.ends]))

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.ends, prepend=0))

    def dot(self, w: np.ndarray) -> np.ndarray:
        """w: features x classes -> rows x classes"""
        out = np.zeros((len(self), w.shape[1]))
        for k in range(w.shape[1]):
            out[:, k] = np.bincount(self.row, self.value * w[self.index, k], len(self))
        return out


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def step(model: Ftrl, batch: Rows, residual_of) -> None:
    """One step on a batch. residual_of(logits) -> rows x classes: the loss's gradient by the logits."""
    at, local = np.unique(batch.index, return_inverse=True)
    w = model.weights(at)
    part = Rows(local, batch.value, batch.ends)
    residual = residual_of(part.dot(w))
    row = part.row
    gradient = np.stack([np.bincount(local, batch.value * residual[row, k], len(at)) for k in range(w.shape[1])], 1)
    model.update(at, gradient, w)


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least negative log-likelihood, by golden section over its logarithm."""
    if not len(y):
        return 1.0
    loss = lambda t: -np.log(np.maximum(softmax(logits / np.exp(t))[np.arange(len(y)), y], 1e-300)).mean()
    low, high, g = 0.0, 4.0, (5**0.5 - 1) / 2  # a set without errors would sharpen without end
    for _ in range(60):
        a, b = high - g * (high - low), low + g * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))
