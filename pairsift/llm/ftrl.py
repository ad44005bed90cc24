"""Follow-the-regularised-leader (FTRL-Proximal) for sparse softmax and logistic regression."""

from __future__ import annotations

import numpy as np


class FtrlProximal:
    """``outputs`` linear scores over ``size`` features, with elastic-net penalties ``l1`` and ``l2``.

    Each feature keeps the sum of adjusted gradients ``z`` and of squared gradients ``n``;
    the weight follows from both in closed form and is exactly 0 while ``|z| <= l1``.
    """

    def __init__(self, size: int, outputs: int, alpha: float, beta: float, l1: float, l2: float) -> None:
        self.z, self.n = np.zeros((size, outputs)), np.zeros((size, outputs))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, features: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[features], self.n[features]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0.0)
        return -shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def learn(self, features: np.ndarray, values: np.ndarray, target: np.ndarray) -> None:
        """One example: distinct features with their values; the target has a probability for each output."""
        held = self.weights(features)
        error = probabilities(values @ held) - target
        gradient = values[:, None] * error[None, :]
        squares = self.n[features]
        grown = squares + gradient * gradient
        self.z[features] += gradient - (np.sqrt(grown) - np.sqrt(squares)) / self.alpha * held
        self.n[features] = grown


def probabilities(scores: np.ndarray) -> np.ndarray:
    """Softmax over the last axis; the logistic function if there is one output."""
    if scores.shape[-1] == 1:
        return 0.5 * (1.0 + np.tanh(0.5 * scores))
    raised = np.exp(scores - scores.max(axis=-1, keepdims=True))
    return raised / raised.sum(axis=-1, keepdims=True)


def best_temperature(scores: np.ndarray, classes: np.ndarray) -> float:
    """The divisor of the scores with the least log loss on held-back examples (golden section over its logarithm)."""
    if not len(scores):
        return 1.0

    def loss(log_t: float) -> float:
        p = probabilities(scores / np.exp(log_t))
        return -np.log(np.maximum(p[np.arange(len(p)), classes], 1e-12)).mean()

    low, high, ratio = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


class Examples:
    """Sparse examples in three flat arrays: four bytes a feature and a value, and no array for each example."""

    def __init__(self) -> None:
        self.features: list[np.ndarray] = []
        self.values: list[np.ndarray] = []
        self.lengths: list[np.ndarray] = []

    def add(self, rows: np.ndarray, features: np.ndarray, values: np.ndarray, count: int) -> None:
        """``count`` more examples; rows (sorted) says whose each feature is."""
        self.features.append(features.astype(np.int32))
        self.values.append(values.astype(np.float32))
        self.lengths.append(np.bincount(rows, minlength=count))

    def pack(self) -> None:
        self.features = [np.concatenate([*self.features, np.zeros(0, np.int32)])]
        self.values = [np.concatenate([*self.values, np.zeros(0, np.float32)])]
        self.ends = np.concatenate([[0], np.cumsum(np.concatenate([*self.lengths, np.zeros(0, np.int64)]))])

    def __len__(self) -> int:
        return len(self.ends) - 1

    def get(self, i: int, bias: int) -> tuple[np.ndarray, np.ndarray]:
        """Features and values of one example, with a constant feature ``bias``."""
        a, b = self.ends[i], self.ends[i + 1]
        return np.append(self.features[0][a:b], bias), np.append(self.values[0][a:b], 1.0)
