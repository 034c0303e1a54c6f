"""Follow-the-regularised-leader with per-coordinate rates and elastic-net penalties, and samples to train on."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Ftrl:
    """Weights of ``size`` features by ``classes`` outputs; a bias per output is not penalised."""

    def __init__(self, size: int, classes: int, alpha: float, l1: float, l2: float, beta: float = 1.0):
        self.z, self.n = np.zeros((size, classes)), np.zeros((size, classes))
        self.bias, self.bias_n = np.zeros(classes), np.zeros(classes)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z = self.z[at]
        rate = (self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2
        return np.where(np.abs(z) > self.l1, (np.sign(z) * self.l1 - z) / rate, 0.0)

    def step(self, index: np.ndarray, value: np.ndarray, target: np.ndarray, link) -> None:
        """One example: ``link`` turns the scores into predictions; the gradient is their difference to ``target``."""
        w = self.weights(index)
        error = link(value @ w + self.bias) - target
        g = value[:, None] * error
        n = self.n[index]
        self.z[index] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[index] = n + g * g
        self.bias_n += error * error
        self.bias -= self.alpha * error / (self.beta + np.sqrt(self.bias_n))


def softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def sigmoid(s: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(s, -40, 40)))


def fold(of: int) -> Column:
    """CRC-32 of the ``doc_id`` as text, modulo ``of``; null for a null ``doc_id``."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % of


def per_class_sample(rows: DataFrame, label: str, per_class: int, classes: int | None = None, by: tuple = ("doc_id",)) -> tuple[DataFrame, dict]:
    """Rows of about ``per_class`` ids of each label, chosen by a hash of ``by``, and the number of rows of each.

    With ``classes``, only of that many commonest labels, and twice the expected number is the hard bound; that goes
    through one task, so it is for rows without texts.
    """
    found = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    found = (found if classes is None else found.orderBy(F.desc("n"), label).limit(classes)).collect()  # a row for each label
    counts = {r[label]: r["n"] for r in found}
    if not counts:
        return rows.limit(0), counts
    share = F.create_map(*(F.lit(x) for k, n in counts.items() for x in (k, per_class / n)))[F.col(label)]
    chosen = rows.where(F.pmod(F.xxhash64(*by, F.lit("sample")), F.lit(1 << 30)) < share * (1 << 30))
    return chosen if classes is None else chosen.limit(2 * per_class * len(counts)), counts


def epochs(examples: list, rounds: int) -> Iterable:
    """The examples in another, repeatable order each round."""
    for k in range(rounds):
        yield from (examples[i] for i in np.random.default_rng(k).permutation(len(examples)))
