"""Quality: a factorisation machine over hashed words, structure statistics and metadata.

Every pair of features interacts through the product of their low-rank vectors. The sum-of-squares identity turns
the sum over pairs into (sum)^2 - sum of squares per rank, so a text is scored in time linear in its features.
Training reads at most `PER_CLASS` labelled documents of each class, whole texts, outside the held-out fold; the bias is
then moved to the share of good rows among all labelled ones.

Nulls and odd rows: null and empty texts are scored by their statistics, which are all zero; a null or missing
``n_chars`` is replaced by the text's length; a ``doc_id`` with several labels is good if all say so; null labels
teach nothing; without labels of both classes every score is the share of good labels (0 without labels); repeated
rows are scored each; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolith.llm import hashed
from cartolith.llm.ftrl import epochs, fold, sigmoid
from cartolith.llm.toxicity import labelled_sample

BITS, RANK, STATS, SIZES = 16, 8, 12, 40
PER_CLASS = 4000
FOLDS, HELD_OUT = 4, 2
WIDTH = (1 << BITS) + STATS + SIZES
#: Factors of the words' relative frequencies and of the statistics.
WORDS, SHARES = 3.0, 4.0
# Classes of bytes: 0 other, 1 upper, 2 lower or beyond ASCII, 3 digit, 4 white space, 5 mark, 6 sign.
_CLASS = bytes(
    1 if 65 <= c <= 90 else 2 if 97 <= c <= 122 or c >= 128 else 3 if 48 <= c <= 57 else 4 if c in b" \t\n\r\x0b\x0c"
    else 5 if c in b".,;:!?'\"()-" else 6 if c > 32 else 0 for c in range(256)
)


def statistics(text: str | None) -> np.ndarray:
    """Shares of character classes, repetition and lengths, each between 0 and 1."""
    out = np.zeros(STATS)
    if not text:
        return out
    raw = text.encode("utf-8", "surrogatepass")
    share = np.bincount(np.frombuffer(raw.translate(_CLASS), np.uint8), minlength=7) / len(raw)
    words, lines = raw.split(), raw.split(b"\n")
    out[:6] = share[1:7]
    out[6] = raw.count(b"!") / len(raw)
    out[7] = len(set(lines)) / len(lines)
    if words:
        out[8] = len(set(words)) / len(words)
        out[9] = min(1.0, len(raw) / len(words) / 20)
        out[10] = min(1.0, np.log1p(len(words)) / 12)
    out[11] = min(1.0, len(lines) / (len(words) + 1))
    return out


def features(texts: list[str | None], sizes: list[int | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, value), by row."""
    rows, at, counts, total = [], [], [], np.zeros(len(texts))
    for row, h, _, _ in hashed.words(texts):
        r, f, c = hashed.distinct_rows(row, hashed.bucket(h, BITS), BITS)
        rows.append(r)
        at.append(f)
        counts.append(c)
        total += np.bincount(row, minlength=len(texts))
    every = np.arange(len(texts))
    if rows:
        r, f, c = np.concatenate(rows), np.concatenate(at), np.concatenate(counts)
        # A long text comes in several blocks, so its counts are merged.
        key, inverse = np.unique((r << BITS) | f, return_inverse=True)
        c = np.bincount(inverse, c)
        r, f = key >> BITS, key & ((1 << BITS) - 1)
    else:
        r, f, c = (np.zeros(0, np.int64) for _ in range(3))
    stats = np.array([statistics(t) for t in texts]).reshape(len(texts), STATS)
    length = np.array([len(t or "") if n is None else max(0, n) for t, n in zip(texts, sizes)], float)
    size = np.minimum(SIZES - 1, (2 * np.log2(length + 1)).astype(np.int64))
    row = np.concatenate((r, np.repeat(every, STATS), every))
    feature = np.concatenate((f, np.tile((1 << BITS) + np.arange(STATS), len(texts)), (1 << BITS) + STATS + size))
    value = np.concatenate((WORDS * c / np.maximum(total[r], 1), SHARES * stats.ravel(), np.ones(len(texts))))
    order = np.argsort(row, kind="stable")
    return row[order], feature[order], value[order]


class Model:
    def __init__(self, bias: float, linear: np.ndarray, vectors: np.ndarray):
        self.bias, self.linear, self.vectors = bias, linear, vectors

    def scores(self, texts: list[str | None], sizes: list[int | None]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        row, at, x = features(texts, sizes)
        start = np.searchsorted(row, np.arange(len(texts)))
        out = self.bias + np.add.reduceat(self.linear[at] * x, start)
        for k in range(RANK):
            v = self.vectors[k][at] * x
            out += 0.5 * (np.add.reduceat(v, start) ** 2 - np.add.reduceat(v * v, start))
        return sigmoid(out)


def _fit(examples: list[tuple[np.ndarray, np.ndarray, int]], rounds: int = 6, rate: float = 0.1, decay: float = 1e-4) -> Model:
    """Stochastic gradient descent with per-coordinate rates."""
    bias, linear = 0.0, np.zeros(WIDTH)
    vectors = np.random.default_rng(7).normal(0, 0.05, (WIDTH, RANK))
    seen, seen_v, seen_b = np.full(WIDTH, 1e-2), np.full((WIDTH, RANK), 1e-2), 1e-2
    for at, x, target in epochs(examples, rounds):
        v = vectors[at]
        s = x @ v
        score = bias + linear[at] @ x + 0.5 * float((s * s).sum() - ((v * x[:, None]) ** 2).sum())
        error = float(sigmoid(np.array(score))) - target
        g, gv = error * x + decay * linear[at], error * (x[:, None] * s - v * (x * x)[:, None]) + decay * v
        seen[at] += g * g
        seen_v[at] += gv * gv
        seen_b += error * error
        linear[at] -= rate * g / np.sqrt(seen[at])
        vectors[at] -= rate * gv / np.sqrt(seen_v[at])
        bias -= rate * error / np.sqrt(seen_b)
    return Model(bias, linear, np.ascontiguousarray(vectors.T))


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        row, at, x = features(batch.column("text").to_pylist(), batch.column("n_chars").to_pylist())
        cut = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(cut), pa.array(v)) for v in (at.astype(np.int32), x)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), *lists], ["doc_id", "label", "at", "x"])


def _with_size(docs: DataFrame) -> DataFrame:
    return docs if "n_chars" in docs.columns else docs.withColumn("n_chars", F.lit(None).cast("bigint"))


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    sample, counts = labelled_sample(_with_size(docs), labels, "quality", FOLDS, HELD_OUT, per_class, "min")
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    if len(counts) < 2:
        return Model(float(np.log((share + 1e-9) / (1 - share + 1e-9))), np.zeros(WIDTH), np.zeros((RANK, WIDTH)))
    rows = sample.select("doc_id", "text", F.col("n_chars").cast("bigint").alias("n_chars"), "label")
    found = rows.mapInArrow(_vectors, "doc_id bigint, label int, at array<int>, x array<double>").toArrow()
    order = np.lexsort((found.column("label").to_numpy(), found.column("doc_id").to_numpy()))
    at, x, label = found.column("at").combine_chunks(), found.column("x").combine_chunks(), found.column("label").to_pylist()
    examples = [(at[int(k)].values.to_numpy(), x[int(k)].values.to_numpy(), label[int(k)]) for k in order]
    model = _fit(examples)
    taken = sum(t for *_, t in examples) / max(1, len(examples))
    model.bias += float(np.log(share / (1 - share)) - np.log((taken + 1e-9) / (1 - taken + 1e-9)))
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Per row: doc_id, held_out, score and predicted (1 at 0.7 or more)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = []
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                scores.append(shared.value.scores(part.column("text").to_pylist(), part.column("n_chars").to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(np.concatenate(scores) if scores else [], pa.float64())], ["doc_id", "held_out", "score"])

    rows = _with_size(docs).select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(fold(FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"),
        F.col("text").cast("string").alias("text"), F.col("n_chars").cast("bigint").alias("n_chars"),
    )
    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, score double").withColumn("predicted", (F.col("score") >= 0.7).cast("int"))
