"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the presence of single words, word beginnings, neighbouring pairs and pairs with one word between;
pairs, which are many and mostly seen once, have the smaller value `PAIR_VALUE`.
Per-coordinate rates and L1 leave few weights, which go to the tasks as two short arrays. Training reads at most
`PER_CLASS` labelled documents of each class, whole texts, outside the held-out fold; the bias is then moved to the
share of toxic rows among all labelled ones.

Nulls and odd rows: null and empty texts get the score of a text without features; a ``doc_id`` with several labels
is toxic if any label says so; null labels teach nothing; without labels of both classes every score is the share
of toxic labels (0 without labels); repeated rows are scored each; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolith.llm import hashed
from cartolith.llm.ftrl import Ftrl, epochs, fold, per_class_sample, sigmoid

BITS, STEMS, PAIR_VALUE = 20, (4, 5, 6), 0.2
PER_CLASS = 4000
#: L1 penalty for each root of the number of examples of the rarer class; rounds over the examples.
L1, ROUNDS = 0.75, 6
FOLDS, HELD_OUT = 5, 0
_PAIR, _SKIP, _STEM = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def features(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(row, bucket, 1 for pairs and else 0) of every feature occurrence, block by block."""
    for row, h, own, stems in hashed.words(texts, 2, STEMS):
        yield row[own], hashed.bucket(h[own], BITS), 0
        for stem in stems:
            yield row[own], hashed.bucket(stem[own] * _STEM, BITS), 0
        for gap, factor in ((1, _PAIR), (2, _SKIP)):
            both = own[:-gap] & (row[:-gap] == row[gap:])
            yield row[:-gap][both], hashed.bucket((h[:-gap] * factor + h[gap:])[both], BITS), 1


class Model:
    def __init__(self, at: np.ndarray, weight: np.ndarray, bias: float):
        self.at, self.weight, self.bias = at, weight, bias

    def scores(self, texts: list[str | None]) -> np.ndarray:
        slot = np.zeros(1 << BITS, np.int32)
        slot[self.at] = np.arange(1, len(self.at) + 1)
        rows, slots = [], []
        for row, feature, pair in features(texts):
            s = slot[feature]
            rows.append(row[s > 0])
            slots.append(2 * s[s > 0].astype(np.int64) + pair)
        total = np.zeros(len(texts))
        if rows:
            row, s, _ = hashed.distinct_rows(np.concatenate(rows), np.concatenate(slots), BITS + 2)
            total = np.bincount(row, self.weight[s // 2 - 1] * np.where(s % 2, PAIR_VALUE, 1.0), len(texts)) if len(row) else total
        return sigmoid(total + self.bias)


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        index = []
        for text in batch.column("text"):
            found = [2 * f + pair for _, f, pair in features([text.as_py()])]
            index.append(np.unique(np.concatenate(found) if found else np.zeros(0, np.int64)).astype(np.int32))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(index, pa.list_(pa.int32()))], ["doc_id", "label", "at"])


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, per_class: int, kind: str):
    """Sampled (doc_id, text, label) outside the held-out fold, and the number of labelled rows of each class."""
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label).cast("int").alias("label"))
    known = known.where(F.col("label").isin(0, 1) & (fold(folds) != held_out)).groupBy("doc_id").agg(getattr(F, kind)("label").alias("label"))
    chosen, counts = per_class_sample(known, "label", per_class, 2)
    # The sample is bounded by its parameter, so it may be broadcast.
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), *[F.col(c) for c in ("n_chars",) if c in docs.columns])
    return rows.join(F.broadcast(chosen), "doc_id"), counts


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    sample, counts = labelled_sample(docs, labels, "toxic", FOLDS, HELD_OUT, per_class, "max")
    none, share = np.zeros(0, np.int64), counts.get(1, 0) / max(1, sum(counts.values()))
    if len(counts) < 2:
        return Model(none, np.zeros(0), float(np.log((share + 1e-9) / (1 - share + 1e-9))))
    found = sample.select("doc_id", "text", "label").mapInArrow(_vectors, "doc_id bigint, label int, at array<int>").toArrow()
    order = np.lexsort((found.column("label").to_numpy(), found.column("doc_id").to_numpy()))
    at, label = found.column("at").combine_chunks(), found.column("label").to_pylist()
    examples = [(at[int(k)].values.to_numpy(), label[int(k)]) for k in order]
    # The sum of gradients that a feature without meaning gathers grows with the root of the rarer class.
    rare = min(sum(label), len(label) - sum(label))
    model = Ftrl(1 << BITS, 1, alpha=1.0, l1=L1 * rare**0.5, l2=0.1)
    for index, target in epochs(examples, ROUNDS):
        if len(index):
            # A bucket that a word and a pair share counts once for each, so its values are added first.
            at, back = np.unique(index >> 1, return_inverse=True)
            model.step(at, np.bincount(back, np.where(index & 1, PAIR_VALUE, 1.0)), np.array([target]), sigmoid)
    weight = model.weights()[:, 0]
    kept = np.flatnonzero(weight)
    taken = sum(t for _, t in examples) / max(1, len(examples))
    shift = np.log(share / (1 - share)) - np.log((taken + 1e-9) / (1 - taken + 1e-9))
    return Model(kept, weight[kept], float(model.bias[0] + shift))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Per row: doc_id, held_out, score and predicted (1 at 0.5 or more)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = shared.value.scores(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores)], ["doc_id", "held_out", "score"])

    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(fold(FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text")
    )
    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, score double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
