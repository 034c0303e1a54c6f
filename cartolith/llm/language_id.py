"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Inverse document frequencies are counted over all training documents, summed per task and merged by bucket. Weights
are trained with follow-the-regularised-leader under an elastic net on a bounded sample (about `PER_LANGUAGE` documents
of every language, whole texts), and the temperature of the softmax is fitted on at most a fifth of it. Scoring adds one
table row per n-gram and never needs a document's distinct n-grams, since term frequencies are relative to the text's length.

Languages are dealt into blocks of `BLOCK_LANGUAGES`, whatever their number. Each block is trained by a task on its own
documents and, where there are other blocks, on as many of the others, which are its class "other"; a language's score is
its logit less that of its block's "other". The driver gets the weights that are not zero and about `CALIBRATED` documents.
A single block is scored from a table with a row per language, which gives the same sums.

Nulls and odd rows: a null text and a text without a letter are ``und`` with score 0; rows with a null ``doc_id``
or ``lang`` are scored but teach nothing; without any training row everything is ``und`` and `keep_known` keeps
what has a letter; repeated rows are scored each; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolith.llm import hashed
from cartolith.llm.ftrl import Ftrl, epochs, fold, per_class_sample, softmax

ORDERS, BITS = (1, 2, 3), 17
PER_LANGUAGE = 1500
#: Languages of a block, and documents that the temperature is fitted on.
BLOCK_LANGUAGES, CALIBRATED = 16, 4000
#: Scores, and weights to be added, that are held at a time.
HELD = 1 << 22
FOLDS, HELD_OUT = 4, 2
#: Term frequencies are scaled to this length, so that common n-grams have values near one.
SCALE = 30.0
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")


class Blocks:
    """Weights other than zero of the languages and of each block's class "other", by feature."""

    def __init__(self, languages: int, columns: list[tuple[np.ndarray, np.ndarray]], block: np.ndarray):
        # The first ``languages`` columns are languages, the others the classes "other" in the order of the blocks.
        feature = np.concatenate([at for at, _ in columns]).astype(np.int64)
        order = np.argsort(feature, kind="stable")
        self.column = np.repeat(np.arange(len(columns), dtype=np.int32), [len(at) for at, _ in columns])[order]
        self.weight = np.concatenate([w for _, w in columns])[order]
        self.start = np.concatenate(([0], np.cumsum(np.bincount(feature, minlength=1 << BITS))))
        self.languages, self.width, self.block = languages, len(columns), block

    def add(self, sums: np.ndarray, row: np.ndarray, feature: np.ndarray, value: np.ndarray | None = None) -> None:
        """Add to ``sums`` (a row per text, a column per language and block) the weights of each (row, feature)."""
        count = self.start[feature + 1] - self.start[feature]
        ends = np.cumsum(count)
        a = 0
        while a < len(feature):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + HELD, "right")))
            n = count[a:b]
            at = np.repeat(self.start[feature[a:b]] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
            weight = self.weight[at] if value is None else self.weight[at] * np.repeat(value[a:b], n)
            low = int(row[a:b].min())
            high = int(row[a:b].max()) + 1
            place = (np.repeat(row[a:b], n) - low) * self.width + self.column[at]
            sums[low:high] += np.bincount(place, weight, (high - low) * self.width).reshape(-1, self.width)
            a = b

    def logits(self, sums: np.ndarray) -> np.ndarray:
        return sums[:, : self.languages] - sums[:, self.languages + self.block]

    def dense(self) -> np.ndarray:
        """The same weights as a row of all features per language."""
        table = np.zeros((1 << BITS, self.width))
        table[np.repeat(np.arange(1 << BITS), np.diff(self.start)), self.column] = self.weight
        return np.ascontiguousarray(self.logits(table).T)


class Model:
    """``table`` is a row of weights per language, or `Blocks`; then ``bias`` is less that of the block's "other"."""

    def __init__(self, languages: list[str], table: np.ndarray | Blocks, bias: np.ndarray, temperature: float):
        self.languages, self.table, self.bias, self.temperature = languages, table, bias, temperature

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Probabilities of each text's languages."""
        total, blocks = np.zeros(len(texts)), isinstance(self.table, Blocks)
        sums = np.zeros((len(texts), self.table.width if blocks else len(self.languages)))
        for row, feature in hashed.char_grams(texts, ORDERS, BITS):
            total += np.bincount(row, minlength=len(texts))
            if blocks:
                self.table.add(sums, row, feature)
                continue
            for k in range(len(self.languages)):
                sums[:, k] += np.bincount(row, self.table[k][feature], len(texts))
        sums = self.table.logits(sums) if blocks else sums
        return softmax((sums * SCALE / np.maximum(total, 1)[:, None] + self.bias) / self.temperature)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Best language and score of each text; a bounded number of scores is held at a time."""
        step = max(1, HELD // max(1, len(self.languages)))
        parts = [self._predict(texts[a : a + step]) for a in range(0, len(texts), step)]
        return [x for found, _ in parts for x in found], np.concatenate([score for _, score in parts] or [np.zeros(0)])

    def _predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        known = np.array([bool(self.languages) and bool(t) and LETTER.search(t) is not None for t in texts], bool)
        if not known.any():
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        p = self.scores([t if k else None for t, k in zip(texts, known)])
        best = p.argmax(axis=1)
        return [self.languages[b] if k else UNKNOWN for b, k in zip(best, known)], np.where(known, p.max(axis=1), 0.0)


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of the task that hold each bucket; bucket -1 counts the documents."""
    held, seen, n = np.zeros(1 << BITS, np.int64), np.full(1 << BITS, -1, np.int64), 0
    for batch in batches:
        for text in batch.column("text"):
            for _, feature in hashed.char_grams([text.as_py()], ORDERS, BITS):
                new = feature[seen[feature] != n]
                place = np.empty(1 << BITS, np.int32) if len(new) > 1 << BITS else _PLACES
                place[new] = np.arange(len(new))
                new = new[place[new] == np.arange(len(new))]
                held[new] += 1
                seen[new] = n
            n += 1
    at = np.flatnonzero(held)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(held[at], n))], ["bucket", "n"])


_PLACES = np.empty(1 << BITS, np.int32)


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        index, value = [], []
        for text in texts:
            found = [f for _, f in hashed.char_grams([text], ORDERS, BITS)]
            at, count = np.unique(np.concatenate(found) if found else np.zeros(0, np.int64), return_counts=True)
            index.append(at.astype(np.int32))
            value.append((count / max(1, count.sum())).astype(np.float32))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("lang"), pa.array(index, pa.list_(pa.int32())), pa.array(value, pa.list_(pa.float32()))],
            ["doc_id", "lang", "at", "tf"],
        )


def _temperature(logits: np.ndarray, truth: np.ndarray) -> float:
    loss = lambda t: -np.mean(np.log(softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12))
    return float(min(np.geomspace(0.05, 20, 121), key=loss)) if len(truth) else 1.0


def _train_blocks(sample: DataFrame, languages: list[str], expected: int, idf: np.ndarray, block_languages: int) -> Model:
    """Blocks of languages trained by the executors; ``expected`` is about the number of rows of ``sample``."""
    n_blocks = -(-len(languages) // block_languages)
    block = np.arange(len(languages)) % n_blocks
    number = {x: k for k, x in enumerate(languages)}
    shared = sample.sparkSession.sparkContext.broadcast((number, idf))
    # Documents for the temperature teach nothing.
    draw = F.pmod(F.xxhash64("doc_id", F.lit("temperature")), F.lit(1 << 30)) < int(min(0.2, CALIBRATED / max(1, expected)) * (1 << 30))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every document for its own block, and for another one as a document of no language of that block."""
        for batch in _vectors(batches):
            ids, n = batch.column("doc_id").to_pylist(), batch.num_rows
            own = np.array([shared.value[0][x] for x in batch.column("lang").to_pylist()], np.int64)
            blocks, targets, source = [own % n_blocks], [own // n_blocks], [np.arange(n)]
            if n_blocks > 1:
                other = np.array([zlib.crc32(b"%d" % i) for i in ids], np.int64) % (n_blocks - 1)
                blocks.append((own + 1 + other) % n_blocks)
                targets.append(np.full(n, -1))
                source.append(np.arange(n))
            take = pa.array(np.concatenate(source))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(blocks)), pa.array(np.concatenate(targets)), *(batch.column(c).take(take) for c in ("doc_id", "at", "tf"))],
                ["block", "target", "doc_id", "at", "tf"],
            )

    def fitted(group: pa.Table) -> pa.Table:
        k = group.column("block")[0].as_py()
        members = np.flatnonzero(block == k)
        model = Ftrl(1 << BITS, len(members) + 1, alpha=0.3, l1=0.02, l2=0.01)
        eye, target, at, tf = np.eye(len(members) + 1), group.column("target").to_numpy(), group.column("at"), group.column("tf")
        # Rows that share an id go in the order of their vectors, so that a model depends on the rows alone.
        digest = np.array([zlib.crc32(a.values.to_numpy().tobytes() + b.values.to_numpy().tobytes()) for a, b in zip(at, tf)])
        order = np.lexsort((digest, target, group.column("doc_id").to_numpy()))
        for i in epochs(order, 2):
            features = at[int(i)].values.to_numpy()
            model.step(features, tf[int(i)].values.to_numpy() * shared.value[1][features] * SCALE, eye[target[i]], softmax)
        weights = model.weights().T
        found = [np.flatnonzero(w) for w in weights]
        columns = [*members.tolist(), len(languages) + k]
        return pa.table({
            "column": pa.array(columns, pa.int32()), "bias": pa.array(model.bias), "at": pa.array([f.astype(np.int32) for f in found], pa.list_(pa.int32())),
            "weight": pa.array([w[f] for w, f in zip(weights, found)], pa.list_(pa.float64())),
        })

    taught = sample.where(~draw).mapInArrow(dealt, "block bigint, target bigint, doc_id bigint, at array<int>, tf array<float>")
    got = taught.groupBy("block").applyInArrow(fitted, "column int, bias double, at array<int>, weight array<double>").toArrow()
    empty = (np.zeros(0, np.int64), np.zeros(0))
    columns, bias = [empty] * (len(languages) + n_blocks), np.zeros(len(languages) + n_blocks)
    for column, b, at, weight in zip(got.column("column").to_pylist(), got.column("bias").to_pylist(), got.column("at"), got.column("weight")):
        columns[column], bias[column] = (at.values.to_numpy(), weight.values.to_numpy()), b
    weights, bias = Blocks(len(languages), columns, block), bias[: len(languages)] - bias[len(languages) + block]
    rest = sample.where(draw).mapInArrow(_vectors, "doc_id bigint, lang string, at array<int>, tf array<float>").toArrow()
    sums, truth = np.zeros((rest.num_rows, weights.width)), np.array([number[x] for x in rest.column("lang").to_pylist()], np.int64)
    for k, (at, tf) in enumerate(zip(rest.column("at"), rest.column("tf"))):
        at = at.values.to_numpy()
        weights.add(sums, np.full(len(at), k), at.astype(np.int64), tf.values.to_numpy() * idf[at] * SCALE)
    temperature = _temperature(weights.logits(sums) + bias, truth)
    weights.weight = weights.weight * np.repeat(idf, np.diff(weights.start))
    return Model(languages, weights.dense() if n_blocks == 1 else weights, bias, temperature)


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, block_languages: int = BLOCK_LANGUAGES) -> Model:
    """Learn from text and ``lang`` of the documents outside the held-out fold."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(FOLDS) != HELD_OUT))
    counted = rows.select("text").mapInArrow(_document_counts, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    table = {r["bucket"]: r["n"] for r in counted.collect()}  # one row per bucket at most
    total = table.pop(-1, 0)
    idf = np.full(1 << BITS, np.log(1 + total) + 1)
    idf[list(table)] = np.log((1 + total) / (1 + np.array(list(table.values()), float))) + 1
    # Chosen by id and text, and copies once, so an id that very many rows share doesn't fill the sample.
    sample, counts = per_class_sample(rows, "lang", per_language, by=("doc_id", "text"))
    sample = sample.dropDuplicates(["doc_id", "lang", "text"])
    languages = sorted(counts)
    if not languages:
        return Model([], np.zeros((0, 1 << BITS)), np.zeros(0), 1.0)
    return _train_blocks(sample, languages, sum(min(per_language, n) for n in counts.values()), idf, block_languages)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            languages, score = shared.value.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(languages), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(fold(FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text")
    )
    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """Train on ``docs`` and predict every row."""
    return predict(docs, train(docs))


def keep_known(docs: DataFrame, least_score: float = 0.3) -> DataFrame:
    """Rows of ``docs`` with a letter whose best language scores ``least_score`` or more; all columns stay."""
    model = train(docs)
    shared, known = docs.sparkSession.sparkContext.broadcast(model), bool(model.languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            languages, score = shared.value.predict(texts)
            if known:
                keep = [x != UNKNOWN and s >= least_score for x, s in zip(languages, score)]
            else:
                keep = [bool(t) and LETTER.search(t) is not None for t in texts]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
