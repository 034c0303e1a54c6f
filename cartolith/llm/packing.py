"""Best-fit packing by a configuration linear program over the length histogram.

Documents become pieces of at most one sequence length. Only the histogram of piece lengths reaches the driver, so
what is solved there has the size of a sequence, whatever the corpus holds. A configuration says how many pieces of
each length share a sequence. The covering program (least number of configurations that cover the histogram) is
solved by multiplicative weights: lengths that are covered lose weight, and a knapsack dynamic program prices the
best configuration of every step. The fractional solution is rounded down to whole sequences; what that leaves is
covered by the same weights and prices in whole steps. The result covers the histogram exactly, so sequences have no
gaps, and neither the steps nor the table of configurations grow with the number of pieces.

Pieces find their place by rank: the rank of a piece among pieces of its length comes from counts per (block,
length) and a rank within its block, where a block is a bounded share of the pieces; the place of that rank is
looked up in the bounded table of configurations.

Nulls and odd rows: a null text counts as empty and packs as the closing id alone; a null ``doc_id`` stays null;
repeated rows are packed each; an empty table gives an empty result. Texts are tokenized whole.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartolith.session import cut_lineage

#: Pieces that one block is meant to hold.
BLOCK_PIECES = 20_000
PLAIN = re.compile("[\\t-\\r\\x20-\\x7e\\xa1-\u024f]*")
#: White space that the rank tokenizer's pattern would walk back over; runs of about a million end it.
WIDE = re.compile("[\\t-\\r\\x20]{1000}")


class Encoder:
    """Ids of a tokenizer file of the ``tokenizers`` library, one closing id after each text.

    ``ranks`` may name the same vocabulary as a rank file of ``tiktoken``, which encodes about three times as fast.
    It is used for texts of Latin letters, digits, signs and plain white space, where both libraries split alike;
    all other texts, those with very long runs of white space or the string of an added token (which is that token's
    id), and all texts without ``ranks``, go to ``tokenizers``.
    """

    def __init__(self, path: str, ranks: str | None = None, closing: int = 0):
        from tokenizers import Tokenizer

        self.tokenizer, self.closing, self.fast = Tokenizer.from_file(path), closing, None
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(added) or "(?!)")
        if ranks:
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        if self.fast and PLAIN.fullmatch(text) and not WIDE.search(text) and not self.added.search(text):
            ids = self.fast.encode_ordinary(text)
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array([*ids, self.closing], "<u4")


def _piece_batches(path: str, ranks: str | None, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, ranks)
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = encoder.encode(text.as_py() or "")
                edges = [0, *range((len(ids) - 1) % capacity + 1, len(ids) + 1, capacity)]
                rows += [(doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(edges, edges[1:]))]
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    return run


def pieces(docs: DataFrame, tokenizer: str, ranks: str | None = None, capacity: int = 2048) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): texts longer than a sequence are cut; the first piece takes the rest."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(_piece_batches(tokenizer, ranks, capacity), "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def _knapsack(lengths: np.ndarray, most: np.ndarray, value: np.ndarray, capacity: int) -> list[tuple[int, int]]:
    """The most valuable filling of ``capacity`` by at most ``most`` pieces of each length: (length, count) pairs."""
    items = []
    for length, bound, worth in zip(lengths.tolist(), most.tolist(), value.tolist()):
        bound, count = min(bound, capacity // length), 1
        while bound > 0:  # counts of 1, 2, 4, ... and a rest, of which every number up to the bound is a sum
            count = min(count, bound)
            items.append((length, count, worth))
            bound, count = bound - count, 2 * count
    best, total, better = np.zeros(capacity + 1), np.zeros(capacity + 1), np.zeros((len(items), capacity + 1), bool)
    for (length, count, worth), gain in zip(items, better):
        size = length * count
        with_item, without = np.add(best[:-size], count * worth, out=total[size:]), best[size:]
        np.greater(with_item, without, out=gain[size:])
        np.maximum(with_item, without, out=without)
    room, used = capacity, Counter()
    for (length, count, _), gain in zip(reversed(items), better[::-1]):
        if gain[room]:
            used[length] += count
            room -= length * count
    return sorted(used.items(), reverse=True)


class Cover:
    """The covering program of a histogram, solved by multiplicative weights.

    A length weighs its tokens times exp(-RATE x the share of it that is covered). Every step prices the best
    configuration by a knapsack program and takes it as often as the scarcest of its lengths allows, so it uses a length
    up: the number of steps goes by the number of lengths, not of pieces. Pricing starts with the weightiest lengths of
    each band (upper bound, lengths) and takes four times as many until the configuration is full or all are priced.
    """

    RATE, PER_LENGTH = 0.5, 2
    BANDS = ((1 / 16, 32), (1 / 4, 24), (1, 24))

    def __init__(self, need: np.ndarray, capacity: int):
        self.need, self.left, self.capacity = need.astype(float), need.astype(float), capacity
        self.tie = np.linspace(0.02, 0, capacity + 1)  # of lengths covered alike, the longer ones come first

    def _priced(self, lengths: np.ndarray, covered: np.ndarray, times: int) -> np.ndarray:
        parts, above = [], 0
        for bound, count in self.BANDS:
            band = np.flatnonzero((lengths > above) & (lengths <= bound * self.capacity))
            if len(band) > count * times:
                band = band[np.argpartition(covered[band], count * times)[: count * times]]
            parts.append(band)
            above = bound * self.capacity
        return np.sort(np.concatenate(parts))[::-1]

    def step(self) -> tuple[tuple[tuple[int, int], ...], float]:
        """The next configuration and how often it is taken."""
        lengths, times = np.flatnonzero(self.left >= 1), 1
        covered = 1 - self.left[lengths] / self.need[lengths] + self.tie[lengths]
        while True:
            part = self._priced(lengths, covered, times)
            value = lengths[part] * np.exp(-self.RATE * covered[part])
            most = np.minimum(self.left[lengths[part]].astype(np.int64), self.PER_LENGTH)
            config = _knapsack(lengths[part], most, value, self.capacity)
            if len(part) == len(lengths) or sum(n * k for n, k in config) == self.capacity:
                break
            times *= 4
        return tuple(config), min(self.left[n] / k for n, k in config)

    def take(self, config: tuple[tuple[int, int], ...], amount: float) -> None:
        for n, k in config:
            self.left[n] -= amount * k


def configurations(need: np.ndarray, capacity: int = 2048) -> Counter:
    """How often each configuration ((length, count), ...) is used; together they hold exactly ``need[length]`` pieces.

    The fractional solution is rounded down to whole sequences, and what it leaves is covered in whole steps.
    """
    out, amounts = Counter(), Counter()
    if need[capacity]:
        out[((capacity, 1),)] = int(need[capacity])
    rest = np.where(np.arange(capacity + 1) == capacity, 0, need).astype(np.int64)
    solution = Cover(rest, capacity)
    while solution.left.sum() > max(0.02 * rest.sum(), np.count_nonzero(rest)):
        config, amount = solution.step()
        solution.take(config, amount)
        amounts[config] += amount
    for config, amount in amounts.items():
        if amount >= 1:
            out[config] += int(amount)
            for n, k in config:
                rest[n] -= int(amount) * k
    whole = Cover(rest, capacity)
    while whole.left.any():
        config, amount = whole.step()
        whole.take(config, int(amount))
        out[config] += int(amount)
    return out


class Places:
    """Where the piece of a length and a rank goes: flat tables over all configurations."""

    def __init__(self, packed: Counter, capacity: int):
        slots, base = {}, 0
        for config, times in sorted(packed.items(), reverse=True):
            offset = 0
            for length, count in config:
                slots.setdefault(length, []).append((base, count, times * count, offset))
                offset += length * count
            base += times
        self.first = np.zeros(capacity + 2, np.int64)
        rows, ends = [], []
        for length in range(capacity + 1):
            self.first[length] = len(rows)
            rows += slots.get(length, [])
        self.first[capacity + 1] = len(rows)
        self.base, self.count, held, self.offset = (np.array([r[k] for r in rows], np.int64) for k in range(4))
        for length in range(capacity + 1):
            part = held[self.first[length] : self.first[length + 1]]
            ends.append(np.cumsum(part) - part)
        self.begin = np.concatenate(ends) if rows else np.zeros(0, np.int64)
        self.sequences = base

    def of(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        wide = np.int64(1) << 46  # more pieces of one length than any corpus has
        key = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first)) * wide + self.begin
        row = np.searchsorted(key, length * wide + rank, "right") - 1
        inside = rank - self.begin[row]
        return self.base[row] + inside // self.count[row], self.offset[row] + inside % self.count[row] * length


def pack(docs: DataFrame, tokenizer: str, ranks: str | None = None, capacity: int = 2048) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id and offset in its sequence."""
    spark = docs.sparkSession
    cut = cut_lineage(pieces(docs, tokenizer, ranks, capacity), "pieces")
    blocks = max(1, -(-cut.count() // BLOCK_PIECES))
    cut = cut.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(blocks)))
    counts = cut_lineage(cut.groupBy("length", "block").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut_lineage(counts.select("length", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")), "piece-offsets")
    need = np.zeros(capacity + 1, np.int64)
    for row in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # a row for each length at most
        need[row["length"]] = row["n"]
    places = spark.sparkContext.broadcast(Places(configurations(need, capacity), capacity))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = places.value.of(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
            columns = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
            )

    within = F.row_number().over(Window.partitionBy("length", "block").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = cut.withColumn("within", within).join(offsets, ["length", "block"])
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("within")).alias("rank")).mapInArrow(
        placed, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    )


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, n_pieces, n_tokens, pieces) of each sequence; a sequence has at most as many pieces as tokens."""
    return packed.groupBy("sequence_id").agg(
        F.count(F.lit(1)).alias("n_pieces"), F.sum("length").alias("n_tokens"),
        F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "length"))).alias("pieces"),
    )
