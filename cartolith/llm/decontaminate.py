"""Benchmark decontamination with an FM-index per training shard.

Benchmark items become windows of 13 consecutive words (a shorter item is one window). A task reads its documents
shard by shard: words become numbers of the benchmark's vocabulary, and stretches of known words that can hold a
window form the shard's text. Over it stand a suffix array, its Burrows-Wheeler transform in a wavelet tree, and
suffix positions sampled every few words. All windows are searched backwards at once through wavelet ranks;
occurrences are located by walking to the next sampled suffix, and their spans are merged per document. Documents
never leave their task, so nothing is shuffled until (document, items) digests are made.

Windows reach the tasks in blocks of about `BLOCK_WINDOWS`. A shard's words meet one block after the other in the same
worker, which holds one block at a time; documents are read once, however many blocks there are.

Nulls and odd rows: a null or wordless text has no words and is never contaminated; a null benchmark text has no
window; a null ``item_id`` reads as the text ``null``; repeated rows are judged each for itself; an empty
benchmark leaves every document clean; an empty documents table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolith.llm.common import filter_by_id, free_name
from cartolith.session import cut_lineage

WINDOW = 13
#: Windows in one broadcast (each is 13 words, so a block stays in the tens of MB).
BLOCK_WINDOWS = 200_000
#: Words in the text of one shard, and documents whose results a task holds at once.
SHARD_WORDS, SHARD_DOCS = 1_000_000, 5_000
SAMPLE = 8

_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else 32 if c < 48 or 58 <= c <= 96 or 123 <= c <= 127 else c for c in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words: runs of digits, ASCII letters and everything beyond ASCII, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; only suffixes that are still tied are sorted again."""
    n = len(symbols)
    values, inverse, counts = np.unique(symbols, return_inverse=True, return_counts=True)
    starts = np.concatenate(([0], np.cumsum(counts)[:-1]))
    rank = np.append(starts[inverse], -1).astype(np.int64)
    tied, step = np.flatnonzero(counts[inverse] > 1), 1
    while len(tied):
        group, after = rank[tied], rank[np.minimum(tied + step, n)]
        order = np.argsort(group * (n + 2) + after + 1)
        tied, group, after = tied[order], group[order], after[order]
        new_group = np.append(True, group[1:] != group[:-1])
        new = new_group | np.append(True, after[1:] != after[:-1])
        at = np.arange(len(tied))
        first = np.maximum.accumulate(np.where(new, at, 0))
        rank[tied] = group + first - np.maximum.accumulate(np.where(new_group, at, 0))
        tied = tied[~(new & np.append(new[1:], True))]
        step *= 2
    order = np.empty(n, np.int64)
    order[rank[:n]] = np.arange(n)
    return order


class FMIndex:
    """``symbols``: numbers from 1 below ``size``; ``starts``: where each stretch of the text begins."""

    def __init__(self, symbols: np.ndarray, starts: np.ndarray, size: int):
        # A stop before every stretch, each its own smallest symbol, so that no comparison runs past a stretch.
        text = np.insert(symbols, starts, 0)
        stops = starts + np.arange(len(starts))
        unique = text + len(stops)
        unique[stops] = np.arange(len(stops))
        suffixes = suffix_order(unique)
        self.bwt = text[suffixes - 1]
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=size))))
        # Sampled: every SAMPLE-th word of a stretch, its first one included, so no walk meets a stop.
        inside = np.arange(len(text)) - np.repeat(stops, np.diff(np.append(stops, len(text)))) - 1
        sampled = (inside >= 0) & (inside % SAMPLE == 0)
        self.text_at = np.cumsum(text > 0) - 1  # place in ``symbols``
        marks = sampled[suffixes]
        self.marked, self.mark_rank, self.positions = marks, np.cumsum(marks) - marks, suffixes[marks]
        self.bits, self.levels, current = max(1, int(size - 1).bit_length()), [], self.bwt
        for level in reversed(range(self.bits)):
            ones = (current >> level) & 1
            count = np.concatenate(([0], np.cumsum(ones))).astype(np.int32)
            self.levels.append((level, count, len(current) - int(count[-1])))
            current = np.concatenate((current[ones == 0], current[ones == 1]))

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each row of the transform."""
        low, high = np.zeros_like(end), end
        for level, count, zeros in self.levels:
            one = (symbol >> level) & 1 == 1
            low = np.where(one, zeros + count[low], low - count[low])
            high = np.where(one, zeros + count[high], high - count[high])
        return high - low

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of ``patterns`` that occur, with their ranges of the suffix array."""
        which = np.arange(len(patterns))
        low, high = self.first[patterns[:, -1]], self.first[patterns[:, -1] + 1]
        for j in reversed(range(patterns.shape[1])):
            if j < patterns.shape[1] - 1:
                c = patterns[which, j]
                low, high = self.first[c] + self.rank(c, low), self.first[c] + self.rank(c, high)
            found = low < high
            which, low, high = which[found], low[found], high[found]
        return which, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix-array rows, by walking back to the next sampled suffix."""
        out, walked = np.empty(len(rows), np.int64), np.zeros(len(rows), np.int64)
        open_, rows = np.arange(len(rows)), rows.copy()
        while len(open_):
            here = rows[open_]
            done = self.marked[here]
            out[open_[done]] = self.positions[self.mark_rank[here[done]]] + walked[open_[done]]
            open_, here = open_[~done], here[~done]
            symbol = self.bwt[here]
            rows[open_] = self.first[symbol] + self.rank(symbol, here)
            walked[open_] += 1
        return self.text_at[out]


def merge_spans(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open spans; spans that touch become one."""
    order = np.lexsort((end, start))
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.append(True, start[1:] > end[:-1]) if len(start) else np.zeros(0, bool)
    return start[new], end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)] if len(start) else end


class Windows:
    """One block of windows: the vocabulary, and the windows by length with the number of their item set."""

    def __init__(self, rows: list[tuple[str, int]]):
        split = [(w.encode("utf-8", "surrogatepass").split(b" "), s) for w, s in rows]
        self.number = {w: k for k, w in enumerate(sorted({w for ws, _ in split for w in ws}), 1)}
        by_length: dict[int, list] = {}
        for ws, s in split:
            by_length.setdefault(len(ws), []).append(([self.number[w] for w in ws], s))
        self.groups = [
            (length, np.array([p for p, _ in found], np.int64), np.array([s for _, s in found], np.int64))
            for length, found in sorted(by_length.items())
        ]
        self.least = min(by_length, default=0)


def _shard_hits(windows: Windows, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, item set) of every window occurrence in ``numbers``; 0 is any other word and ends a stretch."""
    none = np.zeros(0, np.int64)
    edges = np.flatnonzero(np.diff(np.concatenate(([0], numbers > 0, [0]))))
    begin, stop = edges[::2], edges[1::2]
    long = stop - begin >= windows.least
    begin, stop = begin[long], stop[long]
    if not len(begin):
        return none, none, none
    size = stop - begin
    starts = np.concatenate(([0], np.cumsum(size)[:-1]))
    source = np.arange(int(size.sum())) + np.repeat(begin - starts, size)
    index, found = FMIndex(numbers[source], starts, len(windows.number) + 1), [[], [], []]
    for length, patterns, sets in windows.groups:
        which, low, high = index.search(patterns)
        for a in range(0, len(which), 10_000):
            part, count = slice(a, a + 10_000), high[a : a + 10_000] - low[a : a + 10_000]
            row = np.arange(int(count.sum())) + np.repeat(low[part] - np.concatenate(([0], np.cumsum(count)[:-1])), count)
            at = source[index.locate(row)]
            for column, values in zip(found, (at, at + length, np.repeat(sets[which[part]], count))):
                column.append(values)
    return tuple(np.concatenate(c) if c else none for c in found)


def _block_hits(windows: Windows, words: list[list[bytes]], base: np.ndarray) -> list[np.ndarray]:
    """(start, end, item set) of one block's windows in the documents of a shard, document ``d`` lying at ``base[d]``."""
    numbers, get = np.zeros(int(base[-1]), np.int64), windows.number.get
    for at, found in zip(base, words):
        numbers[at : at + len(found)] = np.fromiter(map(get, found, repeat(0)), np.int64, len(found))
    hits = [[], [], []]
    # A stretch longer than a shard is searched in parts that overlap by one word less than a window.
    for at in range(0, len(numbers), SHARD_WORDS):
        start, end, sets = _shard_hits(windows, numbers[at : at + SHARD_WORDS + WINDOW - 1])
        for column, values in zip(hits, (start + at, end + at, sets)):
            column.append(values)
    return [np.concatenate(c) if c else np.zeros(0, np.int64) for c in hits]


def _scan(blocks: list):
    """One pass over documents with the windows of all ``blocks`` (broadcasts): every shard meets block after block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            for a in range(0, len(texts), SHARD_DOCS):
                yield from _shards(ids.slice(a, SHARD_DOCS), texts.slice(a, SHARD_DOCS))

    def _shards(ids, texts):
        begun, words, held = 0, [], 0
        for k in range(len(texts)):
            words.append(words_of(texts[k].as_py()))
            held += len(words[-1])
            if held >= SHARD_WORDS or k + 1 == len(texts):
                yield _answer(ids.slice(begun, k + 1 - begun), words)
                begun, words, held = k + 1, [], 0

    def _answer(ids, words):
        size = np.array([len(x) for x in words], np.int64)
        base = np.concatenate(([0], np.cumsum(size + 1)))
        hits = [[np.zeros(0, np.int64)] for _ in range(3)]
        for block in blocks:
            for column, values in zip(hits, _block_hits(block.value, words, base)):
                column.append(values)
            if len(blocks) > 1:
                # A broadcast keeps what it has loaded; without this a worker would hold all blocks at once.
                vars(block).pop("_value", None)
        start, end, sets = map(np.concatenate, hits)
        pairs = np.unique(np.stack((np.searchsorted(base, start, "right") - 1, sets)), axis=1)
        start, end = merge_spans(start, end)
        in_doc = np.searchsorted(base, start, "right") - 1
        cut = lambda of: np.searchsorted(of, np.arange(len(words) + 1)).astype(np.int32)
        spans = pa.StructArray.from_arrays([pa.array(start - base[in_doc]), pa.array(end - base[in_doc])], ["start", "end"])
        return pa.RecordBatch.from_arrays(
            [
                ids, pa.array(size), pa.ListArray.from_arrays(pa.array(cut(in_doc)), spans),
                pa.ListArray.from_arrays(pa.array(cut(pairs[0])), pa.array(pairs[1])),
            ],
            ["doc_id", "n_words", "spans", "sets"],
        )

    return run


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """(item, window) of each distinct window of each item; a window is its words joined by spaces."""

    def cut(batches):
        for batch in batches:
            items, windows = [], []
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist()):
                words = words_of(text)
                found = dict.fromkeys(b" ".join(words[k : k + WINDOW]) for k in range(max(1, len(words) - WINDOW + 1))) if words else ()
                items += [item] * len(found)
                windows += [w.decode("utf-8", "surrogatepass") for w in found]
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(windows, pa.string())], ["item", "window"])

    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(cut, "item string, window string").distinct()


def contamination(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per document: doc_id, n_words, n_hit, merged removal ``spans`` in words, ``sets`` of items that occur; and
    (set_id, item) with the items of each set. Windows that the same items hold share a set."""
    spark = docs.sparkSession
    windows = cut_lineage(benchmark_windows(benchmark), "windows")
    # Sets are told apart by two order-free hashes and a count of their items, so no set is ever gathered in a row. The
    # second hash starts from a constant; appended to the item it would only be a function of the first one.
    hashes = ["n", "a", "b"]
    per_window = windows.groupBy("window").agg(
        F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(item))").alias("a"), F.expr("bit_xor(xxhash64(1, item))").alias("b")
    )
    per_window = cut_lineage(per_window, "window-hashes")
    numbers = cut_lineage(per_window.select(hashes).distinct().withColumn("set_id", F.monotonically_increasing_id()), "window-numbers")
    per_window = cut_lineage(per_window.join(numbers, hashes).select("window", "set_id"), "window-sets")
    blocks, shared = max(1, -(-per_window.count() // BLOCK_WINDOWS)), []
    for block in range(blocks):
        part = per_window.where(F.pmod(F.xxhash64("window"), F.lit(blocks)) == block).collect()
        shared.append(spark.sparkContext.broadcast(Windows([(r["window"], r["set_id"]) for r in part])))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id bigint, n_words bigint, spans array<struct<start:bigint,end:bigint>>, sets array<bigint>"
    rows = rows.mapInArrow(_scan(shared), schema)
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    found = rows.select("doc_id", "n_words", hit.alias("n_hit"), "spans", F.array_sort("sets").alias("sets"))
    set_items = windows.join(per_window, "window").select("set_id", "item").distinct()
    return found, set_items


def contamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and the removal spans."""
    found, set_items = contamination(docs, benchmark)
    found = cut_lineage(found, "contamination")
    some, none = found.where(F.size("sets") > 0), found.where(F.size("sets") == 0)
    # Documents with the same sets share one answer, so a passage that very many documents hold is resolved once.
    answers = cut_lineage(
        some.select("sets").distinct().select("sets", F.explode("sets").alias("set_id")).join(set_items, "set_id")
        .select("sets", "item").distinct().groupBy("sets").agg(
            F.count(F.lit(1)).alias("n_items"), F.sha2(F.concat_ws(",", F.array_sort(F.collect_list("item"))), 256).alias("items_sha256")
        ), "contamination-items",
    )
    none = none.withColumn("n_items", F.lit(0).cast("bigint")).withColumn("items_sha256", F.sha2(F.lit(""), 256))
    both = some.join(answers, "sets").select(none.columns).unionByName(none)
    contaminated = (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))
    return both.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", contaminated.alias("contaminated"), "spans")


def contaminated_rows(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, bad) of each row: if an item's words make up a twentieth of its words or more."""
    return contamination(docs, benchmark)[0].select("doc_id", F.expr("n_hit > 0 AND n_hit * 20 >= n_words").alias("bad"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without contaminated rows; all columns stay.

    Where clean and contaminated rows share a ``doc_id``, or have none, they are judged text by text, so the clean ones stay.
    """
    found = cut_lineage(contaminated_rows(docs, benchmark), "contaminated-rows")
    per_id = found.groupBy("doc_id").agg(F.max("bad").alias("bad"), F.min("bad").alias("all_bad")).where("bad")
    per_id = cut_lineage(per_id, "contaminated")
    stays = filter_by_id(docs, per_id.select("doc_id"), "left_anti")
    mixed = per_id.where("NOT all_bad").select("doc_id")
    if mixed.isEmpty():
        return stays
    name = free_name(docs, "digest")
    digest = F.unhex(F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"), 256))
    unsure = cut_lineage(filter_by_id(docs, mixed, "left_semi").withColumn(name, digest), "contaminated-unsure")
    texts = unsure.groupBy(name).agg(F.first("text").alias("text")).withColumn("doc_id", F.monotonically_increasing_id())
    texts = cut_lineage(texts, "contaminated-texts")
    bad = contaminated_rows(texts, benchmark).where("bad").join(texts, "doc_id").select(name)
    return stays.unionByName(unsure.join(cut_lineage(bad, "contaminated-digests"), name, "left_anti").select(docs.columns))
