"""Spelling variants: the vocabulary acceptor composed with a one-edit transducer and with itself again.

Words one edit apart either share their first half (the edit comes later) or, the edit coming first, their second half.
So the vocabulary is dealt twice, in reading order by first half and reversed by second half, each word under its own
length and under one less, as the shorter word of a pair sets where the halves meet. All words of such a partition
start in the same state of the vocabulary's acceptor. A task builds the minimised acceptor of a partition and walks
acceptor o one-edit transducer o acceptor from that initial state: before the edit both sides are in one state, after
it in two whose common words are enumerated, and minimisation makes the two states the same one as soon as the rests agree.
Words are numbers along the way (the count of accepted words before a path), so no text is built.

A partition that many words share is dealt again: pairs that agree on one more symbol go on under the longer key, and
pairs that differ in just that symbol share all before and all after it, which is their key; such a partition has
no more words than the alphabet squared. A pair is reported by the partition its first difference belongs to, so none
comes twice.

Occurrences are counted before they are shuffled, so a word that a third of all text repeats is a row per map task.
Nulls and odd rows: a null text has no words; a null ``doc_id`` reads as an empty string where ids are hashed; repeated
rows count again; an empty table gives an empty result. Only ``doc_id`` and ``text`` are read, so further columns
cannot clash. Texts are read whole, and walks are loops, not recursion, so words of any length pass.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartolith.session import cut_lineage

LEAST_LENGTH, LEAST_COUNT, RATIO = 7, 2, 10
#: Words that a partition is meant to hold; more are dealt under longer keys.
PARTITION_WORDS = 20_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n): runs of letters, a letter deleted where the hash of document and run says so, of the least length and count."""
    runs = F.regexp_extract_all(F.col("text").cast("string"), F.lit(f"[A-Za-zÀ-ÿ]{{{LEAST_LENGTH},}}"), F.lit(0))
    doc = F.coalesce(F.col("doc_id").cast("bigint").cast("string"), F.lit(""))
    rows = docs.select(doc.alias("doc"), F.explode(runs).alias("run")).select("doc", F.translate("run", UPPER, LOWER).alias("run"))
    rows = rows.select("run", F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary")).alias("h"))
    at = F.expr("CAST(h % length(run) AS INT)")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = rows.select(F.when(F.col("h") % 31 == 0, shorter).otherwise(F.col("run")).alias("word"))
    counts = words.where(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") >= LEAST_COUNT)


def partitions(words: DataFrame) -> DataFrame:
    """Rows of the two dealings: shorter (length of the pair's shorter word), back (read from the end), shared and after
    (symbols that the words of the partition share at the start and at the end, in reading direction), text (as read), word, n."""
    length = F.length("word")
    lengths = F.filter(F.array(length, length - 1), lambda x: x >= LEAST_LENGTH)
    rows = words.select("word", "n", F.explode(lengths).alias("shorter"))
    rows = rows.select("*", F.explode(F.array(F.lit(False), F.lit(True))).alias("back"))
    half = F.expr("shorter DIV 2")
    return rows.select(
        "shorter", "back", F.when(F.col("back"), F.col("shorter") - half).otherwise(half).alias("shared"), F.lit(0).alias("after"),
        F.when(F.col("back"), F.reverse("word")).otherwise(F.col("word")).alias("text"), "n",
    )


def _key() -> Column:
    start = F.expr("substring(text, 1, shared)")
    end = F.expr("substring(text, length(text) - after + 1, after)")
    return F.concat_ws("\u0001", "shorter", "back", "shared", "after", start, end)


def dealt(rows: DataFrame, most: int) -> DataFrame:
    """``rows`` with their ``key``; partitions of more than ``most`` words that can still be told apart are dealt again."""
    done = None
    while True:
        rows = cut_lineage(rows.withColumn("key", _key()), "spelling-partitions")
        full = rows.where("after = 0 AND shared < shorter").groupBy("key").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > most)
        full = cut_lineage(full.select("key"), "spelling-full")
        if full.isEmpty():
            return rows if done is None else done.unionByName(rows)
        small = rows.join(full, "key", "left_anti")
        done = small if done is None else done.unionByName(small)
        rows = rows.join(full, "key", "left_semi").drop("key")
        at = rows.withColumn("after", F.col("shorter") - F.col("shared") - 1)
        on = rows.withColumn("shared", F.col("shared") + 1).where("shared <= length(text)")
        # With nothing after the symbol, the partition of that symbol alone is the whole rest of both words.
        rows = at.withColumn("after", F.when(F.col("after") == 0, F.lit(-1)).otherwise(F.col("after"))).unionByName(on)


class Acceptor:
    """Minimised acceptor of sorted distinct words, with the number of words accepted from every state."""

    def __init__(self, words: list[str]):
        self.final: list[bool] = []
        self.arcs: list[dict[str, int]] = []
        self.size: list[int] = []
        known: dict[tuple, int] = {}
        path: list[tuple[bool, dict[str, int]]] = [(False, {})]
        last = ""

        def close(depth: int) -> None:
            while len(path) > depth + 1:
                final, arcs = path.pop()
                path[-1][1][last[len(path) - 1]] = self._state(known, final, arcs)

        for word in words:
            same = 0
            while same < min(len(word), len(last)) and word[same] == last[same]:
                same += 1
            close(same)
            path += [(False, {}) for _ in word[same:]]
            path[-1] = (True, path[-1][1])
            last = word
        close(0)
        self.start = self._state(known, *path[0])

    def _state(self, known: dict[tuple, int], final: bool, arcs: dict[str, int]) -> int:
        name = (final, *arcs.items())
        state = known.get(name)
        if state is None:
            state = known[name] = len(self.final)
            self.final.append(final)
            self.arcs.append(arcs)
            self.size.append(final + sum(self.size[q] for q in arcs.values()))
        return state

    def steps(self, state: int) -> Iterator[tuple[str, int, int]]:
        """Each arc: its symbol, its target and how many words of ``state`` come before those through it."""
        before = int(self.final[state])
        for symbol, target in self.arcs[state].items():
            yield symbol, target, before
            before += self.size[target]

    def common(self, p: int, q: int) -> Iterator[tuple[int, int]]:
        """Numbers (among those of ``p``, among those of ``q``) of the words that both states accept."""
        stack = [(p, q, 0, 0)]
        while stack:
            p, q, a, b = stack.pop()
            if p == q:
                yield from ((a + k, b + k) for k in range(self.size[p]))
                continue
            if self.final[p] and self.final[q]:
                yield a, b
            other = {symbol: (target, before) for symbol, target, before in self.steps(q)}
            for symbol, target, before in self.steps(p):
                if symbol in other:
                    stack.append((target, other[symbol][0], a + before, b + other[symbol][1]))

    def edits_here(self, state: int) -> Iterator[tuple[int, int]]:
        """Pairs of the words of ``state`` that differ first in their first symbol, and by one edit.

        An inserted symbol must differ from what follows it, so a pair is found at its first difference alone; runs of
        one letter would otherwise be walked from each of their letters.
        """
        steps = list(self.steps(state))
        for k, (symbol, target, a) in enumerate(steps):
            if self.final[state] and self.final[target]:
                yield 0, a
            inner = {s: (q, before) for s, q, before in self.steps(target)}
            for follows, other, b in steps:
                if follows != symbol and follows in inner:
                    q, before = inner[follows]
                    yield from ((b + i, a + before + j) for i, j in self.common(other, q))
            for _, other, b in steps[k + 1 :]:
                yield from ((a + i, b + j) for i, j in self.common(target, other))

    def one_edit(self) -> set[tuple[int, int]]:
        """Numbers i < j of all accepted pairs of words one edit apart, from the initial state on."""
        offsets: list[list[int]] = [[] for _ in self.final]
        offsets[self.start] = [0]
        out = set()
        for state in range(self.start, -1, -1):  # a state is made after all that it leads to
            starts = offsets[state]
            for _, target, before in self.steps(state):
                offsets[target] += [s + before for s in starts]
            if self.size[state] > 1:
                out.update((s + min(i, j), s + max(i, j)) for i, j in self.edits_here(state) for s in starts)
        return out


def _first_difference(a: str, b: str) -> int:
    k = 0
    while k < len(a) and k < len(b) and a[k] == b[k]:
        k += 1
    return k


def _owned(a: str, b: str, shorter: int, back: bool, shared: int, after: int) -> bool:
    """If the pair belongs to this dealing: of two words as read, the shorter one's length and where they first differ count."""
    if min(len(a), len(b)) != shorter:
        return False
    if back and _first_difference(a[::-1], b[::-1]) >= shorter // 2:
        return False
    at = _first_difference(a, b)
    return at == shared if after else at >= shared


def _near_pairs(table: pa.Table) -> pa.Table:
    order = table.sort_by([("key", "ascending"), ("text", "ascending")])
    keys, texts, counts = (order.column(c).to_pylist() for c in ("key", "text", "n"))
    facts = list(zip(*(order.column(c).to_pylist() for c in ("shorter", "back", "shared", "after"))))
    words, others, others_n, start = [], [], [], 0
    for end in range(1, len(keys) + 1):
        if end < len(keys) and keys[end] == keys[start]:
            continue
        if end - start > 1:
            rule = facts[start]
            skip = rule[2]
            for i, j in Acceptor([text[skip:] for text in texts[start:end]]).one_edit():
                a, b = start + i, start + j
                if _owned(texts[a], texts[b], *rule):
                    for x, y in ((a, b), (b, a)):
                        words.append(texts[x][::-1] if rule[1] else texts[x])
                        others.append(texts[y][::-1] if rule[1] else texts[y])
                        others_n.append(counts[y])
        start = end
    return pa.table([pa.array(words, pa.string()), pa.array(others, pa.string()), pa.array(others_n, pa.int64())], ["word", "other", "other_n"])


def near_pairs(words: DataFrame, most: int = PARTITION_WORDS) -> DataFrame:
    """(word, other, other_n) of all words (word, n; distinct) that differ by one code point, both ways round."""
    rows = dealt(partitions(words), most)
    buckets = max(1, math.ceil(rows.count() / PARTITION_WORDS))
    bucket = F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket")
    return rows.groupBy(bucket).applyInArrow(_near_pairs, "word string, other string, other_n bigint")


def variants(docs: DataFrame, most: int = PARTITION_WORDS) -> DataFrame:
    """One row per word of the vocabulary: word, n, n_near, form, form_n and root (see the contract of the query)."""
    words = cut_lineage(vocabulary(docs), "spelling-words")
    largest = F.min(F.struct((-F.col("other_n")).alias("less"), "other"))  # of the largest count, the first word
    near = near_pairs(words, most).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), largest.alias("best"))
    near = cut_lineage(near.select("word", "n_near", F.col("best.other").alias("best"), (-F.col("best.less")).alias("best_n")), "spelling-near")
    fits = F.col("best_n") >= RATIO * F.col("n")
    rows = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(fits, F.col("best")).alias("form"), F.when(fits, F.col("best_n")).alias("form_n"),
    )
    rows = cut_lineage(rows, "spelling-forms")
    # Every form has ten times the count of its word, so chains are short; each round doubles what is followed.
    links = cut_lineage(rows.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "spelling-links")
    while True:
        ahead = links.select(F.col("word").alias("via"), F.col("root").alias("further"))
        joined = links.join(ahead, F.col("root") == F.col("via"), "left").withColumn("moved", F.col("further").isNotNull())
        joined = cut_lineage(joined.select("word", F.coalesce("further", "root").alias("root"), "moved"), "spelling-roots")
        links = joined.select("word", "root")
        if joined.where("moved").isEmpty():
            break
    return rows.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
