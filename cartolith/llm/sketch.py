"""Document fingerprints: threshold-scaled sketches of word shingles, in DataFrame functions alone.

A document's shingles of five words are hashed to 64 bits, and every hash whose leading bits are zero, a fixed
fraction of all, is kept. The fraction is the same for all documents, so sketches of any parts merge by union, and the
share of one sketch found in another estimates how much of one document is contained in another, however unequal
their lengths are. A text whose hashes all lie above the threshold keeps its least one, so that only texts without
words have an empty sketch; a merge drops such a hash as soon as the other side has one below the threshold.

The likeness of two sketches is the larger of the two containments: shared hashes over the size of the smaller one.
Two empty sketches are alike (1), an empty one and another are not (0).

The neighbour of a document is found without a window over all rows: keys (without their texts) get their rank from
range parts, and the row of the next rank is an equi-join. Texts are shuffled once by their key; what moves to a
neighbour is the needed beginning of the text and the sketch.

Nulls and odd rows: a null text counts as empty; documents descend by ``doc_id``, null ids last, rows of one id by
a digest of their text; rows equal in both count as one document and get the same result; a single document is its own
neighbour; an empty table gives an empty result. Only ``doc_id`` and ``text`` are read, so further columns cannot clash.
Texts are hashed whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartolith.llm.common import ranked
from cartolith.session import cut_lineage

#: Words of a shingle, and leading zero bits of the hashes that stay: one in eight.
SHINGLE, ZERO_BITS = 5, 3


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` evaluated once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def shingle_hashes(text: Column) -> Column:
    """64-bit hashes of all shingles of lower-cased words, repeats included; fewer words give one shingle."""

    def hashed(words: Column) -> Column:
        last = F.greatest(F.size(words) - (SHINGLE - 1), F.lit(1))
        hashes = F.transform(F.sequence(F.lit(1), last), lambda start: F.xxhash64(F.slice(words, start, F.lit(SHINGLE))))
        return F.when(F.size(words) > 0, hashes).otherwise(F.expr("CAST(array() AS array<bigint>)"))

    return _with(F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != ""), hashed)


def sketch(hashes: Column) -> Column:
    """The distinct hashes below the threshold in ascending order, or the least one if there is none."""

    def kept(all_: Column) -> Column:
        low = F.filter(all_, lambda h: F.shiftrightunsigned(h, 64 - ZERO_BITS) == 0)
        least = F.filter(F.array(F.expr("CAST(NULL AS bigint)"), F.array_min(all_)), lambda h: h.isNotNull())
        return _with(low, lambda part: F.when(F.size(part) > 0, F.array_sort(F.array_distinct(part))).otherwise(least))

    return _with(hashes, kept)


def merged(a: Column, b: Column) -> Column:
    """Sketch of the two documents of ``a`` and ``b`` taken together."""
    return sketch(F.array_union(a, b))


def shared(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the shingles of ``a`` that ``b`` holds; 1 if ``a`` has none."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(shared(a, b) / F.size(a))


def likeness(a: Column, b: Column) -> Column:
    """Containment of the smaller sketch in the larger one; 1 if both are empty, 0 if only one is."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, shared(a, b) / least).otherwise((F.size(a) == F.size(b)).cast("double"))


def spelled(hashes: Column) -> Column:
    """A sketch as text: 16 hexadecimal digits for each hash."""
    return F.lower(F.array_join(F.transform(hashes, lambda h: F.lpad(F.hex(h), 16, "0")), ""))


def keyed(docs: DataFrame) -> DataFrame:
    """(key, doc_id, text): the key is a 128-bit digest of id and text."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    whole = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), F.col("text"))
    return rows.select(F.unhex(F.md5(whole.cast("binary"))).alias("key"), "doc_id", "text")


def neighbours(rows: DataFrame) -> DataFrame:
    """(key, to_key, doc_id, take): the document ``key`` follows ``to_key`` of ``doc_id``, which takes a third of its own
    length from it."""
    keys = ranked(rows.select("doc_id", "key", F.length("text").alias("n")).distinct(), ["doc_id", "key"], "sketch-keys")
    keys = cut_lineage(keys.select("rank", "key", "doc_id", "n"), "sketch-ranks")
    last = keys.count() - 1
    follower = F.when(F.col("rank") == last, F.lit(0)).otherwise(F.col("rank") + 1)  # ranks ascend, documents descend
    ahead = keys.select(F.col("rank").alias("of"), F.col("key").alias("to_key"), "doc_id", F.floor(F.col("n") / 3).cast("int").alias("take"))
    pairs = keys.select("rank", "key").join(ahead, follower == F.col("of"))
    return cut_lineage(pairs.select("key", "to_key", "doc_id", "take"), "sketch-neighbours")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, fingerprint) of each row."""
    rows = keyed(docs).select("doc_id", F.length("text").cast("bigint").alias("n_chars"), sketch(shingle_hashes(F.col("text"))).alias("sketch"))
    return rows.select("doc_id", "n_chars", spelled(F.col("sketch")).alias("fingerprint"))


def edit_report(docs: DataFrame) -> DataFrame:
    """One row per document, which it compares with an edited copy and with the next document by descending id.

    The last third of the edited copy is replaced by the beginning of the next document.
    """
    rows = keyed(docs)
    near = neighbours(rows)
    texts = rows.select("key", "text")  # read in both joins with the same columns, so Spark shuffles them once
    given = texts.join(near, "key").select("to_key", "doc_id", F.expr("substring(text, 1, take)").alias("start"), "text")
    given = given.select("to_key", "doc_id", "start", sketch(shingle_hashes(F.col("text"))).alias("next_sketch"))
    given = given.groupBy(F.col("to_key").alias("key")).agg(*(F.first(c).alias(c) for c in ("doc_id", "start", "next_sketch")))
    both = texts.join(given, "key").select("doc_id", "next_sketch", "text", F.length("text").alias("n"), "start")
    both = both.select("doc_id", "next_sketch", "text", "n", F.expr("concat(substring(text, 1, n - CAST(floor(n / 3) AS INT)), start)").alias("edited"))
    both = both.select(
        "doc_id", "n", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "next_sketch",
        sketch(shingle_hashes(F.col("text"))).alias("sketch"), sketch(shingle_hashes(F.col("edited"))).alias("edited_sketch"),
    )
    return both.select(
        "doc_id", F.col("n").cast("bigint").alias("n_chars"), "edited_sha256", spelled(F.col("sketch")).alias("fingerprint"),
        spelled(F.col("edited_sketch")).alias("edited_fingerprint"), likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )
