"""Near-duplicates by SimHash and meet-in-the-middle ball hashing.

Two fingerprints that differ in two bits share a value that differs from each in at most one. Every distinct
fingerprint therefore emits itself and its 64 one-bit neighbours; equal variants meet in a shuffle. All
fingerprints that meet at one variant are within two bits of each other and there are at most 65 of them, so
linking neighbours in their order keeps every component without emitting all pairs. Colliding pairs are
deduplicated, verified by their bit count, and closed into components.

Copies of a text meet as one fingerprint before anything is emitted, so large groups of copies cost one row per
map task. Nulls and odd rows: a null or wordless text has fingerprint zero, linked like any other; a null
``doc_id`` never names a component unless all its ids are null; an empty table gives an empty result. Long texts
are hashed whole, in stretches of bounded length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from cartolith.llm.common import filter_by_id, free_name
from cartolith.llm.graph import components
from cartolith.session import cut_lineage

SHINGLE, SEED, BITS, RADIUS = 3, 42, 64, 2
#: Shingles hashed at a time.
STRETCH = 50_000


def fingerprint(text: str | None) -> int:
    """Majority bits of the XXH64 of all three-word shingles, as an unsigned number."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - SHINGLE + 1)
    ones = np.zeros(BITS, np.int64)
    for a in range(0, n, STRETCH):
        part = words[a : a + STRETCH + SHINGLE - 1]
        grams = map(b" ".join, zip(part, part[1:], part[2:])) if n > 1 or len(words) == SHINGLE else (b" ".join(words),)
        hashes = np.array([xxhash.xxh64_intdigest(g, SEED) for g in grams], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << int(k) for k in np.flatnonzero(2 * ones > n))


def _hash_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.array([fingerprint(t.as_py()) for t in batch.column("text")], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints)], ["doc_id", "print"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, print) of each row; the 64 bits of a fingerprint are held in a signed bigint."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_hash_batches, "doc_id bigint, print bigint")


def ball_links(prints: DataFrame) -> DataFrame:
    """Linked pairs (a, b) of the distinct fingerprints in ``prints``, enough to join all that are linked."""
    flips = [F.col("print")] + [F.col("print").bitwiseXOR(F.lit((1 << k) - (1 << 64 if k == 63 else 0))) for k in range(BITS)]
    variants = prints.select("print", F.explode(F.array(*flips)).alias("variant"))
    before = F.lag("print").over(Window.partitionBy("variant").orderBy("print"))
    met = variants.select(before.alias("a"), F.col("print").alias("b")).where("a IS NOT NULL").distinct()
    return met.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS)


def _grouped(docs: DataFrame, *columns: str) -> DataFrame:
    """doc_id and print of each row, and ``columns`` of its component: root (a fingerprint) or component_id."""
    rows = cut_lineage(fingerprints(docs), "prints")
    nodes = cut_lineage(rows.groupBy("print").agg(F.min("doc_id").alias("least_id")), "print-nodes")
    roots = components(ball_links(nodes.select("print")))
    rooted = cut_lineage(
        nodes.join(roots, nodes.print == roots.node, "left").select("print", "least_id", F.coalesce("root", "print").alias("root")), "print-roots"
    )
    ids = cut_lineage(rooted.groupBy("root").agg(F.min("least_id").alias("component_id")), "print-components")
    of_print = cut_lineage(rooted.join(ids, "root").select("print", *columns), "print-ids")
    return rows.join(of_print, "print").select("doc_id", "print", *columns)


def near_groups(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hexadecimal digits) and component_id."""
    return _grouped(docs, "component_id").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def _with_print(docs: DataFrame, name: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t.as_py()) for t in batch.column("text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(prints)], [*batch.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, LongType())]))


def dedup_near(docs: DataFrame) -> DataFrame:
    """``docs`` with one row, of the smallest ``doc_id``, of each component; all columns stay."""
    rows, stays = _grouped(docs, "root", "component_id"), F.col("doc_id").eqNullSafe(F.col("component_id"))
    per_id = cut_lineage(rows.groupBy("doc_id").agg(F.max(stays).alias("stays"), F.count(F.lit(1)).alias("n")), "near-doc-ids")
    # The dropped ids are far fewer than the kept ones: Spark may broadcast them, and then no text is moved.
    kept = filter_by_id(docs, cut_lineage(per_id.where("NOT stays").select("doc_id"), "near-dropped"), "left_anti")
    # Only ids that several rows bear, null among them, need their rows judged one by one.
    again = cut_lineage(per_id.where("stays AND n > 1").select("doc_id"), "near-again")
    if again.isEmpty():
        return kept
    print_, id_, of_id, root = (free_name(docs, name) for name in ("print", "pair_id", "pair_print", "pair_root"))
    pairs = filter_by_id(rows.where(stays), again, "left_semi").select(F.col("doc_id").alias(id_), F.col("print").alias(of_id), F.col("root").alias(root))
    pairs = cut_lineage(pairs.distinct(), "near-pairs")
    repeated = _with_print(filter_by_id(kept, again, "left_semi"), print_)
    repeated = repeated.join(pairs, F.col("doc_id").cast("bigint").eqNullSafe(F.col(id_)) & (F.col(print_) == F.col(of_id)))
    return filter_by_id(kept, again, "left_anti").unionByName(repeated.dropDuplicates([root]).drop(print_, id_, of_id, root))
