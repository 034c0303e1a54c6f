"""Exact deduplication through a sharded cuckoo-filter index of text digests.

Every text becomes the SHA-256 of its white-space-free form. Copies are counted per (digest, length) before
anything is shuffled by key, so a digest that a third of all rows share arrives as one row per map task. The
digests are dealt into buckets by their leading bits; the number of buckets follows the number of rows, so one
bucket stays small. Each bucket keeps a cuckoo filter over its live digests and, beside it, the stored keys: a
filter hit is verified against the stored key, a full filter is rebuilt at twice the size from the stored keys,
and a digest whose last copy was deleted leaves both.

Nulls and odd rows: a null text counts as empty; a null ``doc_id`` loses every tie; repeated rows count as
copies of each other and share their ``keep_id``; an empty table gives an empty result. Only ``doc_id`` and
``text`` are read, so further columns cannot clash.
"""

from __future__ import annotations

import math
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolith.llm.common import filter_by_id, free_name
from cartolith.session import cut_lineage

#: Digests that one bucket is meant to hold.
BUCKET_KEYS = 20_000
ENTRY = "digest binary, live bigint, keep_id bigint, n_points int"


class CuckooFilter:
    """16-bit tags in buckets of four; the other place of a tag follows from its place and the tag alone."""

    SLOTS, KICKS = 4, 200

    def __init__(self, places: int):
        self.mask = max(2, 1 << max(1, math.ceil(math.log2(max(2, places))))) - 1
        self.tags = array("H", bytes(2 * self.SLOTS * (self.mask + 1)))
        self.turn = 0

    def _where(self, digest: bytes) -> tuple[int, int]:
        return int.from_bytes(digest[8:16], "little") & self.mask, int.from_bytes(digest[16:18], "little") or 1

    def _other(self, place: int, tag: int) -> int:
        return (place ^ (tag * 0x5BD1E995)) & self.mask

    def _swap(self, place: int, old: int, new: int) -> bool:
        """Replace one ``old`` tag of a bucket (0: a free slot) by ``new``."""
        for slot in range(place * self.SLOTS, (place + 1) * self.SLOTS):
            if self.tags[slot] == old:
                self.tags[slot] = new
                return True
        return False

    def contains(self, digest: bytes) -> bool:
        place, tag = self._where(digest)
        return any(
            tag in self.tags[p * self.SLOTS : (p + 1) * self.SLOTS] for p in (place, self._other(place, tag))
        )

    def insert(self, digest: bytes) -> bool:
        """False if the filter overflowed; it must then be rebuilt, as one tag has lost its slot."""
        place, tag = self._where(digest)
        if self._swap(place, 0, tag) or self._swap(self._other(place, tag), 0, tag):
            return True
        for _ in range(self.KICKS):
            self.turn = (self.turn + 1) % self.SLOTS
            slot = place * self.SLOTS + self.turn
            self.tags[slot], tag = tag, self.tags[slot]
            place = self._other(place, tag)
            if self._swap(place, 0, tag):
                return True
        return False

    def delete(self, digest: bytes) -> bool:
        place, tag = self._where(digest)
        return self._swap(place, tag, 0) or self._swap(self._other(place, tag), tag, 0)


class Bucket:
    """One bucket of the index: stored keys with their state, and the filter in front of them."""

    def __init__(self, places: int = 64):
        self.filter = CuckooFilter(places)
        self.keys: dict[bytes, list] = {}
        self.resizes = 0

    def find(self, digest: bytes) -> list | None:
        return self.keys.get(digest) if self.filter.contains(digest) else None

    def insert(self, digest: bytes, live: int, keep_id: int | None, n_points: int) -> None:
        found = self.find(digest)
        if found is None:
            self.keys[digest] = [live, keep_id, n_points]
            if not self.filter.insert(digest):
                self._resize()
            return
        found[0] += live
        rank = lambda i, n: (n, i is not None, -(i or 0))
        if rank(keep_id, n_points) > rank(found[1], found[2]):
            found[1:] = [keep_id, n_points]

    def delete(self, digest: bytes, copies: int) -> None:
        found = self.find(digest)
        if found is None:
            return
        found[0] -= copies
        if found[0] <= 0:
            del self.keys[digest]
            self.filter.delete(digest)

    def _resize(self) -> None:
        size = 2 * (self.filter.mask + 1)
        while True:
            self.resizes += 1
            self.filter = CuckooFilter(size)
            if all(self.filter.insert(k) for k in self.keys):
                return
            size *= 2


def _index_bucket(table: pa.Table) -> pa.Table:
    bucket, gone = Bucket(), []
    columns = (table.column(c).to_pylist() for c in ("digest", "n_points", "added", "deleted", "keep_id"))
    for digest, n_points, added, deleted, keep_id in zip(*columns):
        bucket.insert(digest, added, keep_id, n_points if added > deleted else -1)
        if deleted:
            gone.append((digest, deleted))
    for digest, copies in gone:
        bucket.delete(digest, copies)
    rows = [(k, *v) for k, v in bucket.keys.items()]
    columns = list(zip(*rows)) or [()] * 4
    return pa.Table.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int64(), pa.int64(), pa.int32()))],
        ["digest", "live", "keep_id", "n_points"],
    )


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, n_points) of each row: SHA-256 without ASCII white space, and the text's code points."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.unhex(F.sha2(F.regexp_replace(text, r"[\x20\x09-\x0D]+", ""), 256)).alias("digest"),
        F.length(text).alias("n_points"),
    )


def digest_index(rows: DataFrame, deleted: DataFrame | None = None) -> DataFrame:
    """The live digests of ``rows`` (from `digests`) with their number of copies and the row to keep.

    ``deleted`` (doc_id) names rows that leave the index again after all have been inserted.
    """
    live = F.lit(True)
    if deleted is not None:
        gone = deleted.select(F.col("doc_id").cast("bigint").alias("gone_id")).distinct()
        rows = rows.join(gone, rows.doc_id == gone.gone_id, "left")
        live = F.col("gone_id").isNull()
    bits = max(6, math.ceil(math.log2(max(1, rows.count()) / BUCKET_KEYS + 1)))
    counted = rows.groupBy("digest", "n_points").agg(
        F.count(F.lit(1)).alias("added"),
        F.count(F.when(~live, 1)).alias("deleted"),
        F.min(F.when(live, F.col("doc_id"))).alias("keep_id"),
    )
    leading = F.conv(F.substring(F.hex("digest"), 1, 8), 16, 10).cast("bigint")
    return (
        counted.withColumn("bucket", F.shiftright(leading, 32 - bits))
        .groupBy("bucket").applyInArrow(_index_bucket, ENTRY)
    )


def exact_groups(docs: DataFrame, deleted: DataFrame | None = None) -> DataFrame:
    """One row per document: the copy that stays, the size of its group and the digest.

    Of equal texts, the one with the most code points stays, then the smallest ``doc_id``. Documents named in
    ``deleted`` are not returned. Both sides of the last join are stored tables, so a digest that very many rows
    share is split by Spark's skew join.
    """
    rows = cut_lineage(digests(docs), "exact-digests")
    index = cut_lineage(digest_index(rows, deleted), "exact-index")
    if deleted is not None:
        rows = rows.join(deleted.select(F.col("doc_id").cast("bigint").alias("doc_id")).distinct(), "doc_id", "left_anti")
    return rows.join(index.select("digest", "live", "keep_id"), "digest").select(
        "doc_id", "keep_id", F.col("live").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def dedup_exact(docs: DataFrame) -> DataFrame:
    """``docs`` with one row per distinct text; all columns stay. Rows that repeat a kept row go as well."""
    groups = exact_groups(docs)
    per_id = cut_lineage(groups.groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n")), "exact-ids")
    # The dropped ids are far fewer than the kept ones: Spark may broadcast them, and then no text is moved.
    stays = filter_by_id(docs, cut_lineage(per_id.where("NOT kept").select("doc_id"), "exact-dropped"), "left_anti")
    # Only ids that several rows bear, null among them, need their rows judged one by one.
    again = cut_lineage(per_id.where("kept AND n > 1").select("doc_id"), "exact-again")
    if again.isEmpty():
        return stays
    digest, id_, of_id = (free_name(docs, name) for name in ("digest", "pair_id", "pair_digest"))
    pairs = filter_by_id(groups.where("kept"), again, "left_semi").select(F.col("doc_id").alias(id_), F.col("text_sha256").alias(of_id))
    pairs = cut_lineage(pairs.distinct(), "exact-pairs")
    plain = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", "")
    repeated = filter_by_id(stays, again, "left_semi").withColumn(digest, F.sha2(plain, 256))
    repeated = repeated.join(pairs, F.col("doc_id").cast("bigint").eqNullSafe(F.col(id_)) & (F.col(digest) == F.col(of_id)), "left_semi")
    return filter_by_id(stays, again, "left_anti").unionByName(repeated.dropDuplicates([digest]).drop(digest))
