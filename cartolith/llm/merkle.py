"""Merkle manifest of a dataset: leaf coordinates by bitmap rank, levels by keyed slot arrays.

A leaf is the digest of one row. Its coordinate is the number of leaves of its group that come before it, and it is
read from bitmaps instead of a sort: every group's ``doc_id`` values form a bitmap, kept as its non-empty 64-bit words,
which are merged by bitwise or with map-side combination. Above the words stands a directory of population counts of
fan-out 64, as many levels as the range of ids needs. A rank query is one join with the word of the id: the leaves
before the word plus the set bits below the id's own.

A coordinate is a place in a slot array: 512 consecutive leaves of a group share one, keyed by (group, coordinate div
512), and a task reduces it by up to three levels of eight. The nodes left are dealt into slot arrays again until a
group has one node, its subroot; the subroots are reduced the same way. Siblings go back down: an array gets the
siblings above it as one row, so upper siblings are never repeated per leaf.

Nulls and odd rows: a null field is hashed as ``-``; null groups form a group of their own, before all others; rows with
a null ``doc_id`` come first in their group and are never tampered with; rows that share an id (or have none) follow
each other by leaf digest, and equal leaves in any order, as they can be exchanged; an empty table gives an empty
result. Only the five hashed columns are read, so further columns cannot clash. Texts are hashed whole.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartolith.llm.common import ranked
from cartolith.session import cut_lineage

FAN, LEVELS = 8, 3
#: Leaves of one slot array.
SLOTS = FAN**LEVELS
WORD_BITS = 6
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def encoded(field: Column) -> Column:
    """``-`` for null, else the value's number of UTF-8 bytes, a colon and the value."""
    value = field.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf_digest(**fields: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*(encoded(fields[name]) for name in FIELDS)), 256))


def leaves(docs: DataFrame) -> DataFrame:
    """(lang, doc_id, leaf, tampered): ``tampered`` is the leaf of the altered row, null where nothing was altered."""
    own = {
        "doc_id": F.col("doc_id").cast("bigint"), "source": F.col("source"), "lang": F.col("lang").cast("string"),
        "n_chars": F.col("n_chars").cast("bigint"), "text": F.col("text").cast("string"),
    }
    altered = F.translate(own["text"], UPPER, LOWER)
    chosen = (F.crc32(own["doc_id"].cast("string").cast("binary")) % 3 == 0) & (altered != own["text"])
    return docs.select(
        own["lang"].alias("lang"), own["doc_id"].alias("doc_id"), leaf_digest(**own).alias("leaf"),
        F.when(chosen, leaf_digest(**(own | {"text": altered}))).alias("tampered"),
    )


def bitmap_words(rows: DataFrame) -> DataFrame:
    """(group_no, word, mask, n): the non-empty words of each group's bitmap of ids, and the rows they stand for."""
    bit = F.expr(f"shiftleft(1L, CAST(doc_id & {(1 << WORD_BITS) - 1} AS INT))")
    return rows.where("doc_id IS NOT NULL").groupBy("group_no", F.shiftright("doc_id", WORD_BITS).alias("word")).agg(
        F.bit_or(bit).alias("mask"), F.count(F.lit(1)).alias("n")
    )


def directory(words: DataFrame) -> DataFrame:
    """(group_no, word, before): leaves of the group in earlier words, from counts at every 64th part of the range.

    A count is added up among 64 siblings at most, so no level needs a group in one task.
    """
    levels, node = [], words.select("group_no", F.col("word").alias("node"), "n")
    while True:
        among = Window.partitionBy("group_no", "parent").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
        node = node.withColumn("parent", F.shiftright("node", WORD_BITS))
        level = cut_lineage(node.select("group_no", "node", "parent", "n", F.coalesce(F.sum("n").over(among), F.lit(0)).alias("before")), "bitmap-directory")
        levels.append(level)
        least, most = level.agg(F.min("parent"), F.max("parent")).first()
        if least == most:
            break
        if (least, most) == (-1, 0):  # ids below and from zero: a shift never joins these two
            wide = Window.partitionBy("group_no").orderBy("parent").rowsBetween(Window.unboundedPreceding, -1)
            halves = level.groupBy("group_no", "parent").agg(F.sum("n").alias("n"))
            levels.append(halves.select("group_no", F.col("parent").alias("node"), F.coalesce(F.sum("n").over(wide), F.lit(0)).alias("before")))
            break
        node = level.groupBy("group_no", "parent").agg(F.sum("n").alias("n")).withColumnRenamed("parent", "node")
    above = None
    for level in reversed(levels):
        if above is not None:
            up = above.select(F.col("group_no").alias("g"), F.col("node").alias("p"), F.col("before").alias("base"))
            level = level.join(up, (F.col("group_no") == F.col("g")) & (F.col("parent") == F.col("p")))
            level = level.withColumn("before", F.col("before") + F.col("base"))
        above = level.select("group_no", "node", "before")
    return above.withColumnRenamed("node", "word")


def coordinates(rows: DataFrame) -> DataFrame:
    """``rows`` (group_no, doc_id, leaf, ...; a stored table) with ``slot``, the rank of the row in its group."""
    words = cut_lineage(bitmap_words(rows), "bitmap-words")
    ranks = cut_lineage(words.drop("n").join(directory(words), ["group_no", "word"]).withColumnRenamed("group_no", "g"), "bitmap-ranks")
    nulls = cut_lineage(rows.where("doc_id IS NULL").groupBy("group_no").agg(F.count(F.lit(1)).alias("nulls")), "null-ids")
    repeats = words.where("n > bit_count(mask)").select("group_no", "word").join(
        rows.withColumn("word", F.shiftright("doc_id", WORD_BITS)), ["group_no", "word"]
    )
    repeats = cut_lineage(repeats.groupBy("group_no", "word", "doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "repeated-ids")
    below = F.expr(f"bit_count(mask & ~shiftleft(-1L, CAST(doc_id & {(1 << WORD_BITS) - 1} AS INT)))")
    at_word = (F.col("group_no") == F.col("g")) & (F.shiftright("doc_id", WORD_BITS) == F.col("word"))
    plain = rows.where("doc_id IS NOT NULL").join(ranks, at_word).withColumn("slot", F.col("before") + below).drop("g", "word", "mask", "before")
    if not nulls.isEmpty():
        plain = plain.join(nulls, "group_no", "left").withColumn("slot", F.col("slot") + F.coalesce("nulls", F.lit(0))).drop("nulls")
    elif repeats.isEmpty():
        return plain
    # Ids that several rows bear: a word has 64 at most, so their additional rows fit in one array per word.
    more = repeats.groupBy("group_no", "word").agg(F.collect_list(F.struct("doc_id", (F.col("n") - 1).alias("more"))).alias("repeated"))
    more = more.select(F.col("group_no").alias("g"), "word", "repeated")
    extra = F.expr("aggregate(coalesce(repeated, array()), 0L, (s, r) -> s + IF(r.doc_id < doc_id, r.more, 0L))")
    plain = plain.join(more, at_word, "left").withColumn("slot", F.col("slot") + extra).drop("g", "word", "repeated")
    again = repeats.select(F.col("group_no").alias("g"), F.col("doc_id").alias("i"))
    same = (F.col("group_no") == F.col("g")) & (F.col("doc_id") == F.col("i"))
    tied = plain.join(again, same, "left_semi").unionByName(rows.where("doc_id IS NULL").withColumn("slot", F.lit(0).cast("bigint")))
    # Rows equal in all that counts are told apart by where they were read, and spread over parts by that.
    tied = ranked(tied.withColumn("read", F.monotonically_increasing_id()), ["group_no", "doc_id", "leaf", "read"], "tied-ids").drop("read")
    tied = cut_lineage(tied, "tied-ranks")
    first = tied.groupBy("group_no", "doc_id").agg(F.min("rank").alias("first")).select(F.col("group_no").alias("g"), F.col("doc_id").alias("i"), "first")
    first = cut_lineage(first, "tied-first")
    tied = tied.join(first, (F.col("group_no") == F.col("g")) & F.col("doc_id").eqNullSafe(F.col("i")))
    tied = tied.withColumn("slot", F.col("slot") + F.col("rank") - F.col("first")).drop("g", "i", "rank", "first")
    return plain.join(again, same, "left_anti").unionByName(tied)


def _digest(parts: list[bytes]) -> bytes:
    return sha256(b"".join(p.hex().encode() for p in parts)).digest()


def _slot_array(slots: list[int], values: list) -> list:
    array = [None] * len(values)
    for slot, value in zip(slots, values):
        array[slot % SLOTS] = value
    return array


def _levels(nodes: list[bytes], whole: bool) -> list[list[bytes]]:
    """The nodes and the levels above them: three, or fewer where the array is the whole group and one node is left."""
    out = [nodes]
    while len(out) <= LEVELS and not (whole and len(out[-1]) == 1):
        out.append([_digest(out[-1][k : k + FAN]) for k in range(0, len(out[-1]), FAN)])
    return out


def _reduce(key: tuple, table: pa.Table) -> pa.Table:
    group, block = (k.as_py() for k in key)
    array = _slot_array(table.column("slot").to_pylist(), table.column("node").to_pylist())
    top = _levels(array, table.column("n")[0].as_py() <= SLOTS)[-1]
    n = -(-table.column("n")[0].as_py() // SLOTS)
    return pa.table({"group_no": [group], "slot": [block], "node": top, "n": [n]}, schema=NODES)


NODES = pa.schema([("group_no", pa.int64()), ("slot", pa.int64()), ("node", pa.binary()), ("n", pa.int64())])
PATHS = pa.schema([("group_no", pa.int64()), ("slot", pa.int64()), ("left", pa.list_(pa.binary())), ("right", pa.list_(pa.binary()))])
ROWS = "group_no bigint, slot bigint, node binary, n bigint"
PATH_ROWS = "group_no bigint, slot bigint, left array<binary>, right array<binary>"


def _block(slot: str = f"slot DIV {SLOTS}") -> Column:
    return F.expr(slot).alias("block")


def reduced(nodes: DataFrame) -> list[DataFrame]:
    """Stages of nodes (group_no, slot, node, n of the group), the last one with one node for each group."""
    stages = [nodes]
    while stages[-1].where("n > 1").limit(1).count():
        # A group that is down to one node stays as it is.
        stages.append(cut_lineage(stages[-1].groupBy("group_no", _block()).applyInArrow(_reduce, ROWS), "merkle-nodes"))
    return stages


def _siblings(array: list[bytes], n: int, above: tuple[list[bytes], list[bytes]]):
    """Of every node of a slot array: what stands left and right of it at each level up to the root, as hex text."""
    levels = _levels(array, n <= SLOTS)
    for slot in range(len(array)):
        left, right, at = [], [], slot
        for level in levels[:-1]:
            run = at // FAN * FAN
            left.append("".join(x.hex() for x in level[run:at]).encode())
            right.append("".join(x.hex() for x in level[at + 1 : run + FAN]).encode())
            at //= FAN
        yield left + above[0], right + above[1]


def _above(path: pa.Table) -> tuple[list[bytes], list[bytes]]:
    return path.column("left")[0].as_py(), path.column("right")[0].as_py()


def _descend(key: tuple, table: pa.Table, path: pa.Table) -> pa.Table:
    group, block = (k.as_py() for k in key)
    array = _slot_array(table.column("slot").to_pylist(), table.column("node").to_pylist())
    sides = list(_siblings(array, table.column("n")[0].as_py(), _above(path)))
    slots = [block * SLOTS + k for k in range(len(array))]
    return pa.table([[group] * len(slots), slots, [s[0] for s in sides], [s[1] for s in sides]], schema=PATHS)


def paths(stages: list[DataFrame], top: DataFrame) -> DataFrame:
    """Siblings above each slot array of the first stage, ``top`` holding those above the last stage's arrays.

    The row of a slot array bears the array's own number, which is the slot of its node one stage up.
    """
    for nodes in stages[:0:-1]:
        top = nodes.groupBy("group_no", _block()).cogroup(top.groupBy("group_no", _block("slot"))).applyInArrow(_descend, PATH_ROWS)
        top = cut_lineage(top, "merkle-paths")
    return top


PROOF_ROWS = "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
PROOFS = pa.schema([
    ("doc_id", pa.int64()), ("leaf", pa.string()), ("subroot", pa.string()), ("root", pa.string()),
    ("proof_sha256", pa.string()), ("folded_root", pa.string()), ("verified", pa.bool_()),
])


def _prove(root: str):
    def run(key: tuple, table: pa.Table, path: pa.Table) -> pa.Table:
        slots = table.column("slot").to_pylist()
        array, docs, changed = (_slot_array(slots, table.column(c).to_pylist()) for c in ("node", "doc_id", "tampered"))
        subroot = path.column("subroot")[0].as_py().hex()
        out = []
        sides = _siblings(array, table.column("n")[0].as_py(), _above(path))
        for doc, leaf, tampered, (left, right) in zip(docs, array, changed, sides):
            proof, at = sha256(), (tampered or leaf).hex().encode()
            for a, b in zip(left, right):
                proof.update(a + b)
                at = sha256(a + at + b).hexdigest().encode()
            folded = at.decode()
            out.append((doc, leaf.hex(), subroot, root, proof.hexdigest(), folded, folded == root))
        return pa.table([list(c) for c in zip(*out)], schema=PROOFS)

    return run


def manifest(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, leaf, subroot, root, proof_sha256, folded_root (of the tampered leaf) and verified."""
    rows = cut_lineage(leaves(docs), "merkle-leaves")
    groups = cut_lineage(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "merkle-groups")
    numbered = cut_lineage(ranked(groups, ["lang"], "merkle-group-order").select("lang", "n", F.col("rank").alias("group_no")), "merkle-group-numbers")
    keyed = numbered.select(F.col("lang").alias("of_lang"), "n", "group_no")
    rows = rows.join(keyed, F.col("lang").eqNullSafe(F.col("of_lang"))).select("group_no", "n", "doc_id", "leaf", "tampered")
    rows = cut_lineage(coordinates(cut_lineage(rows, "merkle-rows")), "merkle-coordinates").withColumnRenamed("leaf", "node")
    stages = reduced(rows.select("group_no", "slot", "node", "n"))
    subroots = stages[-1].select(F.col("group_no").alias("slot"), "node")
    tops = reduced(subroots.select(F.lit(0).cast("bigint").alias("group_no"), "slot", "node", F.lit(subroots.count()).cast("bigint").alias("n")))
    found = tops[-1].first()
    if found is None:
        return docs.sparkSession.createDataFrame([], PROOF_ROWS)
    start = docs.sparkSession.createDataFrame([(0, 0, [], [])], PATH_ROWS)
    # Down the tree of subroots first, then down each group.
    up = paths([tops[0], *tops], start).select(F.col("slot").alias("group_no"), F.lit(0).cast("bigint").alias("slot"), "left", "right")
    at = paths(stages, up).join(subroots.select(F.col("slot").alias("group_no"), F.col("node").alias("subroot")), "group_no")
    return rows.groupBy("group_no", _block()).cogroup(at.groupBy("group_no", _block("slot"))).applyInArrow(
        _prove(bytes(found["node"]).hex()), PROOF_ROWS
    )
