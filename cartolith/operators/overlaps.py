"""Overlaps counted, not listed.

The number of overlapping pairs grows with the square of the density, and a count needs no row per pair. Boxes are
dealt to grid cells as in a box join; a task compares the boxes of a cell as arrays of ranks and gives out one row per
box and cell. A crowded cell is cut into buckets of its boxes, and every pair of buckets is a group of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolith.operators import spatial
from cartolith.session import cut_lineage

#: Boxes of one bucket of a cell, about; ranks of a bucket are to fit 16 bits.
CROWDED = 60_000
#: Up to so many boxes a group's pairs are listed with those of other groups; beyond, each box is compared with slices of ranks.
_SMALL = 192
#: Tests of one slice; they stay in a core's own memory.
_SLICE = 1 << 18

_GROUP = ["_lvl", "_cx", "_cy", "_i", "_j"]
_SIDES = ("w", "s", "e", "n")


def _level(*box):
    """Every second grid level, so that a box lives on few of them."""
    return (F.floor(spatial.grid_level(*box) / 2) * 2).cast("int")


def later_overlaps(shapes: DataFrame, key: str, box: tuple[str, str, str, str], crowded: int = CROWDED) -> DataFrame:
    """Per ``key`` (a whole number) with any: rows of larger key whose box overlaps (``n``), and the least such key (``first``).

    Boxes that only touch do not overlap. The count is exact: no cell is left out or cut short.
    """
    rows = shapes.select(F.col(key).cast("bigint").alias("_id"), *[F.col(c).cast("double").alias(n) for c, n in zip(box, _SIDES)])
    used = rows.select(_level(*_SIDES).alias("l")).distinct().agg(F.collect_set("l")).scalar()
    rows = spatial._spread(rows.where(F.col("_id").isNotNull()), _SIDES, used, "_at_home", _level)
    cell = ["_lvl", "_cx", "_cy"]
    full = rows.groupBy(*cell).count().where(F.col("count") > crowded)
    full = cut_lineage(full.select(*cell, F.ceil(F.col("count") / crowded).cast("int").alias("_k")), "crowded-cells")
    rows = rows.join(full, cell, "left").withColumn("_k", F.coalesce("_k", F.lit(1)))
    mine = F.pmod(F.xxhash64("_id", *_SIDES), F.col("_k")).cast("int")
    rows = rows.withColumn("_mine", mine).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    rows = rows.select(
        *cell, F.least("_mine", "_other").alias("_i"), F.greatest("_mine", "_other").alias("_j"), "_id", *_SIDES,
        (spatial._cell("w", 180.0, "_lvl") == F.col("_cx")).alias("in_x"), (spatial._cell("s", 90.0, "_lvl") == F.col("_cy")).alias("in_y"),
        "_at_home", (F.col("_mine") > F.col("_other")).alias("right"),
    )
    tasks = max(4 * shapes.sparkSession.sparkContext.defaultParallelism, int(shapes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartition(tasks, *_GROUP).sortWithinPartitions(*_GROUP, "_id")
    counted = dealt.mapInArrow(_count_batches, "_id bigint, n bigint, first bigint")
    return counted.groupBy(F.col("_id").alias(key)).agg(F.sum("n").alias("n"), F.min("first").alias("first"))


# --- inside a task ------------------------------------------------------------------------


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups come one after another; rows of the last group of a batch wait for the next batch."""
    waiting, waits_for = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(len(_GROUP))], axis=1)
        last = keys[-1]
        start = int(np.flatnonzero((keys != last).any(axis=1))[-1]) + 1 if (keys[0] != last).any() else 0
        if start or (waits_for is not None and (waits_for != last).any()):
            yield from _counted([*waiting, batch.slice(0, start)])
            waiting = []
        waiting.append(batch.slice(start))
        waits_for = last
    if waiting:
        yield from _counted(waiting)


def _counted(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches(parts)
    if not table.num_rows:
        return
    rows = {n: table.column(n).to_numpy() for n in table.column_names}
    n, first = _count_rows(rows)
    some = n > 0
    yield pa.RecordBatch.from_arrays([pa.array(rows["_id"][some]), pa.array(n[some]), pa.array(first[some])], ["_id", "n", "first"])


def _count_rows(rows: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(number, least key) of the later overlapping rows of each row; rows are sorted by group and key."""
    size = len(rows["_id"])
    fresh = np.zeros(size, bool)
    fresh[0] = True
    for name in _GROUP:
        fresh[1:] |= rows[name][1:] != rows[name][:-1]
    begins = np.flatnonzero(fresh)
    ends = np.append(begins[1:], size)
    n, first = np.zeros(size, np.int64), np.zeros(size, np.int64)
    small = ends - begins <= _SMALL
    _list_pairs(rows, begins[small], ends[small], n, first)
    for b, e in zip(begins[~small].tolist(), ends[~small].tolist()):
        group = {name: rows[name][b:e] for name in (*_SIDES, "_id", "in_x", "in_y", "_at_home")}
        if rows["_i"][b] == rows["_j"][b]:
            every = np.arange(e - b)
            _compare(group, every, every, n[b:e], first[b:e])
        else:
            left, right = np.flatnonzero(~rows["right"][b:e]), np.flatnonzero(rows["right"][b:e])
            _compare(group, left, right, n[b:e], first[b:e])
            _compare(group, right, left, n[b:e], first[b:e])
    return n, first


def _list_pairs(rows, begins, ends, n, first) -> None:
    """Small groups: each row with every row behind it in its group, about a million pairs at a time."""
    if not len(begins):
        return
    # A row of a small group, and how many rows are behind it.
    at = np.arange(int((ends - begins).sum())) + np.repeat(begins - np.cumsum(ends - begins) + (ends - begins), ends - begins)
    behind = np.repeat(ends, ends - begins) - at - 1
    cuts = np.searchsorted(np.cumsum(behind), np.arange(1 << 20, int(behind.sum()) + (1 << 20), 1 << 20))
    for part_at, part in zip(np.split(at, cuts), np.split(behind, cuts)):
        a = np.repeat(part_at, part)
        if not len(a):
            continue
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(part) - part, part)
        v = lambda name: (rows[name][a], rows[name][b])  # noqa: B023, E731
        (aw, bw), (ae, be), (as_, bs), (an, bn) = v("w"), v("e"), v("s"), v("n")
        hit = (aw < be) & (ae > bw) & (as_ < bn) & (an > bs)
        for name in ("in_x", "in_y", "_at_home"):
            hit &= np.logical_or(*v(name))
        hit &= np.less(*v("_id")) & ((rows["_i"][a] == rows["_j"][a]) | np.not_equal(*v("right")))
        a, b = a[hit], b[hit]
        who, where, times = np.unique(a, return_index=True, return_counts=True)
        n[who] = times
        first[who] = rows["_id"][b[where]]


def _compare(group, left, right, n, first) -> None:
    """Adds to ``n`` and ``first`` of the rows ``left`` what of the rows ``right`` is later and overlaps; both are sorted by key.

    A pair counts in the cell of the lower left corner of its overlap: at least one of its boxes begins there, on each axis. And
    at least one of the two is at home on the cell's level.
    """
    for home in (True, False):
        a = left[group["_at_home"][left] == home]
        b = right if home else right[group["_at_home"][right]]
        if len(a) and len(b):
            _compare_ranks(group, a, b, n, first)


def _ranks(values: np.ndarray, kind, width: int) -> tuple[np.ndarray, np.ndarray]:
    ordered = np.sort(values)
    out = np.full(width, np.iinfo(kind).max, kind)
    out[: len(values)] = np.searchsorted(ordered, values, "left")
    return ordered, out


def _compare_ranks(group, a, b, n, first) -> None:
    # The number of values below a bound tells the values below it: their ranks are less than that number.
    kind = np.uint16 if len(b) < 65_535 else np.uint32
    width = -(-len(b) // 8) * 8
    axes = []
    for low, high, inside in (("w", "e", "in_x"), ("s", "n", "in_y")):
        lows, low_rank = _ranks(group[low][b], kind, width)
        highs, high_rank = _ranks(group[high][b], kind, width)
        below = np.searchsorted(lows, group[high][a], "left").astype(kind)
        above = np.searchsorted(highs, group[low][a], "right").astype(kind)
        # Of a box that begins before the cell only those count that begin in it, which lie behind its own beginning.
        outside = kind(len(b) - int(group[inside][b].sum()))
        axes.append((low_rank, below, high_rank, above, outside, group[inside][a]))
    keys, ids = group["_id"][b], group["_id"][a]
    later = np.searchsorted(keys, ids, "right")
    (xl, xb, xh, xa, xo, xi), (yl, yb, yh, ya, yo, yi) = axes
    for in_x in (True, False):
        for in_y in (True, False):
            some = np.flatnonzero((xi == in_x) & (yi == in_y) & (later < len(b)))
            x, y = (xh if in_x else xl), (yh if in_y else yl)
            at = 0
            while at < len(some):
                skip = int(later[some[at]]) // 8 * 8
                part = some[at : at + max(8, _SLICE // (width - skip))]
                at += len(part)
                hit = xl[skip:] < xb[part, None]
                test = np.empty_like(hit)
                np.greater_equal(x[skip:], xa[part, None] if in_x else xo, out=test)
                hit &= test
                np.less(yl[skip:], yb[part, None], out=test)
                hit &= test
                np.greater_equal(y[skip:], ya[part, None] if in_y else yo, out=test)
                hit &= test
                own = later[part]
                mixed = int(own[-1]) - skip
                hit[:, :mixed] &= np.arange(skip, skip + mixed) >= own[:, None]
                words = np.bitwise_count(hit.view(np.uint64)).sum(axis=1, dtype=np.int64)
                found = words > 0
                who, least = a[part[found]], keys[skip + hit[found].argmax(axis=1)]
                first[who] = np.where(n[who] > 0, np.minimum(first[who], least), least)
                n[who] += words[found]
