"""Feature-tile blobs: the compact binary form of one tile's features.

Layout: magic, zoom, column, row and extent, then per layer a count and its features. A
feature is a vertex count, a class byte (roads and areas), zigzag varint steps on the
4096 grid and, for buildings, the height in decimetres.

Encoding is native: each feature becomes a binary fragment on its own row, fragments are appended by
(tile, layer, part of the order), and parts by tile. Decoding runs on Arrow batches in two steps: a walk over the
counts of a blob cuts it into sections of features, and the sections are dealt to tasks that decode the steps as arrays.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartolith import constants as K
from cartolith.functions import osm, tiles
from cartolith.functions._c import c
from cartolith.operators.features import grid_steps
from cartolith.session import cut_lineage

LAYERS = ("building", "road", "landuse")
DECODED = (
    "z bigint, x bigint, y bigint, layer string, seq bigint, class string, height_m double, "
    "line array<struct<lon:double,lat:double>>, error string"
)


def _byte(value: Column) -> Column:
    return F.lpad(F.hex(value), 2, "0")


def varint_hex(value) -> Column:
    """Base-128 bytes of an unsigned value below 2^32, low bits first, as hex.

    All bytes go through one number; the first of several bytes is at least 128, so its digits need no padding.
    """
    v = c(value)
    out = F.when(v < 2**7, _byte(v))
    for n in range(2, 6):
        bits = F.shiftright(v, 7 * (n - 1)).bitwiseAND(127)
        for i in range(n - 1):
            bits = bits + F.shiftleft(F.shiftright(v, 7 * i).bitwiseAND(127) + 128, 8 * (n - 1 - i))
        out = out.when(v < 2 ** (7 * n), F.hex(bits)) if n < 5 else out.otherwise(F.hex(bits))
    return out


def _little(value, n_bytes: int) -> Column:
    v = c(value).cast("bigint")
    return F.concat(*[_byte(F.shiftright(v, 8 * i).bitwiseAND(255)) for i in range(n_bytes)])


def fragment() -> Column:
    """Hex bytes of one feature row (tile box ``_box``, layer, class, height_m, line)."""
    steps = F.flatten(
        F.transform(grid_steps("line", F.col("_box")), lambda s: F.array(tiles.zigzag(s["dx"]), tiles.zigzag(s["dy"])))
    )
    body = F.array_join(F.transform(steps, varint_hex), "")
    count = varint_hex(F.size("line").cast("bigint"))
    height = varint_hex(F.greatest(F.lit(0).cast("bigint"), tiles.half_up(F.col("height_m") * 10).cast("bigint")))
    return (
        F.when(F.col("layer") == "building", F.concat(count, body, height))
        .when(F.col("layer") == "road", F.concat(count, _byte(osm.road_index("class")), body))
        .otherwise(F.concat(count, _byte(osm.landuse_index("class")), body))
    )


#: Features that one task appends at once, about.
BLOCK = 65_536


def encode(features: DataFrame, order: str = "seq", answered: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """One blob per tile, up to the 2 GB of one value. Features keep ``order`` inside their layer.

    Features are dealt along tile, layer and ``order`` to tasks of about ``block`` each, and what one task has of a layer is a
    part. Parts are built by separate groups, and the last step only appends finished parts, so a tile that holds a large
    share of all features never has its features gathered in one group. Features of equal ``order`` in one layer stay in one part.

    ``answered`` (z, x, y) names tiles that were asked for; those without features get a blob
    with empty layers. Whether an answer was cut off is judged where it is fetched.
    """
    key = ["z", "x", "y"]
    rows = features.withColumn("_box", tiles.tile_box("z", "x", "y"))
    layer = F.array_position(F.array(*[F.lit(n) for n in LAYERS]), F.col("layer"))
    parts = rows.select(*key, layer.alias("l"), F.col(order).alias("o"), F.unhex(fragment()).alias("body"))
    # Written once: the cuts along the order are sampled from it.
    parts = cut_lineage(parts, "tile-fragments")
    tasks = max(parts.sparkSession.sparkContext.defaultParallelism, -(-parts.count() // block))
    # Partitions of a given number are not merged or split later, so their numbers follow the order.
    parts = parts.repartitionByRange(tasks, *key, "l", "o").withColumn("part", F.spark_partition_id())
    built = parts.groupBy(*key, "l", "part").agg(
        F.count("body").alias("n"), F.expr("listagg(body) WITHIN GROUP (ORDER BY o, body)").alias("bytes")
    )
    numbers = range(1, len(LAYERS) + 1)
    joined = built.groupBy(*key).agg(
        *[F.sum(F.when(F.col("l") == k, F.col("n"))).alias(f"n{k}") for k in numbers],
        *[F.expr(f"listagg(bytes) WITHIN GROUP (ORDER BY part) FILTER (WHERE l = {k})").alias(f"b{k}") for k in numbers],
    )
    if answered is not None:
        wanted = answered.select(*[F.col(n).cast(features.schema[n].dataType).alias(n) for n in key]).distinct()
        joined = joined.join(wanted, key, "full_outer")
    head = F.concat(
        _little(F.lit(K.TILE_MAGIC), 4), _byte(F.col("z")), _little("x", 4), _little("y", 4), _little(F.lit(K.TILE_EXTENT), 2)
    )
    sections = [
        part for k in numbers
        for part in (F.unhex(varint_hex(F.coalesce(f"n{k}", F.lit(0)).cast("bigint"))), F.coalesce(f"b{k}", F.lit(b"")))
    ]
    return joined.select(*key, F.concat(F.unhex(head), *sections).alias("content"))


#: Bytes of the fixed head, of the longest number, of a section about, and of sections decoded at once.
_HEAD, _LONGEST, _SECTION, _AT_ONCE = 15, 6, 1 << 17, 1 << 19
_CLASSED = {"road": (K.ROAD_CLASSES, "residential"), "landuse": (K.LANDUSE_CLASSES, "grass")}


class _Walk:
    """A walk over features that reads counts, class bytes and heights only.

    A number ends at the next byte below 128, so the ends of all numbers are known beforehand and the walk jumps over
    the steps of a feature.
    """

    def __init__(self, data) -> None:
        self.data, self.bytes, self.at, self.k = data, np.frombuffer(data, np.uint8), 0, 0
        self.ends = np.flatnonzero(self.bytes < 128)
        self.end = memoryview(self.ends)
        # Numbers that end too far behind the one before, and the end of the data: the walk checks before it passes the first of them.
        self.far = [*np.flatnonzero(np.diff(self.ends, prepend=-1) > _LONGEST).tolist(), len(self.ends)]
        self.limit = self.far[0]

    def number(self) -> int:
        if self.k >= self.limit:
            self._check(self.k + 1)
        start, last = self.at, self.end[self.k]
        self.k += 1
        self.at = last + 1
        value = self.data[last]
        while last > start:
            last -= 1
            value = value << 7 | self.data[last] & 127
        return value

    def feature(self, layer: str) -> tuple[int, int | None, int | None, int, int]:
        """Vertices, class byte, height, number and place of the first step of the feature that the walk passes."""
        n, kind, height = self.number(), None, None
        if layer in _CLASSED:
            if self.at >= len(self.data):
                raise ValueError("truncated")
            kind = self.data[self.at]
            self.at += 1
            self.k += kind < 128
        first, place = self.k, self.at
        if n:
            last = first + 2 * n
            if last > self.limit:
                self._check(last)
            self.k, self.at = last, self.end[last - 1] + 1
        if layer == "building":
            height = self.number()
        return n, kind, height, first, place

    def _check(self, last: int) -> None:
        """Whether the numbers before ``last`` can be passed."""
        while len(self.far) > 1 and self.far[0] < last:
            # A class byte of 128 or more lies between the first number and the one before.
            if self.far[0] > self.k or self.end[self.k] - self.at >= _LONGEST:
                raise ValueError("varint overflow")
            del self.far[0]
        self.limit = self.far[0]
        if last > len(self.end):
            rest = self.end[-1] + 1 if len(self.end) > self.k else self.at
            raise ValueError("varint overflow" if len(self.data) - rest >= _LONGEST else "truncated")

    def steps(self, first: np.ndarray, place: np.ndarray, vertices: np.ndarray) -> np.ndarray:
        """(x, y) of every vertex, features one after another."""
        count, total = 2 * vertices, int(2 * vertices.sum())
        if not total:
            return np.zeros((0, 2), np.int64)
        begins = np.concatenate(([0], np.cumsum(count)[:-1]))
        number = np.repeat(first - begins, count) + np.arange(total)
        end = self.ends[number]
        start = np.where(number > 0, self.ends[number - 1] + 1, 0)
        some = count > 0
        start[begins[some]] = place[some]
        value = np.zeros(total, np.int64)
        for k in range(int((end - start).max()) + 1):
            here = start + k <= end
            value[here] |= (self.bytes[start[here] + k].astype(np.int64) & 127) << (7 * k)
        moves = np.cumsum(((value >> 1) ^ -(value & 1)).reshape(-1, 2), axis=0)
        # Sums run over all features, so each feature takes off what the ones before it moved.
        before = np.concatenate((np.zeros((1, 2), np.int64), moves))[begins // 2]
        return moves - np.repeat(before, vertices, axis=0)


_SECTION_DDL = "z bigint, x bigint, y bigint, layer string, seq bigint, _n bigint, _body binary, error string"
_RAW_DDL = (
    "z bigint, x bigint, y bigint, layer string, seq bigint, class string, height_dm bigint, "
    "steps array<struct<qx:bigint,qy:bigint>>, error string"
)


def _sections(data: bytes) -> list[tuple]:
    """A blob's sections: tile, layer, number of the first feature, features and their bytes. Reads the whole blob first."""
    if len(data) < _HEAD:
        raise ValueError("truncated")
    magic, z, x, y, extent = struct.unpack_from("<IBIIH", data)
    if magic != K.TILE_MAGIC:
        raise ValueError("not a feature tile")
    if extent != K.TILE_EXTENT:
        raise ValueError("unsupported extent")
    walk, out = _Walk(data[_HEAD:]), []
    for layer in LAYERS:
        seq, count = 0, walk.number()
        while seq < count:
            first, start = seq, walk.at
            while seq < count and walk.at - start < _SECTION:
                walk.feature(layer)
                seq += 1
            out.append((z, x, y, layer, first, seq - first, walk.data[start : walk.at]))
    return out


def _given_out(columns: list[pa.Array], names: list[str], batch: pa.RecordBatch, source, skip: int) -> pa.RecordBatch:
    """``columns``, and the columns of ``batch`` behind the first ``skip`` for the rows in ``source``."""
    source = pa.array(source, pa.int64())
    kept = [batch.column(k).take(source) for k in range(skip, batch.num_columns)]
    return pa.RecordBatch.from_arrays(columns + kept, names + batch.schema.names[skip:])


def _section_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sections of the first column's blobs; the other columns go with each section and each error."""
    names = ["z", "x", "y", "layer", "seq", "_n", "_body", "error"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
    for batch in batches:
        rows, source, held = [], [], 0
        for k, data in enumerate(batch.column(0)):
            try:
                found = [(*s, None) for s in _sections(data.as_py() or b"")]
            except ValueError as error:
                found = [(*[None] * 5, 0, b"", str(error))]
            rows += found
            source += [k] * len(found)
            held += sum(len(s[6]) for s in found)
            if held >= _AT_ONCE or k == batch.num_rows - 1:
                columns = [pa.array([row[i] for row in rows], kind) for i, kind in enumerate(types)]
                yield _given_out(columns, names, batch, source, 1)
                rows, source, held = [], [], 0


def _features(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Features of some sections, and their errors behind them."""
    layers, firsts, counts, bodies, errors = (batch.column(n).to_pylist() for n in ("layer", "seq", "_n", "_body", "error"))
    walk, found, kinds = _Walk(b"".join(bodies)), [], []
    for layer, count in zip(layers, counts):
        own = [walk.feature(layer) for _ in range(count)]
        found += own
        if layer in _CLASSED:
            known, default = _CLASSED[layer]
            kinds += [known[f[1]] if f[1] < len(known) else default for f in own]
        else:
            kinds += [None] * count
    vertices, _, heights, first, place = zip(*found) if found else ((),) * 5
    vertices = np.array(vertices, np.int64)
    bad = [k for k, error in enumerate(errors) if error is not None]
    source = np.concatenate((np.repeat(np.arange(batch.num_rows), counts), np.array(bad, np.int64)))
    seq = [s for start, count in zip(firsts, counts) if count for s in range(start, start + count)]
    xy = walk.steps(np.array(first, np.int64), np.array(place, np.int64), vertices)
    pairs = pa.StructArray.from_arrays([pa.array(xy[:, 0].copy()), pa.array(xy[:, 1].copy())], ["qx", "qy"])
    steps = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(vertices))).astype(np.int32)), pairs)
    none = [None] * len(bad)
    taken = {n: batch.column(n).take(pa.array(source)) for n in ("z", "x", "y", "layer", "error")}
    columns = [
        taken["z"], taken["x"], taken["y"], taken["layer"], pa.array(seq + none, pa.int64()), pa.array(kinds + none, pa.string()),
        pa.array([*heights, *none], pa.int64()), pa.concat_arrays([steps, pa.nulls(len(bad), steps.type)]), taken["error"],
    ]
    return _given_out(columns, ["z", "x", "y", "layer", "seq", "class", "height_dm", "steps", "error"], batch, source, 8)


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features of the sections, some sections at a time."""
    for batch in batches:
        begin, held = 0, 0
        for k, body in enumerate(batch.column("_body")):
            held += len(body.as_buffer())
            if held >= _AT_ONCE or k == batch.num_rows - 1:
                yield _features(batch.slice(begin, k + 1 - begin))
                begin, held = k + 1, 0


def decode(blobs: DataFrame, content: str = "content", keep: tuple[str, ...] = ()) -> DataFrame:
    """Feature rows of many blobs; a blob that cannot be read is a row with ``error``.

    ``keep`` names columns of ``blobs`` that every row carries, an error's too, so a bad blob is known by its key; they
    must not be called like a column of a feature. A null blob counts as an empty one and is ``truncated``. Blobs are cut
    into sections of about 128 KB, which are dealt to all tasks, so a large blob is not decoded by one of them. Python
    only finds the grid positions; they become coordinates in the JVM.
    """
    kept = "".join(f", `{n}` {blobs.schema[n].dataType.simpleString()}" for n in keep)
    sections = blobs.select(content, *keep).mapInArrow(_section_batches, _SECTION_DDL + kept)
    raw = sections.hint("rebalance").mapInArrow(_feature_batches, _RAW_DDL + kept)
    raw = raw.withColumn("_box", tiles.tile_box("z", "x", "y"))
    line = F.transform("steps", lambda s: tiles.restore(s["qx"], s["qy"], F.col("_box")))
    return raw.select(
        "z", "x", "y", "layer", "seq", "class", (F.col("height_dm") / 10.0).alias("height_m"), line.alias("line"), "error", *keep
    )
