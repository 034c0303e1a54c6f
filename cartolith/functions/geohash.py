"""Geohash encoding, decoding and covers as native column expressions.

A geohash character holds five bits taken alternately from the longitude and the
latitude lattice index. Character ``i`` therefore depends on three bits of one index and
two of the other, so it can be read from a 32-letter table addressed by those bits: two
shifts, two masks and one substring per character, with no loop and no Python worker.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cartolith import constants as K
from cartolith.functions._c import c


def bits(precision: int) -> tuple[int, int]:
    """Bits of the longitude and the latitude index at a precision."""
    total = 5 * precision
    return (total + 1) // 2, total // 2


def grid_size(precision) -> Column:
    """Cells of the lattice per axis."""
    total = 5.0 * c(precision)
    return F.struct(
        F.pow(F.lit(2.0), F.ceil(total / 2.0)).cast("bigint").alias("lon_cells"),
        F.pow(F.lit(2.0), F.floor(total / 2.0)).cast("bigint").alias("lat_cells"),
    )


def _tables() -> tuple[str, str]:
    """Letter tables: [lon 3 bits][lat 2 bits] for even places, [lon 2][lat 3] for odd."""
    even, odd = [], []
    for a in range(8):
        for b in range(4):
            n = ((a >> 2 & 1) << 4) | ((b >> 1 & 1) << 3) | ((a >> 1 & 1) << 2) | ((b & 1) << 1) | (a & 1)
            even.append(K.GEOHASH_ALPHABET[n])
    for a in range(4):
        for b in range(8):
            n = ((b >> 2 & 1) << 4) | ((a >> 1 & 1) << 3) | ((b >> 1 & 1) << 2) | ((a & 1) << 1) | (b & 1)
            odd.append(K.GEOHASH_ALPHABET[n])
    return "".join(even), "".join(odd)


_EVEN, _ODD = _tables()


def cell_hash(ix, iy, precision: int) -> Column:
    """Geohash of a lattice cell."""
    ix, iy = c(ix).cast("bigint"), c(iy).cast("bigint")
    lon_left, lat_left = bits(precision)
    letters = []
    for place in range(precision):
        take_lon, take_lat = (3, 2) if place % 2 == 0 else (2, 3)
        lon_left -= take_lon
        lat_left -= take_lat
        a = F.shiftright(ix, lon_left).bitwiseAND(2**take_lon - 1)
        b = F.shiftright(iy, lat_left).bitwiseAND(2**take_lat - 1)
        table = _EVEN if place % 2 == 0 else _ODD
        letters.append(F.substring(F.lit(table), (a * 2**take_lat + b + 1).cast("int"), F.lit(1)))
    return F.concat(*letters)


def _axis_index(value: Column, origin: float, extent: float, n_bits: int, exact: bool) -> Column:
    cells = 2**n_bits
    width = extent / cells
    floor = F.least(F.floor((value - origin) / width), F.lit(cells - 1))
    floor = F.greatest(floor, F.lit(0)).cast("bigint")
    if not exact:
        return floor
    # Adding the origin can swallow a tiny negative coordinate; the coordinate itself
    # decides on which side of the cell edge it lies.
    return F.when(value < floor * width + origin, floor - 1).otherwise(floor)


def lon_index(lon, precision: int, exact: bool = True) -> Column:
    return _axis_index(c(lon), -180.0, 360.0, bits(precision)[0], exact)


def lat_index(lat, precision: int, exact: bool = True) -> Column:
    return _axis_index(c(lat), -90.0, 180.0, bits(precision)[1], exact)


def encode(lat, lon, precision: int) -> Column:
    """Geohash of a point; cells are half-open, so an edge belongs to the upper cell."""
    return cell_hash(lon_index(lon, precision), lat_index(lat, precision), precision)


def encode_checked(lat, lon, precision: int) -> Column:
    """As :func:`encode`, null outside the world."""
    ok = c(lat).between(-90, 90) & c(lon).between(-180, 180)
    return F.when(ok, encode(lat, lon, precision))


def prefixes(hash_col) -> Column:
    """Every prefix of a geohash, shortest first."""
    h = c(hash_col)
    return F.transform(F.sequence(F.lit(1), F.length(h)), lambda n: F.substring(h, F.lit(1), n))


def social_ladder(lat, lon) -> Column:
    """The prefixes announced with a social event (precisions 1 to 6)."""
    deepest = encode(lat, lon, max(K.SOCIAL_PRECISIONS))
    return F.array(*[F.substring(deepest, 1, p) for p in K.SOCIAL_PRECISIONS])


def decode(hash_col) -> Column:
    """Centre of a geohash cell, null when a character is not in the alphabet."""
    h = c(hash_col)
    letters = F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(h), F.lit(1))),
        lambda i: F.instr(F.lit(K.GEOHASH_ALPHABET), F.substring(h, i, F.lit(1))) - 1,
    )
    # Per letter, split its five bits into the two axis indexes; the axis that gets
    # three bits alternates with the place.
    def step(acc, v):
        even = acc["n"] % 2 == 0
        outer = F.shiftright(v, 2).bitwiseAND(4) + F.shiftright(v, 1).bitwiseAND(2) + v.bitwiseAND(1)
        inner = F.shiftright(v, 2).bitwiseAND(2) + F.shiftright(v, 1).bitwiseAND(1)
        return F.struct(
            F.when(even, acc["ix"] * 8 + outer).otherwise(acc["ix"] * 4 + inner).cast("bigint").alias("ix"),
            F.when(even, acc["iy"] * 4 + inner).otherwise(acc["iy"] * 8 + outer).cast("bigint").alias("iy"),
            (acc["n"] + 1).cast("int").alias("n"),
        )

    zero = F.struct(
        F.lit(0).cast("bigint").alias("ix"),
        F.lit(0).cast("bigint").alias("iy"),
        F.lit(0).cast("int").alias("n"),
    )

    def finish(acc):
        total = acc["n"] * 5.0
        lon_w = 360.0 / F.pow(F.lit(2.0), F.ceil(total / 2.0))
        lat_h = 180.0 / F.pow(F.lit(2.0), F.floor(total / 2.0))
        return F.struct(
            ((acc["iy"] + 0.5) * lat_h - 90.0).alias("lat"),
            ((acc["ix"] + 0.5) * lon_w - 180.0).alias("lon"),
        )

    point = F.aggregate(letters, zero, step, finish)
    return F.when(F.forall(letters, lambda v: v >= 0) & (F.length(h) > 0), point)


def cover_range(west, south, east, north, precision: int) -> Column:
    """Lattice index rectangle a box touches (both edges included)."""
    return F.struct(
        lon_index(west, precision, exact=False).alias("ix0"),
        lon_index(east, precision, exact=False).alias("ix1"),
        lat_index(south, precision, exact=False).alias("iy0"),
        lat_index(north, precision, exact=False).alias("iy1"),
    )


def cover_count(west, south, east, north, precision: int) -> Column:
    """Number of cells in a cover, without building one."""
    return (
        lon_index(east, precision, exact=False) - lon_index(west, precision, exact=False) + 1
    ) * (lat_index(north, precision, exact=False) - lat_index(south, precision, exact=False) + 1)


def cover_array(west, south, east, north, precision: int) -> Column:
    """Cells of a box as an array, longitude outer and latitude inner.

    For boxes already known to be small; :func:`cartolith.operators.generate.box_cells`
    yields rows instead.
    """
    r = cover_range(west, south, east, north, precision)
    return F.flatten(
        F.transform(
            F.sequence(r["ix0"], r["ix1"]),
            lambda ix: F.transform(
                F.sequence(r["iy0"], r["iy1"]), lambda iy: cell_hash(ix, iy, precision)
            ),
        )
    )


def deepest(cells) -> Column:
    """Longest cell of a tag list, the first one among equals."""
    cells = c(cells)
    best = F.array_max(F.transform(cells, lambda x: F.length(x)))
    return F.try_element_at(F.filter(cells, lambda x: F.length(x) == best), F.lit(1))
