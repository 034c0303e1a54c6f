"""Covers as table functions for SQL users.

They are SQL functions: the optimizer expands them into explodes of ranges, so a call costs
what the DataFrame generators cost and no Python worker is started.

    SELECT v.id, t.x, t.y FROM views v, LATERAL tile_cover(v.west, v.south, v.east, v.north, 9) t
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from cartolith import constants as K
from cartolith.functions.geohash import _EVEN, _ODD

_SIDE = "CAST(pow(2D, z) AS BIGINT)"


def _clamp(value: str, last: str) -> str:
    return f"CAST(least(greatest(floor({value}), 0), {last}) AS BIGINT)"


def _tile_x(lon: str) -> str:
    return _clamp(f"({lon} + 180D) / 360D * pow(2D, z)", f"{_SIDE} - 1")


def _tile_y(lat: str) -> str:
    top = f"{K.MAX_LATITUDE}D"
    clamped = f"greatest(-{top}, least({top}, {lat}))"
    return _clamp(f"(1D - asinh(tan(radians({clamped}))) / pi()) / 2D * pow(2D, z)", f"{_SIDE} - 1")


def _index(value: str, origin: int, extent: int, bits: str) -> str:
    return _clamp(f"({value} + {origin}D) / ({extent}D / pow(2D, {bits}))", f"CAST(pow(2D, {bits}) AS BIGINT) - 1")


_LON_BITS, _LAT_BITS = "ceil(5 * p / 2D)", "floor(5 * p / 2D)"
_LETTER = (
    "substr(if(i % 2 = 0, '{even}', '{odd}'), CAST("
    "(shiftright(ix, CAST({lon} - ceil(5 * (i + 1) / 2D) AS INT)) & if(i % 2 = 0, 7, 3)) * if(i % 2 = 0, 4, 8)"
    " + (shiftright(iy, CAST({lat} - floor(5 * (i + 1) / 2D) AS INT)) & if(i % 2 = 0, 3, 7)) + 1 AS INT), 1)"
).format(even=_EVEN, odd=_ODD, lon=_LON_BITS, lat=_LAT_BITS)

TILE_COVER = f"""
CREATE OR REPLACE TEMPORARY FUNCTION tile_cover(west DOUBLE, south DOUBLE, east DOUBLE, north DOUBLE, z INT)
RETURNS TABLE (x BIGINT, y BIGINT)
RETURN SELECT x, explode(sequence(y0, y1)) AS y FROM (
  SELECT explode(sequence({_tile_x('west')}, {_tile_x('east')})) AS x, {_tile_y('north')} AS y0, {_tile_y('south')} AS y1) AS a
"""

GEOHASH_COVER = f"""
CREATE OR REPLACE TEMPORARY FUNCTION geohash_cover(west DOUBLE, south DOUBLE, east DOUBLE, north DOUBLE, p INT)
RETURNS TABLE (ix BIGINT, iy BIGINT, cell STRING)
RETURN SELECT ix, iy, array_join(transform(sequence(0, p - 1), i -> {_LETTER}), '') AS cell FROM (
  SELECT ix, p, explode(sequence(iy0, iy1)) AS iy FROM (
    SELECT p, explode(sequence({_index('west', 180, 360, _LON_BITS)}, {_index('east', 180, 360, _LON_BITS)})) AS ix,
           {_index('south', 90, 180, _LAT_BITS)} AS iy0, {_index('north', 90, 180, _LAT_BITS)} AS iy1) AS a) AS b
"""


def register(spark: SparkSession) -> None:
    """Make ``tile_cover`` and ``geohash_cover`` callable from SQL in this session."""
    spark.sql(TILE_COVER)
    spark.sql(GEOHASH_COVER)
