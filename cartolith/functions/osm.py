"""Classes, widths and heights of map features from their tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cartolith import constants as K
from cartolith.functions._c import c, lookup


def tag(tags, key: str) -> Column:
    """Value of a tag, null when absent or empty."""
    return F.nullif(F.try_element_at(c(tags), F.lit(key)), F.lit(""))


def leading_number(text) -> Column:
    """The number a text starts with ("12m" reads 12), null when it starts otherwise."""
    raw = F.regexp_extract(c(text), r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)", 1)
    return F.nullif(raw, F.lit("")).try_cast("double")


def building_height(height_text, levels_text) -> Column:
    """Stated height, else levels times three, else six metres; at most 400."""
    height, levels = leading_number(height_text), leading_number(levels_text)
    return (
        F.when(height > 0, F.least(height, F.lit(K.MAX_HEIGHT_M)))
        .when(levels > 0, F.least(levels * K.METRES_PER_LEVEL, F.lit(K.MAX_HEIGHT_M)))
        .otherwise(F.lit(K.DEFAULT_HEIGHT_M))
    )


def road_class(highway) -> Column:
    base = F.regexp_replace(c(highway), "_link$", "")
    known = {name: name for name in K.ROAD_CLASSES}
    return lookup({**known, **K.ROAD_ALIASES}, base)


def landuse_class(landuse, natural, leisure=None) -> Column:
    """First mapped value among the keys; leave ``leisure`` out for the tile profile."""
    keys = [landuse, natural] + ([] if leisure is None else [leisure])
    return F.coalesce(*[lookup(K.LANDUSE_TAGS, c(key)) for key in keys])


def waterway_class(waterway) -> Column:
    return F.when(c(waterway).isin(*K.WATERWAY_WIDTH_M), c(waterway))


def road_width(road) -> Column:
    return F.coalesce(lookup(K.ROAD_WIDTH_M, c(road)), F.lit(4.0))


def waterway_width(waterway) -> Column:
    return lookup(K.WATERWAY_WIDTH_M, c(waterway))


def _index(values, value, default: str) -> Column:
    found = F.array_position(F.array(*[F.lit(v) for v in values]), c(value)).cast("bigint")
    return F.when(F.coalesce(found, F.lit(0)) > 0, found - 1).otherwise(F.lit(values.index(default)))


def road_index(value) -> Column:
    return _index(K.ROAD_CLASSES, value, "residential").cast("bigint")


def landuse_index(value) -> Column:
    return _index(K.LANDUSE_CLASSES, value, "grass").cast("bigint")


def part_height(top, terrain) -> Column:
    """Measured height of a building part, null outside 1.5 to 220 metres."""
    height = c(top) - c(terrain)
    return F.when(height.between(K.MIN_PART_HEIGHT_M, K.MAX_PART_HEIGHT_M), height)
