"""Slippy-map tile arithmetic as native column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from cartolith import constants as K
from cartolith.functions._c import c, first_code, let, long


def span(z) -> Column:
    """Tiles per axis at a zoom, as a double (exact: a power of two)."""
    return F.pow(F.lit(2.0), c(z).cast("double"))


def lon_to_x(lon, z) -> Column:
    """Fractional tile column of a longitude."""
    return (c(lon) + 180.0) / 360.0 * span(z)


def lat_to_y(lat, z) -> Column:
    """Fractional tile row of a latitude."""
    return (1.0 - F.asinh(F.tan(F.radians(c(lat)))) / F.lit(math.pi)) / 2.0 * span(z)


def x_to_lon(x, z) -> Column:
    return c(x) / span(z) * 360.0 - 180.0


def y_to_lat(y, z) -> Column:
    return F.degrees(F.atan(F.sinh(F.lit(math.pi) * (1.0 - 2.0 * c(y) / span(z)))))


def _index(value: Column, z) -> Column:
    """Whole tile index inside 0..2^z-1."""
    return F.least(F.greatest(F.floor(value), F.lit(0)).cast("bigint"), span(z).cast("bigint") - 1)


def tile_x(lon, z) -> Column:
    return _index(lon_to_x(lon, z), z)


def tile_y(lat, z) -> Column:
    clamped = F.greatest(F.lit(-K.MAX_LATITUDE), F.least(F.lit(K.MAX_LATITUDE), c(lat)))
    return _index(lat_to_y(clamped, z), z)


def tile_for_point(lat, lon, z) -> Column:
    """Tile holding a point; the latitude is clamped to the Mercator limit."""
    return F.struct(tile_x(lon, z).alias("x"), tile_y(lat, z).alias("y"))


def tile_box(z, x, y) -> Column:
    """Bounding box of a tile."""
    x, y = c(x).cast("double"), c(y).cast("double")
    return F.struct(
        x_to_lon(x, z).alias("west"),
        y_to_lat(y + 1.0, z).alias("south"),
        x_to_lon(x + 1.0, z).alias("east"),
        y_to_lat(y, z).alias("north"),
    )


def tile_centre(z, x, y) -> Column:
    """Centre of a tile in the projected sense (row + 0.5), not the mean of its latitudes."""
    return F.struct(
        y_to_lat(c(y).cast("double") + 0.5, z).alias("lat"),
        x_to_lon(c(x).cast("double") + 0.5, z).alias("lon"),
    )


def tile_code(z, x, y, max_zoom: int = K.MAX_EVENT_ZOOM) -> Column:
    """Null for a valid tile, else the code of the first broken rule."""
    z, x, y = c(z).cast("double"), c(x).cast("double"), c(y).cast("double")

    def whole(v):
        return F.coalesce(v == F.floor(v), F.lit(False))

    bad_zoom = ~(whole(z) & F.coalesce((z >= 0) & (z <= max_zoom), F.lit(False)))
    n = F.pow(F.lit(2.0), F.least(F.greatest(z, F.lit(0.0)), F.lit(float(max_zoom))))
    inside = whole(x) & whole(y) & F.coalesce(
        (x >= 0) & (y >= 0) & (x < n) & (y < n), F.lit(False)
    )
    return first_code((bad_zoom, "TILE_ZOOM_RANGE"), (~inside, "TILE_XY_RANGE"))


def tile_range(west, south, east, north, z) -> Column:
    """Index rectangle (x0, x1, y0, y1) of the tiles a box touches."""
    return F.struct(
        tile_x(west, z).alias("x0"),
        tile_x(east, z).alias("x1"),
        tile_y(north, z).alias("y0"),
        tile_y(south, z).alias("y1"),
    )


def count_tiles(west, south, east, north, z) -> Column:
    """Number of tiles covering a box, by arithmetic only."""
    return (F.abs(tile_x(east, z) - tile_x(west, z)) + 1) * (
        F.abs(tile_y(south, z) - tile_y(north, z)) + 1
    )


def metres_per_pixel(zoom, latitude, tile_px: int = K.TILE_PX) -> Column:
    return K.EARTH_CIRCUMFERENCE_M * F.cos(F.radians(c(latitude))) / (span(zoom) * float(tile_px))


def native_zoom(resolution_m, latitude, tile_px: int = K.TILE_PX) -> Column:
    """Fractional zoom whose pixel equals a posting."""
    return F.log2(
        K.EARTH_CIRCUMFERENCE_M * F.cos(F.radians(c(latitude))) / (tile_px * c(resolution_m))
    )


def zoom_for_resolution(latitude, target_m_per_px) -> Column:
    """Shallowest zoom in 0..23 whose pixel is at most the target; 23 when none is."""
    equator = K.EARTH_CIRCUMFERENCE_M * F.cos(F.radians(c(latitude)))
    pair = F.struct(equator.alias("m"), c(target_m_per_px).alias("t"))

    def shallowest(s):
        zooms = F.sequence(F.lit(0), F.lit(23))
        fine = F.filter(zooms, lambda z: s["m"] / (F.pow(F.lit(2.0), z) * float(K.TILE_PX)) <= s["t"])
        return F.coalesce(F.array_min(fine), F.lit(23))

    return let(pair, shallowest)


def mesh_zoom(west, east, target_px=K.MESH_GRID_N, tile_px=K.TILE_PX, min_zoom=8, max_zoom=13):
    """Shallowest zoom giving ``target_px`` samples across the box, inside the source's range."""
    need = c(target_px) * 360.0 / (c(tile_px) * (c(east) - c(west)))
    row = F.struct(need.alias("need"), c(min_zoom).alias("lo"), c(max_zoom).alias("hi"))

    def shallowest(s):
        enough = F.filter(F.sequence(s["lo"], s["hi"]), lambda z: F.pow(F.lit(2.0), z) >= s["need"])
        return F.coalesce(F.array_min(enough), s["hi"])

    return let(row, shallowest)


def budget_zoom(west, south, east, north, zoom, min_zoom: int = 8, budget: int = K.MESH_TILE_BUDGET) -> Column:
    """Deepest zoom from ``zoom`` down to ``min_zoom`` whose tile count fits the budget.

    The edges are projected once; each zoom then costs a few multiplications.
    """
    def row_of(lat):
        clamped = F.greatest(F.lit(-K.MAX_LATITUDE), F.least(F.lit(K.MAX_LATITUDE), c(lat)))
        return lat_to_y(clamped, 0)

    edges = F.struct(
        lon_to_x(west, 0).alias("x0"), lon_to_x(east, 0).alias("x1"), row_of(north).alias("y0"),
        row_of(south).alias("y1"), c(zoom).cast("int").alias("z"),
    )

    def deepest(s):
        def fits(z):
            n = F.pow(F.lit(2.0), z)
            at = lambda v: F.least(F.greatest(F.floor(v * n), F.lit(0)), n - 1)
            return (at(s["x1"]) - at(s["x0"]) + 1) * (at(s["y1"]) - at(s["y0"]) + 1) <= budget

        zooms = F.sequence(F.lit(min_zoom), F.greatest(F.lit(min_zoom), s["z"]))
        return F.coalesce(F.array_max(F.filter(zooms, fits)), F.lit(min_zoom))

    return let(edges, deepest)


def elevation_from_rgb(red, green, blue) -> Column:
    return c(red) * 256.0 + c(green) + c(blue) / 256.0 - 32768.0


def sphere_area_km2(west, south, east, north) -> Column:
    """Area of a lon/lat rectangle on the sphere."""
    band = F.sin(F.radians(c(north))) - F.sin(F.radians(c(south)))
    return K.EARTH_RADIUS_KM**2 * F.radians(c(east) - c(west)) * band


def flat_area_km2(west, south, east, north) -> Column:
    """Area of a small box with fixed kilometres per degree."""
    mid = F.radians((c(south) + c(north)) / 2.0)
    width = (c(east) - c(west)) * K.KM_PER_DEGREE_LON * F.cos(mid)
    return width * (c(north) - c(south)) * K.KM_PER_DEGREE_LAT


def tile_area_km2(z, latitude) -> Column:
    width = K.EARTH_CIRCUMFERENCE_KM * F.cos(F.radians(c(latitude))) / span(z)
    return width * width


def dem_bytes_per_tile(z) -> Column:
    return K.DEM_TILE_BYTES_Z13 * F.pow(F.lit(K.ZOOM_TOTAL_SCALE / 4), c(z).cast("double") - 13.0)


def dem_bytes_per_km2(z) -> Column:
    width = K.EARTH_CIRCUMFERENCE_KM * math.cos(math.radians(K.DEM_ANCHOR_LAT)) / 2**13
    anchor = K.DEM_TILE_BYTES_Z13 / (width * width)
    return anchor * F.pow(F.lit(K.ZOOM_TOTAL_SCALE), c(z).cast("double") - 13.0)


def box_size_m(west, south, east, north) -> Column:
    """Width and depth of a box in metres at its middle latitude."""
    mid = F.radians((c(south) + c(north)) / 2.0)
    return F.struct(
        ((c(east) - c(west)) * K.METRES_PER_DEGREE * F.cos(mid)).alias("width_m"),
        ((c(north) - c(south)) * K.METRES_PER_DEGREE).alias("depth_m"),
    )


def local_x(lon, west, south, east, north) -> Column:
    """Metres east of the box centre."""
    width = box_size_m(west, south, east, north)["width_m"]
    return (c(lon) - c(west)) / (c(east) - c(west)) * width - width / 2.0


def local_z(lat, west, south, east, north) -> Column:
    """Metres south of the box centre."""
    depth = box_size_m(west, south, east, north)["depth_m"]
    return (c(north) - c(lat)) / (c(north) - c(south)) * depth - depth / 2.0


def tile_key(z, x, y) -> Column:
    return F.concat_ws("/", long(z), long(x), long(y))


# --- positions on the 4096 grid of a feature tile --------------------------------


def half_up(value) -> Column:
    """Nearest whole number, halves towards plus infinity."""
    return F.floor(c(value) + 0.5)


def quantise(lon, lat, box) -> Column:
    """Grid position of a point in a tile, clamped to the tile."""
    top = float(K.TILE_EXTENT)
    qx = half_up((c(lon) - box["west"]) / (box["east"] - box["west"]) * top)
    qy = half_up((box["north"] - c(lat)) / (box["north"] - box["south"]) * top)

    def clamp(v):
        return F.greatest(F.lit(0), F.least(F.lit(K.TILE_EXTENT), v)).cast("bigint")

    return F.struct(clamp(qx).alias("qx"), clamp(qy).alias("qy"))


def restore(qx, qy, box) -> Column:
    """Point at a grid position of a tile."""
    top = float(K.TILE_EXTENT)
    return F.struct(
        (box["west"] + c(qx) / top * (box["east"] - box["west"])).alias("lon"),
        (box["north"] - c(qy) / top * (box["north"] - box["south"])).alias("lat"),
    )


def zigzag(delta) -> Column:
    """Unsigned 32-bit form of a signed delta, small magnitudes first."""
    d = long(delta)
    return F.when(d >= 0, d * 2).otherwise(-d * 2 - 1)


def varint_length(value) -> Column:
    """Bytes a value takes in base-128 form."""
    v = long(value)
    return (
        F.when(v < 2**7, 1).when(v < 2**14, 2).when(v < 2**21, 3).when(v < 2**28, 4).otherwise(5)
    ).cast("bigint")
