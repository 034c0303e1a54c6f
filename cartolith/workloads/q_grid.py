"""Tile and cell arithmetic, covers, boxes and spatial joins."""

from __future__ import annotations

import math

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cartolith import constants as K
from cartolith.functions import boxes, geohash, numbers, tiles
from cartolith.operators import generate, overlaps, spatial
from cartolith.workloads import duck
from cartolith.workloads.registry import query
from cartolith.workloads.views import tile_x, tile_y

r6 = lambda v: F.round(v, 6)
BOX = boxes.EDGES


# --- projections on points and tiles -----------------------------------------------


@query("b01_tile_for_point", f"""
SELECT event_id, {tile_x('lon', '14')} AS x, {tile_y('lat', '14')} AS y FROM v_points""", "v_points")
def _(v):
    t = tiles.tile_for_point("lat", "lon", 14)
    return v.v_points.select("event_id", t["x"].alias("x"), t["y"].alias("y"))


@query("b02_fractional_tiles", """
SELECT event_id, round((lon + 180e0) / 360e0 * 4096e0, 6) AS fx,
       round((1e0 - asinh(tan(radians(lat))) / pi()) / 2e0 * 4096e0, 6) AS fy,
       round(lon, 6) AS lon_back, round(lat, 6) AS lat_back
FROM v_points""", "v_points")
def _(v):
    fx, fy = tiles.lon_to_x("lon", 12), tiles.lat_to_y("lat", 12)
    return v.v_points.select(
        "event_id", r6(fx).alias("fx"), r6(fy).alias("fy"),
        r6(tiles.x_to_lon(fx, 12)).alias("lon_back"), r6(tiles.y_to_lat(fy, 12)).alias("lat_back"),
    )


def _sql_lat(y: str) -> str:
    return f"degrees(atan(sinh(pi() * (1e0 - 2e0 * ({y}) / pow(2e0, z)))))"


@query("b03_tile_box", f"""
SELECT event_id, round(x / pow(2e0, z) * 360e0 - 180e0, 6) AS west, round({_sql_lat('y + 1')}, 6) AS south,
       round((x + 1) / pow(2e0, z) * 360e0 - 180e0, 6) AS east, round({_sql_lat('y')}, 6) AS north
FROM v_tiles""", "v_tiles")
def _(v):
    b = tiles.tile_box("z", "x", "y")
    return v.v_tiles.select("event_id", *[r6(b[n]).alias(n) for n in BOX])


@query("b04_tile_centre", f"""
SELECT event_id, round({_sql_lat('y + 0.5e0')}, 6) AS lat, round((x + 0.5e0) / pow(2e0, z) * 360e0 - 180e0, 6) AS lon
FROM v_tiles""", "v_tiles")
def _(v):
    m = tiles.tile_centre("z", "x", "y")
    return v.v_tiles.select("event_id", r6(m["lat"]).alias("lat"), r6(m["lon"]).alias("lon"))


@query("b05_tile_code", """
SELECT event_id, CASE WHEN zz < 0 OR zz > 22 THEN 'TILE_ZOOM_RANGE'
       WHEN x >= pow(2, zz) OR yy >= pow(2, zz) OR yy < 0 THEN 'TILE_XY_RANGE' END AS code
FROM (SELECT event_id, z * 2 - 1 - event_id % 7 AS zz, x, y - event_id % 3 * 900 AS yy FROM v_tiles) t""", "v_tiles")
def _(v):
    t = v.v_tiles.select(
        "event_id", (F.col("z") * 2 - 1 - F.col("event_id") % 7).alias("z"), "x",
        (F.col("y") - F.col("event_id") % 3 * 900).alias("y"),
    )
    return t.select("event_id", tiles.tile_code("z", "x", "y").alias("code"))


_COUNT = (
    f"((abs({tile_x('east', '13')} - {tile_x('west', '13')}) + 1) * "
    f"(abs({tile_y('south', '13')} - {tile_y('north', '13')}) + 1))"
)


@query("b06_count_tiles", f"SELECT id, CAST({_COUNT} AS BIGINT) AS n FROM v_boxes", "v_boxes")
def _(v):
    return v.v_boxes.select("id", tiles.count_tiles(*BOX, 13).alias("n"))


@query("b07_geohash", f"""
SELECT event_id, {duck.gh('lat', 'lon', 6)} AS g6, {duck.gh('lat', 'lon', 11)} AS g11, {duck.gh('lat', 'lon', 12)} AS g12
FROM v_points""", "v_points")
def _(v):
    return v.v_points.select(
        "event_id", *[geohash.encode("lat", "lon", p).alias(f"g{p}") for p in (6, 11, 12)]
    )


@query("b08_geohash_prefixes", f"""
SELECT event_id, array_to_string(list_transform(range(1, 9), lambda n: substr(g, 1, CAST(n AS INT))), ' ') AS prefixes,
       array_to_string(list_transform(range(1, 7), lambda n: substr(g, 1, CAST(n AS INT))), ' ') AS ladder
FROM (SELECT event_id, {duck.gh('lat', 'lon', 8)} AS g FROM v_points) p""", "v_points")
def _(v):
    g = v.v_points.select("event_id", "lat", "lon", geohash.encode("lat", "lon", 8).alias("g"))
    return g.select(
        "event_id", F.array_join(geohash.prefixes("g"), " ").alias("prefixes"),
        F.array_join(geohash.social_ladder("lat", "lon"), " ").alias("ladder"),
    )


@query("b09_geohash_decode", f"""
SELECT event_id, CASE WHEN event_id % 5 > 0 THEN
         round(({duck.lat_iy('lat', 7)} + 0.5e0) * (180e0 / {2**17}) - 90e0, 9) END AS lat,
       CASE WHEN event_id % 5 > 0 THEN round(({duck.lon_ix('lon', 7)} + 0.5e0) * (360e0 / {2**18}) - 180e0, 9) END AS lon
FROM v_points""", "v_points")
def _(v):
    h = geohash.encode("lat", "lon", 7)
    h = F.when(F.col("event_id") % 5 == 0, F.concat(F.substring(h, 1, 4), F.lit("a"))).otherwise(h)
    at = geohash.decode("h")
    return v.v_points.select("event_id", h.alias("h")).select(
        "event_id", F.round(at["lat"], 9).alias("lat"), F.round(at["lon"], 9).alias("lon")
    )


@query("b10_grid_size", """
SELECT p AS precision_no, CAST(pow(2, (5 * p + 1) // 2) AS BIGINT) AS lon_cells, CAST(pow(2, 5 * p // 2) AS BIGINT) AS lat_cells,
       CAST(count(*) AS BIGINT) AS n
FROM (SELECT event_id % 12 + 1 AS p FROM events) e GROUP BY p""")
def _(v):
    g = geohash.grid_size("precision_no")
    rows = v.events.groupBy((F.col("event_id") % 12 + 1).alias("precision_no")).agg(F.count("*").alias("n"))
    return rows.select("precision_no", g["lon_cells"].alias("lon_cells"), g["lat_cells"].alias("lat_cells"), "n")


@query("b11_cell_hash", f"""
SELECT id, {duck.gh_cell('id % 1024', '(id * 7) % 1024', 4)} AS cell4, {duck.gh_cell('id % 8192', '(id * 13) % 4096', 5)} AS cell5
FROM v_boxes""", "v_boxes")
def _(v):
    i = F.col("id")
    return v.v_boxes.select(
        "id", geohash.cell_hash(i % 1024, (i * 7) % 1024, 4).alias("cell4"),
        geohash.cell_hash(i % 8192, (i * 13) % 4096, 5).alias("cell5"),
    )


def _sql_cover_count(p: int) -> str:
    return (
        f"CAST(({duck.lon_ix('east', p)} - {duck.lon_ix('west', p)} + 1) * "
        f"({duck.lat_iy('north', p)} - {duck.lat_iy('south', p)} + 1) AS BIGINT)"
    )


@query("b12_cover_count", f"SELECT id, {_sql_cover_count(4)} AS n4, {_sql_cover_count(6)} AS n6 FROM v_boxes", "v_boxes")
def _(v):
    return v.v_boxes.select(
        "id", geohash.cover_count(*BOX, 4).alias("n4"), geohash.cover_count(*BOX, 6).alias("n6")
    )


@query("b13_centre_hash", f"""
SELECT id, round((south + north) / 2e0, 6) AS lat, round((west + east) / 2e0, 6) AS lon,
       {duck.gh('((south + north) / 2e0)', '((west + east) / 2e0)', 12)} AS geohash
FROM v_boxes""", "v_boxes")
def _(v):
    m = boxes.centre(*BOX)
    return v.v_boxes.select(
        "id", r6(m["lat"]).alias("lat"), r6(m["lon"]).alias("lon"), boxes.centre_hash(*BOX).alias("geohash")
    )


# Boxes with planted defects, the same text for both engines.
_BROKEN = """SELECT id,
    CASE id % 9 WHEN 1 THEN west + 300e0 WHEN 2 THEN east + 1e0 WHEN 3 THEN CAST('NaN' AS DOUBLE) ELSE west END AS west,
    CASE id % 9 WHEN 4 THEN -95e0 WHEN 5 THEN north + 1e0 ELSE south END AS south,
    CASE id % 9 WHEN 6 THEN west + 1e-7 WHEN 7 THEN west ELSE east END AS east,
    CASE id % 9 WHEN 8 THEN south ELSE north END AS north FROM {source}"""
_VIEWPORT = """CASE WHEN isnan(west) OR isnan(south) OR isnan(east) OR isnan(north) THEN 'BBOX_NOT_FINITE'
    WHEN west < -180 OR west > 180 OR east < -180 OR east > 180 THEN 'BBOX_OUT_OF_RANGE'
    WHEN south < -90 OR south > 90 OR north < -90 OR north > 90 THEN 'BBOX_OUT_OF_RANGE'
    WHEN west > east THEN 'BBOX_ANTIMERIDIAN' WHEN south > north THEN 'BBOX_INVERTED' """


def _broken(v):
    return v.spark.sql(_BROKEN.format(source="{b}"), b=v.v_boxes)


@query("b14_viewport_code", f"SELECT id, {_VIEWPORT} END AS code FROM ({_BROKEN.format(source='v_boxes')}) b", "v_boxes")
def _(v):
    return _broken(v).select("id", boxes.viewport_code(*BOX).alias("code"))


@query("b15_extent_code", f"""
SELECT id, {_VIEWPORT} WHEN round_even(west, 6) >= round_even(east, 6) OR round_even(south, 6) >= round_even(north, 6)
       THEN 'BBOX_DEGENERATE' END AS code FROM ({_BROKEN.format(source='v_boxes')}) b""", "v_boxes")
def _(v):
    return _broken(v).select("id", boxes.extent_code(*BOX).alias("code"))


@query("b16_selection_code", f"""
SELECT id, CASE WHEN isnan(west) OR isnan(south) OR isnan(east) OR isnan(north) THEN 'NON_FINITE'
    WHEN west < -180 OR west > 180 OR east < -180 OR east > 180 OR south < -90 OR south > 90 OR north < -90 OR north > 90 THEN 'RANGE'
    WHEN west > east THEN 'ANTIMERIDIAN_AMBIGUOUS' WHEN west = east OR south >= north THEN 'ORDER'
    WHEN {duck.sphere_area()} > 900 THEN 'AREA_LIMIT' END AS code FROM ({_BROKEN.format(source='v_boxes')}) b""", "v_boxes")
def _(v):
    return _broken(v).select("id", boxes.selection_code(*BOX, 900.0).alias("code"))


@query("b17_canonical_coordinate", """
WITH d AS (SELECT id, CAST(CAST((west + (id % 64) / 128e0) / (1 + id % 3) AS VARCHAR) AS DECIMAL(30, 20)) * 1000000 AS m FROM v_boxes),
f AS (SELECT id, m, CAST(floor(m) AS BIGINT) AS lo FROM d),
k AS (SELECT id, lo + CASE WHEN m - lo > 0.5 OR (m - lo = 0.5 AND lo % 2 <> 0) THEN 1 ELSE 0 END AS micro FROM f)
SELECT id, CASE WHEN micro = 0 THEN '0' ELSE rtrim(rtrim(concat(CASE WHEN micro < 0 THEN '-' ELSE '' END, CAST(abs(micro) // 1000000 AS VARCHAR), '.',
       lpad(CAST(abs(micro) % 1000000 AS VARCHAR), 6, '0')), '0'), '.') END AS text FROM k""", "v_boxes")
def _(v):
    x = (F.col("west") + (F.col("id") % 64) / F.lit(128.0)) / (1 + F.col("id") % 3)
    return v.v_boxes.select("id", numbers.canonical_coordinate(x).alias("text"))


@query("b20_sphere_area", f"SELECT id, round({duck.sphere_area()}, 6) AS km2 FROM v_boxes", "v_boxes")
def _(v):
    return v.v_boxes.select("id", r6(tiles.sphere_area_km2(*BOX)).alias("km2"))


@query("b21_flat_area", f"SELECT id, round({duck.flat_area()}, 6) AS km2 FROM v_boxes", "v_boxes")
def _(v):
    return v.v_boxes.select("id", r6(tiles.flat_area_km2(*BOX)).alias("km2"))


@query("b22_tile_area", """
SELECT event_id, round(pow(40075.017e0 * cos(radians(lat)) / pow(2e0, z), 2), 6) AS km2 FROM v_tiles""", "v_tiles")
def _(v):
    return v.v_tiles.select("event_id", r6(tiles.tile_area_km2("z", "lat")).alias("km2"))


@query("b23_box_metres", """
SELECT id, round(w, 4) AS width_m, round(d, 4) AS depth_m, round(0.25e0 * w - w / 2e0, 4) AS x_m, round(0.75e0 * d - d / 2e0, 4) AS z_m
FROM (SELECT id, (east - west) * 111320e0 * cos(radians((south + north) / 2e0)) AS w, (north - south) * 111320e0 AS d FROM v_boxes) b""", "v_boxes")
def _(v):
    size = tiles.box_size_m(*BOX)
    lon = F.col("west") + (F.col("east") - F.col("west")) * 0.25
    lat = F.col("south") + (F.col("north") - F.col("south")) * 0.25
    return v.v_boxes.select(
        "id", F.round(size["width_m"], 4).alias("width_m"), F.round(size["depth_m"], 4).alias("depth_m"),
        F.round(tiles.local_x(lon, *BOX), 4).alias("x_m"), F.round(tiles.local_z(lat, *BOX), 4).alias("z_m"),
    )


@query("b24_ground_resolution", """
SELECT event_id, round(40075016.686e0 * cos(radians(lat)) / (pow(2e0, z) * 256e0), 6) AS m_per_px,
       round(log2(40075016.686e0 * cos(radians(lat)) / (512e0 * 0.5e0)), 6) AS native_zoom
FROM v_tiles""", "v_tiles")
def _(v):
    return v.v_tiles.select(
        "event_id", r6(tiles.metres_per_pixel("z", "lat")).alias("m_per_px"),
        r6(tiles.native_zoom(F.lit(0.5), "lat", 512)).alias("native_zoom"),
    )


@query("b25_zoom_for_resolution", """
SELECT event_id, CAST(coalesce(list_min(list_filter(range(24), lambda z:
       40075016.686e0 * cos(radians(lat)) / (pow(2e0, z) * 256e0) <= 0.05e0 * (1 + event_id % 40))), 23) AS BIGINT) AS z
FROM v_points""", "v_points")
def _(v):
    target = F.lit(0.05) * (1 + F.col("event_id") % 40)
    return v.v_points.select("event_id", tiles.zoom_for_resolution("lat", target).cast("bigint").alias("z"))


@query("b26_mesh_zoom", """
SELECT id, CAST(least(13, greatest(8, ceil(log2(192e0 / (256e0 * ((east - west) / 360e0)))))) AS BIGINT) AS z FROM v_boxes""", "v_boxes")
def _(v):
    return v.v_boxes.select("id", tiles.mesh_zoom("west", "east").cast("bigint").alias("z"))


def _sql_span(z: str) -> str:
    return (
        f"((abs({tile_x('east', z)} - {tile_x('west', z)}) + 1) * "
        f"(abs({tile_y('south', z)} - {tile_y('north', z)}) + 1))"
    )


@query("b27_budget_zoom", f"""
SELECT id, CAST(coalesce(max(z), 8) AS BIGINT) AS z FROM v_boxes LEFT JOIN (SELECT unnest(range(8, 14)) AS z) t
ON {_sql_span('z')} <= 16 GROUP BY id""", "v_boxes")
def _(v):
    return v.v_boxes.select("id", tiles.budget_zoom(*BOX, 13).cast("bigint").alias("z"))


@query("b28_elevation_from_rgb", """
SELECT event_id, event_id % 256 * 256e0 + event_id // 7 % 256 + event_id // 11 % 256 / 256e0 - 32768e0 AS h FROM events""")
def _(v):
    e = F.col("event_id")
    r, g, b = e % 256, F.floor(e / 7) % 256, F.floor(e / 11) % 256
    return v.events.select("event_id", tiles.elevation_from_rgb(r, g, b).alias("h"))


@query("b54_dem_bytes", f"""
SELECT event_id, round(43014e0 * pow(0.965e0, z - 13), 4) AS per_tile,
       round(43014e0 / pow(40075.017e0 * cos(radians(32.75e0)) / 8192e0, 2) * pow(3.86e0, z - 13), 4) AS per_km2
FROM v_tiles""", "v_tiles")
def _(v):
    return v.v_tiles.select(
        "event_id", F.round(tiles.dem_bytes_per_tile("z"), 4).alias("per_tile"),
        F.round(tiles.dem_bytes_per_km2("z"), 4).alias("per_km2"),
    )


# --- generators and covers -------------------------------------------------------------


@query("l01_box_tiles", f"""
SELECT id, z, x, y FROM (
  SELECT id, z, x0 + unnest(range(CAST(x1 - x0 + 1 AS BIGINT))) AS x, y0, y1 FROM (
    SELECT id, z, {tile_x('west', 'z')} AS x0, {tile_x('east', 'z')} AS x1, {tile_y('north', 'z')} AS y0, {tile_y('south', 'z')} AS y1
    FROM v_boxes, (SELECT unnest([CAST(9 AS BIGINT), 11]) AS z) zs) a) b,
  LATERAL (SELECT y0 + unnest(range(CAST(y1 - y0 + 1 AS BIGINT))) AS y) c""", "v_boxes")
def _(v):
    rows = generate.with_literals(v.v_boxes.select("id", *BOX), "z", (9, 11))
    return generate.box_tiles(rows.withColumn("z", F.col("z").cast("bigint"))).select("id", "z", "x", "y")


_CELLS = f"""
SELECT view_id, ix, iy, {duck.gh_cell('ix', 'iy', 4)} AS cell FROM (
  SELECT view_id, ix0 + unnest(range(CAST(ix1 - ix0 + 1 AS BIGINT))) AS ix, iy0, iy1 FROM (
    SELECT view_id, {duck.lon_ix('west', 4)} AS ix0, {duck.lon_ix('east', 4)} AS ix1,
           {duck.lat_iy('south', 4)} AS iy0, {duck.lat_iy('north', 4)} AS iy1 FROM v_views) a) b,
  LATERAL (SELECT iy0 + unnest(range(CAST(iy1 - iy0 + 1 AS BIGINT))) AS iy) c"""


@query("l02_box_cells", _CELLS, "v_views")
def _(v):
    return generate.box_cells(v.v_views, 4).select("view_id", "ix", "iy", "cell")


@query("g06_cover_order", f"""
SELECT view_id, string_agg(cell, ' ' ORDER BY ix, iy) AS cells FROM ({_CELLS}) c GROUP BY view_id""", "v_views")
def _(v):
    return v.v_views.select("view_id", F.array_join(geohash.cover_array(*BOX, 4), " ").alias("cells"))


@query("l03_grid_points", """
SELECT view_id, r AS row_no, c AS col_no, round(north - (north - south) * r / 8e0, 9) AS lat, round(west + (east - west) * c / 8e0, 9) AS lon
FROM v_views, (SELECT unnest(range(9)) AS r) a, (SELECT unnest(range(9)) AS c) b""", "v_views")
def _(v):
    p = generate.grid_points(v.v_views, 9)
    return p.select("view_id", "row_no", "col_no", F.round("lat", 9).alias("lat"), F.round("lon", 9).alias("lon"))


@query("l04_triangles", """
SELECT view_id, r AS row_no, c AS col_no, half, CASE half WHEN 0 THEN a ELSE a + 1 END AS a, a + 5 AS b,
       CASE half WHEN 0 THEN a + 1 ELSE a + 6 END AS c
FROM (SELECT view_id, r, c, half, r * 5 + c AS a FROM v_views, (SELECT unnest(range(4)) AS r) x, (SELECT unnest(range(4)) AS c) y,
      (SELECT unnest([0, 1]) AS half) h) t""", "v_views")
def _(v):
    return generate.triangles(v.v_views, 5, "view_id")


# --- predicates and joins ----------------------------------------------------------------

_VIEW = (10.0, 45.0, 14.0, 49.0)


@query("c01_open_overlap", "SELECT id FROM v_boxes WHERE west < 14 AND east > 10 AND south < 49 AND north > 45", "v_boxes")
def _(v):
    return v.v_boxes.where(boxes.overlaps(BOX, _VIEW)).select("id")


@query("c02_contained", "SELECT id FROM v_boxes WHERE west >= 10 AND east <= 14 AND south >= 45 AND north <= 49", "v_boxes")
def _(v):
    return v.v_boxes.where(boxes.contains_box(_VIEW, BOX)).select("id")


@query("c03_point_in_box", """
SELECT event_id FROM v_points WHERE event_id % 9 > 0 AND lon BETWEEN 10 AND 14 AND lat BETWEEN 45 AND 49""", "v_points")
def _(v):
    lon = F.when(F.col("event_id") % 9 > 0, F.col("lon"))
    return v.v_points.where(boxes.contains_point(_VIEW, lon, "lat")).select("event_id")


_SEGMENTS = """
segs AS (SELECT view_id, greatest(south, -90e0) AS south, least(north, 90e0) AS north,
    CAST(w AS DOUBLE) AS west, CAST(w + width AS DOUBLE) AS east FROM (
    SELECT *, ((west + 180e0) % 360e0 + 360e0) % 360e0 - 180e0 AS w, east - west AS width FROM v_wide_views) a),
parts AS (SELECT view_id, 0 AS part, west, south, least(east, 180e0) AS east, north FROM segs
    UNION ALL SELECT view_id, 1, -180e0, south, east - 360e0, north FROM segs WHERE east > 180)"""


@query("h02_view_segments", f"WITH {_SEGMENTS} SELECT view_id, CAST(part AS INT) AS part, west, south, east, north FROM parts", "v_wide_views")
def _(v):
    rows = v.v_wide_views.select("view_id", F.posexplode(boxes.view_segments(*BOX)).alias("part", "b"))
    return rows.select("view_id", "part", "b.*")


@query("c04_points_in_segments", f"""
WITH {_SEGMENTS}, pts AS (SELECT event_id, CASE WHEN lon < 0 THEN lon * 7e0 ELSE lon * 5.5e0 END AS plon, lat AS plat FROM v_points)
SELECT view_id, CAST(count(*) AS BIGINT) AS n FROM parts JOIN pts
ON west <= plon AND plon <= east AND south <= plat AND plat <= north GROUP BY view_id""", "v_wide_views v_points")
def _(v):
    plon = F.when(F.col("lon") < 0, F.col("lon") * 7.0).otherwise(F.col("lon") * 5.5)
    pts = v.v_points.select("event_id", plon.alias("plon"), F.col("lat").alias("plat"))
    segs = v.v_wide_views.select("view_id", F.explode(boxes.view_segments(*BOX)).alias("b")).select("view_id", "b.*")
    hits = spatial.point_box_join(pts, segs, BOX, "plon", "plat")
    return hits.groupBy("view_id").agg(F.count("*").alias("n"))


@query("c05_tile_lookup", "SELECT event_id, lon, lat FROM v_tiles WHERE z = 10 AND x = 440 AND y = 409", "v_tiles")
def _(v):
    return v.v_tiles.where("z = 10 AND x = 440 AND y = 409").select("event_id", "lon", "lat")


_PAIRS = """SELECT w.view_id, b.id, b.uploaded_at, b.sha256 FROM v_views w JOIN v_boxes b
ON b.west < w.east AND b.east > w.west AND b.south < w.north AND b.north > w.south"""


def _view_pairs(v):
    views = v.v_views.select("view_id", *[F.col(n).alias(f"v_{n}") for n in BOX])
    return spatial.box_join(v.v_boxes, views, BOX, tuple(f"v_{n}" for n in BOX))


@query("d02_views_over_footprints", f"SELECT view_id, id, uploaded_at FROM ({_PAIRS}) p", "v_views v_boxes")
def _(v):
    return _view_pairs(v).select("view_id", "id", "uploaded_at")


@query("d02_footprint_self_overlap", """
SELECT a.id AS id_a, count(*) AS n, min(b.id) AS first_id FROM v_boxes a JOIN v_boxes b
ON a.id < b.id AND a.west < b.east AND a.east > b.west AND a.south < b.north AND a.north > b.south GROUP BY a.id""", "v_boxes")
def _(v):
    """Later footprints that overlap each stored footprint: both sides large, many sizes; pairs are only counted."""
    counted = overlaps.later_overlaps(v.v_boxes, "id", BOX)
    return counted.select(F.col("id").alias("id_a"), "n", F.col("first").alias("first_id"))


@query("g03_newest_per_view", f"""
SELECT view_id, id, uploaded_at, CAST(rk AS INT) AS rk FROM (SELECT *, row_number() OVER (PARTITION BY view_id ORDER BY uploaded_at DESC, sha256) AS rk
FROM ({_PAIRS}) p) q WHERE rk <= 5""", "v_views v_boxes")
def _(v):
    newest = W.partitionBy("view_id").orderBy(F.col("uploaded_at").desc(), "sha256")
    ranked = _view_pairs(v).withColumn("rk", F.row_number().over(newest))
    return ranked.where("rk <= 5").select("view_id", "id", "uploaded_at", "rk")


@query("g03_newest_in_box", """
SELECT id, uploaded_at FROM v_boxes WHERE west < 14 AND east > 10 AND south < 49 AND north > 45
ORDER BY uploaded_at DESC, sha256 LIMIT 100""", "v_boxes")
def _(v):
    hits = v.v_boxes.where(boxes.overlaps(BOX, _VIEW))
    return hits.orderBy(F.col("uploaded_at").desc(), "sha256").limit(100).select("id", "uploaded_at")


_IN_POLY = """SELECT p.event_id, q.poly_id FROM v_points p JOIN (
  SELECT poly_id, i, ring[i].lon AS xi, ring[i].lat AS yi, ring[CASE WHEN i = 1 THEN 6 ELSE i - 1 END].lon AS xj,
         ring[CASE WHEN i = 1 THEN 6 ELSE i - 1 END].lat AS yj
  FROM v_polys, (SELECT unnest(range(1, 7)) AS i) s) q
ON (yi > lat) <> (yj > lat) AND lon < (xj - xi) * (lat - yi) / (yj - yi) + xi
GROUP BY p.event_id, q.poly_id HAVING count(*) % 2 = 1"""


def _in_polys(v):
    shapes = v.v_polys.select("poly_id", F.array("ring").alias("rings"))
    return spatial.points_in_polygons(v.v_points.select("event_id", "lon", "lat"), shapes)


@query("d01_point_in_polygon", _IN_POLY, "v_points v_polys")
def _(v):
    return _in_polys(v).select("event_id", "poly_id")


@query("d16_land_points", f"SELECT DISTINCT event_id FROM ({_IN_POLY}) h", "v_points v_polys")
def _(v):
    return _in_polys(v).select("event_id").distinct()


@query("l05_globe_dots_on_land", """
WITH rings AS (SELECT poly_id, i, ring[i].lon AS xi, ring[i].lat AS yi, ring[CASE WHEN i = 1 THEN 6 ELSE i - 1 END].lon AS xj,
               ring[CASE WHEN i = 1 THEN 6 ELSE i - 1 END].lat AS yj FROM v_polys, (SELECT unnest(range(1, 7)) AS i) s),
rws AS (SELECT -58e0 + r * 0.3e0 AS lat FROM (SELECT unnest(range(454)) AS r) a),
dots AS (SELECT lat, -180e0 + i * stride AS lon FROM (SELECT lat, stride, unnest(range(CAST(ceil(360e0 / stride) AS BIGINT))) AS i
         FROM (SELECT lat, 0.3e0 / greatest(0.25e0, cos(radians(lat))) AS stride FROM rws) b) c WHERE lat > 33 AND lat < 62),
hits AS (SELECT lon, lat FROM (SELECT lon, lat, poly_id FROM dots JOIN rings ON (yi > lat) <> (yj > lat)
         AND lon < (xj - xi) * (lat - yi) / (yj - yi) + xi GROUP BY lon, lat, poly_id HAVING count(*) % 2 = 1) h GROUP BY lon, lat)
SELECT CAST(floor(lat) AS BIGINT) AS band, CAST(count(*) AS BIGINT) AS n, round(min(lon), 4) AS first_lon FROM hits GROUP BY 1""", "v_polys")
def _(v):
    """Dots of a cosine-compensated grid that fall on land, counted per latitude band."""
    dots = generate.globe_dots(v.spark, step=0.3)
    shapes = v.v_polys.select("poly_id", F.array("ring").alias("rings"))
    on_land = spatial.points_in_polygons(dots, shapes).select("lon", "lat").distinct()
    return on_land.groupBy(F.floor("lat").cast("bigint").alias("band")).agg(
        F.count("*").alias("n"), F.round(F.min("lon"), 4).alias("first_lon")
    )


_REGION_CASE = """CASE WHEN west >= -17.32 AND east <= -16.24 AND south >= 32.35 AND north <= 33.15 THEN 'madeira'
 WHEN west >= 10.38 AND east <= 12.48 AND south >= 46.21 AND north <= 47.10 THEN 'south-tyrol'
 WHEN west >= 16.18 AND east <= 16.58 AND south >= 48.11 AND north <= 48.33 THEN 'vienna' ELSE 'europe' END"""


@query("d03_first_container", f"SELECT id, {_REGION_CASE} AS region FROM v_boxes", "v_boxes")
def _(v):
    return v.v_boxes.select("id", spatial.first_container(K.REGIONS, BOX, "europe").alias("region"))


@query("d05_cell_equi_join", f"""
SELECT c.view_id, p.event_id FROM ({_CELLS}) c JOIN (SELECT event_id, lon, lat, {duck.gh('lat', 'lon', 4)} AS cell FROM v_points) p
ON c.cell = p.cell JOIN v_views w ON w.view_id = c.view_id
WHERE p.lon BETWEEN w.west AND w.east AND p.lat BETWEEN w.south AND w.north""", "v_views v_points")
def _(v):
    tagged = v.v_points.select("event_id", "lon", "lat", geohash.encode("lat", "lon", 4).alias("cell4"))
    coarse = spatial.cover_join(v.v_views, tagged, 4, "cell4")
    return coarse.where(boxes.contains_point(BOX, "lon", "lat")).select("view_id", "event_id")


@query("e30_crowded_cells", f"""
SELECT cell, CAST(count(*) AS BIGINT) AS n FROM (SELECT {duck.gh('lat', 'lon', 1)} AS cell FROM v_points) p
GROUP BY cell HAVING count(*) > 500""", "v_points")
def _(v):
    cells = v.v_points.select(geohash.encode("lat", "lon", 1).alias("cell"))
    return cells.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > K.PAGE_LIMIT)


def _ladder_sql() -> str:
    counts = ", ".join(
        f"sum(({duck.lon_ix('east', p)} - {duck.lon_ix('west', p)} + 1) * ({duck.lat_iy('north', p)} - {duck.lat_iy('south', p)} + 1)) AS n{p}"
        for p in range(1, 7)
    )
    chain = " ".join(f"WHEN n{p} <= 48 THEN {p}" for p in range(6, 1, -1))
    need = " ".join(f"WHEN n{p} <= 48 THEN n{p}" for p in range(6, 1, -1))
    return (
        f"WITH {_SEGMENTS} SELECT view_id, CAST(CASE {chain} ELSE 1 END AS BIGINT) AS precision_no, "
        f"CAST(CASE {need} ELSE n1 END AS BIGINT) AS required, CASE {need} ELSE n1 END <= 48 AS complete, "
        f"CAST(least(48, CASE {need} ELSE n1 END) AS BIGINT) AS kept FROM (SELECT view_id, {counts} FROM parts GROUP BY view_id) c"
    )


@query("g08_ladder_coverage", _ladder_sql(), "v_wide_views")
def _(v):
    from cartolith.operators.feed import ladder_coverage

    rows = ladder_coverage(v.v_wide_views)
    return rows.select(
        "view_id", F.col("precision_no").cast("bigint").alias("precision_no"),
        F.col("required_cells").alias("required"), "complete", F.size("cells").cast("bigint").alias("kept"),
    )


assert math.isclose(K.ZOOM_TOTAL_SCALE / 4, 0.965)
