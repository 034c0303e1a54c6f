"""Map features and feature tiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartolith import constants as K
from cartolith.functions import boxes, gates, osm, tiles
from cartolith.operators import features, raster
from cartolith.sources import feature_tiles
from cartolith.workloads.registry import query
from cartolith.workloads.views import tile_x, tile_y

BOX = (16.1, 48.0, 16.4, 48.3)
_ROADS = ", ".join(f"'{n}'" for n in K.ROAD_CLASSES)


def _case(mapping, expr, default="NULL"):
    rows = " ".join(f"WHEN '{k}' THEN {v!r}" if isinstance(v, str) else f"WHEN '{k}' THEN {v}e0" for k, v in mapping.items())
    return f"CASE {expr} {rows} ELSE {default} END"


_ROAD_SQL = (
    f"CASE WHEN regexp_replace(highway, '_link$', '') IN ({_ROADS}) THEN regexp_replace(highway, '_link$', '') ELSE "
    + _case(K.ROAD_ALIASES, "regexp_replace(highway, '_link$', '')") + " END"
)
_USE = lambda k: _case(K.LANDUSE_TAGS, k)
_NUM = lambda k: f"TRY_CAST(nullif(regexp_extract({k}, '^\\s*([0-9.]+)', 1), '') AS DOUBLE)"
_HEIGHT = f"CASE WHEN {_NUM('height')} > 0 THEN least({_NUM('height')}, 400e0) WHEN {_NUM('levels')} > 0 THEN least({_NUM('levels')} * 3e0, 400e0) ELSE 6e0 END"


@query("b29_building_height", f"SELECT way_id, {_HEIGHT} AS height_m FROM v_ways", "v_ways")
def _(v):
    return v.v_ways.select("way_id", osm.building_height("height", "levels").alias("height_m"))


@query("b30_road_class", f"SELECT way_id, {_ROAD_SQL} AS class FROM v_ways", "v_ways")
def _(v):
    return v.v_ways.select("way_id", osm.road_class("highway").alias("class"))


@query("b31_landuse_class", f"SELECT way_id, coalesce({_USE('landuse')}, {_USE('natural_tag')}, {_USE('leisure')}) AS full_class, coalesce({_USE('landuse')}, {_USE('natural_tag')}) AS tile_class FROM v_ways", "v_ways")
def _(v):
    return v.v_ways.select(
        "way_id", osm.landuse_class("landuse", "natural_tag", "leisure").alias("full_class"),
        osm.landuse_class("landuse", "natural_tag").alias("tile_class"),
    )


@query("b32_waterway_and_widths", f"""
SELECT way_id, CASE WHEN waterway IN ('river', 'canal', 'stream', 'drain', 'ditch') THEN waterway END AS waterway_class, {_case(K.WATERWAY_WIDTH_M, 'waterway')} AS waterway_m,
 {_case(K.ROAD_WIDTH_M, _ROAD_SQL, '4e0')} AS road_m FROM v_ways""", "v_ways")
def _(v):
    return v.v_ways.select(
        "way_id", osm.waterway_class("waterway").alias("waterway_class"), osm.waterway_width("waterway").alias("waterway_m"),
        osm.road_width(osm.road_class("highway")).alias("road_m"),
    )


@query("b33_class_index", f"""
SELECT way_id, CASE WHEN list_position([{_ROADS}], {_ROAD_SQL}) > 0 THEN CAST(list_position([{_ROADS}], {_ROAD_SQL}) AS BIGINT) - 1 ELSE 5 END AS road_no,
 CASE WHEN list_position([{', '.join(repr(n) for n in K.LANDUSE_CLASSES)}], {_USE('landuse')}) > 0 THEN CAST(list_position([{', '.join(repr(n) for n in K.LANDUSE_CLASSES)}], {_USE('landuse')}) AS BIGINT) - 1 ELSE 3 END AS use_no FROM v_ways""", "v_ways")
def _(v):
    return v.v_ways.select(
        "way_id", osm.road_index(osm.road_class("highway")).alias("road_no"),
        osm.landuse_index(osm.landuse_class("landuse", F.lit(None).cast("string"))).alias("use_no"),
    )


@query("c18_part_height", "SELECT way_id, CASE WHEN p_size * 7.5e0 - way_id % 40 BETWEEN 1.5 AND 220 THEN p_size * 7.5e0 - way_id % 40 END AS height_m FROM v_ways", "v_ways")
def _(v):
    return v.v_ways.select("way_id", osm.part_height(F.col("p_size") * 7.5, (F.col("way_id") % 40).cast("double")).alias("height_m"))


def _ways(v):
    pairs = [x for k, n in (("building", "building"), ("highway", "highway"), ("waterway", "waterway"), ("landuse", "landuse"),
                            ("natural", "natural_tag"), ("leisure", "leisure"), ("height", "height"), ("building:levels", "levels"))
             for x in (F.lit(k), F.col(n))]
    tags = F.map_filter(F.create_map(*pairs), lambda k, x: x.isNotNull())
    corner = lambda a, b: F.struct((F.col("lat") + b).alias("lat"), (F.col("lon") + a).alias("lon"))
    ring = F.array(corner(0.0, 0.0), corner(0.001, 0.0), corner(0.001, 0.001), corner(0.0, 0.0))
    return v.v_ways.select("way_id", F.lit("way").alias("type"), tags.alias("tags"), F.slice(ring, F.lit(1), 1 + F.col("way_id").cast("int") % 4).alias("geometry"))


_LAYER = f"""lay AS (SELECT way_id, 1 + way_id % 4 AS n, lon, lat, CASE WHEN nullif(building, '') IS NOT NULL THEN 'building' WHEN highway IS NOT NULL THEN 'road' WHEN waterway IS NOT NULL THEN 'waterway' ELSE 'landuse' END AS layer,
 {_ROAD_SQL} AS rc, CASE WHEN waterway IN ('river', 'ditch') THEN waterway END AS wc, coalesce({_USE('landuse')}, {_USE('natural_tag')}, {_USE('leisure')}) AS lc, {_HEIGHT} AS h FROM v_ways),
typed AS (SELECT way_id, n, lon, lat, layer, CASE layer WHEN 'road' THEN rc WHEN 'waterway' THEN wc WHEN 'landuse' THEN lc END AS class, CASE WHEN layer = 'building' THEN h END AS height_m FROM lay),
feat AS (SELECT * FROM typed WHERE n >= CASE WHEN layer IN ('building', 'landuse') THEN 3 ELSE 2 END AND (layer = 'building' OR class IS NOT NULL))"""


@query("a02_way_layers", f"WITH {_LAYER} SELECT way_id, layer, class, height_m, n AS vertices FROM feat", "v_ways")
def _(v):
    out = features.layers(_ways(v))
    return out.select("way_id", "layer", "class", "height_m", F.size("line").cast("bigint").alias("vertices"))


@query("a03_building_ways", f"SELECT way_id, {_HEIGHT} AS height_m FROM v_ways WHERE 1 + way_id % 4 >= 3", "v_ways")
def _(v):
    return features.building_ways(_ways(v)).select("way_id", "height_m")


@query("h07_selected_ways", "SELECT way_id FROM v_ways WHERE building IS NOT NULL OR highway IS NOT NULL OR landuse IS NOT NULL OR natural_tag IS NOT NULL", "v_ways")
def _(v):
    return features.selected_ways(_ways(v)).select("way_id")


@query("e29_way_counts", "SELECT count(highway) AS highway, count(waterway) AS waterway FROM v_ways", "v_ways")
def _(v):
    return features.way_counts(_ways(v))


@query("e18_features_per_tile", f"""
WITH {_LAYER} SELECT CAST(14 AS BIGINT) AS z, {tile_x('lon', '14')} AS x, {tile_y('lat', '14')} AS y, count(*) FILTER (layer = 'building') AS buildings, count(*) FILTER (layer = 'road') AS roads,
 count(*) FILTER (layer = 'landuse') AS landuse FROM feat GROUP BY 2, 3""", "v_ways")
def _(v):
    f = features.layers(_ways(v))
    at = tiles.tile_for_point(F.col("line")[0]["lat"], F.col("line")[0]["lon"], 14)
    return features.tile_counts(f.select("layer", F.lit(14).cast("bigint").alias("z"), at["x"].alias("x"), at["y"].alias("y")))


# --- vertices -----------------------------------------------------------------------------

_IN_TILE = f"""t AS (SELECT feature, class_no, line, n, {tile_x('line[1].lon', '14')} AS x, {tile_y('line[1].lat', '14')} AS y FROM v_lines),
b AS (SELECT *, x / 16384e0 * 360e0 - 180e0 AS west, (x + 1) / 16384e0 * 360e0 - 180e0 AS east, degrees(atan(sinh(pi() * (1e0 - 2e0 * (y + 1) / 16384e0)))) AS south,
 degrees(atan(sinh(pi() * (1e0 - 2e0 * y / 16384e0)))) AS north FROM t),
p AS (SELECT *, unnest(range(1, n + 1)) AS i FROM b),
q AS (SELECT feature, class_no, x, y, i, west, east, south, north, CAST(least(4096, greatest(0, floor((line[i].lon - west) / (east - west) * 4096e0 + 0.5e0))) AS BIGINT) AS qx,
 CAST(least(4096, greatest(0, floor((north - line[i].lat) / (north - south) * 4096e0 + 0.5e0))) AS BIGINT) AS qy FROM p),
d AS (SELECT *, qx - lag(qx, 1, 0) OVER w AS dx, qy - lag(qy, 1, 0) OVER w AS dy FROM q WINDOW w AS (PARTITION BY feature ORDER BY i))"""


def _tiled(v):
    at = tiles.tile_for_point(F.col("line")[0]["lat"], F.col("line")[0]["lon"], 14)
    rows = v.v_lines.withColumns({"z": F.lit(14).cast("bigint"), "x": at["x"], "y": at["y"]})
    return rows.withColumn("box", tiles.tile_box("z", "x", "y"))


@query("b34_quantise_restore", f"""
WITH {_IN_TILE} SELECT feature, i, qx, qy, round(west + qx / 4096e0 * (east - west), 6) AS lon, round(north - qy / 4096e0 * (north - south), 6) AS lat FROM q""", "v_lines")
def _(v):
    rows = _tiled(v).select("feature", F.posexplode(F.transform("line", lambda p: tiles.quantise(p["lon"], p["lat"], F.col("box")))).alias("i", "q"), "box")
    back = tiles.restore("q.qx", "q.qy", F.col("box"))
    return rows.select("feature", (F.col("i") + 1).cast("bigint").alias("i"), "q.qx", "q.qy", F.round(back["lon"], 6).alias("lon"), F.round(back["lat"], 6).alias("lat"))


@query("f03_grid_steps", f"WITH {_IN_TILE} SELECT feature, i, dx, dy FROM d", "v_lines")
def _(v):
    rows = _tiled(v).select("feature", F.posexplode(features.grid_steps("line", F.col("box"))).alias("i", "s"))
    return rows.select("feature", (F.col("i") + 1).cast("bigint").alias("i"), "s.dx", "s.dy")


_LEN = lambda e: f"CASE WHEN {e} < 128 THEN 1 WHEN {e} < 16384 THEN 2 ELSE 3 END"


@query("b35_zigzag_varint", f"""
WITH {_IN_TILE} SELECT feature, i, CAST(CASE WHEN dx >= 0 THEN dx * 2 ELSE -dx * 2 - 1 END AS BIGINT) AS zx, CAST({_LEN('CASE WHEN dx >= 0 THEN dx * 2 ELSE -dx * 2 - 1 END')} AS BIGINT) AS n FROM d""", "v_lines")
def _(v):
    rows = _tiled(v).select("feature", F.posexplode(features.grid_steps("line", F.col("box"))).alias("i", "s"))
    zx = tiles.zigzag("s.dx")
    return rows.select("feature", (F.col("i") + 1).cast("bigint").alias("i"), zx.alias("zx"), tiles.varint_length(zx).alias("n"))


@query("f02_segments", """
SELECT feature, i AS seq, round(line[i].lon, 6) AS a_lon, round(line[i + 1].lat, 6) AS b_lat FROM (SELECT feature, line, unnest(range(1, n)) AS i FROM v_lines) s""", "v_lines")
def _(v):
    rows = v.v_lines.select("feature", F.explode(features.segments("line")).alias("s"))
    return rows.select("feature", (F.col("s.seq") + 1).cast("bigint").alias("seq"), F.round("s.a.lon", 6).alias("a_lon"), F.round("s.b.lat", 6).alias("b_lat"))


@query("f02_ring_edges", """
SELECT feature, i AS seq, round(line[i].lon, 6) AS a_lon, round(line[CASE WHEN i = n THEN 1 ELSE i + 1 END].lat, 6) AS b_lat FROM (SELECT feature, line, n, unnest(range(1, n + 1)) AS i FROM v_lines) s""", "v_lines")
def _(v):
    rows = v.v_lines.select("feature", F.explode(features.ring_edges("line")).alias("s"))
    return rows.select("feature", (F.col("s.seq") + 1).cast("bigint").alias("seq"), F.round("s.a.lon", 6).alias("a_lon"), F.round("s.b.lat", 6).alias("b_lat"))


_LOCAL = """k AS (SELECT 0.3e0 * 111320e0 * cos(radians((48.0e0 + 48.3e0) / 2e0)) AS w, 0.3e0 * 111320e0 AS dd),
v AS (SELECT feature, class_no, i, n, (line[i].lon - 16.1e0) / (16.4e0 - 16.1e0) * w - w / 2e0 AS x, (48.3e0 - line[i].lat) / (48.3e0 - 48.0e0) * dd - dd / 2e0 AS z
 FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM v_lines) s, k)"""


_CLEANED = """cl AS (SELECT * FROM (SELECT *, lag(x) OVER w AS ox, lag(z) OVER w AS oz FROM v WINDOW w AS (PARTITION BY feature ORDER BY i)) r WHERE ox IS NULL OR abs(ox - x) >= 1e-6 OR abs(oz - z) >= 1e-6),
vv AS (SELECT feature, class_no, i, x, z FROM (SELECT *, first_value(x) OVER p AS fx, first_value(z) OVER p AS fz, count(*) OVER (PARTITION BY feature) AS cnt, row_number() OVER p AS rn FROM cl WINDOW p AS (PARTITION BY feature ORDER BY i)) r
 WHERE NOT (cnt > 1 AND rn = cnt AND abs(fx - x) < 1e-6 AND abs(fz - z) < 1e-6))"""


def _doubled(v):
    """Lines as rings with every vertex repeated and the first one closing the ring."""
    twice = F.flatten(F.transform("line", lambda p: F.array(p, p)))
    closed = F.concat(twice, F.slice("line", 1, 1))
    return v.v_lines.withColumn("line", closed)


@query("f11_clean_ring", f"""WITH {_LOCAL}, {_CLEANED} SELECT feature, count(*) AS vertices FROM vv GROUP BY feature""", "v_lines")
def _(v):
    """Repeated and closing vertices go; every distinct vertex stays."""
    return _doubled(v).select("feature", F.size(features.clean_ring(features.localise("line", BOX))).cast("bigint").alias("vertices"))


_CLASS_SQL = f"[{_ROADS}][class_no + 1]"
_SEG = """seg AS (SELECT *, lead(x) OVER w - x AS dx, lead(z) OVER w - z AS dz, lead(x) OVER w AS bx, lead(z) OVER w AS bz FROM v WINDOW w AS (PARTITION BY feature ORDER BY i)),
quad AS (SELECT *, sqrt(dx * dx + dz * dz) AS len FROM seg WHERE dx IS NOT NULL AND sqrt(dx * dx + dz * dz) >= 1e-6)"""
_WIDTH = _case(K.ROAD_WIDTH_M, _CLASS_SQL)


def _roads(v):
    name = F.get(F.array(*[F.lit(n) for n in K.ROAD_CLASSES]), F.col("class_no").cast("int"))
    return v.v_lines.withColumn("class", name)


@query("e24_ribbon_corners", f"""
WITH {_LOCAL}, {_SEG} SELECT feature, CAST(i - 1 AS INT) AS seq, round(x + dz / len * {_WIDTH} / 2, 4) AS c0x, round(z - dx / len * {_WIDTH} / 2, 4) AS c0z,
 round(bx - dz / len * {_WIDTH} / 2, 4) AS c2x, round(bz + dx / len * {_WIDTH} / 2, 4) AS c2z FROM quad""", "v_lines")
def _(v):
    q = features.ribbons(_roads(v), BOX, osm.road_width("class"), ["feature", "class"])
    return q.select("feature", "seq", *[F.round(f"{k}.{a}", 4).alias(k + a) for k in ("c0", "c2") for a in ("x", "z")])


@query("e24_ribbon_stats", f"""
WITH {_LOCAL}, {_SEG} SELECT {_CLASS_SQL} AS class, count(DISTINCT feature) AS lines, count(*) AS segments, count(*) * 2 AS triangles, round(sum(len) / 1e3, 3) AS length_km FROM quad GROUP BY 1""", "v_lines")
def _(v):
    q = features.ribbons(_roads(v), BOX, osm.road_width("class"), ["feature", "class"])
    out = features.ribbon_stats(q, "feature", ["class"])
    return out.select("class", "lines", "segments", "triangles", F.round(F.col("length_m") / 1000, 3).alias("length_km"))


_USES = "[" + ", ".join(repr(n) for n in K.LANDUSE_CLASSES) + "]"
_AREA = "area AS (SELECT feature, max(class_no) AS class_no, count(*) AS n, sum((coalesce(px, lx) - x) * (coalesce(pz, lz) + z)) / 2 AS a FROM (SELECT *, lag(x) OVER w AS px, lag(z) OVER w AS pz, last_value(x) OVER (PARTITION BY feature ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS lx, last_value(z) OVER (PARTITION BY feature ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS lz FROM vv WINDOW w AS (PARTITION BY feature ORDER BY i)) r GROUP BY feature)"


@query("e23_landcover_patches", f"""
WITH {_LOCAL}, {_CLEANED}, {_AREA} SELECT {_USES}[class_no + 4] AS class, count(*) AS patches, CAST(sum(n) AS BIGINT) AS vertices, round(sum(abs(a)) / 1e6, 4) AS area_km2
FROM area WHERE n >= 3 AND {_USES}[class_no + 4] NOT IN ('residential', 'industrial', 'commercial', 'quarry') GROUP BY 1""", "v_lines")
def _(v):
    name = F.get(F.array(*[F.lit(n) for n in K.LANDUSE_CLASSES]), (F.col("class_no") + 3).cast("int"))
    out = features.landcover_patches(_doubled(v).withColumn("class", name), BOX)
    return out.select("class", "patches", "vertices", F.round(F.col("area_m2") / 1e6, 4).alias("area_km2"))


@query("e25_building_bodies", f"""
WITH {_LOCAL}, {_CLEANED}, {_AREA}, g AS (SELECT vv.feature, avg(h) AS base FROM vv, k JOIN v_grid ON v_grid.source = vv.feature % 100 AND row_no = CAST(least(7, greatest(0, floor((z + dd / 2) / (dd / 7) + 0.5e0))) AS BIGINT)
 AND col_no = CAST(least(7, greatest(0, floor((x + w / 2) / (w / 7) + 0.5e0))) AS BIGINT) GROUP BY vv.feature)
SELECT area.feature, CAST(n AS BIGINT) AS walls, round(base, 4) AS base_m, round(base + 3e0 * (class_no + 1), 4) AS top_m, round(a / 1e6, 4) AS area_km2 FROM area JOIN g ON g.feature = area.feature WHERE n >= 3""", "v_lines v_grid")
def _(v):
    homes = _doubled(v).withColumn("height_m", 3.0 * (F.col("class_no") + 1)).withColumn("source", F.col("feature") % 100)
    rings = features.building_rings(homes, BOX).select("feature", "source", "height_m", "ring")
    size = tiles.box_size_m(*BOX)
    ground = raster.nearest_sample(
        features.ring_vertices(rings, ["feature", "source"]), v.v_grid.select("source", "row_no", "col_no", "h"), "source", 8,
        size["width_m"], size["depth_m"],
    )
    out = features.building_bodies(rings, "feature", ground)
    return out.select(
        "feature", F.col("walls").cast("bigint").alias("walls"), F.round("base_m", 4).alias("base_m"), F.round("top_m", 4).alias("top_m"),
        F.round(F.col("signed_area_m2") / 1e6, 4).alias("area_km2"),
    )


_MODEL = "CASE s_suppkey % 5 WHEN 0 THEN 'dtm' WHEN 1 THEN 'dsm' WHEN 2 THEN 'mixed' WHEN 3 THEN 'unknown' ELSE 'guess' END"


@query("c19_surface_gate", f"""
SELECT s_suppkey, CASE WHEN {_MODEL} = 'guess' THEN 'SURFACE_MODEL_UNRECOGNISED' WHEN {_MODEL} <> 'dtm' THEN 'BARE_EARTH_REQUIRED' END AS strict_code,
 {_MODEL} = 'dtm' AS bare_earth, CASE WHEN {_MODEL} = 'dtm' THEN NULL WHEN {_MODEL} = 'unknown' THEN concat('Elevation source ', s_name, ' did not report') WHEN {_MODEL} = 'dsm' THEN
 concat('Elevation source ', s_name, ' is a surface model, not bare earth') ELSE concat('Elevation source ', s_name, ' is a mixed surface/terrain mosaic, not bare earth') END AS notice_head FROM supplier""")
def _(v):
    k = F.col("s_suppkey") % 5
    model = F.when(k == 0, "dtm").when(k == 1, "dsm").when(k == 2, "mixed").when(k == 3, "unknown").otherwise("guess")
    rows = v.supplier.select("s_suppkey", model.alias("model"), F.col("s_name").alias("source_id"))
    head = F.regexp_extract(gates.surface_notice("model", "source_id"), r"^(.*?(?:did not report|not bare earth))", 1)
    return rows.select("s_suppkey", gates.surface_code("model", "source_id", False).alias("strict_code"), gates.bare_earth("model").alias("bare_earth"), head.alias("notice_head"))


# --- feature tiles ------------------------------------------------------------------------------------


def _tile_rows(v):
    layer = F.when(F.col("class_no") % 3 == 0, "building").when(F.col("class_no") % 3 == 1, "road").otherwise("landuse")
    road = F.get(F.array(*[F.lit(n) for n in K.ROAD_CLASSES]), F.col("class_no").cast("int"))
    use = F.get(F.array(*[F.lit(n) for n in K.LANDUSE_CLASSES]), F.col("class_no").cast("int"))
    name = F.when(layer == "road", road).when(layer == "landuse", use)
    return _tiled(v).select("z", "x", "y", layer.alias("layer"), F.col("feature").alias("seq"), name.alias("class"),
                            F.when(layer == "building", F.col("class_no") + 0.25).alias("height_m"), "line")


@query("a14_write_feature_tiles", f"""
WITH {_IN_TILE}, f AS (SELECT x, y, feature, any_value(class_no) AS c, count(*) AS n, CAST(sum({_LEN('CASE WHEN dx >= 0 THEN dx * 2 ELSE -dx * 2 - 1 END')} + {_LEN('CASE WHEN dy >= 0 THEN dy * 2 ELSE -dy * 2 - 1 END')}) AS BIGINT) AS steps FROM d GROUP BY x, y, feature),
s AS (SELECT x, y, sum(steps + 2) AS body, count(*) FILTER (c % 3 = 0) AS b, count(*) FILTER (c % 3 = 1) AS r, count(*) FILTER (c % 3 = 2) AS l FROM f GROUP BY x, y)
SELECT CAST(14 AS BIGINT) AS z, x, y, CAST(15 + body + {_LEN('b')} + {_LEN('r')} + {_LEN('l')} AS BIGINT) AS size FROM s""", "v_lines")
def _(v):
    """Blob sizes per tile: header, layer counts and one varint per step."""
    blobs = feature_tiles.encode(_tile_rows(v))
    return blobs.select("z", "x", "y", F.octet_length("content").cast("bigint").alias("size"))


@query("a13_scan_feature_tiles", f"""
WITH {_IN_TILE} SELECT x, y, CASE class_no % 3 WHEN 0 THEN 'building' WHEN 1 THEN 'road' ELSE 'landuse' END AS layer,
 CASE class_no % 3 WHEN 1 THEN [{_ROADS}][class_no + 1] WHEN 2 THEN {_USES}[class_no + 1] END AS class, CASE WHEN class_no % 3 = 0 THEN floor((class_no + 0.25e0) * 10 + 0.5e0) / 10e0 END AS height_m,
 count(*) AS vertices, round(sum(west + qx / 4096e0 * (east - west)), 6) AS sum_lon, round(sum(north - qy / 4096e0 * (north - south)), 6) AS sum_lat FROM q GROUP BY feature, x, y, class_no""", "v_lines")
def _(v):
    """Tiles written and scanned back: every feature with its restored vertices."""
    blobs = feature_tiles.encode(_tile_rows(v))
    out = feature_tiles.decode(blobs)
    total = lambda f: F.round(F.aggregate("line", F.lit(0.0), lambda a, p: a + p[f]), 6)
    return out.select("x", "y", "layer", "class", "height_m", F.size("line").cast("bigint").alias("vertices"), total("lon").alias("sum_lon"), total("lat").alias("sum_lat"))


assert boxes.EDGES == ("west", "south", "east", "north")
