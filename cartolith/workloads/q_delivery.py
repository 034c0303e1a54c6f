"""Source chains, texture forecasts, plans and prices."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartolith.functions import boxes, gates
from cartolith.plans import delivery, elevation
from cartolith.sources import registry
from cartolith.workloads import duck
from cartolith.workloads.registry import query
from cartolith.workloads.views import tile_x, tile_y

BOX = boxes.EDGES

_SRC = "src(" + ", ".join(registry.FIELDS) + ") AS (" + duck.values(registry.ELEVATION) + ")"
_RANKS = "ranks(region, rk, id) AS (" + duck.values(
    [(r, i, s) for r, ids in registry.REGION_ELEVATION.items() for i, s in enumerate(ids)]
) + ")"
_REQ = """req AS (SELECT request_id, west, south, east, north, CASE request_id % 4 WHEN 0 THEN 'south-tyrol' WHEN 1 THEN 'europe' WHEN 2 THEN 'vienna' ELSE 'madeira' END AS region FROM v_requests)"""
_CHAIN = f"""{_SRC}, {_RANKS}, {_REQ},
links AS (SELECT r.request_id, rk, s.* FROM req r JOIN ranks k ON k.region = r.region JOIN src s ON s.id = k.id WHERE s.west IS NULL OR (r.west >= s.west AND r.east <= s.east AND r.south >= s.south AND r.north <= s.north)
 UNION ALL SELECT request_id, 98, s.* FROM req, src s WHERE s.id = 'gedtm30' UNION ALL SELECT request_id, 99, s.* FROM req, src s WHERE s.id = 'mapzen-terrarium'),
chain AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY rk) - 1 AS rank FROM links)"""
_V = "v_requests"


def _requests(v):
    k = F.col("request_id") % 4
    region = F.when(k == 0, "south-tyrol").when(k == 1, "europe").when(k == 2, "vienna").otherwise("madeira")
    return v.v_requests.select("request_id", *BOX, region.alias("region"))


@query("d04_source_chain", f"WITH {_CHAIN} SELECT request_id, CAST(rank AS BIGINT) AS rank, id, model FROM chain", _V)
def _(v):
    rows = elevation.chain_rows(_requests(v), "request_id")
    return rows.select("request_id", F.col("rank").cast("bigint").alias("rank"), "id", "model")


@query("h04_chain_union", f"WITH {_CHAIN} SELECT request_id, string_agg(id, ',' ORDER BY rank) AS ids FROM chain GROUP BY request_id", _V)
def _(v):
    ids = F.transform(elevation.chain("region"), lambda s: s["id"])
    return _requests(v).select("request_id", F.array_join(F.array_distinct(ids), ",").alias("ids"))


@query("f09_rank_one", f"WITH {_CHAIN} SELECT request_id, id FROM chain WHERE rank = 0", _V)
def _(v):
    return _requests(v).select("request_id", elevation.choice(elevation.chain("region"))["id"].alias("id"))


@query("d20_bare_earth_reference", f"WITH {_CHAIN} SELECT request_id, arg_min(id, rank) FILTER (model = 'dtm') AS id, arg_min(sigma_m, rank) FILTER (model = 'dtm') AS sigma_m FROM chain GROUP BY request_id", _V)
def _(v):
    s = elevation.bare_earth_reference(elevation.chain("region"))
    return _requests(v).select("request_id", s["id"].alias("id"), s["sigma_m"].alias("sigma_m"))


_CREDIT = "CASE WHEN composite THEN attribution ELSE concat(attribution, ' — ', license) END"


@query("e20_credit_line", f"""
WITH {_CHAIN}, c AS (SELECT request_id, {_CREDIT} AS credit, min(rank) AS rank FROM chain GROUP BY 1, 2) SELECT request_id, string_agg(credit, ' · ' ORDER BY rank) AS line FROM c GROUP BY request_id""", _V)
def _(v):
    return _requests(v).select("request_id", elevation.credit_line(elevation.chain("region")).alias("line"))


@query("b59_credit", f"WITH {_CHAIN} SELECT id, {_CREDIT} AS credit, count(*) AS uses FROM chain GROUP BY 1, 2", _V)
def _(v):
    rows = elevation.provenance(elevation.chain_rows(_requests(v), "request_id"))
    return rows.groupBy("id", "credit").agg(F.count("*").alias("uses"))


@query("e21_provenance", f"WITH {_CHAIN} SELECT request_id, CAST(rank AS BIGINT) AS rank, id, name, resolution_m, sigma_m, license, {_CREDIT} AS credit FROM chain", _V)
def _(v):
    rows = elevation.provenance(elevation.chain_rows(_requests(v), "request_id"))
    return rows.select("request_id", F.col("rank").cast("bigint").alias("rank"), "id", "name", "resolution_m", "sigma_m", "license", "credit")


@query("b60_dense_zoom", """
SELECT p_partkey, CAST(CASE WHEN p_size % 3 = 0 THEN least(p_size, 12) ELSE p_size END AS BIGINT) AS z, CAST(p_size AS BIGINT) AS sparse_z FROM part""")
def _(v):
    source = F.struct(F.col("p_size").alias("max_zoom"), F.when(F.col("p_size") % 3 == 0, F.least("p_size", F.lit(12))).alias("dense_max_zoom"))
    rows = v.part.select("p_partkey", source.alias("s"))
    return rows.select(
        "p_partkey", elevation.served_max_zoom(F.col("s")).cast("bigint").alias("z"), elevation.served_max_zoom(F.col("s"), True).cast("bigint").alias("sparse_z")
    )


@query("b57_posting_sigma", "SELECT p_partkey, greatest(0.3e0, p_retailprice / 5000e0) AS sigma_m FROM part")
def _(v):
    return v.part.select("p_partkey", elevation.assumed_sigma(F.col("p_retailprice") / 5000.0).alias("sigma_m"))


@query("b63_preflight", f"""
WITH {_CHAIN}, f AS (SELECT c.request_id, c.id, c.model, c.tile_size, (r.south + r.north) / 2e0 AS lat, CAST(least(c.max_zoom, greatest(c.min_zoom, ceil(log2(192e0 * 360e0 / (c.tile_size * (r.east - r.west)))))) AS BIGINT) AS zoom
 FROM chain c JOIN req r ON r.request_id = c.request_id WHERE rank = 0) SELECT request_id, id AS source_id, model, zoom, round(40075016.686e0 * cos(radians(lat)) / (pow(2e0, zoom) * tile_size), 6) AS m_per_px FROM f""", _V)
def _(v):
    out = elevation.preflight(_requests(v))
    return out.select("request_id", "source_id", "model", F.col("zoom").cast("bigint").alias("zoom"), F.round("m_per_px", 6).alias("m_per_px"))


# --- quotes ---------------------------------------------------------------------------------


def _span(z):
    return f"((abs({tile_x('east', z)} - {tile_x('west', z)}) + 1) * (abs({tile_y('south', z)} - {tile_y('north', z)}) + 1))"


_DZ = "CASE lod WHEN 'overview' THEN 11 WHEN 'standard' THEN 12 WHEN 'detail' THEN 13 END"
_FZ = "CASE lod WHEN 'overview' THEN 12 WHEN 'standard' THEN 13 WHEN 'detail' THEN 14 END"
_REGION = """CASE WHEN west >= -17.32 AND east <= -16.24 AND south >= 32.35 AND north <= 33.15 THEN 'madeira' WHEN west >= 10.38 AND east <= 12.48 AND south >= 46.21 AND north <= 47.10 THEN 'south-tyrol'
 WHEN west >= 16.18 AND east <= 16.58 AND south >= 48.11 AND north <= 48.33 THEN 'vienna' ELSE 'europe' END"""
_PLAN = f"""r0 AS (SELECT *, {_DZ} AS dz, {_FZ} AS fz, {_REGION} AS region, {duck.flat_area()} AS area, (south + north) / 2e0 AS lat FROM v_requests),
r1 AS (SELECT *, CASE WHEN dz IS NULL THEN 'LOD_UNKNOWN' WHEN area > 120 THEN 'AREA_CEILING' WHEN {_span('dz')} > 64 THEN 'DEM_TILE_CEILING' WHEN {_span('fz')} > 16 THEN 'FEATURE_TILE_CEILING'
  WHEN texture AND (target < 0.05 OR target > 10) THEN 'TEXTURE_RANGE' END AS code, region IN ('madeira', 'south-tyrol') AS wms, (east - west) * 111320e0 * cos(radians(lat)) AS wm FROM r0),
r2 AS (SELECT *, CAST(coalesce((SELECT min(z) FROM (SELECT unnest(range(24)) AS z) t WHERE 40075016.686e0 * cos(radians(lat)) / (pow(2e0, z) * 256e0) <= target), 23) AS BIGINT) AS want,
  greatest(1e0, round_even(wm / target, 0)) AS wpx, greatest(1e0, round_even((north - south) * 111320e0 / target, 0)) AS hpx FROM r1),
r3 AS (SELECT *, least(want, 19) AS top FROM r2),
zs AS (SELECT request_id, max(z) AS zoom FROM r3, (SELECT unnest(range(24)) AS z) t WHERE z <= top AND {_span('z')} <= 256 GROUP BY request_id),
r4 AS (SELECT r3.*, coalesce(zs.zoom, 0) AS zoom FROM r3 LEFT JOIN zs ON zs.request_id = r3.request_id),
r5 AS (SELECT *, round(CASE WHEN wms THEN wm / CASE WHEN greatest(wpx, hpx) > 4096 THEN greatest(1e0, floor(wpx * (4096e0 / greatest(wpx, hpx)))) ELSE wpx END
  ELSE 40075016.686e0 * cos(radians(lat)) / (pow(2e0, zoom) * 256e0) END, 3) AS mpp FROM r4),
r6 AS (SELECT *, CASE WHEN code IS NULL AND texture THEN mpp END AS m_per_px, {_span('dz')} AS dt, {_span('fz')} AS ft FROM r5),
r7 AS (SELECT *, CASE WHEN m_per_px > 0 THEN area * 1e6 / (m_per_px * m_per_px) / 1e6 ELSE 0e0 END AS mp FROM r6)"""


@query("c25_plan_ceilings", f"WITH {_PLAN} SELECT request_id, code FROM r1", _V)
def _(v):
    return v.v_requests.select("request_id", gates.plan_refusal(*BOX, "lod", "texture", "target").alias("code"))


@query("b61_texture_forecast", f"""
WITH {_PLAN} SELECT request_id, region, mpp AS m_per_px, CASE WHEN wms THEN CASE WHEN greatest(wpx, hpx) > 4096 THEN 'clamped to 4096px — a smaller selection gets sharper' ELSE '' END ELSE
 concat(CASE WHEN want > 19 THEN concat(CASE WHEN region = 'vienna' THEN 'basemap.at Orthofoto' ELSE 'Esri World Imagery' END, ' stops at z19') ELSE '' END, CASE WHEN want > 19 AND zoom < top THEN '|' ELSE '' END,
 CASE WHEN zoom < top THEN concat('tile budget caps this extent at z', CAST(zoom AS VARCHAR), ' — a smaller selection gets sharper') ELSE '' END) END AS notes FROM r5""", _V)
def _(v):
    out = delivery.forecast(v.v_requests.withColumn("texture_region", delivery.texture_region()))
    return out.select("request_id", F.col("texture_region").alias("region"), "m_per_px", F.array_join("notes", "|").alias("notes"))


@query("b62_downgraded", f"WITH {_PLAN} SELECT request_id, NOT (abs(m_per_px - target) <= 1e-3 * greatest(abs(m_per_px), abs(target))) AS downgraded FROM r6 WHERE m_per_px IS NOT NULL", _V)
def _(v):
    return delivery.quotes(v.v_requests).where("m_per_px IS NOT NULL").select("request_id", "downgraded")


@query("b52_price", f"""
SELECT request_id, round(mp, 4) AS megapixels, CAST(greatest(1000, floor(21e0 * (mp + 8e0 * (request_id % 60) + 40e0 * (request_id % 14)))) AS BIGINT) AS price FROM (SELECT request_id, {duck.flat_area()} / (target * target) AS mp FROM v_requests) r""", _V)
def _(v):
    from cartolith.functions import tiles

    pixels = gates.texture_megapixels(tiles.flat_area_km2(*BOX), "target")
    units = gates.work_units(pixels, F.col("request_id") % 60, F.col("request_id") % 14)
    return v.v_requests.select("request_id", F.round(pixels, 4).alias("megapixels"), gates.price(units).alias("price"))


@query("d21_quotes", f"""
WITH {_PLAN} SELECT request_id, code, CASE WHEN code IS NULL THEN dt END AS dem_tiles, CASE WHEN code IS NULL THEN ft END AS feature_tiles, m_per_px, round(CASE WHEN code IS NULL THEN mp END, 4) AS megapixels,
 CASE WHEN code IS NULL THEN CAST(greatest(1000, floor(21e0 * (mp + 8e0 * dt + 40e0 * ft))) AS BIGINT) END AS price FROM r7""", _V)
def _(v):
    out = delivery.quotes(v.v_requests)
    return out.select("request_id", "code", "dem_tiles", "feature_tiles", "m_per_px", F.round("megapixels", 4).alias("megapixels"), "price")


@query("e28_price_range", f"""
WITH {_PLAN}, p AS (SELECT lod, greatest(1000, floor(21e0 * (mp + 8e0 * dt + 40e0 * ft))) AS price FROM r7 WHERE code IS NULL)
SELECT lod, CAST(min(price) AS BIGINT) AS low, CAST(max(price) AS BIGINT) AS high, bool_and(price BETWEEN 1000 AND 64512) AS advertised FROM p GROUP BY lod""", _V)
def _(v):
    """Quoted prices per level of detail against the advertised range."""
    low, high = delivery.price_range()
    rows = delivery.quotes(v.v_requests).where("code IS NULL")
    return rows.groupBy("lod").agg(
        F.min("price").alias("low"), F.max("price").alias("high"), F.bool_and(F.col("price").between(low, high)).alias("advertised")
    )


@query("d09_planned_tiles", f"""
WITH {_PLAN}, a AS (SELECT request_id, z, media, {tile_x('west', 'z')} AS x0, {tile_x('east', 'z')} AS x1, {tile_y('north', 'z')} AS y0, {tile_y('south', 'z')} AS y1 FROM (
 SELECT *, dz AS z, 'image/png' AS media FROM r1 WHERE code IS NULL UNION ALL SELECT *, fz, 'application/vnd.feature-tile' FROM r1 WHERE code IS NULL) u),
b AS (SELECT request_id, z, media, x0 + unnest(range(CAST(x1 - x0 + 1 AS BIGINT))) AS x, y0, y1 FROM a)
SELECT request_id, CAST(z AS BIGINT) AS z, x, y0 + unnest(range(CAST(y1 - y0 + 1 AS BIGINT))) AS y, media AS media_type FROM b""", _V)
def _(v):
    ok = v.v_requests.where(gates.plan_refusal(*BOX, "lod", "texture", "target").isNull())
    return delivery.planned_tiles(ok, "request_id")


@query("a17_source_dimension", f"""
WITH {_SRC}, {_REQ} SELECT s.id, s.model, count(r.request_id) AS covered FROM src s LEFT JOIN req r ON s.west IS NULL OR (r.west >= s.west AND r.east <= s.east AND r.south >= s.south AND r.north <= s.north) GROUP BY s.id, s.model""", _V)
def _(v):
    """Requests inside each registered source; the registry is a fixed array of constants."""
    all_ = F.array(*[registry.as_struct(row) for row in registry.ELEVATION])
    w, s, e, n = (F.col(x) for x in BOX)
    inside = lambda x: x["west"].isNull() | ((w >= x["west"]) & (e <= x["east"]) & (s >= x["south"]) & (n <= x["north"]))
    hits = _requests(v).select(F.explode(F.filter(all_, inside)).alias("h")).groupBy("h.id").agg(F.count("*").alias("n"))
    dim = registry.elevation_sources(v.spark).select("id", "model")
    return dim.join(hits, "id", "left").select("id", "model", F.coalesce("n", F.lit(0)).alias("covered"))
