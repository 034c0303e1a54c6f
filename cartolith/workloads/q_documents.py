"""JSON documents as sources, and covers called from SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartolith import sql
from cartolith.session import work_dir
from cartolith.sources import feeds, geojson
from cartolith.workloads.q_grid import _CELLS
from cartolith.workloads.registry import query


@query("j02_geohash_cover", _CELLS, "v_views")
def _(v):
    sql.register(v.spark)
    return v.spark.sql(
        "SELECT v.view_id, t.ix, t.iy, t.cell FROM {views} v, LATERAL geohash_cover(v.west, v.south, v.east, v.north, 4) t", views=v.v_views
    )


@query("j02_tile_cover", """
WITH a AS (SELECT view_id, floor((west + 180e0) / 360e0 * 512e0) AS x0, floor((east + 180e0) / 360e0 * 512e0) AS x1, floor((1e0 - asinh(tan(radians(north))) / pi()) / 2e0 * 512e0) AS y0,
 floor((1e0 - asinh(tan(radians(south))) / pi()) / 2e0 * 512e0) AS y1 FROM v_views)
SELECT view_id, CAST(count(*) AS BIGINT) AS n, CAST(min(x) AS BIGINT) AS x0, CAST(max(y) AS BIGINT) AS y1 FROM (SELECT view_id, x, y0 + unnest(range(CAST(y1 - y0 + 1 AS BIGINT))) AS y FROM (
 SELECT view_id, x0 + unnest(range(CAST(x1 - x0 + 1 AS BIGINT))) AS x, y0, y1 FROM a) b) c GROUP BY view_id""", "v_views")
def _(v):
    sql.register(v.spark)
    rows = v.spark.sql("SELECT v.view_id, t.x, t.y FROM {views} v, LATERAL tile_cover(v.west, v.south, v.east, v.north, 9) t", views=v.v_views)
    return rows.groupBy("view_id").agg(F.count("*").alias("n"), F.min("x").alias("x0"), F.max("y").alias("y1"))


@query("a04_city_parts", """
SELECT way_id % 3 AS shape, CAST(count(*) AS BIGINT) AS parts, round(sum(h), 4) AS height_m FROM (SELECT way_id, p_size * 7.5e0 - way_id % 40 AS h, unnest(range(CASE way_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END)) AS i
 FROM v_ways) w WHERE h BETWEEN 1.5 AND 220 GROUP BY 1""", "v_ways")
def _(v):
    """Measured building parts: one ring per polygon, other geometry types give none."""
    ring = F.array(*[F.array(F.col("lon") + a, F.col("lat") + b) for a, b in ((0.0, 0.0), (0.1, 0.0), (0.1, 0.1), (0.0, 0.0))])
    point = F.concat(F.lit('{"type":"Point","coordinates":'), F.to_json(F.array("lon", "lat")), F.lit("}"))
    one = F.concat(F.lit('{"type":"Polygon","coordinates":['), F.to_json(ring), F.lit("]}"))
    two = F.concat(F.lit('{"type":"MultiPolygon","coordinates":[['), F.to_json(ring), F.lit("],["), F.to_json(ring), F.lit("]]}"))
    shape = F.col("way_id") % 3
    geometry = F.when(shape == 0, one).when(shape == 1, two).otherwise(point)
    text = F.concat(
        F.lit('{"properties":{"O_KOTE":'), (F.col("p_size") * 7.5).cast("string"), F.lit(',"T_KOTE":'), (F.col("way_id") % 40).cast("string"),
        F.lit('},"geometry":'), geometry, F.lit("}"),
    )
    parts = geojson.city_parts(v.v_ways.select("way_id", F.parse_json(text).alias("f")), keep=["way_id"])
    out = parts.groupBy((F.col("way_id") % 3).alias("shape")).agg(F.count("*").alias("parts"), F.round(F.sum("height_m"), 4).alias("height_m"))
    return out


@query("a10_character_manifest", """
SELECT c_custkey, c_name AS name, sha256(c_name) AS sha256, CAST(c_custkey AS BIGINT) AS size FROM customer WHERE c_custkey % 3 > 0""")
def _(v):
    sha = F.when(F.col("c_custkey") % 3 > 0, F.sha2("c_name", 256)).otherwise("nohash")
    doc = F.concat(F.lit('{"'), F.col("c_name"), F.lit('":{"sha256":"'), sha, F.lit('","size":'), F.col("c_custkey").cast("string"), F.lit("}}"))
    return feeds.characters(v.customer.select("c_custkey", doc.alias("value")), keep=["c_custkey"]).select("c_custkey", "name", "sha256", "size")


@query("a15_delivery_metadata", """
SELECT lod AS region, CAST(count(*) FILTER (texture AND request_id % 4 < 3) AS BIGINT) AS kept, CAST(count(*) FILTER (NOT (texture AND request_id % 4 < 3)) AS BIGINT) AS refused FROM v_requests GROUP BY lod""", "v_requests")
def _(v):
    """Delivery metadata written as JSON lines and read back with its required fields."""
    source = F.struct(
        F.lit("a").alias("id"), F.col("lod").alias("name"), F.when(F.col("texture"), "CC0").alias("license"), F.lit("x").alias("attribution")
    )
    doc = F.struct(
        F.col("lod").alias("region"), F.when(F.col("request_id") % 4 < 3, F.col("target")).alias("m_per_px"), F.lit(2.0).alias("width_px"),
        F.lit(2.0).alias("height_px"), source.alias("source"),
    )
    path = work_dir(v.spark, "deliveries")
    v.v_requests.select(doc.alias("d")).select("d.*").write.json(path)
    kept, refused = feeds.read_deliveries(v.spark, path, multi_line=False)
    rows = kept.select("region", F.lit(1).alias("k")).unionByName(refused.select("region", F.lit(0).alias("k")))
    return rows.groupBy("region").agg(F.count_if(F.col("k") == 1).alias("kept"), F.count_if(F.col("k") == 0).alias("refused"))
