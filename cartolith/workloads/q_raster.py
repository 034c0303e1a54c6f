"""Elevation grids and pictures."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartolith.functions import boxes, gates, tiles
from cartolith.operators import corpus, generate, raster
from cartolith.session import work_dir
from cartolith.sources import images
from cartolith.workloads.registry import query

BOX = boxes.EDGES
r6 = lambda n: F.round(n, 6).alias(n)

_G = "v_grid"


def _grid(v, h="h"):
    return v.v_grid.select("source", "row_no", "col_no", F.col(h).alias("h"))


@query("c16_nodata_mask", "SELECT source, row_no, col_no, isnan(raw_h) OR raw_h < -500 OR raw_h > 9000 AS bad FROM v_grid", _G)
def _(v):
    return v.v_grid.select("source", "row_no", "col_no", gates.elevation_bad("raw_h").alias("bad"))


_CLEAN = """bad AS (SELECT *, isnan(raw_h) OR raw_h < -500 OR raw_h > 9000 AS b FROM v_grid),
med AS (SELECT source, quantile_cont(raw_h, 0.5) AS m FROM bad WHERE NOT b GROUP BY source),
clean AS (SELECT bad.source, row_no, col_no, CASE WHEN b THEN m ELSE raw_h END AS h FROM bad JOIN med ON bad.source = med.source)"""


@query("e10_clean_grid", f"WITH {_CLEAN} SELECT source, row_no, col_no, round(h, 6) AS h FROM clean", _G)
def _(v):
    return raster.clean(_grid(v, "raw_h"))[0].select("source", "row_no", "col_no", r6("h"))


@query("e10_nodata_fraction", f"WITH {_CLEAN} SELECT source, round(avg(b::INT), 6) AS nodata FROM bad GROUP BY source", _G)
def _(v):
    return raster.clean(_grid(v, "raw_h"))[1].select("source", r6("nodata"))


@query("e11_relief", "SELECT source, round(quantile_cont(h, 0.98) - quantile_cont(h, 0.02), 6) AS relief_m FROM v_grid GROUP BY source", _G)
def _(v):
    return raster.relief(_grid(v)).select("source", r6("relief_m"))


_DIFF = """diff AS (SELECT source, row_no, col_no, h, lag(h) OVER r - 2 * h + lead(h) OVER r AS d_row, lag(h) OVER c - 2 * h + lead(h) OVER c AS d_col, lead(h) OVER r - h AS step
 FROM {0} WINDOW r AS (PARTITION BY source, row_no ORDER BY col_no), c AS (PARTITION BY source, col_no ORDER BY row_no))"""


@query("f04_second_differences", f"WITH {_DIFF.format('v_grid')} SELECT source, row_no, col_no, round(d_row, 6) AS d_row, round(d_col, 6) AS d_col FROM diff", _G)
def _(v):
    return raster.second_differences(_grid(v)).select("source", "row_no", "col_no", r6("d_row"), r6("d_col"))


_ROUGH = "sqrt((avg(d_row * d_row) + avg(d_col * d_col)) / 2)"


@query("e12_roughness", f"WITH {_DIFF.format('v_grid')} SELECT source, round({_ROUGH}, 6) AS roughness FROM diff GROUP BY source", _G)
def _(v):
    return raster.roughness(_grid(v)).select("source", r6("roughness"))


_LINEAR = """lin AS (SELECT d.source, avg((abs(d_row) <= 0.02e0 * s.sc AND abs(d_col) <= 0.02e0 * s.sc)::INT) AS linear FROM diff d
 JOIN (SELECT source, quantile_cont(abs(step), 0.5) AS sc FROM diff WHERE step IS NOT NULL GROUP BY source) s ON s.source = d.source
 WHERE d_row IS NOT NULL AND d_col IS NOT NULL GROUP BY d.source)"""


@query("e14_linear_fraction", f"WITH {_DIFF.format('v_grid')}, {_LINEAR} SELECT source, round(linear, 6) AS linear FROM lin", _G)
def _(v):
    return raster.linear_fraction(_grid(v)).select("source", r6("linear"))


_STRETCH = """st AS (SELECT g.source, g.row_no, g.col_no, sum(s.h * (1e0 - abs(g.row_no * 3e0 / 7e0 - s.row_no / 2)) * (1e0 - abs(g.col_no * 3e0 / 7e0 - s.col_no / 2))) AS h
 FROM {0} g JOIN {0} s ON s.source = g.source AND s.row_no % 2 = 0 AND s.col_no % 2 = 0 AND abs(g.row_no * 3e0 / 7e0 - s.row_no / 2) < 1 AND abs(g.col_no * 3e0 / 7e0 - s.col_no / 2) < 1
 GROUP BY g.source, g.row_no, g.col_no)"""
_DETAIL = f"""{_STRETCH}, {_DIFF}, coarse AS (SELECT source, {_ROUGH} AS c FROM (SELECT source, lag(h) OVER r - 2 * h + lead(h) OVER r AS d_row, lag(h) OVER c - 2 * h + lead(h) OVER c AS d_col
 FROM st WINDOW r AS (PARTITION BY source, row_no ORDER BY col_no), c AS (PARTITION BY source, col_no ORDER BY row_no)) x GROUP BY source),
det AS (SELECT d.source, {_ROUGH} / max(c) AS detail FROM diff d JOIN coarse ON coarse.source = d.source GROUP BY d.source)"""


@query("e13_detail_score", f"WITH {_DETAIL.format('v_grid')} SELECT source, round(detail, 6) AS detail FROM det", _G)
def _(v):
    return raster.detail_score(_grid(v)).select("source", r6("detail"))


@query("d08_surface_twin", "SELECT source, TRUE AS same_shape, round(avg(surface_h - h), 6) AS offset_m FROM v_grid GROUP BY source", _G)
def _(v):
    out = raster.surface_offset(_grid(v), _grid(v, "surface_h"))
    return out.select("source", "same_shape", r6("offset_m"))


@query("e15_mean_offset", "SELECT label, round(avg(surface_h - h), 6) AS offset_m FROM v_grid GROUP BY label", _G)
def _(v):
    offset = raster.surface_offset(
        _grid(v), _grid(v, "surface_h")
    ).join(v.embeddings.select(F.col("vec_id").alias("source"), F.col("label").cast("bigint").alias("label")), "source")
    return offset.groupBy("label").agg(F.round(F.avg("offset_m"), 6).alias("offset_m"))


@query("c14_elevation_gates", f"""
WITH {_CLEAN}, {_DETAIL.format('clean')}, {_LINEAR}, s AS (SELECT source, quantile_cont(h, 0.98) - quantile_cont(h, 0.02) AS relief FROM clean GROUP BY source),
n AS (SELECT source, avg(b::INT) AS nodata, max(label) AS label FROM bad GROUP BY source),
o AS (SELECT c.source, avg(g.surface_h - c.h) AS off FROM clean c JOIN v_grid g ON g.source = c.source AND g.row_no = c.row_no AND g.col_no = c.col_no GROUP BY c.source)
SELECT n.source, array_to_string(list_filter([CASE WHEN nodata > 0.05 THEN 'nodata' END, CASE WHEN relief < 20 + n.label THEN 'relief' END, CASE WHEN detail < 1.7 THEN 'detail' END,
  CASE WHEN linear > 0.05 THEN 'linear' END, CASE WHEN off < 1 THEN 'surface' END], lambda x: x IS NOT NULL), '; ') AS failures
FROM n JOIN s ON s.source = n.source JOIN det ON det.source = n.source JOIN lin ON lin.source = n.source JOIN o ON o.source = n.source""", _G)
def _(v):
    """Every gate on every grid, with its surface twin; a compact file of grids is dealt to all tasks."""
    v = v.spread("embeddings", 4 * v.spark.sparkContext.defaultParallelism)
    candidates = v.embeddings.select(
        F.col("vec_id").alias("source"), (F.lit(20.0) + F.col("label")).alias("min_relief_m"), F.lit(1.0).alias("native_resolution_m")
    )
    out = raster.evaluate(_grid(v, "raw_h"), _grid(v, "surface_h"), candidates)
    return out.select("source", F.array_join("failures", "; ").alias("failures"))


@query("f05_slope_normals", """
WITH s AS (SELECT source, row_no, col_no, (coalesce(lead(h) OVER r, h) - coalesce(lag(h) OVER r, h)) / (CASE WHEN col_no IN (0, 7) THEN 1 ELSE 2 END * 30e0) AS dx,
  (coalesce(lead(h) OVER c, h) - coalesce(lag(h) OVER c, h)) / (CASE WHEN row_no IN (0, 7) THEN 1 ELSE 2 END * 20e0) AS dz FROM v_grid
  WINDOW r AS (PARTITION BY source, row_no ORDER BY col_no), c AS (PARTITION BY source, col_no ORDER BY row_no))
SELECT source, row_no, col_no, round(dx, 6) AS dhdx, round(-dx / sqrt(dx * dx + 1 + dz * dz), 6) AS nx, round(1 / sqrt(dx * dx + 1 + dz * dz), 6) AS ny,
  round(-dz / sqrt(dx * dx + 1 + dz * dz), 6) AS nz FROM s""", _G)
def _(v):
    out = raster.slopes(_grid(v), "source", F.lit(30.0), F.lit(20.0))
    return out.select("source", "row_no", "col_no", r6("dhdx"), r6("nx"), r6("ny"), r6("nz"))


@query("e09_height_range", "SELECT source, round(min(h), 6) AS min_m, round(max(h), 6) AS max_m, count(*) AS vertices FROM v_grid GROUP BY source", _G)
def _(v):
    return raster.height_range(_grid(v)).select("source", r6("min_m"), r6("max_m"), "vertices")


# Tiles of 8 x 8 pixels at zoom 6 over Europe, every vector contributing to one of them.
_DEM = """dem AS (SELECT 27 + source % 11 AS tx, 17 + (source // 11) % 10 AS ty, row_no, col_no, avg(h) AS h FROM v_grid GROUP BY ALL)"""


def _dem(v):
    px = v.v_grid.groupBy(
        F.lit(6).cast("bigint").alias("z"), (27 + F.col("source") % 11).alias("x"),
        (17 + F.floor(F.col("source") / 11) % 10).alias("y"), (F.col("row_no") * 8 + F.col("col_no")).alias("i"),
    ).agg(F.avg("h").alias("h"))
    packed = F.transform(F.array_sort(F.collect_list(F.struct("i", "h"))), lambda s: s["h"])
    return px.groupBy("z", "x", "y").agg(packed.alias("heights"))


def _samples(v, n):
    r = tiles.tile_range(*BOX, 6)
    req = v.v_views.withColumns({
        "zoom": F.lit(6).cast("bigint"), "tx0": r["x0"], "tx1": r["x1"], "ty0": r["y0"], "ty1": r["y1"],
    })
    return generate.grid_points(req, n)


@query("d06_resample_bilinear", f"""
WITH {_DEM}, p AS (SELECT view_id, r AS row_no, c AS col_no, ((west + (east - west) * c / 16e0) + 180e0) / 360e0 * 64e0 * 8e0 - 0.5e0 AS fx,
  (1e0 - asinh(tan(radians(north - (north - south) * r / 16e0))) / pi()) / 2e0 * 64e0 * 8e0 - 0.5e0 AS fy,
  floor((west + 180e0) / 360e0 * 64e0) * 8 AS px0, floor((east + 180e0) / 360e0 * 64e0) * 8 + 7 AS px1,
  floor((1e0 - asinh(tan(radians(north))) / pi()) / 2e0 * 64e0) * 8 AS py0, floor((1e0 - asinh(tan(radians(south))) / pi()) / 2e0 * 64e0) * 8 + 7 AS py1
  FROM v_views, (SELECT unnest(range(17)) AS r) a, (SELECT unnest(range(17)) AS c) b),
q AS (SELECT view_id, row_no, col_no, least(px1, greatest(px0, floor(fx) + dx)) AS gx, least(py1, greatest(py0, floor(fy) + dy)) AS gy,
  (CASE dx WHEN 0 THEN 1 - (fx - floor(fx)) ELSE fx - floor(fx) END) * (CASE dy WHEN 0 THEN 1 - (fy - floor(fy)) ELSE fy - floor(fy) END) AS w
  FROM p, (VALUES (0, 0), (1, 0), (0, 1), (1, 1)) o(dx, dy))
SELECT view_id, q.row_no, q.col_no, round(sum(w * coalesce(h, 0)), 6) AS h FROM q LEFT JOIN dem ON tx * 8 + dem.col_no = gx AND ty * 8 + dem.row_no = gy
GROUP BY view_id, q.row_no, q.col_no""", "v_views v_grid")
def _(v):
    out = raster.resample(_samples(v, 17), _dem(v), ["view_id"], 8)
    return out.select("view_id", "row_no", "col_no", r6("h"))


@query("d07_nearest_sample", """
WITH pts AS (SELECT event_id, event_id % 100 AS source, (value * 7 % 700) - 350e0 AS x_m, (value * 3 % 700) - 350e0 AS z_m FROM v_points),
pl AS (SELECT *, CAST(least(7, greatest(0, floor((x_m + 350e0) / 100e0 + 0.5e0))) AS BIGINT) AS c, CAST(least(7, greatest(0, floor((z_m + 350e0) / 100e0 + 0.5e0))) AS BIGINT) AS r FROM pts)
SELECT event_id, r AS row_no, c AS col_no, round(h, 6) AS ground_m FROM pl LEFT JOIN v_grid g ON g.source = pl.source AND g.row_no = r AND g.col_no = c""", "v_points v_grid")
def _(v):
    pts = v.v_points.select(
        "event_id", (F.col("event_id") % 100).alias("source"), (F.col("value") * 7 % 700 - 350.0).alias("x_m"),
        (F.col("value") * 3 % 700 - 350.0).alias("z_m"),
    )
    out = raster.nearest_sample(pts, _grid(v), "source", 8, F.lit(700.0), F.lit(700.0))
    return out.select("event_id", "row_no", "col_no", r6("ground_m"))


@query("e16_image_detail")
def _(v):
    """Detail score of grey pictures made of the documents' bytes, 64 pixels wide."""
    data = F.encode("text", "UTF-8")
    rows = F.floor(F.octet_length(data) / 64).cast("int")
    pics = v.documents.select("doc_id", data.alias("data"), rows.alias("height"))
    # A picture without a full line has no detail.
    tall = pics.where("height > 0").select("doc_id", images.image_detail("height", F.lit(64), F.lit(1), "data").alias("detail"))
    return tall.unionByName(pics.where("height <= 0 OR height IS NULL").select("doc_id", F.lit(0.0).alias("detail")))


@query("a18_storage_inventory", """
SELECT substr(sha256, 1, 2) AS shard, count(*) AS blobs, CAST(sum(strlen(content)) AS BIGINT) AS bytes, true AS listed
FROM (SELECT sha256, any_value(content) AS content FROM v_blobs WHERE sha256 IS NOT NULL GROUP BY sha256) b GROUP BY 1""", "v_blobs")
def _(v):
    """Blobs and bytes per folder, read back from a store written by this job, and whether the listing has the folder."""
    path = work_dir(v.spark, "store")
    corpus.write_blobs(v.v_blobs.where("sha256 IS NOT NULL").select("sha256", "content").dropDuplicates(["sha256"]), path)
    held = v.spark.read.parquet(path).select(F.substring("sha256", 1, 2).alias("shard"), F.octet_length("content").alias("size"))
    held = held.groupBy("shard").agg(F.count("*").alias("blobs"), F.sum("size").alias("bytes"))
    listed = corpus.storage_inventory(v.spark, path).where("files > 0 AND file_bytes > 0").select("shard", F.lit(True).alias("listed"))
    return held.join(listed, "shard", "full").select("shard", "blobs", "bytes", F.coalesce("listed", F.lit(False)).alias("listed"))
