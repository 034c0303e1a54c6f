"""Elevation grids: resampling, slopes and the statistics that qualify a source.

A grid is a long table (key, row_no, col_no, h). Neighbours along a row or a column come
from windows over one row or one column, never over a whole grid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cartolith.functions import gates, tiles
from cartolith.functions._c import c
from cartolith.operators.quantiles import exact_quantiles
from cartolith.session import cut_lineage


# --- resampling -------------------------------------------------------------------------


def height_from_bgr(data, offset: Column) -> Column:
    """Elevation of a pixel in packed blue-green-red bytes; ``offset`` counts pixels."""
    def byte(i):
        return F.conv(F.hex(F.substring(c(data), (offset * 3 + i + 1).cast("int"), F.lit(1))), 16, 10).cast("int")

    return tiles.elevation_from_rgb(byte(2), byte(1), byte(0))


def height_from_array(heights, offset: Column) -> Column:
    return F.get(c(heights), offset.cast("int"))


def resample(points: DataFrame, dem: DataFrame, key: list[str], size: int, height=height_from_array,
             payload: str = "heights") -> DataFrame:
    """Bilinear heights at sample points, across tile seams.

    ``points``: key, row_no, col_no, lon, lat, zoom and the loaded tile rectangle
    (tx0, tx1, ty0, ty1), to which pixels are clamped. ``dem``: z, x, y and a payload read
    by ``height``. A missing tile counts as zero. Each point joins the one to four tiles
    its pixels fall in and takes all its pixels of a tile in that one row.
    """
    fx = tiles.lon_to_x("lon", "zoom") * size - 0.5
    fy = tiles.lat_to_y("lat", "zoom") * size - 0.5
    rows = points.withColumns({"_fx": fx, "_fy": fy})
    px, py = F.floor("_fx"), F.floor("_fy")
    rx, ry = F.col("_fx") - px, F.col("_fy") - py

    def clamp(p, lo, hi):
        return F.least(F.greatest(p, F.col(lo) * size), (F.col(hi) + 1) * size - 1)

    def pixel(dx, dy, weight):
        gx, gy = clamp(px + dx, "tx0", "tx1"), clamp(py + dy, "ty0", "ty1")
        return F.struct(
            F.floor(gx / size).alias("tx"), F.floor(gy / size).alias("ty"),
            ((gy % size) * size + gx % size).alias("at"), weight.alias("w"),
        )

    corners = F.array(
        pixel(0, 0, (1 - rx) * (1 - ry)), pixel(1, 0, rx * (1 - ry)),
        pixel(0, 1, (1 - rx) * ry), pixel(1, 1, rx * ry),
    )
    rows = rows.withColumn("_corners", corners)
    rows = rows.withColumn(
        "_t", F.explode(F.array_distinct(F.transform("_corners", lambda k: F.struct(k["tx"], k["ty"]))))
    )
    rows = rows.withColumns({"_tx": F.col("_t.tx"), "_ty": F.col("_t.ty")})
    here = F.filter("_corners", lambda k: (k["tx"] == F.col("_tx")) & (k["ty"] == F.col("_ty")))
    rows = rows.select(*key, "row_no", "col_no", "zoom", "_tx", "_ty", here.alias("_here"))
    on = (F.col("zoom") == F.col("z")) & (F.col("_tx") == F.col("x")) & (F.col("_ty") == F.col("y"))
    joined = rows.join(dem.select("z", "x", "y", payload), on, "left")
    part = F.aggregate(
        "_here", F.lit(0.0), lambda acc, k: acc + k["w"] * F.coalesce(height(payload, k["at"]), F.lit(0.0))
    )
    return joined.groupBy(*key, "row_no", "col_no").agg(F.sum(part).alias("h"))


def nearest_sample(vertices: DataFrame, grid: DataFrame, key: str, grid_n: int, width_m, depth_m) -> DataFrame:
    """Height of the nearest grid point under local positions ``x_m``, ``z_m``."""
    def index(value, extent):
        at = tiles.half_up((c(value) + c(extent) / 2.0) / (c(extent) / (grid_n - 1)))
        return F.least(F.greatest(at, F.lit(0)), F.lit(grid_n - 1)).cast("bigint")

    placed = vertices.withColumns({"row_no": index("z_m", depth_m), "col_no": index("x_m", width_m)})
    return placed.join(grid.select(key, "row_no", "col_no", F.col("h").alias("ground_m")), [key, "row_no", "col_no"], "left")


# --- neighbours ----------------------------------------------------------------------------


def _along(key: str):
    row = W.partitionBy(key, "row_no").orderBy("col_no")
    column = W.partitionBy(key, "col_no").orderBy("row_no")
    return row, column


def second_differences(grid: DataFrame, key: str = "source", h: str = "h") -> DataFrame:
    """Curvature along the row (``d_row``) and the column (``d_col``), null at the rim."""
    row, column = _along(key)
    v = F.col(h)
    return grid.withColumns({
        "d_row": F.lag(v).over(row) - 2 * v + F.lead(v).over(row),
        "step": F.lead(v).over(row) - v,
        "d_col": F.lag(v).over(column) - 2 * v + F.lead(v).over(column),
    })


def slopes(grid: DataFrame, key: str, step_x, step_z, exaggeration: float = 1.0, h: str = "h") -> DataFrame:
    """Slope and unit normal by central differences, one-sided at the rim."""
    row, column = _along(key)
    v = F.col(h)

    def gradient(window, step):
        before, after = F.lag(v).over(window), F.lead(v).over(window)
        steps = before.isNotNull().cast("int") + after.isNotNull().cast("int")
        return F.when(steps > 0, (F.coalesce(after, v) - F.coalesce(before, v)) / (steps * c(step)) * exaggeration).otherwise(0.0)

    out = grid.withColumns({"dhdx": gradient(row, step_x), "dhdz": gradient(column, step_z)})
    length = F.sqrt(F.col("dhdx") * F.col("dhdx") + 1.0 + F.col("dhdz") * F.col("dhdz"))
    return out.withColumns({"nx": -F.col("dhdx") / length, "ny": 1.0 / length, "nz": -F.col("dhdz") / length})


# --- statistics -----------------------------------------------------------------------------


def height_range(grid: DataFrame, keys=("source",)) -> DataFrame:
    return grid.groupBy(*keys).agg(F.min("h").alias("min_m"), F.max("h").alias("max_m"), F.count("*").alias("vertices"))


def clean(grid: DataFrame, key: str = "source", h: str = "h") -> tuple[DataFrame, DataFrame]:
    """(grid with bad samples replaced by the median, nodata fraction per grid).

    A grid with nothing valid becomes all zeros with a fraction of one.
    """
    marked = grid.withColumn("_bad", gates.elevation_bad(h))
    fraction = marked.groupBy(key).agg(F.avg(F.col("_bad").cast("double")).alias("nodata"))
    median = exact_quantiles(marked.where("NOT _bad"), [key], h, {"_median": 0.5})
    filled = marked.join(median, key, "left").withColumn(
        h, F.when(F.col("_bad"), F.coalesce("_median", F.lit(0.0))).otherwise(F.col(h))
    )
    return filled.drop("_bad", "_median"), fraction


def relief(grid: DataFrame, key: str = "source", h: str = "h") -> DataFrame:
    """Robust vertical range: 98th minus 2nd percentile."""
    q = exact_quantiles(grid, [key], h, {"_lo": 0.02, "_hi": 0.98})
    return q.select(key, (F.col("_hi") - F.col("_lo")).alias("relief_m"))


def roughness(grid: DataFrame, key: str = "source", h: str = "h") -> DataFrame:
    """RMS second difference over both axes; zero for a grid narrower than three."""
    d = second_differences(grid, key, h)
    mean = (F.avg(F.col("d_row") * F.col("d_row")) + F.avg(F.col("d_col") * F.col("d_col"))) / 2.0
    return d.groupBy(key).agg(F.coalesce(F.sqrt(mean), F.lit(0.0)).alias("roughness"))


def linear_fraction(grid: DataFrame, key: str = "source", h: str = "h") -> DataFrame:
    """Share of inner samples on a straight line between their neighbours, on both axes."""
    d = second_differences(grid, key, h)
    scale = exact_quantiles(d.select(key, F.abs("step").alias("step")), [key], "step", {"_scale": 0.5})
    # ``left`` keeps grids without any step: a constant plane counts as fully linear.
    joined = d.where(F.col("d_row").isNotNull() & F.col("d_col").isNotNull()).join(scale, key, "left")
    limit = 0.02 * F.col("_scale")
    straight = (F.abs("d_row") <= limit) & (F.abs("d_col") <= limit)
    counted = joined.groupBy(key).agg(
        F.when(F.max("_scale") > 0, F.avg(straight.cast("double"))).otherwise(1.0).alias("linear")
    )
    every = grid.select(key).distinct().join(counted, key, "left")
    return every.withColumn("linear", F.coalesce("linear", F.lit(1.0)))


def stretched(grid: DataFrame, key: str = "source", h: str = "h") -> DataFrame:
    """Every second sample of a grid, stretched back bilinearly to its full size."""
    shape = grid.groupBy(key).agg((F.max("row_no") + 1).alias("_r"), (F.max("col_no") + 1).alias("_c"))
    small = grid.where((F.col("row_no") % 2 == 0) & (F.col("col_no") % 2 == 0)).select(
        F.col(key).alias("_k"), (F.col("row_no") / 2).cast("bigint").alias("_sr"),
        (F.col("col_no") / 2).cast("bigint").alias("_sc"), F.col(h).alias("_h"),
    )
    t = grid.select(key, "row_no", "col_no").join(shape, key)

    def place(n, i):
        last = F.floor((F.col(n) - 1) / 2)
        at = F.try_divide(F.col(i) * last, F.col(n) - 1)
        at = F.coalesce(at, F.lit(0.0))
        return F.floor(at), F.least(F.floor(at) + 1, last), at - F.floor(at)

    (y0, y1, fy), (x0, x1, fx) = place("_r", "row_no"), place("_c", "col_no")
    corner = lambda a, b, w: F.struct(a.alias("sr"), b.alias("sc"), w.alias("w"))
    four = F.array(
        corner(y0, x0, (1 - fy) * (1 - fx)), corner(y0, x1, (1 - fy) * fx),
        corner(y1, x0, fy * (1 - fx)), corner(y1, x1, fy * fx),
    )
    t = t.withColumn("_q", F.explode(F.filter(four, lambda q: q["w"] > 0)))
    on = (F.col(key) == F.col("_k")) & (F.col("_q.sr") == F.col("_sr")) & (F.col("_q.sc") == F.col("_sc"))
    return t.join(small, on).groupBy(key, "row_no", "col_no").agg(F.sum(F.col("_q.w") * F.col("_h")).alias(h))


def detail_score(grid: DataFrame, key: str = "source", h: str = "h") -> DataFrame:
    """Fine roughness over the roughness left after a decimate-and-stretch round trip."""
    shape = grid.groupBy(key).agg(F.least(F.max("row_no"), F.max("col_no")).alias("_last"))
    fine = roughness(grid, key, h).withColumnRenamed("roughness", "_fine")
    coarse = roughness(stretched(grid, key, h), key, h).withColumnRenamed("roughness", "_coarse")
    out = shape.join(fine, key).join(coarse, key)
    ok = (F.col("_last") >= 7) & (F.col("_coarse") > 0)
    return out.select(key, F.when(ok, F.col("_fine") / F.col("_coarse")).otherwise(0.0).alias("detail"))


def surface_offset(terrain: DataFrame, surface: DataFrame, key: str = "source") -> DataFrame:
    """Mean height of a surface twin above the terrain; null offset when shapes differ."""
    a = terrain.select(key, "row_no", "col_no", F.col("h").alias("_t"))
    b = surface.select(key, "row_no", "col_no", F.col("h").alias("_s"))
    both = a.join(b, [key, "row_no", "col_no"], "full_outer")
    same = F.bool_and(F.col("_t").isNotNull() & F.col("_s").isNotNull())
    return both.groupBy(key).agg(
        same.alias("same_shape"), F.when(same, F.avg(F.col("_s") - F.col("_t"))).alias("offset_m")
    )


def evaluate(grid: DataFrame, surface: DataFrame | None, candidates: DataFrame, key: str = "source") -> DataFrame:
    """All gates for every elevation grid: statistics, failures and a verdict.

    ``candidates``: key, min_relief_m, native_resolution_m.
    """
    filled, nodata = clean(grid, key)
    # Five statistics read the cleaned grid: write it once instead of cleaning it five times.
    filled = cut_lineage(filled.select(key, "row_no", "col_no", "h"), "clean-grid")
    out = candidates.join(nodata, key)
    for part in (relief, detail_score, linear_fraction):
        out = out.join(part(filled, key), key)
    shape_failure = F.array().cast("array<string>")
    offset = None
    if surface is not None:
        twin, _ = clean(surface, key)
        out = out.join(surface_offset(filled, twin, key), key, "left")
        offset = "offset_m"
        shape_failure = F.when(~F.col("same_shape"), F.array(F.lit("shape"))).otherwise(shape_failure)
    failures = F.concat(
        gates.elevation_failures("nodata", "relief_m", "min_relief_m", "detail", "linear", offset), shape_failure
    )
    out = out.withColumn("failures", failures)
    return out.withColumn("verdict", gates.elevation_verdict("failures", "native_resolution_m"))
