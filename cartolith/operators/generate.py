"""Row generators: tiles and cells of boxes, work items, grid points, triangles, dots.

Every generator explodes ranges inside the executors. A continental box is one input row
that stands for billions of tiles, so ranges are cut into blocks first and the blocks are
dealt over the cluster before the inner explode. ``spread`` is the number of tasks they
are dealt to (by default four for every core); 0 leaves rows where they are, for boxes
that are known to be small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartolith import constants as K
from cartolith.functions import geohash, tiles

#: Tiles along each side of a block, which one task expands.
BLOCK = 256


def _blocks(lo: Column, hi: Column) -> Column:
    """Start of each block of an inclusive range; no block for an empty one."""
    none = F.array().cast("array<bigint>")
    return F.when(hi >= lo, F.sequence(lo, hi, F.lit(BLOCK).cast("bigint"))).otherwise(none)


def _grid_rows(df: DataFrame, x0, x1, y0, y1, names: tuple[str, str], spread: int | None) -> DataFrame:
    a, b = names
    out = df.withColumns({"_x0": x0, "_x1": x1, "_y0": y0, "_y1": y1})
    out = out.withColumn("_bx", F.explode(_blocks(F.col("_x0"), F.col("_x1"))))
    out = out.withColumn("_by", F.explode(_blocks(F.col("_y0"), F.col("_y1"))))
    tasks = 4 * df.sparkSession.sparkContext.defaultParallelism if spread is None else spread
    if tasks:
        out = out.repartition(tasks)
    last_x = F.least(F.col("_bx") + (BLOCK - 1), F.col("_x1"))
    last_y = F.least(F.col("_by") + (BLOCK - 1), F.col("_y1"))
    out = out.withColumn(a, F.explode(F.sequence(F.col("_bx"), last_x)))
    out = out.withColumn(b, F.explode(F.sequence(F.col("_by"), last_y)))
    return out.drop("_x0", "_x1", "_y0", "_y1", "_bx", "_by")


def box_tiles(df: DataFrame, zoom="z", box=("west", "south", "east", "north"), spread: int | None = None):
    """One row per tile touching each row's box at ``zoom`` (a column or a number)."""
    z = F.col(zoom) if isinstance(zoom, str) else F.lit(zoom)
    r = tiles.tile_range(*box, z)
    xs = F.least(r["x0"], r["x1"]), F.greatest(r["x0"], r["x1"])
    ys = F.least(r["y0"], r["y1"]), F.greatest(r["y0"], r["y1"])
    return _grid_rows(df, *xs, *ys, ("x", "y"), spread)


def box_cells(df: DataFrame, precision: int, box=("west", "south", "east", "north"), spread: int | None = None):
    """One row per geohash cell touching each row's box, with its lattice index."""
    r = geohash.cover_range(*box, precision)
    rows = _grid_rows(df, r["ix0"], r["ix1"], r["iy0"], r["iy1"], ("ix", "iy"), spread)
    return rows.withColumn("cell", geohash.cell_hash("ix", "iy", precision))


def with_literals(df: DataFrame, name: str, values) -> DataFrame:
    """Each row once per value of a fixed list: a cross product with no join."""
    return df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))


def work_items(regions: DataFrame, zooms=(13,), kinds=tuple(K.KIND_PRIORITY), spread: int | None = None):
    """Queue rows for every kind, zoom and tile of each region's box."""
    rows = with_literals(with_literals(regions, "kind", kinds), "z", [int(z) for z in zooms])
    rows = box_tiles(rows.withColumn("z", F.col("z").cast("bigint")), "z", spread=spread)
    return rows.select("region", "kind", "z", "x", "y")


def grid_points(requests: DataFrame, grid_n: int) -> DataFrame:
    """Sample points of each request's box, row 0 north, column 0 west."""
    n = F.lit(grid_n - 1).cast("bigint")
    rows = requests.withColumn("row_no", F.explode(F.sequence(F.lit(0).cast("bigint"), n)))
    rows = rows.withColumn("col_no", F.explode(F.sequence(F.lit(0).cast("bigint"), n)))
    step = float(grid_n - 1)
    return rows.withColumns({
        "lat": F.col("north") - (F.col("north") - F.col("south")) * F.col("row_no") / step,
        "lon": F.col("west") + (F.col("east") - F.col("west")) * F.col("col_no") / step,
    })


def triangles(grids: DataFrame, grid_n: int, key: str) -> DataFrame:
    """Two triangles per grid cell, counter-clockwise from above, as vertex numbers."""
    n = F.lit(grid_n - 2).cast("bigint")
    zero = F.lit(0).cast("bigint")
    cells = grids.select(key).withColumn("row_no", F.explode(F.sequence(zero, n)))
    cells = cells.withColumn("col_no", F.explode(F.sequence(zero, n)))
    a = F.col("row_no") * grid_n + F.col("col_no")
    b, d, e = a + 1, a + grid_n, a + grid_n + 1

    def triple(i, p, q, r):
        return F.struct(F.lit(i).alias("half"), p.alias("a"), q.alias("b"), r.alias("c"))

    halves = F.explode(F.array(triple(0, a, d, b), triple(1, b, d, e)))
    return cells.withColumn("t", halves).select(key, "row_no", "col_no", "t.half", "t.a", "t.b", "t.c")


def globe_dots(spark, step: float = 1.8, south: float = -58.0, north: float = 78.0) -> DataFrame:
    """Dot grid whose longitude stride grows towards the poles."""
    n_rows = int((north - south) / step + 1e-9) + 1
    rows = spark.range(n_rows).select((F.lit(south) + F.col("id") * step).alias("lat"))
    stride = F.lit(step) / F.greatest(F.lit(0.25), F.cos(F.radians(F.col("lat"))))
    count = F.ceil(F.lit(360.0) / stride).cast("bigint")
    return rows.withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), count - 1))).select(
        (F.lit(-180.0) + F.col("i") * stride).alias("lon"), "lat"
    )
