"""Spatial joins.

Spark has no range join, so every box relation here is turned into an equi-join on grid
cells. Boxes live on the grid level whose cells are as large as they are, which bounds a
box to four cells of its own level whatever its size; it also appears in the coarser
levels the other side really uses. A pair is reported only in the cell that holds the
lower-left corner of its intersection, so no ``distinct`` is needed afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartolith.functions import boxes
from cartolith.functions._c import c

LEVELS = tuple(range(0, 17))


def _size(level) -> Column:
    return F.lit(360.0) / F.pow(F.lit(2.0), c(level).cast("double"))


def grid_level(west, south, east, north) -> Column:
    """Finest level whose cell is at least as large as the box."""
    extent = F.greatest(c(east) - c(west), c(north) - c(south))
    chain = None
    for level in reversed(LEVELS[1:]):
        test = extent <= 360.0 / 2**level
        chain = F.when(test, level) if chain is None else chain.when(test, level)
    return chain.otherwise(0).cast("int")


def _cell(value, origin: float, level) -> Column:
    return F.floor((c(value) + origin) / _size(level)).cast("bigint")


def _levels_of(df: DataFrame, box) -> Column:
    """Levels in use as one array value: a scalar subquery of at most seventeen numbers."""
    used = df.select(grid_level(*box).alias("l")).distinct()
    return used.agg(F.collect_set("l")).scalar()


def _spread(df: DataFrame, box, used_by_other: Column, mark: str, level=grid_level) -> DataFrame:
    """Rows repeated per grid cell: own level, and coarser levels the other side lives on."""
    w, s, e, n = box
    rows = df.withColumns({"_own": level(*box), "_used": used_by_other})
    rows = rows.withColumn("_lvl", F.explode(F.array_union("_used", F.array("_own"))))
    rows = rows.where(F.col("_lvl") <= F.col("_own")).drop("_used")
    rows = rows.withColumn(
        "_cx", F.explode(F.sequence(_cell(w, 180.0, "_lvl"), _cell(e, 180.0, "_lvl")))
    ).withColumn("_cy", F.explode(F.sequence(_cell(s, 90.0, "_lvl"), _cell(n, 90.0, "_lvl"))))
    return rows.withColumn(mark, F.col("_lvl") == F.col("_own")).drop("_own")


def box_join(
    left: DataFrame,
    right: DataFrame,
    left_box: tuple[str, str, str, str],
    right_box: tuple[str, str, str, str],
    closed: bool = False,
    condition: Column | None = None,
    hint: str | None = None,
) -> DataFrame:
    """Pairs of rows whose boxes overlap, each pair once.

    ``closed`` also pairs boxes that only touch, which points need (a point is a box of
    no size). ``condition`` is an exact test on top of the box test. Column names of the
    two inputs must differ. ``hint`` is a join hint for the right side: ``"merge"`` spreads the
    pair tests of two dense inputs over the shuffle even where one side would fit a broadcast.
    """
    a = _spread(left, left_box, _levels_of(right, right_box), "_a_own")
    b = _spread(right, right_box, _levels_of(left, left_box), "_b_own")
    b = b.withColumnsRenamed({"_lvl": "_blvl", "_cx": "_bcx", "_cy": "_bcy"})
    lw, ls, le, ln = (F.col(v) for v in left_box)
    rw, rs, re, rn = (F.col(v) for v in right_box)
    if closed:
        overlap = (lw <= re) & (le >= rw) & (ls <= rn) & (ln >= rs)
    else:
        overlap = boxes.overlaps((lw, ls, le, ln), (rw, rs, re, rn))
    on = (
        (F.col("_lvl") == F.col("_blvl"))
        & (F.col("_cx") == F.col("_bcx"))
        & (F.col("_cy") == F.col("_bcy"))
        & (F.col("_a_own") | F.col("_b_own"))
        & overlap
        & (F.col("_cx") == _cell(F.greatest(lw, rw), 180.0, "_lvl"))
        & (F.col("_cy") == _cell(F.greatest(ls, rs), 90.0, "_lvl"))
    )
    if condition is not None:
        on = on & condition
    if hint is not None:
        b = b.hint(hint)
    return a.join(b, on).select(*left.columns, *right.columns)


def point_box_join(points: DataFrame, shapes: DataFrame, box, lon="lon", lat="lat", condition=None):
    """Points inside boxes (edges included)."""
    return box_join(points, shapes, (lon, lat, lon, lat), box, closed=True, condition=condition)


# --- polygons -----------------------------------------------------------------------


def ring_box(ring) -> Column:
    """Bounding box of a ring."""
    ring = c(ring)

    def edge(pick, field):
        return pick(F.transform(ring, lambda p: p[field]))

    return F.struct(
        edge(F.array_min, "lon").alias("west"), edge(F.array_min, "lat").alias("south"),
        edge(F.array_max, "lon").alias("east"), edge(F.array_max, "lat").alias("north"),
    )


def crossings(ring, lon, lat) -> Column:
    """How many edges of a ring a ray to the east of the point crosses."""
    ring, lon, lat = c(ring), c(lon), c(lat)
    n = F.size(ring)

    def crosses(i):
        p = F.get(ring, i)
        q = F.get(ring, F.when(i == 0, n - 1).otherwise(i - 1))
        at = F.try_divide((q["lon"] - p["lon"]) * (lat - p["lat"]), q["lat"] - p["lat"]) + p["lon"]
        return ((p["lat"] > lat) != (q["lat"] > lat)) & (lon < at)

    edges = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.size(F.filter(edges, crosses))


def inside_polygon(rings, lon, lat) -> Column:
    """Even-odd test over all rings of a polygon, so holes need no special case."""
    total = F.aggregate(c(rings), F.lit(0), lambda acc, ring: acc + crossings(ring, lon, lat))
    return total % 2 == 1


def inside_any(polygons, lon, lat) -> Column:
    """Test against a multi-polygon (array of polygons)."""
    return F.exists(c(polygons), lambda rings: inside_polygon(rings, lon, lat))


def multi_polygon_box(polygons) -> Column:
    """Bounding box over every ring of a multi-polygon."""
    points = F.flatten(F.flatten(c(polygons)))
    return ring_box(points)


#: Cells that hold an edge also take edges this near to them (degrees), so that rounding never moves an edge.
_PAD = 1e-9
#: Finest grid of a polygon cover; every second level is used, so that points meet few levels.
_FINEST = 28


def _cover_level(box, n_edges: Column) -> Column:
    """Grid level on which a polygon of ``n_edges`` is at most four times the root of that number of cells wide."""
    extent = F.greatest(box["east"] - box["west"], box["north"] - box["south"], F.lit(1e-12))
    level = F.floor(F.log2(360.0 * 4 * F.sqrt(n_edges.cast("double")) / extent))
    return (F.floor(F.least(F.greatest(level, F.lit(0)), F.lit(_FINEST)) / 2) * 2).cast("int")


def _ring_edges(ring: Column) -> Column:
    """Every vertex (x1, y1) with the one before it (x2, y2); the first follows the last."""
    def edge(p, i):
        q = F.get(ring, F.when(i == 0, F.size(ring) - 1).otherwise(i - 1))
        return F.struct(p["lon"].alias("x1"), p["lat"].alias("y1"), q["lon"].alias("x2"), q["lat"].alias("y2"))

    return F.transform(ring, edge)


def _leveled(shapes: DataFrame, rings: str) -> DataFrame:
    """Distinct multi-ring outlines: ``_poly`` (a digest of the rings), their edges and ``_lvl``."""
    whole = ~F.exists(F.col(rings), lambda r: r.isNull() | F.exists(r, lambda p: F.coalesce(F.isnan(p["lon"] + p["lat"]), F.lit(True))))
    rows = shapes.where(whole).withColumn("_e", F.flatten(F.transform(F.col(rings), _ring_edges))).where(F.size("_e") > 0)
    box = ring_box(F.flatten(F.col(rings)))
    return rows.select("_poly", _cover_level(box, F.size("_e")).alias("_lvl"), "_e")


def _columns_of_row(row: Column) -> tuple[Column, Column]:
    """First and last column that edge ``_edge`` reaches in a row of cells."""
    x1, y1, x2, y2 = (F.col("_edge")[n] for n in ("x1", "y1", "x2", "y2"))
    low, high = F.least(x1, x2), F.greatest(x1, x2)

    def at(y):
        y = F.least(F.greatest(y, F.least(y1, y2)), F.greatest(y1, y2))
        return F.least(F.greatest((x2 - x1) * F.try_divide(y - y1, y2 - y1) + x1, low), high)

    south, north = at(row * F.col("_size") - 90.0 - _PAD), at((row + 1) * F.col("_size") - 90.0 + _PAD)
    flat = y1 == y2
    west = F.when(flat, low).otherwise(F.least(south, north))
    east = F.when(flat, high).otherwise(F.greatest(south, north))
    return _cell(west - _PAD, 180.0, "_lvl"), _cell(east + _PAD, 180.0, "_lvl")


def polygon_cover(outlines: DataFrame) -> DataFrame:
    """Cells of each outline: (_poly, _lvl, _cx, _cy, _odd, _edges).

    Border cells carry the edges that reach them, inner cells none. ``_odd`` says whether a ray to the north from the
    cell's north-east corner crosses an odd number of edges that the cell does not carry; inner cells are odd. A task
    sees one column of one outline at most, of as many cells as the grid of that outline is high.
    """
    edges = outlines.select("_poly", "_lvl", _size("_lvl").alias("_size"), F.explode("_e").alias("_edge"))
    y1, y2 = F.col("_edge.y1"), F.col("_edge.y2")
    first = _cell(F.least(y1, y2) - _PAD, 90.0, "_lvl")
    rows = edges.withColumn("_first", first)
    rows = rows.withColumn("_cy", F.explode(F.sequence("_first", _cell(F.greatest(y1, y2) + _PAD, 90.0, "_lvl"))))
    a, b = _columns_of_row(F.col("_cy"))
    c0, c1 = _columns_of_row(F.col("_cy") - 1)
    rows = rows.withColumn("_below", F.when(F.col("_cy") > F.col("_first"), F.struct(c0.alias("a"), c1.alias("b"))))
    rows = rows.withColumn("_cx", F.explode(F.sequence(a, b)))
    # The lowest cell of a column that an edge reaches, if the edge passes the column's east side.
    lowest = F.col("_below").isNull() | ~F.col("_cx").between(F.col("_below.a"), F.col("_below.b"))
    east = (F.col("_cx") + 1) * F.col("_size") - 180.0
    passes = (F.col("_edge.x1") > east) != (F.col("_edge.x2") > east)
    border = rows.groupBy("_poly", "_lvl", "_cx", "_cy").agg(
        F.collect_list("_edge").alias("_edges"), F.count(F.when(lowest & passes, 1)).alias("_starts")
    )
    column = Window.partitionBy("_poly", "_lvl", "_cx").orderBy(F.desc("_cy"))
    border = border.withColumns({
        "_above": F.coalesce(F.sum("_starts").over(column.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "_next": F.lead("_cy").over(column),
    })
    filled = (F.col("_next") < F.col("_cy") - 1) & ((F.col("_above") + F.col("_starts")) % 2 == 1)
    inner = F.when(filled, F.sequence(F.col("_next") + 1, F.col("_cy") - 1)).otherwise(F.array().cast("array<bigint>"))
    cells = border.withColumn("_y", F.explode(F.concat(F.array("_cy"), inner)))
    is_border = F.col("_y") == F.col("_cy")
    return cells.select(
        "_poly", "_lvl", "_cx", F.col("_y").alias("_cy"), F.when(is_border, F.col("_above") % 2 == 1).otherwise(True).alias("_odd"),
        F.when(is_border, F.col("_edges")).otherwise(F.slice("_edges", 1, 0)).alias("_edges"),
    )


def _inside_cell(lon, lat) -> Column:
    """Even-odd test by the edges of the point's cell: the ray goes east to the cell's side and then north."""
    lon, lat = c(lon), c(lat)
    east = (F.col("_cx") + 1) * _size("_lvl") - 180.0

    def odd(e):
        straddles = (e["y1"] > lat) != (e["y2"] > lat)
        at = F.try_divide((e["x2"] - e["x1"]) * (lat - e["y1"]), e["y2"] - e["y1"]) + e["x1"]
        first, second = (e["x1"] > east) & (e["y1"] > lat), (e["x2"] > east) & (e["y2"] > lat)
        return F.coalesce(straddles & (lon < at), F.lit(False)) != (first != second)

    return ((F.size(F.filter("_edges", odd)) % 2) == 1) != F.col("_odd")


def points_in_polygons(points: DataFrame, shapes: DataFrame, rings: str = "rings", lon="lon", lat="lat"):
    """Point rows joined to the polygons that hold them, by the even-odd rule over all rings.

    Polygons become cells: points of an inner cell need no test, those of a border cell meet only the edges that reach
    the cell. The result is that of `inside_polygon` to the last bit. Outlines that many shapes share are covered once.
    A polygon with a null ring or vertex holds no point, nor does one without vertices; a null position lies nowhere.
    """
    digest = F.sha2(F.to_json(F.struct(F.col(rings).alias("r"))), 256)
    keyed = shapes.withColumn("_poly", digest)
    outlines = _leveled(keyed.select("_poly", rings).dropDuplicates(["_poly"]), rings)
    used = _leveled(keyed, rings).select("_lvl").distinct().agg(F.collect_set("_lvl")).scalar()
    cells = polygon_cover(outlines).join(keyed, "_poly")
    cells = cells.withColumnsRenamed({"_lvl": "_clvl", "_cx": "_ccx", "_cy": "_ccy"})
    at = points.withColumn("_lvl", F.explode(used))
    at = at.withColumn("_cx", _cell(lon, 180.0, "_lvl")).withColumn("_cy", _cell(lat, 90.0, "_lvl"))
    on = [F.col("_lvl") == F.col("_clvl"), F.col("_cx") == F.col("_ccx"), F.col("_cy") == F.col("_ccy")]
    met = at.join(cells, on)
    return met.where(_inside_cell(lon, lat)).select(*points.columns, *shapes.columns)


# --- containment in a fixed list --------------------------------------------------------


def first_container(regions: dict[str, tuple], box, default: str, skip=()) -> Column:
    """First region of a declared list that holds a box, else the default.

    The list is a constant of the program, so this is a projection and not a join.
    """
    chain = None
    for name, outer in regions.items():
        if name == default or name in skip:
            continue
        test = boxes.contains_box(outer, box)
        chain = F.when(test, name) if chain is None else chain.when(test, name)
    return F.lit(default) if chain is None else chain.otherwise(default)


# --- cell tags ------------------------------------------------------------------------


def cover_join(views: DataFrame, tagged: DataFrame, precision: int, cell: str, view_box=boxes.EDGES):
    """Rows whose cell tag lies in the cover of a view, by equi-join on the cell.

    Coarse: callers refine with the exact position. The cover of each view is exploded in
    the executors, and a cell held by a third of all rows is split by AQE's skew join,
    since the view side of that cell is small enough to be repeated.
    """
    from cartolith.operators.generate import box_cells

    covered = box_cells(views, precision, view_box).drop("ix", "iy").withColumnRenamed("cell", "_cell")
    return tagged.join(covered, F.col(cell) == F.col("_cell")).drop("_cell")
