"""Map features: layers of ways, segments, ribbons, patches and buildings.

A feature keeps its vertices in one array, so everything per vertex is an array
expression on the row: no window and no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartolith import constants as K
from cartolith.functions import osm, tiles
from cartolith.functions._c import c, let

SNAP_M = 1e-6


# --- layers ---------------------------------------------------------------------------------


def layers(ways: DataFrame, profile: str = "full") -> DataFrame:
    """Ways as typed features; the first matching layer wins.

    ``ways``: type, tags (map), geometry (array of lat, lon). ``profile="tile"`` leaves out
    waterways and leisure areas, as feature tiles do.
    """
    t = lambda key: osm.tag("tags", key)
    full = profile == "full"
    points = F.transform(
        F.filter(F.coalesce("geometry", F.array().cast("array<struct<lat:double,lon:double>>")),
                 lambda p: p["lat"].isNotNull() & p["lon"].isNotNull()),
        lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat")),
    )
    kind = F.when(t("building").isNotNull(), "building").when(t("highway").isNotNull(), "road")
    if full:
        kind = kind.when(t("waterway").isNotNull(), "waterway")
    kind = kind.otherwise("landuse")
    name = (
        F.when(F.col("layer") == "road", osm.road_class(t("highway")))
        .when(F.col("layer") == "waterway", osm.waterway_class(t("waterway")))
        .when(F.col("layer") == "landuse", osm.landuse_class(t("landuse"), t("natural"), t("leisure") if full else None))
    )
    rows = ways.where(F.col("type") == "way").withColumns({"layer": kind, "line": points})
    rows = rows.withColumns({
        "class": name,
        "height_m": F.when(F.col("layer") == "building", osm.building_height(t("height"), t("building:levels"))),
    })
    area = F.col("layer").isin("building", "landuse")
    enough = F.size("line") >= F.when(area, 3).otherwise(2)
    return rows.where(enough & ((F.col("layer") == "building") | F.col("class").isNotNull())).drop("type", "tags", "geometry")


def building_ways(ways: DataFrame) -> DataFrame:
    """Ways of a buildings-only answer: every ring counts, tagged or not."""
    points = F.transform(
        F.filter("geometry", lambda p: p["lat"].isNotNull() & p["lon"].isNotNull()),
        lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat")),
    )
    rows = ways.where((F.col("type") == "way") & F.col("geometry").isNotNull()).withColumn("line", points)
    height = osm.building_height(osm.tag("tags", "height"), osm.tag("tags", "building:levels"))
    return rows.where(F.size("line") >= 3).withColumn("height_m", height).drop("type", "tags", "geometry")


def selected_ways(ways: DataFrame, keys=("building", "highway", "landuse", "natural")) -> DataFrame:
    """Ways carrying any of the keys, each once: one predicate instead of a union."""
    hit = F.lit(False)
    for key in keys:
        hit = hit | F.map_contains_key("tags", key)
    return ways.where(F.coalesce(hit, F.lit(False)))


def way_counts(ways: DataFrame, keys=("highway", "waterway")) -> DataFrame:
    """How many ways carry each key."""
    has = lambda k: F.coalesce(F.map_contains_key("tags", k), F.lit(False))
    return ways.agg(*[F.count_if(has(k)).alias(k) for k in keys])


def tile_counts(features: DataFrame) -> DataFrame:
    """Features per tile and layer."""
    one = lambda s: F.count_if(F.col("layer") == s)
    return features.groupBy("z", "x", "y").agg(
        one("building").alias("buildings"), one("road").alias("roads"), one("landuse").alias("landuse")
    )


# --- vertices -------------------------------------------------------------------------------------


def localise(line, box) -> Column:
    """Vertices in metres around the centre of a box; non-finite vertices are dropped."""
    from cartolith.functions._c import finite

    kept = F.filter(c(line), lambda p: finite(p["lon"]) & finite(p["lat"]))
    return F.transform(
        kept,
        lambda p: F.struct(tiles.local_x(p["lon"], *box).alias("x"), tiles.local_z(p["lat"], *box).alias("z")),
    )


def _same(a: Column, b: Column) -> Column:
    return (F.abs(a["x"] - b["x"]) < SNAP_M) & (F.abs(a["z"] - b["z"]) < SNAP_M)


def clean_ring(ring) -> Column:
    """Ring without repeated neighbours and without its closing vertex."""
    empty = F.array().cast("array<struct<x:double,z:double>>")

    def step(kept, p):
        last = F.try_element_at(kept, F.lit(-1))
        return F.when(F.coalesce(_same(last, p), F.lit(False)), kept).otherwise(F.concat(kept, F.array(p)))

    def close(kept):
        n = F.size(kept)
        closed = (n > 1) & F.coalesce(_same(F.get(kept, F.lit(0)), F.try_element_at(kept, F.lit(-1))), F.lit(False))
        return F.when(closed, F.slice(kept, F.lit(1), n - 1)).otherwise(kept)

    return F.aggregate(c(ring), empty, step, close)


def _rest(points: Column, start: int) -> Column:
    """All but one of the points, from ``start``; empty for an empty list."""
    return F.slice(points, F.lit(start), F.greatest(F.size(points) - 1, F.lit(0)))


def _paired(a: Column, b: Column) -> Column:
    both = F.zip_with(a, b, lambda p, q: F.struct(p.alias("a"), q.alias("b")))
    return F.transform(both, lambda s, i: F.struct(i.alias("seq"), s["a"].alias("a"), s["b"].alias("b")))


def segments(line) -> Column:
    """Consecutive vertex pairs of an open line."""
    line = c(line)
    return _paired(_rest(line, 1), _rest(line, 2))


def ring_edges(ring) -> Column:
    """Vertex pairs of a ring; the last edge leads back to the first vertex."""
    ring = c(ring)
    return _paired(ring, F.concat(_rest(ring, 2), F.slice(ring, 1, 1)))


def grid_steps(line, box) -> Column:
    """Quantised vertices as steps from the vertex before, the first from the corner.

    ``box`` should be a column of its own, so it is worked out once per feature.
    """
    q = F.transform(c(line), lambda p: tiles.quantise(p["lon"], p["lat"], box))

    def steps(q):
        def move(p, i, name):
            return p[name] - F.when(i == 0, F.lit(0).cast("bigint")).otherwise(F.get(q, i - 1)[name])

        return F.transform(q, lambda p, i: F.struct(move(p, i, "qx").alias("dx"), move(p, i, "qy").alias("dy")))

    return let(q, steps)


def signed_area(ring) -> Column:
    """Shoelace area of a local ring; the sign tells its direction."""
    ring = c(ring)
    before = F.concat(F.slice(ring, F.greatest(F.size(ring), F.lit(1)), F.lit(1)), _rest(ring, 1))
    terms = F.zip_with(ring, before, lambda p, q: (q["x"] - p["x"]) * (q["z"] + p["z"]))
    return F.aggregate(terms, F.lit(0.0), lambda acc, v: acc + v) / 2.0


# --- placed geometry ---------------------------------------------------------------------------------


def ribbons(lines: DataFrame, box, width_m: Column, keep: list[str]) -> DataFrame:
    """One quad per segment of each line: four corners at half a width from the axis.

    ``a`` and ``b`` are the segment's ends, to be joined with the ground height.
    """
    rows = lines.withColumns({"_half": width_m / 2.0, "_local": localise("line", box)})
    rows = rows.withColumn("_s", F.explode(segments("_local")))
    a, b = F.col("_s.a"), F.col("_s.b")
    dx, dz = b["x"] - a["x"], b["z"] - a["z"]
    length = F.sqrt(dx * dx + dz * dz)
    rows = rows.withColumn("_len", length).where(F.col("_len") >= SNAP_M)
    px, pz = -dz / F.col("_len") * F.col("_half"), dx / F.col("_len") * F.col("_half")
    corner = lambda p, s, n: F.struct((p["x"] + s * px).alias("x"), (p["z"] + s * pz).alias("z")).alias(n)
    return rows.select(
        *keep, F.col("_s.seq").alias("seq"), a.alias("a"), b.alias("b"), F.col("_len").alias("length_m"),
        corner(a, -1, "c0"), corner(a, 1, "c1"), corner(b, 1, "c2"), corner(b, -1, "c3"),
    )


def ribbon_stats(quads: DataFrame, line_key: str, by: list[str]) -> DataFrame:
    """Used lines, segments and triangles; lines are counted in two steps, not collected."""
    per_line = quads.groupBy(*by, line_key).agg(F.count("*").alias("n"), F.sum("length_m").alias("l"))
    return per_line.groupBy(*by).agg(
        F.count("*").alias("lines"), F.sum("n").alias("segments"), (F.sum("n") * 2).alias("triangles"),
        F.sum("l").alias("length_m"),
    )


def landcover_patches(areas: DataFrame, box, by=("class",)) -> DataFrame:
    """Drawable patches per land-cover class with their area; zones are left out."""
    rows = areas.where(F.col("class").isin(*K.LANDCOVER_CLASSES)).withColumn("_ring", clean_ring(localise("line", box)))
    rows = rows.where(F.size("_ring") >= 3).withColumn("_area", F.abs(signed_area("_ring")))
    return rows.groupBy(*by).agg(F.count("*").alias("patches"), F.sum("_area").alias("area_m2"), F.sum(F.size("_ring")).alias("vertices"))


def building_rings(buildings: DataFrame, box) -> DataFrame:
    """Buildings with a usable height and a cleaned local ring."""
    rows = buildings.where(F.coalesce(F.col("height_m") > 0, F.lit(False)))
    return rows.withColumn("ring", clean_ring(localise("line", box))).where(F.size("ring") >= 3)


def building_bodies(rings: DataFrame, key: str, ground: DataFrame) -> DataFrame:
    """Base, top, walls and area of each building.

    ``ground``: key and ground_m per vertex of the ring. One base per building, the mean
    over its vertices, keeps walls vertical.
    """
    base = ground.groupBy(key).agg(F.avg("ground_m").alias("base_m"))
    out = rings.join(base, key)
    return out.select(
        *[n for n in rings.columns if n != "ring"], "base_m", (F.col("base_m") + F.col("height_m")).alias("top_m"),
        F.size("ring").alias("walls"), signed_area("ring").alias("signed_area_m2"),
    )


def ring_vertices(rings: DataFrame, keep: list[str]) -> DataFrame:
    """One row per ring vertex in local metres."""
    rows = rings.select(*keep, F.posexplode("ring").alias("seq", "p"))
    return rows.select(*keep, "seq", F.col("p.x").alias("x_m"), F.col("p.z").alias("z_m"))


def ground_choice(surfaces: DataFrame, allow_indicative: bool = False) -> tuple[DataFrame, DataFrame]:
    """(surfaces geometry may stand on, refused ones), with the disclosure to show."""
    from cartolith.functions import gates

    coded = surfaces.withColumns({
        "code": gates.surface_code("model", "source_id", allow_indicative),
        "bare_earth": gates.bare_earth("model"), "notice": gates.surface_notice("model", "source_id"),
    })
    return coded.where(F.col("code").isNull()).drop("code"), coded.where(F.col("code").isNotNull())
