"""Delivery plans: texture forecasts, ceilings, tile counts and prices per request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartolith import constants as K
from cartolith.functions import boxes, gates, tiles
from cartolith.functions._c import c
from cartolith.operators.spatial import first_container
from cartolith.sources import registry


def texture_region(box=boxes.EDGES) -> Column:
    """Survey region of a place: the first declared one that holds the box."""
    return first_container(K.REGIONS, box, "europe")


def _first_texture(region, field: str) -> Column:
    place = registry.TEXTURE_FIELDS.index(field)
    chain = None
    for name, ids in registry.REGION_TEXTURE.items():
        value = F.lit(registry.by_id(registry.TEXTURE, ids[0])[place])
        chain = F.when(c(region) == name, value) if chain is None else chain.when(c(region) == name, value)
    return chain.otherwise(F.lit(registry.by_id(registry.TEXTURE, "esri-world-imagery")[place]))


def forecast(rows: DataFrame, region: str = "texture_region", target: str = "target",
             max_tiles: int = K.TEXTURE_MAX_TILES) -> DataFrame:
    """Resolution a texture will really have, with the reasons for any loss.

    Adds texture_source, texture_kind, m_per_px, notes.
    """
    w, s, e, n = (F.col(v) for v in boxes.EDGES)
    lat = (s + n) / 2.0
    t = F.col(target)
    width_m = (e - w) * K.METRES_PER_DEGREE * F.cos(F.radians(lat))
    whole = lambda v: F.greatest(F.lit(1.0), F.bround(v, 0))
    rows = rows.withColumns({
        "texture_source": _first_texture(region, "id"), "texture_kind": _first_texture(region, "kind"),
        "_name": _first_texture(region, "name"), "_max_zoom": _first_texture(region, "max_zoom").cast("int"),
        "_width_m": width_m, "_wpx": whole(width_m / t), "_hpx": whole((n - s) * K.METRES_PER_DEGREE / t),
        "_want": tiles.zoom_for_resolution(lat, t),
    })
    side = float(K.TEXTURE_MAX_SIDE_PX)
    longest = F.greatest("_wpx", "_hpx")
    shrunk = F.greatest(F.lit(1.0), F.floor(F.col("_wpx") * (side / longest)))
    clamped = longest > side
    top = F.least(F.col("_want"), F.coalesce("_max_zoom", "_want"))
    rows = rows.withColumn("_top", top)
    rows = rows.withColumn("_zoom", tiles.budget_zoom(w, s, e, n, "_top", 0, max_tiles))
    wms = F.col("texture_kind") == "wms"
    m_per_px = F.when(wms, F.col("_width_m") / F.when(clamped, shrunk).otherwise(F.col("_wpx"))).otherwise(
        tiles.metres_per_pixel("_zoom", lat)
    )
    text = lambda v: c(v).cast("string")
    notes = F.array_compact(F.array(
        F.when(wms & clamped, f"clamped to {K.TEXTURE_MAX_SIDE_PX}px — a smaller selection gets sharper"),
        F.when(~wms & (F.col("_want") > F.col("_max_zoom")), F.concat(F.col("_name"), F.lit(" stops at z"), text("_max_zoom"))),
        F.when(~wms & (F.col("_zoom") < F.col("_top")),
               F.concat(F.lit("tile budget caps this extent at z"), text("_zoom"), F.lit(" — a smaller selection gets sharper"))),
    ))
    rows = rows.withColumns({"m_per_px": F.round(m_per_px, 3), "notes": notes})
    return rows.drop("_name", "_max_zoom", "_width_m", "_wpx", "_hpx", "_want", "_top", "_zoom")


def quotes(requests: DataFrame) -> DataFrame:
    """Plan and price of every request, refusals included as rows with a code.

    ``requests``: box, lod, texture (boolean), target (m/px, null for the tier's default).
    The price reads only the plan, so it cannot reveal what is already stored.
    """
    box = boxes.EDGES
    rows = requests.withColumn("target", F.coalesce("target", gates.tier("lod", "texture")))
    rows = rows.withColumn("code", gates.plan_refusal(*box, "lod", "texture", "target"))
    ok = F.col("code").isNull()
    rows = rows.withColumns({
        "area_km2": tiles.flat_area_km2(*box), "texture_region": F.when(ok & F.col("texture"), texture_region()),
        "dem_tiles": F.when(ok, tiles.count_tiles(*box, gates.tier("lod", "dem_zoom"))),
        "feature_tiles": F.when(ok, tiles.count_tiles(*box, gates.tier("lod", "feature_zoom"))),
    })
    rows = forecast(rows)
    wanted = ok & F.col("texture")
    rows = rows.withColumns({
        "m_per_px": F.when(wanted, F.col("m_per_px")), "texture_source": F.when(wanted, F.col("texture_source")),
        "notes": F.when(wanted, F.col("notes")),
    })
    rows = rows.withColumn("downgraded", F.when(wanted, ~gates.same_resolution("m_per_px", "target")))
    pixels = gates.texture_megapixels("area_km2", "m_per_px")
    units = gates.work_units(pixels, "dem_tiles", "feature_tiles")
    return rows.withColumns({
        "megapixels": F.when(ok, pixels), "work_units": F.when(ok, units), "price": F.when(ok, gates.price(units)),
    }).drop("texture_kind")


def planned_tiles(requests: DataFrame, key: str) -> DataFrame:
    """Elevation and feature tiles of accepted requests, with their media type."""
    from cartolith.operators.generate import box_tiles

    def part(kind: str, media: str) -> DataFrame:
        zoom = gates.tier("lod", kind).cast("bigint")
        rows = box_tiles(requests.select(key, *boxes.EDGES, zoom.alias("z")))
        return rows.select(key, "z", "x", "y", F.lit(media).alias("media_type"))

    return part("dem_zoom", K.MEDIA_TYPES["dem"]).unionByName(part("feature_zoom", K.MEDIA_TYPES["features"]))


def price_range() -> tuple[int, int]:
    """Advertised range: the floor and the dearest request every ceiling allows."""
    finest = min(t[2] for t in K.LOD_TIERS.values())
    pixels = K.MAX_AREA_KM2 / (finest * finest)
    units = (
        K.MEGAPIXEL_WEIGHT * pixels + K.DEM_TILE_WEIGHT * K.MAX_DEM_TILES + K.FEATURE_TILE_WEIGHT * K.MAX_FEATURE_TILES
    )
    return K.MIN_PRICE, max(K.MIN_PRICE, int(K.UNIT_PRICE * units))


def capability_tag(tool: str, unit: str = "sats") -> list[str]:
    low, high = price_range()
    return ["cap", f"tool:{tool}", f"{low}-{high}", unit]
