"""Elevation source chains: choice, credits, zoom and preflight resolution per request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartolith import constants as K
from cartolith.functions import boxes, gates, tiles
from cartolith.functions._c import c
from cartolith.sources import registry


def chain(region, box=boxes.EDGES) -> Column:
    """Ordered sources for a region and box: regional ones that cover it, then the tail.

    An array expression over constants: no join, no window, ranks are array positions.
    """
    w, s, e, n = (c(v) for v in box)
    by_region = None
    for name, ids in registry.REGION_ELEVATION.items():
        listed = F.array(*[registry.as_struct(registry.by_id(registry.ELEVATION, i)) for i in ids])
        test = c(region) == name
        by_region = F.when(test, listed) if by_region is None else by_region.when(test, listed)
    regional = F.filter(
        by_region, lambda x: x["west"].isNull() | ((w >= x["west"]) & (e <= x["east"]) & (s >= x["south"]) & (n <= x["north"]))
    )
    tail = F.array(*[registry.as_struct(registry.by_id(registry.ELEVATION, i)) for i in registry.GLOBAL_TAIL])
    fresh = F.filter(tail, lambda t: ~F.exists(regional, lambda r: r["id"] == t["id"]))
    return F.when(regional.isNull(), tail).otherwise(F.concat(regional, fresh))


def chain_rows(requests: DataFrame, key: str, region: str = "region") -> DataFrame:
    """One row per request and source, with its rank."""
    rows = requests.select(key, F.posexplode(chain(region)).alias("rank", "s"))
    return rows.select(key, "rank", "s.*")


def choice(sources) -> Column:
    return F.get(c(sources), F.lit(0))


def bare_earth_reference(sources) -> Column:
    """First bare-earth source of a chain, null when there is none."""
    return F.get(F.filter(c(sources), lambda s: s["model"] == "dtm"), F.lit(0))


def credit(source) -> Column:
    """Credit of one source: composite ones show their attribution alone."""
    s = source
    return F.when(s["composite"], s["attribution"]).otherwise(F.concat(s["attribution"], F.lit(" — "), s["license"]))


def credit_line(sources) -> Column:
    """Distinct credits of a chain in use order."""
    return F.array_join(F.array_distinct(F.transform(c(sources), credit)), " · ")


def compose_credits(*active: tuple[Column, str]) -> Column:
    """Credits of the layers that are on, in order."""
    return F.array_join(F.array_compact(F.array(*[F.when(on, text) for on, text in active])), " · ")


def provenance(chain_table: DataFrame) -> DataFrame:
    """What has to travel with a result, one row per source of a chain."""
    text = F.when(F.col("composite"), F.col("attribution")).otherwise(F.concat("attribution", F.lit(" — "), "license"))
    return chain_table.withColumn("credit", text)


def served_max_zoom(source, allow_sparse: bool = False) -> Column:
    """Deepest zoom to ask a source for: sparse pyramids stop where they are dense."""
    s = source
    return s["max_zoom"] if allow_sparse else F.coalesce(s["dense_max_zoom"], s["max_zoom"])


def preflight(requests: DataFrame, region: str = "region") -> DataFrame:
    """Zoom, ground resolution and source a request would get."""
    rows = requests.withColumn("_s", choice(chain(region)))
    s = F.col("_s")
    zoom = tiles.mesh_zoom("west", "east", K.MESH_GRID_N, s["tile_size"], s["min_zoom"], s["max_zoom"])
    rows = rows.withColumn("zoom", zoom)
    mid = (F.col("south") + F.col("north")) / 2.0
    m_per_px = K.EARTH_CIRCUMFERENCE_M * F.cos(F.radians(mid)) / (tiles.span("zoom") * s["tile_size"])
    return rows.withColumns({
        "m_per_px": m_per_px, "source_id": s["id"], "source_name": s["name"], "license": s["license"], "model": s["model"],
    }).drop("_s")


def assumed_sigma(resolution_m) -> Column:
    return gates.posting_sigma_m(resolution_m)
