"""Source surveys: qualification per cell, roll-ups and the baked map layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartolith import constants as K
from cartolith.functions import boxes, gates, tiles
from cartolith.functions._c import c
from cartolith.operators import spatial


def first_usable(probes: DataFrame, keys: list[str], usable: str, rank: str) -> DataFrame:
    """Per key the first candidate that qualifies, else the first one tried.

    One ordered minimum does both: usable rows sort before unusable ones, then by rank.
    """
    order = F.struct((~F.coalesce(F.col(usable), F.lit(False))).alias("no"), F.col(rank))
    rest = [F.col(n) for n in probes.columns if n not in keys]
    best = probes.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_best"))
    return best.select(*keys, "_best.*")


def cell_status(covered, elevation_m) -> Column:
    """covered, sea, gap or unknown; the ground height matters only where nothing covers."""
    h = c(elevation_m)
    return (
        F.when(F.coalesce(c(covered), F.lit(False)), "covered").when(h.isNull(), "unknown")
        .when(h <= K.SEA_LEVEL_M, "sea").otherwise("gap")
    )


def survey(probes: DataFrame, cells: list[str]) -> DataFrame:
    """Coverage cells from a table of probe results (ok, m_per_px, detail, density)."""
    judged = probes.withColumns({
        "covered": gates.imagery_usable("ok", "m_per_px", "detail", "density"),
        "verdict": F.when(F.col("ok"), gates.imagery_verdict("m_per_px", "detail", "density")).otherwise("unreachable"),
    })
    best = first_usable(judged, cells, "covered", "rank")
    return best.withColumn("status", cell_status("covered", "elevation_m"))


def summarise(cells: DataFrame, keys=()) -> DataFrame:
    """Counts per state, land share and areas in one aggregate."""
    area = tiles.flat_area_km2(*boxes.EDGES)
    state = lambda s: F.count_if(F.col("status") == s)
    out = cells.groupBy(*keys).agg(
        F.count("*").alias("cells"), F.count_if("covered").alias("covered"),
        state("gap").alias("gaps"), state("sea").alias("sea"), state("unknown").alias("unknown"),
        F.sum(area).alias("_total"), F.sum(F.when(F.col("covered"), area).otherwise(0.0)).alias("_covered"),
    )
    land = F.col("covered") + F.col("gaps")

    def percent(part, whole):
        return F.coalesce(F.round(100.0 * part / F.nullif(whole, F.lit(0)), 1), F.lit(0.0))

    return out.withColumns({
        "land_cells": land, "land_percent": percent(F.col("covered"), land),
        "percent": percent(F.col("covered"), F.col("cells")),
        "covered_km2": F.round("_covered").cast("bigint"), "total_km2": F.round("_total").cast("bigint"),
    }).drop("_total", "_covered")


def observe_cells(cells: DataFrame, observation) -> DataFrame:
    """Attach running counts to a survey: read them from ``observation`` after the action."""
    return cells.observe(
        observation, F.count(F.lit(1)).alias("cells"), F.count_if("covered").alias("covered"),
        F.count_if(F.col("status") == "gap").alias("gaps"),
    )


def by_source(cells: DataFrame) -> DataFrame:
    """Covered cells per source."""
    return cells.where("covered").groupBy("source_id").agg(F.count("*").alias("n"))


def roll_up(cells: DataFrame) -> DataFrame:
    """Totals, totals per state and covered cells per source from one pass (grouping sets)."""
    src = F.when(F.col("covered"), F.col("source_id"))
    rows = cells.select("status", src.alias("source_id"))
    grouped = rows.groupingSets([[F.col("status")], [F.col("source_id")], []], "status", "source_id")
    return grouped.agg(F.grouping_id().alias("level"), F.count("*").alias("n"))


def header(cells: DataFrame, region: str, zoom: int) -> DataFrame:
    """Header row of a survey file."""
    counted = summarise(cells)
    return counted.select(
        F.lit(region).alias("region"), F.lit(zoom).alias("zoom"), "cells", "covered",
        (F.col("cells") - F.col("covered")).alias("uncovered"), "gaps", "sea",
    )


# --- GeoJSON ----------------------------------------------------------------------------


def box_ring(west, south, east, north) -> Column:
    """Closed ring of a box as GeoJSON coordinates."""
    w, s, e, n = (c(v) for v in (west, south, east, north))
    return F.array(F.array(w, s), F.array(e, s), F.array(e, n), F.array(w, n), F.array(w, s))


def cell_feature() -> Column:
    """Feature of a coverage cell; a detail of zero stays zero."""
    return F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("Polygon").alias("type"), F.array(box_ring(*boxes.EDGES)).alias("coordinates")).alias("geometry"),
        F.struct(
            tiles.tile_key("z", "x", "y").alias("tile"), F.col("covered"), F.col("status"),
            F.col("source_id").alias("source"), F.round("m_per_px", 3).alias("m_per_px"),
            F.round("detail", 2).alias("detail"), F.round(F.col("density") / 1000).alias("kb_per_mp"), F.col("verdict"),
        ).alias("properties"),
    )


def _rounded(ring: Column, places: int) -> Column:
    step = float(10**places)
    return F.transform(ring, lambda p: F.transform(p, lambda v: F.floor(v * step + 0.5) / step))


def bake_gaps(features: DataFrame, places: int = 4) -> DataFrame:
    """Only the gap features, with short coordinates and two properties."""
    gaps = features.where(F.col("properties.status") == "gap")
    rings = F.transform(F.col("geometry.coordinates"), lambda ring: _rounded(ring, places))
    return gaps.select(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("Polygon").alias("type"), rings.alias("coordinates")).alias("geometry"),
        F.struct(F.col("properties.tile").alias("tile"), F.lit("gap").alias("status")).alias("properties"),
    )


def country_gaps(cells: DataFrame, countries: DataFrame, min_share: float = 0.5) -> DataFrame:
    """Countries whose sampled land cells are mostly gaps."""
    mid = boxes.centre(*boxes.EDGES)
    land = cells.where(F.col("status").isin("covered", "gap")).select(
        mid["lon"].alias("lon"), mid["lat"].alias("lat"), (F.col("status") == "gap").alias("gap")
    )
    inside = spatial.points_in_polygons(land, countries)
    share = inside.groupBy("name").agg(
        F.count("*").alias("land_cells"), F.avg(F.col("gap").cast("double")).alias("gap_share")
    )
    return share.where(F.col("gap_share") >= min_share)


# --- chains and candidates -------------------------------------------------------------------


def first_success(attempts: DataFrame, key: str) -> DataFrame:
    """First source of a chain that answered, and the failures when none did.

    ``attempts``: key, rank, source_id, error (null when it answered). A chain has one row
    per rank and its ranks come from a declared source list, which bounds the failure text.
    """
    one = attempts.groupBy(key, "rank").agg(F.min(F.struct("source_id", "error")).alias("a"))
    failed = F.col("a.error").isNotNull()
    text = F.concat_ws(": ", "a.source_id", "a.error")
    out = one.groupBy(key).agg(
        F.min_by(F.when(~failed, F.col("a.source_id")), F.when(~failed, F.col("rank"))).alias("source_id"),
        F.collect_list(F.when(failed, F.struct("rank", text.alias("t")))).alias("_f"),
    )
    failures = F.array_join(F.transform(F.array_sort("_f"), lambda f: f["t"]), "; ")
    return out.select(key, "source_id", F.when(F.col("source_id").isNull(), failures).alias("failures"))


def city_override(measured: DataFrame, mapped: DataFrame, request: str) -> DataFrame:
    """Measured footprints where a request has any, the mapped ones elsewhere."""
    kept = mapped.join(measured.select(request).distinct(), request, "left_anti")
    return measured.unionByName(kept)


def evaluate_candidates(evidence: DataFrame) -> DataFrame:
    """Failed fields and status per candidate.

    ``evidence``: role, candidate, rank, expect_live, failed (array of codes). The codes
    come from a fixed vocabulary, so the set per candidate is small whatever the row count.
    """
    codes = evidence.groupBy("role", "candidate").agg(
        F.min("rank").alias("rank"), F.bool_and("expect_live").alias("expect_live")
    )
    failed = evidence.select("role", "candidate", F.explode("failed").alias("f")).groupBy("role", "candidate").agg(
        F.array_sort(F.collect_set("f")).alias("failed_fields")
    )
    out = codes.join(failed, ["role", "candidate"], "left")
    out = out.withColumn("failed_fields", F.coalesce("failed_fields", F.array().cast("array<string>")))
    live = F.col("expect_live") & (F.size("failed_fields") == 0)
    return out.withColumn("status", F.when(live, "live-verified").otherwise("blocked")).drop("expect_live")


def role_winners(candidates: DataFrame) -> DataFrame:
    """First fully passing candidate per role, or the union of what failed."""
    win = candidates.groupBy("role").agg(
        F.min_by(
            F.when(F.col("status") == "live-verified", F.col("candidate")),
            F.when(F.col("status") == "live-verified", F.col("rank")),
        ).alias("winner"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("failed_fields")))).alias("_all"),
    )
    lost = F.col("winner").isNull()
    return win.select(
        "role", "winner", F.when(lost, "blocked").otherwise("live-verified").alias("status"),
        F.when(lost, F.col("_all")).otherwise(F.array().cast("array<string>")).alias("failed_fields"),
    )
