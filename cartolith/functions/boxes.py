"""Bounding boxes: relations, validation codes and antimeridian handling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cartolith.functions import geohash, numbers
from cartolith.functions._c import c, finite, first_code
from cartolith.functions.tiles import sphere_area_km2

EDGES = ("west", "south", "east", "north")


def edges(prefix: str = "") -> tuple[Column, Column, Column, Column]:
    return tuple(F.col(prefix + name) for name in EDGES)


def overlaps(a, b) -> Column:
    """Open overlap: boxes that only touch do not overlap."""
    (aw, as_, ae, an), (bw, bs, be, bn) = [tuple(c(v) for v in box) for box in (a, b)]
    return (aw < be) & (ae > bw) & (as_ < bn) & (an > bs)


def contains_box(outer, inner) -> Column:
    """Closed containment of one box in another."""
    (ow, os_, oe, on), (iw, is_, ie, in_) = [tuple(c(v) for v in box) for box in (outer, inner)]
    return (ow <= iw) & (ie <= oe) & (os_ <= is_) & (in_ <= on)


def contains_point(box, lon, lat) -> Column:
    """Closed point test; a missing position is outside."""
    w, s, e, n = (c(v) for v in box)
    return F.coalesce(c(lon).between(w, e) & c(lat).between(s, n), F.lit(False))


def centre(west, south, east, north) -> Column:
    """Mean of the edges (not the Mercator middle)."""
    return F.struct(
        ((c(south) + c(north)) / 2.0).alias("lat"), ((c(west) + c(east)) / 2.0).alias("lon")
    )


def centre_hash(west, south, east, north, precision: int = 12) -> Column:
    mid = centre(west, south, east, north)
    return geohash.encode(mid["lat"], mid["lon"], precision)


def footprint_ok(west, south, east, north) -> Column:
    """Rule of a stored footprint: finite, in range, strictly ordered."""
    w, s, e, n = c(west), c(south), c(east), c(north)
    return (
        finite(w) & finite(s) & finite(e) & finite(n)
        & F.coalesce((w < e) & (s < n) & (w >= -180) & (e <= 180) & (s >= -90) & (n <= 90), F.lit(False))
    )


def _viewport_rules(west, south, east, north):
    w, s, e, n = c(west), c(south), c(east), c(north)
    return (
        (~(finite(w) & finite(s) & finite(e) & finite(n)), "BBOX_NOT_FINITE"),
        (~(w.between(-180, 180) & e.between(-180, 180)), "BBOX_OUT_OF_RANGE"),
        (~(s.between(-90, 90) & n.between(-90, 90)), "BBOX_OUT_OF_RANGE"),
        (w > e, "BBOX_ANTIMERIDIAN"),
        (s > n, "BBOX_INVERTED"),
    )


def viewport_code(west, south, east, north) -> Column:
    """Null for a usable viewport, else the first broken rule in normative order."""
    return first_code(*_viewport_rules(west, south, east, north))


def extent_code(west, south, east, north) -> Column:
    """Viewport rules plus: still a box after rounding to six places."""
    q = [numbers.quantised(v) for v in (west, south, east, north)]
    flat = F.coalesce((q[0] >= q[2]) | (q[1] >= q[3]), F.lit(True))
    return first_code(*_viewport_rules(west, south, east, north), (flat, "BBOX_DEGENERATE"))


def selection_code(west, south, east, north, max_area_km2: float) -> Column:
    """Rule codes of a user selection, with an area limit."""
    w, s, e, n = c(west), c(south), c(east), c(north)
    missing = w.isNull() | s.isNull() | e.isNull() | n.isNull()
    return first_code(
        (missing, "MALFORMED"),
        (~(finite(w) & finite(s) & finite(e) & finite(n)), "NON_FINITE"),
        (
            ~(w.between(-180, 180) & e.between(-180, 180) & s.between(-90, 90) & n.between(-90, 90)),
            "RANGE",
        ),
        (w > e, "ANTIMERIDIAN_AMBIGUOUS"),
        (w == e, "ORDER"),
        (s >= n, "ORDER"),
        (sphere_area_km2(w, s, e, n) > max_area_km2, "AREA_LIMIT"),
    )


def view_segments(west, south, east, north) -> Column:
    """A viewport as zero, one or two plain boxes.

    Latitudes are clamped, longitudes wrapped, and a view over the 180th meridian is
    split; east below west and an east beyond 180 are both read as a crossing.
    """
    w, e = c(west), c(east)
    s = F.least(F.greatest(c(south), F.lit(-90.0)), F.lit(90.0))
    n = F.least(F.greatest(c(north), F.lit(-90.0)), F.lit(90.0))
    east_of_west = F.when(e < w, e + 360.0).otherwise(e)
    width = east_of_west - w
    start = F.pmod(w + 180.0, F.lit(360.0)) - 180.0
    stop = start + width

    def box(a, b):
        return F.struct(a.alias("west"), s.alias("south"), b.alias("east"), n.alias("north"))

    none = F.filter(F.array(box(start, stop)), lambda _: F.lit(False))
    usable = finite(west) & finite(south) & finite(east) & finite(north)
    return (
        F.when(~usable | (s > n), none)
        .when(width >= 360.0, F.array(box(F.lit(-180.0), F.lit(180.0))))
        .when(
            stop > 180.0,
            F.array(box(start, F.lit(180.0)), box(F.lit(-180.0), stop - 360.0)),
        )
        .otherwise(F.array(box(start, stop)))
    )


def in_segments(segments, lon, lat) -> Column:
    """Closed test of a position against the boxes of :func:`view_segments`."""
    lon, lat = c(lon), c(lat)
    return F.exists(
        c(segments),
        lambda b: (b["west"] <= lon) & (lon <= b["east"]) & (b["south"] <= lat) & (lat <= b["north"]),
    )
