"""Scalar SQL texts of the check engine for functions it does not have."""

from __future__ import annotations

ALPHABET = "0123456789bcdefghjkmnpqrstuvwxyz"


def gh_cell(ix: str, iy: str, p: int) -> str:
    """Geohash of a lattice cell, bit by bit."""
    lon_bits, lat_bits = (5 * p + 1) // 2, 5 * p // 2
    code = (
        f"CAST(list_sum(list_transform(range({5 * p}), lambda k: "
        f"(CASE WHEN k % 2 = 0 THEN (({ix}) >> CAST({lon_bits - 1} - k // 2 AS INT)) & 1 "
        f"ELSE (({iy}) >> CAST({lat_bits - 1} - k // 2 AS INT)) & 1 END) "
        f"<< CAST({5 * p - 1} - k AS INT))) AS BIGINT)"
    )
    return (
        f"array_to_string(list_transform(range({p}), lambda i: substr('{ALPHABET}', "
        f"CAST((({code}) >> CAST(5 * ({p - 1} - i) AS INT)) & 31 AS INT) + 1, 1)), '')"
    )


def lon_ix(lon: str, p: int) -> str:
    n = 2 ** ((5 * p + 1) // 2)
    return f"CAST(greatest(least(floor(({lon} + 180e0) / (360e0 / {n})), {n - 1}), 0) AS BIGINT)"


def lat_iy(lat: str, p: int) -> str:
    n = 2 ** (5 * p // 2)
    return f"CAST(greatest(least(floor(({lat} + 90e0) / (180e0 / {n})), {n - 1}), 0) AS BIGINT)"


def gh(lat: str, lon: str, p: int) -> str:
    return gh_cell(lon_ix(lon, p), lat_iy(lat, p), p)


def flat_area(w="west", s="south", e="east", n="north") -> str:
    return (
        f"(({e} - {w}) * 111.32e0 * cos(radians(({s} + {n}) / 2e0)) * ({n} - {s}) * 110.57e0)"
    )


def sphere_area(w="west", s="south", e="east", n="north") -> str:
    return (
        f"(6371.0088e0 * 6371.0088e0 * radians({e} - {w}) * (sin(radians({n})) - sin(radians({s}))))"
    )


def values(rows) -> str:
    """VALUES rows from Python tuples (None becomes NULL)."""

    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return "TRUE" if v else "FALSE"
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        if isinstance(v, float):
            return f"CAST({v!r} AS DOUBLE)"
        return str(v)

    return "VALUES " + ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in rows)


def canon(source: str, key: str, cols: list[str]) -> str:
    """CTEs giving ``<col>_t``: six places half-even, positional text of each column."""
    dec = ", ".join(f"CAST(CAST({c} AS VARCHAR) AS DECIMAL(30, 20)) * 1000000 AS {c}_m" for c in cols)
    lo = ", ".join(f"{c}_m, CAST(floor({c}_m) AS BIGINT) AS {c}_lo" for c in cols)
    micro = ", ".join(
        f"{c}_lo + CASE WHEN {c}_m - {c}_lo > 0.5 OR ({c}_m - {c}_lo = 0.5 AND {c}_lo % 2 <> 0) THEN 1 ELSE 0 END AS {c}_k"
        for c in cols
    )
    text = ", ".join(
        f"CASE WHEN {c}_k = 0 THEN '0' ELSE rtrim(rtrim(concat(CASE WHEN {c}_k < 0 THEN '-' ELSE '' END, "
        f"CAST(abs({c}_k) // 1000000 AS VARCHAR), '.', lpad(CAST(abs({c}_k) % 1000000 AS VARCHAR), 6, '0')), '0'), '.') END AS {c}_t"
        for c in cols
    )
    return (
        f"cn1 AS (SELECT {key}, {dec} FROM {source}), cn2 AS (SELECT {key}, {lo} FROM cn1), "
        f"cn3 AS (SELECT {key}, {micro} FROM cn2), canon AS (SELECT {key}, {text} FROM cn3)"
    )
