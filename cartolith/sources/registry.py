"""Source registries: elevation and imagery services, fixed in code.

The tables are small constants of the program. They are used as array and case
expressions (a projection per request) or, through :func:`elevation_sources` and
:func:`texture_sources`, as dimension tables whose size is known.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = (
    "id", "name", "country", "model", "resolution_m", "sigma_m", "license", "attribution", "composite",
    "tile_size", "min_zoom", "max_zoom", "dense_max_zoom", "delivery", "west", "south", "east", "north",
)

_CC0 = "CC0-1.0"
_BZ = "Autonome Provinz Bozen — Südtirol / Provincia autonoma di Bolzano"


def _national(id_, name, country, resolution, licence, attribution, max_zoom, box):
    """A transcoded bare-earth service: its sigma is the posting, at least 0.3 m."""
    return (
        id_, name, country, "dtm", resolution, max(0.3, resolution), licence, attribution, False, 256, 8, max_zoom,
        None, "transcoded", *box,
    )


# --- fixed values: elevation services ------------------------------------------------
ELEVATION = (
    (
        "mapzen-terrarium", "Mapzen Terrain Tiles (Terrarium)", "XX", "mixed", 30.0, 14.31,
        "Public domain / permissive per contributing source (SRTM, GMTED2010, NED)",
        "Elevation: Mapzen Terrain Tiles via AWS Open Data (SRTM, GMTED2010, NED)",
        False, 256, 8, 13, None, "direct", None, None, None, None,
    ),
    (
        "gedtm30", "GEDTM30 global ensemble digital terrain model", "XX", "dtm", 30.0, 10.69, "CC-BY-4.0",
        "Elevation: GEDTM30 — Ho, Parente, Hengl et al., OpenGeoHub Foundation, CC BY 4.0 (doi:10.7717/peerj.19673)",
        False, 256, 8, 13, None, "transcoded", None, None, None, None,
    ),
    (
        "mapterhorn", "Mapterhorn", "XX", "mixed", 30.0, 14.31,
        "Composite of 134 open datasets audited 2026-08-02 — see `composite`; binding obligation across the whole "
        "set is attribution; no non-commercial, share-alike or no-derivatives terms declared",
        "Elevation: © Mapterhorn — 134 open national and global elevation datasets, each credited at "
        "mapterhorn.com/attribution (CC BY 4.0, Licence Ouverte 2.0, dl-de/by-2.0, GSI Japan and public-domain terms)",
        True, 512, 8, 18, 12, "direct", None, None, None, None,
    ),
    _national("it-bz-dtm-05m", "Südtirol Digitales Geländemodell 0,5 m", "IT-BZ", 0.5, _CC0, _BZ, 18, (10.38, 46.21, 12.48, 47.1)),
    _national("it-bz-dtm-25m", "Südtirol Digitales Geländemodell 2,5 m", "IT-BZ", 2.5, _CC0, _BZ, 16, (10.38, 46.21, 12.48, 47.1)),
    _national("at-bev-dtm-1m", "BEV ALS Digitales Geländemodell 1 m", "AT", 1.0, "CC-BY-4.0",
              "Datenquelle: Bundesamt für Eich- und Vermessungswesen (BEV)", 17, (9.53, 46.37, 17.17, 49.02)),
    _national("ch-swissalti3d", "swissALTI3D", "CH", 0.5,
              "swisstopo Open Government Data terms — free incl. commercial use, source must be cited", "© swisstopo", 18,
              (5.9503666, 45.7213375, 10.4998461, 47.8216742)),
    _national("nl-ahn-dtm-05m", "Actueel Hoogtebestand Nederland — maaiveld 0,5 m", "NL", 0.5, _CC0,
              "Actueel Hoogtebestand Nederland (AHN), Rijkswaterstaat", 18, (3.2, 50.75, 7.23, 53.56)),
    _national("fr-ign-rgealti-1m", "IGN RGE ALTI 1 m", "FR", 1.0, "etalab-2.0 (Licence Ouverte / Open Licence 2.0)",
              "© IGN — Institut national de l'information géographique et forestière", 17, (-5.15, 41.31, 9.66, 51.11)),
    _national("de-nw-dgm1", "Geobasis NRW Digitales Geländemodell 1 m", "DE-NW", 1.0, "dl-de/zero-2-0",
              "Land NRW / Geobasis NRW", 17, (5.86, 50.32, 9.46, 52.53)),
    _national("cz-cuzk-dmr5g", "ČÚZK DMR 5G", "CZ", 5.0, "CC-BY-4.0", "Český úřad zeměměřický a katastrální (ČÚZK)", 15,
              (12.09, 48.55, 18.86, 51.06)),
)
#: Best first; the global tail follows every chain.
REGION_ELEVATION = {
    "south-tyrol": ("it-bz-dtm-05m", "it-bz-dtm-25m"),
    "vienna": ("at-bev-dtm-1m",),
    "europe": (
        "it-bz-dtm-05m", "at-bev-dtm-1m", "ch-swissalti3d", "nl-ahn-dtm-05m", "fr-ign-rgealti-1m", "de-nw-dgm1", "cz-cuzk-dmr5g",
    ),
}
GLOBAL_TAIL = ("gedtm30", "mapzen-terrarium")

# --- fixed values: imagery services (id, name, kind, max zoom, licence, attribution) ------
TEXTURE_FIELDS = ("id", "name", "kind", "max_zoom", "license", "attribution")
TEXTURE = (
    ("esri-world-imagery", "Esri World Imagery", "xyz", 19, "Esri Terms of Use — display with attribution",
     "Source: Esri, Vantor, Earthstar Geographics, and the GIS User Community"),
    ("irig-south-tyrol-ortho", "IRIG Südtirol Orthoimagery", "wms", None, _CC0, _BZ),
    ("drote-madeira-ortho", "DROTe Ortofotocartografia RAM 2023", "wms", None,
     "Free use with attribution (non-CC; redistribution terms unconfirmed)", "© DROTe — Região Autónoma da Madeira"),
    ("basemap-at-ortho", "basemap.at Orthofoto", "xyz", 19, "CC-BY-4.0 (Open Government Data Österreich)", "Grundkarte: basemap.at"),
)
REGION_TEXTURE = {
    "madeira": ("drote-madeira-ortho", "esri-world-imagery"),
    "south-tyrol": ("irig-south-tyrol-ortho", "esri-world-imagery"),
    "vienna": ("basemap-at-ortho", "esri-world-imagery"),
    "europe": ("esri-world-imagery",),
}

_TYPES = {
    "resolution_m": "double", "sigma_m": "double", "composite": "boolean", "tile_size": "int", "min_zoom": "int",
    "max_zoom": "int", "dense_max_zoom": "int", "west": "double", "south": "double", "east": "double", "north": "double",
}


def as_struct(row: tuple, fields: tuple = FIELDS) -> Column:
    """A registry row as a constant struct."""
    return F.struct(*[F.lit(v).cast(_TYPES.get(n, "string")).alias(n) for n, v in zip(fields, row)])


def by_id(rows, id_: str) -> tuple:
    return next(row for row in rows if row[0] == id_)


def _table(spark: SparkSession, rows, fields) -> DataFrame:
    schema = ", ".join(f"{n} {_TYPES.get(n, 'string')}" for n in fields)
    return spark.createDataFrame(list(rows), schema)


def elevation_sources(spark: SparkSession) -> DataFrame:
    return _table(spark, ELEVATION, FIELDS)


def texture_sources(spark: SparkSession) -> DataFrame:
    return _table(spark, TEXTURE, TEXTURE_FIELDS)
