"""Announcement events of finished tiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartolith import constants as K
from cartolith.functions import events
from cartolith.functions._c import c, lookup

#: Identity and licence of each announced dataset.
DATASETS = {
    "dem": {
        "title": "Terrarium elevation tiles", "mime": "image/png",
        "license": (
            "Terrain Tiles on AWS Open Data (Mapzen terrarium). Attribution required: DEMs composited "
            "from public sources — see https://github.com/tilezen/joerd/blob/master/docs/attribution.md"
        ),
        "source": "https://s3.amazonaws.com/elevation-tiles-prod/terrarium",
    },
    "features": {
        "title": "OpenStreetMap feature tiles", "mime": K.MEDIA_TYPES["features"],
        "license": "ODbL-1.0 — (c) OpenStreetMap contributors; share-alike applies to derived geometry",
        "source": "https://www.openstreetmap.org (via Overpass API)",
    },
}


def fact(dataset, name: str) -> Column:
    return lookup({k: v[name] for k, v in DATASETS.items()}, c(dataset))


def region_edge(region, place: int) -> Column:
    return lookup({k: v[place] for k, v in K.REGIONS.items()}, c(region))


def assemble(items: DataFrame, server: str, pubkey: str, now: int) -> DataFrame:
    """Unsigned collection and item events of finished tiles of the announced datasets.

    The acquisition time is the crawl instant, never the publish instant.
    """
    host = server.rstrip("/")
    rows = items.where(F.col("kind").isin(*DATASETS))
    mime = fact("kind", "mime")
    box = tuple(region_edge("region", i) for i in range(4))
    collection = events.collection_event(
        "kind", fact("kind", "title"), box, mime, fact("kind", "license"), fact("kind", "source"), F.lit(host), F.lit(now)
    )
    rows = rows.withColumn("collection", collection)
    return events.with_item_event(
        rows, "item", "kind", F.lit(pubkey), "z", "x", "y", "sha256", F.concat(F.lit(host + "/"), F.col("sha256")), mime,
        "bytes", events.rfc3339("updated_at"), F.lit(now),
    )
