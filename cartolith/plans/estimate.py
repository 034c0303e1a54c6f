"""Byte estimate of corpus plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolith import constants as K
from cartolith.functions import boxes, tiles
from cartolith.operators.generate import with_literals

#: Plans as shipped: plan, part, west, south, east, north, distinct fraction (negative:
#: derive it from the land share), land km2.
PLANS = (
    ("v1", "madeira", -17.32, 32.35, -16.24, 33.15, 32 / 168, 800.0),
    ("v1", "south-tyrol", 10.38, 46.21, 12.48, 47.10, 1.0, 15_800.0),
    ("austria-bbox", "austria", 9.53, 46.37, 17.16, 49.02, 1.0, 168_000.0),
    ("europe", "europe", -25.0, 34.0, 32.0, 71.5, -1.0, 10_500_000.0),
)
PLAN_SCHEMA = (
    "plan string, part string, west double, south double, east double, north double, "
    "distinct_fraction double, land_km2 double"
)


def estimate(parts: DataFrame, zooms=(12, 13, 14)) -> DataFrame:
    """Low and high byte bounds per plan and zoom, judged on the high bound."""
    rows = with_literals(parts, "zoom", zooms)
    count = tiles.count_tiles(*boxes.EDGES, "zoom")
    share = F.least(F.lit(1.0), F.col("land_km2") / tiles.sphere_area_km2(*boxes.EDGES))
    fraction = F.when(F.col("distinct_fraction") < 0, share).otherwise(F.col("distinct_fraction"))
    rows = rows.withColumns({"_n": count, "_d": count * fraction})
    total = rows.groupBy("plan", "zoom").agg(
        F.sum("_n").alias("tiles_bbox"), F.sum("_d").alias("_d"), F.sum("land_km2").alias("_land")
    )
    low, high = K.FEATURES_MEAN_FRACTION
    total = total.withColumns({
        "dem_low": F.col("_land") * tiles.dem_bytes_per_km2("zoom"),
        "dem_high": F.col("_d") * tiles.dem_bytes_per_tile("zoom"),
        "features_low": F.col("_d") * (K.FEATURES_DENSE_BYTES * low),
        "features_high": F.col("_d") * (K.FEATURES_DENSE_BYTES * high),
        "tiles_distinct": F.floor("_d").cast("bigint"),
    })
    total = total.withColumns({
        "total_low": F.col("dem_low") + F.col("features_low"),
        "total_high": F.col("dem_high") + F.col("features_high"),
    })
    return total.withColumn("passes_gate", F.col("total_high") <= K.GATE_BYTES).drop("_d", "_land")
