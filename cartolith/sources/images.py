"""Elevation and imagery tiles as pictures.

The image source decodes in the JVM and hands bytes over as blue, green, red. Tiles lie in
``<root>/<z>/<x>/<y>.png`` folders, so place is read from the path.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartolith.operators.raster import height_from_bgr

_PLACE = r"([0-9]+)/([0-9]+)/([0-9]+)\.[a-zA-Z]+$"


def read_tiles(spark: SparkSession, root: str) -> DataFrame:
    """Decoded tiles: z, x, y, width, height, channels and packed bytes.

    A picture that cannot be read stays as a row with ``code`` UNREADABLE and nulls, so that
    nothing takes its pixels for heights.
    """
    img = spark.read.format("image").option("dropInvalid", False).load(f"{root}/*/*/*")
    good = F.col("image.width") > 0
    part = lambda i: F.regexp_extract("image.origin", _PLACE, i).cast("bigint")
    return img.select(
        part(1).alias("z"), part(2).alias("x"), part(3).alias("y"), *[
            F.when(good, F.col(f"image.{field}")).alias(name)
            for name, field in (("width", "width"), ("height", "height"), ("channels", "nChannels"), ("data", "data"))
        ], F.when(~F.coalesce(good, F.lit(False)), "UNREADABLE").alias("code"),
    )


def centre_elevation(tiles: DataFrame) -> DataFrame:
    """Elevation of the middle pixel of each tile, which tells sea from land."""
    middle = F.floor(F.col("height") / 2) * F.col("width") + F.floor(F.col("width") / 2)
    return tiles.select("z", "x", "y", height_from_bgr("data", middle).alias("elevation_m"))


def tile_pixels(tiles: DataFrame) -> DataFrame:
    """One row per pixel with its height, for jobs that need the long form."""
    n = (F.col("width") * F.col("height") - 1).cast("bigint")
    rows = tiles.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("bigint"), n)))
    return rows.select(
        "z", "x", "y", F.floor(F.col("_i") / F.col("width")).alias("row_no"), (F.col("_i") % F.col("width")).alias("col_no"),
        height_from_bgr("data", F.col("_i")).alias("h"),
    )


def _lanczos(n_in: int, n_out: int) -> np.ndarray:
    """Row-normalised Lanczos-3 weights from ``n_in`` samples to ``n_out``."""
    scale = n_in / n_out
    stretch = max(scale, 1.0)
    centre = (np.arange(n_out) + 0.5) * scale
    offset = (np.arange(n_in)[None, :] + 0.5 - centre[:, None]) / stretch
    weight = np.where(np.abs(offset) < 3, np.sinc(offset) * np.sinc(offset / 3), 0.0)
    return weight / weight.sum(axis=1, keepdims=True)


def _edge_energy(grey: np.ndarray) -> float:
    """Mean response of the eight-neighbour edge kernel; the rim keeps its own value."""
    out = grey.copy()
    total = sum(
        grey[1 + dy: grey.shape[0] - 1 + dy, 1 + dx: grey.shape[1] - 1 + dx] for dy in (-1, 0, 1) for dx in (-1, 0, 1)
    )
    out[1:-1, 1:-1] = np.clip(9 * grey[1:-1, 1:-1] - total, 0, 255)
    return float(out.mean())


def _score(grey: np.ndarray) -> float:
    rows, cols = grey.shape
    if min(rows, cols) < 16:
        return 0.0
    shrink = lambda n: _lanczos(n, n // 2)
    grow = lambda n: _lanczos(n // 2, n)
    to_bytes = lambda a: np.clip(np.floor(a + 0.5), 0, 255)
    half = to_bytes(shrink(rows) @ grey @ shrink(cols).T)
    back = to_bytes(grow(rows) @ half @ grow(cols).T)
    return _edge_energy(grey) / (_edge_energy(back) or 1e-6)


@F.pandas_udf(T.DoubleType())
def image_detail(height: pd.Series, width: pd.Series, channels: pd.Series, data: pd.Series) -> pd.Series:
    """Edge energy of a picture against the same picture halved and restored.

    One row is one picture, so no shuffle and no group is needed.
    """
    scores = []
    for h, w, n, raw in zip(height, width, channels, data):
        a = np.frombuffer(raw, dtype=np.uint8)[: h * w * n].reshape(h, w, n).astype(np.float64)
        grey = a[..., 0] if n == 1 else np.floor(a[..., 2] * 0.299 + a[..., 1] * 0.587 + a[..., 0] * 0.114 + 0.5)
        scores.append(_score(grey))
    return pd.Series(scores)
