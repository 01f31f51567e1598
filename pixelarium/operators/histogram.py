"""Bounds and density of a pixel table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelarium.functions.grid import bin_of
from pixelarium.functions.imaging import heat_rgb, png

BINS = 768


def bounds(pixels: DataFrame) -> DataFrame:
    """Rows and extremes in one column-pruned scan; null extremes for no rows."""
    return pixels.agg(
        F.count("*").alias("n"), F.min("lon").alias("min_lon"), F.min("lat").alias("min_lat"), F.max("lon").alias("max_lon"), F.max("lat").alias("max_lat")
    )


def density(pixels: DataFrame, box: tuple[float, float, float, float], bins: int = BINS) -> DataFrame:
    """Sparse (lat_bin, lon_bin, n), rows counted from the south."""
    west, south, east, north = box
    binned = pixels.select(bin_of(F.col("lat"), south, north, bins).alias("lat_bin"), bin_of(F.col("lon"), west, east, bins).alias("lon_bin"))
    return binned.groupBy("lat_bin", "lon_bin").agg(F.count("*").alias("n"))


def density_summary(cells: DataFrame) -> DataFrame:
    return cells.agg(F.count("*").alias("nonzero_cells"), F.coalesce(F.max("n"), F.lit(0)).alias("max_cell"))


def density_png(cells: DataFrame, bins: int = BINS) -> bytes:
    """The histogram as an image: at most bins x bins counts come to the driver."""
    grid = np.zeros((bins, bins))
    for r in cells.collect():
        grid[r.lat_bin, r.lon_bin] = r.n
    return png(heat_rgb(grid))
