"""Density of pixel files as they arrive.

New Parquet files of a folder are read by Structured Streaming; each micro-batch adds
its cells to the running histogram, which is kept as stateful counts per cell.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pixelarium.functions.grid import bin_of
from pixelarium.operators.build import SCHEMA


def arriving_pixels(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def running_density(pixels: DataFrame, box: tuple[float, float, float, float], bins: int = 768) -> DataFrame:
    """(lat_bin, lon_bin, n); the state has one count per cell, however many pixels."""
    west, south, east, north = box
    cells = pixels.select(bin_of(F.col("lat"), south, north, bins).alias("lat_bin"), bin_of(F.col("lon"), west, east, bins).alias("lon_bin"))
    return cells.groupBy("lat_bin", "lon_bin").agg(F.count("*").alias("n"))


def start(density: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    return density.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
