"""Building the pixel table from rasters clipped to a boundary.

Two passes over the rasters: one counts each block's valid, inside and zero pixels
(and so fixes where its ids begin), one writes the unit vectors. The manifest comes
last and marks the table complete.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pixelarium.functions import geo, vector
from pixelarium.sources import files, rasters
from pixelarium.sources.kml import load_boundary

from .boundary import Boundary

log = logging.getLogger("pixelarium.build")
SCHEMA = "id long, lon double, lat double, tile_path string, row long, col long, embedding array<float>"
BLOCK = ["tile_path", "block_row", "block_col"]


@dataclass(frozen=True)
class BuildResult:
    tile_count: int
    vector_count: int
    folder: str
    index_type: str


def select_tiles(tiles: DataFrame, boundary: Boundary) -> DataFrame:
    """Tiles whose bounds meet the boundary's box (a pushed-down range), then the
    boundary itself (a few headers, on the driver)."""
    near = tiles.where(geo.boxes_meet([F.col(c) for c in ("min_lon", "min_lat", "max_lon", "max_lat")], boundary.box))
    kept = [r.path for r in near.collect() if boundary.meets_box((r.min_lon, r.min_lat, r.max_lon, r.max_lat))]
    return near.where(F.col("path").isin(kept)) if kept else near.limit(0)


def locate_tile(tiles: DataFrame, lon: float, lat: float) -> DataFrame:
    """The first tile by path whose bounds hold a point."""
    return tiles.where(geo.boxes_meet([F.col(c) for c in ("min_lon", "min_lat", "max_lon", "max_lat")], (lon, lat, lon, lat))).orderBy("path").limit(1)


def block_counts(pixels: DataFrame) -> DataFrame:
    """Per block: valid, inside and zero pixels, and the first zero pixel's place."""
    zero = F.col("inside") & vector.all_zero(F.col("bands"))
    return pixels.groupBy(*BLOCK).agg(
        F.count_if("valid").alias("valid"), F.count_if("inside").alias("inside_n"), F.count_if(zero).alias("zero"),
        F.min(F.when(zero, F.struct("row", "col", "lon", "lat"))).alias("first_zero"), F.max(F.size("bands")).alias("bands"), F.min(F.size("bands")).alias("least_bands"),
    )


def dense_ids(pixels: DataFrame, blocks: DataFrame) -> DataFrame:
    """Ids 0, 1, ... in the order of tile, block, row and column. ``blocks`` has
    one row per block with its number of rows (inside_n): only those rows are summed
    in order; pixels are numbered within their block, which is of bounded size."""
    ahead = Window.orderBy(*BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select(*BLOCK, F.coalesce(F.sum("inside_n").over(ahead), F.lit(0)).alias("ahead"))
    own = F.row_number().over(Window.partitionBy(*BLOCK).orderBy("row", "col")) - 1
    return pixels.withColumn("at", own).join(offsets, BLOCK).withColumn("id", (F.col("at") + F.col("ahead")).cast("long")).drop("at", "ahead")


def build_index(spark: SparkSession, data_dir: str, kml: str, folder: str, *, year: int = 2024, block_size: int = 512, boundary: Boundary | None = None) -> BuildResult:
    """Writes ``folder``/pixels.parquet and, only on success, build_info.json.

    A zero vector inside the boundary, or tiles with different numbers of bands,
    end the build with an error; no selected pixel gives an empty table.
    """
    cache = f"{folder}/boundary.geojson"
    boundary = boundary or load_boundary(spark, kml, cache)
    tiles = select_tiles(rasters.scan_tiles(spark, data_dir), boundary)
    selected = [r.path for r in tiles.select("path").orderBy("path").collect()]
    for i, path in enumerate(selected, 1):
        log.info("tile_start tile_index=%d/%d path=%s", i, len(selected), path)
    table = f"{folder}/pixels.parquet"
    total = 0
    if not selected:
        spark.createDataFrame([], SCHEMA).write.mode("overwrite").parquet(table)
    else:
        scanned = rasters.scan_pixels(spark, data_dir, block_size).where(F.col("tile_path").isin(selected))
        placed = scanned.withColumn("inside", F.col("valid") & boundary.contains_strict(F.col("lon"), F.col("lat")))
        blocks = block_counts(placed).cache()
        try:
            total = _check_blocks(blocks)
            numbered = dense_ids(placed.where("inside"), blocks)
            unit = vector.l2_normalize(F.col("bands")).cast("array<float>").alias("embedding")
            rows = numbered.select("id", "lon", "lat", "tile_path", "row", "col", unit)
            rows.repartitionByRange(F.col("id")).sortWithinPartitions("id").write.mode("overwrite").option("maxRecordsPerFile", 1_000_000).parquet(table)
        finally:
            blocks.unpersist()
    for i, path in enumerate(selected, 1):
        log.info("tile_done tile_index=%d/%d path=%s", i, len(selected), path)
    info = {
        "year": year, "data_dir": data_dir, "boundary_kml_path": kml, "boundary_cache_path": cache, "pixels_path": table,
        "build_time": datetime.now(UTC).isoformat(), "tile_count": len(selected), "vector_count": total, "selected_tiles": selected,
        "index_type": "numpy_exact", "block_size": block_size,
    }
    files.write_json(spark, f"{folder}/build_info.json", info)
    return BuildResult(len(selected), total, folder, "numpy_exact")


def _check_blocks(blocks: DataFrame) -> int:
    """Logs one line per block (their number follows the rasters' headers) and
    returns the pixels inside; the first zero vector is an error."""
    total, widths = 0, set()
    for r in blocks.orderBy(*BLOCK).toLocalIterator():
        place = f"tile={r.tile_path} block={r.block_row},{r.block_col}"
        log.info("block_scan %s valid_pixels=%d", place, r.valid)
        log.info("block_filter %s inside_pixels=%d valid_pixels=%d", place, r.inside_n, r.valid)
        if r.zero:
            z = r.first_zero
            message = (
                f"all-zero vector in {r.tile_path} at row={z.row}, col={z.col} ({z.lon}, {z.lat}); "
                f"its block has {r.zero} of them among {r.inside_n} pixels inside and {r.valid} valid ones"
            )
            log.error("zero_vector_error %s", message)
            raise ValueError(message)
        total += r.inside_n
        widths |= {r.bands, r.least_bands} if r.inside_n else set()
        log.info("block_ready %s vectors=%d total_after_append=%d", place, r.inside_n, total)
    if len(widths) > 1:
        raise ValueError(f"inconsistent band count across tiles: {sorted(widths)}")
    return total
