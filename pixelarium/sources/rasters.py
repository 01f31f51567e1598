"""Raster tables: tile headers, pixel blocks, basemap listings.

Headers are parsed and pixels are read on the executors, block by block. Files whose
store Arrow reaches are opened there, and only the header and the blocks asked for are
read, whatever the file's size. In a store that only Spark reads, files come whole from
the binaryFile source, which takes up to 2 GiB.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelarium.functions.geo import to_lonlat

from . import tiff
from .shipping import map_arrow

TILES = (
    "path string, crs string, width int, height int, count int, nodata double, "
    "min_lon double, min_lat double, max_lon double, max_lat double, a double, b double, c double, d double, e double, f double"
)
PIXELS = "tile_path string, block_row int, block_col int, row long, col long, lon double, lat double, valid boolean, bands array<float>"
LISTING = "path string, name string, width int, height int, band_count int, left double, bottom double, right double, top double, error string"


def _local(path: str) -> str:
    return path.removeprefix("file://").removeprefix("file:") if path.startswith("file:") else path


def files(spark: SparkSession, folder: str, pattern: str = "*.tif*", recursive: bool = False) -> DataFrame:
    """(path, content) of a folder's rasters; none where the folder has none."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], "path string, modificationTime timestamp, length long, content binary")
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower())
    return reader.load(folder)


def _rows(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    names = [p.strip().split(" ")[0] for p in schema.split(",")]
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "array<float>": pa.list_(pa.float32()), "binary": pa.binary()}
    types = [kinds[p.strip().split(" ")[1]] for p in schema.split(",")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)


def opened(path: str) -> tiff.Ranges:
    """A file opened through Arrow."""
    from pyarrow import fs

    local = path.startswith(("file:", "/"))
    store, name = (fs.LocalFileSystem(), _local(path)) if local else fs.FileSystem.from_uri(path)
    return tiff.Ranges(store.open_input_file(name))


def located(spark: SparkSession, folder: str, pattern: str = "*.tif*", recursive: bool = False) -> DataFrame:
    """(path, content) of a folder's rasters; content is null where Arrow can open
    the files, so that it isn't read."""
    found = files(spark, folder, pattern, recursive).select("path", "content")
    first = found.select("path").first()
    try:
        if first is not None:
            opened(first["path"])
    except Exception:  # a store that Arrow doesn't know or reach
        return found
    return found.select("path", F.lit(None).cast("binary").alias("content"))


def _header(path: str, content: bytes | None) -> tiff.Tiff:
    return tiff.read_header(opened(path) if content is None else content)


def scan_tiles(spark: SparkSession, folder: str) -> DataFrame:
    """The tile catalogue: one header row per file of the folder itself, by path."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                t = _header(path, content.as_py())
                rows.append((_local(path), str(t.crs), t.width, t.height, t.count, t.nodata, *t.bounds_wgs84, *t.affine))
            yield _rows(TILES, rows)

    return map_arrow(located(spark, folder), run, TILES).orderBy("path")


def scan_pixels(spark: SparkSession, folder: str, block: int = 512, every_band: bool = True) -> DataFrame:
    """One row per pixel, block by block: place, position in degrees, whether it is
    valid (no band at the nodata value, NaN included) and its bands."""

    def strips(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                n = -(-_header(path, content.as_py()).height // block)
                yield pa.RecordBatch.from_arrays([pa.array([path] * n), pa.array(range(n), pa.int32())], ["path", "strip"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, strip, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                t = _header(path, content.as_py())
                for r in range(0, t.height, block) if strip < 0 else (strip * block,):
                    for c in range(0, t.width, block):
                        yield _pixel_batch(_local(path), t, r, c, min(block, t.height - r), min(block, t.width - c), block)

    found = located(spark, folder)
    if found.where("content IS NOT NULL").select("path").limit(1).count():
        # whole files, one task each
        return map_arrow(found.select("path", F.lit(-1).alias("strip"), "content").repartition("path"), run, PIXELS)
    # one row for each row of blocks, so that a large file is read by many tasks
    parts = map_arrow(found, strips, "path string, strip int")
    return map_arrow(parts.repartition("path", "strip").select("path", "strip", F.lit(None).cast("binary").alias("content")), run, PIXELS)


def _pixel_batch(path: str, t: tiff.Tiff, r: int, c: int, rows: int, cols: int, block: int) -> pa.RecordBatch:
    data = t.window(r, c, rows, cols).reshape(t.count, -1)
    row, col = np.divmod(np.arange(rows * cols), cols)
    row, col = row + r, col + c
    if t.nodata is None:
        valid = np.ones(rows * cols, bool)
    elif np.isnan(t.nodata):
        valid = ~np.isnan(data.astype(float)).any(0)
    else:
        valid = (data != t.nodata).all(0)
    a, b, x0, d, e, y0 = t.affine
    lon, lat = to_lonlat(t.crs, x0 + (col + 0.5) * a + (row + 0.5) * b, y0 + (col + 0.5) * d + (row + 0.5) * e)
    flat = np.ascontiguousarray(data.T.astype(np.float32)).ravel()
    bands = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, t.count), pa.int32()), pa.array(flat, pa.float32()))
    n = rows * cols
    columns = [
        pa.array([path] * n, pa.string()), pa.array(np.full(n, r // block), pa.int32()), pa.array(np.full(n, c // block), pa.int32()),
        pa.array(row, pa.int64()), pa.array(col, pa.int64()), pa.array(lon, pa.float64()), pa.array(lat, pa.float64()), pa.array(valid), bands,
    ]
    return pa.RecordBatch.from_arrays(columns, [p.strip().split(" ")[0] for p in PIXELS.split(",")])


def basemap_id(path: Column) -> Column:
    """16 hex digits of the path's SHA-1."""
    return F.substring(F.sha1(path.cast("binary")), 1, 16)


def find_basemap(spark: SparkSession, folder: str, wanted: str):
    """(path, modificationTime) of the raster with that id, or None: the folder is
    listed, and no raster is opened."""
    listed = files(spark, folder, "*.{tif,tiff}", True).select(F.regexp_replace("path", "^file:(//)?", "").alias("path"), "modificationTime")
    return listed.where(basemap_id(F.col("path")) == wanted).first()


def list_basemaps(spark: SparkSession, folder: str) -> DataFrame:
    """Rasters of a folder and those below it, by path; a file that can't be read
    becomes a row with its error. ``id`` is 16 hex digits of the path's SHA-1."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                path = _local(path)
                try:
                    t = _header(path, content.as_py())
                    rows.append((path, path.rsplit("/", 1)[-1], t.width, t.height, t.count, *t.bounds, None))
                except Exception as problem:
                    rows.append((path, path.rsplit("/", 1)[-1], None, None, None, None, None, None, None, str(problem)))
            yield _rows(LISTING, rows)

    listed = map_arrow(located(spark, folder, "*.{tif,tiff}", True), run, LISTING)
    return listed.withColumn("id", basemap_id(F.col("path"))).withColumn("tile_url_template", F.concat(F.lit("/offline/basemaps/"), "id", F.lit("/tiles/{z}/{x}/{y}.png"))).orderBy("path")


def pixel_at(spark: SparkSession, folder: str, path: str, lon: float, lat: float) -> dict:
    """One pixel's samples straight from its raster; outside the extent or on
    nodata is an error."""
    from pixelarium.functions.geo import from_lonlat

    found = located(spark, folder).where(F.col("path").endswith(path)).first()
    if found is None:
        raise ValueError(f"no such tile: {path}")
    t = _header(found["path"], found["content"])
    x, y = from_lonlat(t.crs, lon, lat)
    a, b, c, d, e, f = t.affine
    det = a * e - b * d
    col = int(np.floor((e * (x - c) - b * (y - f)) / det))
    row = int(np.floor((a * (y - f) - d * (x - c)) / det))
    if not (0 <= row < t.height and 0 <= col < t.width):
        raise ValueError("the raster does not reach this position")
    values = t.window(row, col, 1, 1)[:, 0, 0]
    if t.nodata is not None and (values == t.nodata).any():
        raise ValueError("no data at this position")
    return {"tile_path": path, "row": row, "col": col, "embedding": values.astype(np.float32).tolist()}
