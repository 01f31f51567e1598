"""Diagnostic reports over pixel tables and raster folders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelarium.functions import vector
from pixelarium.functions.grid import Grid
from pixelarium.sources import files, rasters

from . import histogram
from .search import nearest_of_each

INFO_KEYS = ("vector_count", "tile_count", "index_type", "data_dir", "build_time")
POINT_GRID, BOX_GRID = 5, 6


def info_summary(info: dict | None) -> dict:
    return {k: info[k] for k in INFO_KEYS if k in info} if info else {}


def overview(metadata: DataFrame, embeddings: DataFrame, info: dict | None = None) -> dict:
    """Counts of metadata and vectors, ids without a vector, share of zero vectors.
    ``embeddings`` has id and embedding; a valid id is below the vectors' number."""
    vectors = embeddings.agg(F.count("*").alias("n"), F.avg(vector.all_zero(F.col("embedding")).cast("int")).alias("zero")).first()
    rows = metadata.agg(F.count("*").alias("n"), F.count_if((F.col("id") < 0) | (F.col("id") >= vectors.n)).alias("bad")).first()
    wanted = (info or {}).get("vector_count")
    return {
        "build_info_present": info is not None,
        "build_info": info_summary(info),
        "metadata_row_count": rows.n,
        "embedding_count": vectors.n,
        "row_count_match": rows.n == vectors.n,
        "invalid_id_count": rows.bad,
        "embedding_sample": {"sample_zero_ratio": vectors.zero},
        "build_info_comparison": {"vector_count_matches_metadata": wanted == rows.n, "vector_count_matches_embeddings": wanted == vectors.n} if info else {},
    }


def lattice(box: Sequence[float], n: int = POINT_GRID) -> list[tuple[float, float]]:
    west, south, east, north = map(float, box)
    at = [i / (n - 1) for i in range(n)]
    return [(west + (east - west) * x, south + (north - south) * y) for y in at for x in at]


def point_sampling(pixels: DataFrame, sample: int = 1000, info: dict | None = None) -> dict:
    """Nearest-pixel lookups at up to ``sample`` pixels (by id) and on a 5 by 5
    lattice over the bounds."""
    box = histogram.bounds(pixels).first()
    own = pixels.orderBy("id").limit(sample).select("id", "lon", "lat").collect()
    points = [(r.lon, r.lat) for r in own] + (lattice((box.min_lon, box.min_lat, box.max_lon, box.max_lat)) if own else [])
    found = []
    if points:
        hits = nearest_of_each(pixels, points).join(pixels.select("id", vector.all_zero(F.col("embedding")).alias("zero")), "id")
        found = sorted(hits.collect(), key=lambda r: r.point)
    self_hits = sum(found[i].id == r.id for i, r in enumerate(own))
    return {
        "build_info_present": info is not None,
        "metadata_sample_point_count": len(own),
        "grid_point_count": len(points) - len(own),
        "local_hit_count": sum(not r.used_fallback for r in found),
        "global_fallback_count": sum(r.used_fallback for r in found),
        "zero_return_count": sum(r.zero for r in found),
        "metadata_self_hit_ratio": self_hits / len(own) if own else None,
        "query_results": [{"lon": r.x, "lat": r.y, "id": r.id, "used_global_fallback": r.used_fallback, "zero": r.zero} for r in found],
    }


def split_boxes(box: Sequence[float], n: int = BOX_GRID) -> list[tuple[int, float, float, float, float]]:
    west, south, east, north = map(float, box)
    xs, ys = [west + (east - west) * i / n for i in range(n + 1)], [south + (north - south) * i / n for i in range(n + 1)]
    return [(j * n + i, xs[i], ys[j], xs[i + 1], ys[j + 1]) for j in range(n) for i in range(n)]


def classify(candidates: Column, zeros: Column, selected: Column) -> Column:
    return F.when(candidates == 0, "empty").when(zeros == selected, "all_zero").when(zeros == 0, "nonzero").otherwise("mixed")


def box_scan(pixels: DataFrame, box: Sequence[float], samples: int = 100, n: int = BOX_GRID) -> DataFrame:
    """One row for each of n by n boxes over ``box``: its pixels, the pixels that a
    grid extract selects, how many of them are zero vectors, and a class. Every
    pixel meets the boxes in one pass, as an array of constants."""
    boxes = split_boxes(box, n)
    grids = {b: Grid.over((w, s, e, t), samples) for b, w, s, e, t in boxes}
    shape = F.array(*[F.struct(F.lit(b).alias("box"), *[F.lit(v).alias(k) for k, v in zip(("west", "south", "east", "north"), xs, strict=True)], F.lit(grids[b].rows).alias("rows"), F.lit(grids[b].cols).alias("cols")) for b, *xs in boxes])
    rows = pixels.select("id", "lon", "lat", vector.all_zero(F.col("embedding")).alias("zero"))
    met = rows.select("*", F.explode(F.filter(shape, lambda b: (F.col("lon") >= b["west"]) & (F.col("lon") <= b["east"]) & (F.col("lat") >= b["south"]) & (F.col("lat") <= b["north"]))).alias("b"))
    step = lambda lo, hi, k: F.greatest(F.col(f"b.{hi}") - F.col(f"b.{lo}"), F.lit(1e-9)) / F.col(f"b.{k}")
    clip = lambda x, k: F.least(F.greatest(F.floor(x), F.lit(0)), F.col(f"b.{k}") - 1)
    cell = clip((F.col("b.north") - F.col("lat")) / step("south", "north", "rows"), "rows") * F.col("b.cols") + clip((F.col("lon") - F.col("b.west")) / step("west", "east", "cols"), "cols")
    first = met.groupBy(F.col("b.box").alias("box"), cell.alias("cell")).agg(F.min(F.struct("id", "zero")).alias("f"), F.count("*").alias("n"))
    per = first.groupBy("box").agg(F.sum("n").alias("candidate_count"), F.count("*").alias("selected_count"), F.count_if("f.zero").alias("zero_count"))
    every = pixels.sparkSession.createDataFrame(boxes, "box int, west double, south double, east double, north double")
    zero = lambda c: F.coalesce(c, F.lit(0))
    out = every.join(per, "box", "left").select("box", "west", "south", "east", "north", *[zero(F.col(c)).alias(c) for c in ("candidate_count", "selected_count", "zero_count")])
    ratio = F.when(F.col("selected_count") > 0, F.col("zero_count") / F.col("selected_count"))
    return out.withColumns({"selected_zero_ratio": ratio, "classification": classify(F.col("candidate_count"), F.col("zero_count"), F.col("selected_count"))})


def box_report(pixels: DataFrame, info: dict | None = None, samples: int = 100) -> dict:
    box = histogram.bounds(pixels).first()
    rows = box_scan(pixels, (box.min_lon, box.min_lat, box.max_lon, box.max_lat), samples).orderBy("box").collect() if box.n else []
    return {"build_info_present": info is not None, "bbox_count": len(rows), "bbox_reports": [r.asDict() for r in rows]}


def distribution_report(pixels: DataFrame, folder: str, info: dict | None = None, bins: int = histogram.BINS) -> dict:
    """Bounds, density and its picture, written below ``folder``/diagnostics."""
    box = histogram.bounds(pixels).first()
    path = f"{folder}/diagnostics/metadata_distribution.png"
    report = {
        "derived_dir": folder, "metadata_row_count": box.n, "bbox": [box.min_lon, box.min_lat, box.max_lon, box.max_lat] if box.n else None,
        "build_info_present": info is not None, "build_info": info_summary(info), "lon_bins": bins, "lat_bins": bins,
        "nonzero_cell_count": 0, "max_cell_count": 0, "output_image_path": path, "scale": "log1p",
    }
    cells = histogram.density(pixels, tuple(report["bbox"] or (0.0, 0.0, 1.0, 1.0)), bins)
    summary = histogram.density_summary(cells).first()
    report |= {"nonzero_cell_count": summary.nonzero_cells, "max_cell_count": summary.max_cell}
    files.write_bytes(pixels.sparkSession, path, histogram.density_png(cells, bins))
    return report


def tif_overview(spark: SparkSession, folder: str) -> dict:
    tiles = rasters.scan_tiles(spark, folder)
    rows = tiles.drop("a", "b", "c", "d", "e", "f").collect()  # a header per file
    box = tiles.agg(F.min("min_lon"), F.min("min_lat"), F.max("max_lon"), F.max("max_lat")).first()
    bands = {str(r["count"]): r["n"] for r in tiles.groupBy("count").agg(F.count("*").alias("n")).orderBy("count").collect()}
    return {"tile_count": len(rows), "band_count_distribution": bands, "tiles": [r.asDict() for r in rows], "overall_bbox_wgs84": list(box) if rows else None}


def pixel_classes(pixels: DataFrame) -> DataFrame:
    """Per raster: pixels at nodata, valid and all zero, and the other valid ones."""
    zero = F.col("valid") & vector.all_zero(F.col("bands"))
    return pixels.groupBy("tile_path").agg(
        F.count("*").alias("sampled_pixels"), F.count_if(~F.col("valid")).alias("nodata_pixels"), F.count_if(zero).alias("all_zero_pixels"),
        F.count_if(F.col("valid") & ~vector.all_zero(F.col("bands"))).alias("nonzero_valid_pixels"),
    )


def tif_pixel_sampling(spark: SparkSession, folder: str, block: int = 512) -> dict:
    """Every pixel is classed, raster by raster, in parallel."""
    rows = pixel_classes(rasters.scan_pixels(spark, folder, block)).orderBy("tile_path").collect()
    total = lambda c: sum(r[c] for r in rows)
    return {
        "tile_count": len(rows), "sampled_pixel_total": total("sampled_pixels"), "nodata_pixel_total": total("nodata_pixels"),
        "all_zero_pixel_total": total("all_zero_pixels"), "nonzero_valid_pixel_total": total("nonzero_valid_pixels"),
        "tiles": [r.asDict() for r in rows], "parallel_workers": spark.sparkContext.defaultParallelism,
    }


