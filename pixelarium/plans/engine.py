"""The query engine: a pixel table, a boundary and what is asked of them."""

from __future__ import annotations

import os
from collections.abc import Sequence
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelarium.functions.geo import square_box, validate_box
from pixelarium.operators import basemap, coarse, region, search
from pixelarium.operators.boundary import Boundary
from pixelarium.operators.build import SCHEMA
from pixelarium.operators.cluster import cluster
from pixelarium.sources import files, rasters
from pixelarium.sources.kml import load_boundary

PREFIX = "PIXELARIUM_"


@dataclass(frozen=True)
class Settings:
    folder: str = "derived"
    service_name: str = "Local embedding search"
    year: int = 2024
    data_dir: str = ""
    boundary_kml: str = ""
    basemap_dir: str = ""
    basemap_cache_dir: str = ""

    @staticmethod
    def from_env(env: dict[str, str] | None = None) -> Settings:
        """Fields from variables PIXELARIUM_<FIELD>, defaults for the others."""
        env = os.environ if env is None else env
        given = {f.name: env[PREFIX + f.name.upper()] for f in fields(Settings) if PREFIX + f.name.upper() in env}
        if "year" in given:
            given["year"] = int(given["year"])
        return Settings(**given)


def _number(name: str, value: float, low: float, high: float | None = None) -> None:
    if not (value >= low and (high is None or value <= high)):
        raise ValueError(f"{name} must be >= {low}" + (f" and <= {high}" if high is not None else ""))


@dataclass
class Engine:
    """Opened once; every method builds one lazy plan and returns plain results.
    Errors of parameters and of state are ValueErrors."""

    spark: SparkSession
    settings: Settings
    pixels: DataFrame
    info: dict
    boundary: Boundary
    coarse_index: coarse.CoarseIndex | None = None
    _counts: dict = field(default_factory=dict)

    @staticmethod
    def open(spark: SparkSession, settings: Settings) -> Engine:
        """A missing table or manifest gives an empty index, not an error."""
        folder = settings.folder
        info = files.read_json(spark, f"{folder}/build_info.json")
        there = info is not None and files.exists(spark, f"{folder}/pixels.parquet")
        pixels = spark.read.schema(SCHEMA).parquet(f"{folder}/pixels.parquet") if there else spark.createDataFrame([], SCHEMA)
        boundary = load_boundary(spark, settings.boundary_kml, f"{folder}/boundary.geojson")
        return Engine(spark, settings, pixels, info or {}, boundary, coarse.load_coarse(spark, folder))

    # -- status -----------------------------------------------------------
    @property
    def vector_count(self) -> int:
        if "n" not in self._counts:
            self._counts["n"] = self.pixels.count()
        return self._counts["n"]

    @property
    def dimension(self) -> int:
        if "dim" not in self._counts:
            row = self.pixels.select(F.size("embedding").alias("n")).first()
            self._counts["dim"] = row["n"] if row else 64
        return self._counts["dim"]

    @property
    def index_type(self) -> str:
        return self.info.get("index_type", "numpy_exact") + ("+coarse" if self.coarse_index else "")

    def health(self) -> dict:
        i = self.coarse_index.info if self.coarse_index else {}
        return {
            "status": "ok", "service_name": self.settings.service_name, "year": self.settings.year, "index_loaded": self.vector_count > 0,
            "vector_count": self.vector_count, "index_type": self.index_type, "coarse_index_loaded": self.coarse_index is not None,
            "coarse_vector_count": i.get("coarse_vector_count", 0), "coarse_dim": i.get("reduced_dim"), "coarse_stride": i.get("stride"),
        }

    def index_info(self) -> dict:
        return self.health() | {
            "dim": self.dimension, "tile_count": self.info.get("tile_count", 0), "data_dir": self.info.get("data_dir"), "build_time": self.info.get("build_time"),
            "pixels_path": f"{self.settings.folder}/pixels.parquet", "coarse_path": f"{self.settings.folder}/coarse.parquet", "boundary_bbox": self.boundary.box,
        }

    # -- basemaps ---------------------------------------------------------
    def basemaps(self) -> list[dict]:
        if not self.settings.basemap_dir or not files.exists(self.spark, self.settings.basemap_dir):
            return []
        return [r.asDict() for r in rasters.list_basemaps(self.spark, self.settings.basemap_dir).collect()]

    def basemap_tile(self, basemap_id: str, z: int, x: int, y: int) -> bytes | None:
        if not self.settings.basemap_dir or not self.settings.basemap_cache_dir:
            return None
        return basemap.tile_png(self.spark, self.settings.basemap_dir, self.settings.basemap_cache_dir, basemap_id, z, x, y)

    # -- queries ----------------------------------------------------------
    def embedding_by_point(self, lon: float, lat: float) -> dict:
        """The nearest pixel's vector, under the lon and lat asked for."""
        _number("lon", lon, -180, 180)
        _number("lat", lat, -90, 90)
        if not self.boundary.has_point(lon, lat):
            raise ValueError("the position is not inside the boundary")
        row = search.nearest(self.pixels, lon, lat).first()
        if row is None:
            raise ValueError("there are no pixels: build the index")
        return {"year": self.settings.year, "lon": lon, "lat": lat, "tile_path": row.tile_path, "row": row.row, "col": row.col, "embedding": list(row.embedding)}

    def search_by_embedding(
        self, embedding: Sequence[float], top_k: int = 10, *, bbox: Sequence[float] | None = None, min_distance_m: float = 100.0, min_score: float = 0.0, search_mode: str = "fine"
    ) -> dict:
        """Hits best first. The box, or else the boundary's, is cut down to the
        bounds of what the boundary has in it; a box apart from it finds nothing."""
        if not len(embedding):
            raise ValueError("embedding must not be empty")
        _number("top_k", top_k, 1, 1000)
        _number("min_distance_m", min_distance_m, 0)
        _number("min_score", min_score, 0, 1)
        if search_mode not in ("fine", "coarse"):
            raise ValueError("search_mode must be fine or coarse")
        box = self.boundary.box if bbox is None else self.boundary.clip(validate_box(bbox))
        if box is None or self.vector_count == 0:
            return {"top_k": top_k, "result_count": 0, "results": []}
        if search_mode == "coarse":
            hits = coarse.coarse_top_k(self.coarse_index, embedding, top_k, box=box, min_score=min_score, min_distance_m=min_distance_m)
            hits = hits.withColumn("embedding", F.col("q").cast("array<float>"))
        else:
            inside = self.pixels.where(search.geo.in_box(F.col("lon"), F.col("lat"), box))
            if inside.limit(1).count() == 0:
                return {"top_k": top_k, "result_count": 0, "results": []}
            search.require_dimension(self.pixels, embedding)
            hits = search.exact_top_k(inside, embedding, top_k, min_score=min_score, min_distance_m=min_distance_m, batches=True)
        rows = hits.orderBy("rank").collect()  # top_k rows
        keys = ("rank", "score", "lon", "lat", "embedding", "tile_path", "row", "col")
        return {"top_k": top_k, "result_count": len(rows), "results": [{k: r[k] for k in keys} for r in rows]}

    def grid(self, bbox: Sequence[float], total_samples: int) -> tuple[DataFrame | None, object, list[float]]:
        box = self.boundary.clip(validate_box(bbox))
        if box is None:
            return None, None, []
        cells, grid = region.grid_extract(self.pixels, box, total_samples)
        return cells, grid, box

    def embeddings_by_bbox(self, bbox: Sequence[float], total_samples: int = 5000) -> dict:
        """A grid extract as columns, ordered by cell; at most the grid's cells."""
        _number("total_samples", total_samples, 100, 50_000)
        return self._extract(bbox, total_samples)

    def _extract(self, bbox: Sequence[float], total_samples: int) -> dict:
        cells, grid, box = self.grid(bbox, total_samples)
        rows = cells.orderBy("grid_row", "grid_col").collect() if cells is not None else []
        if not rows:
            grid = None
        return {
            "count": len(rows), "lons": [r.lon for r in rows], "lats": [r.lat for r in rows], "embeddings": [list(r.embedding) for r in rows],
            "grid_rows": grid.rows if grid else 0, "grid_cols": grid.cols if grid else 0,
            "grid_row_indices": [r.grid_row for r in rows], "grid_col_indices": [r.grid_col for r in rows], "effective_bbox": box,
        }

    # -- scenes -----------------------------------------------------------
    def point_query_scene(self, points: Sequence[dict], *, top_k: int = 20, min_distance_m: float = 50.0, min_score: float = 0.9, search_radius_km: float = 5.0, year: int | None = None) -> dict:
        """Search by the mean vector of some points, around their centre."""
        if not points:
            raise ValueError("give at least one point")
        _number("top_k", top_k, 1)
        _number("min_distance_m", min_distance_m, 0)
        _number("min_score", min_score, 0, 1)
        if search_radius_km <= 0:
            raise ValueError("the search radius has to be positive")
        for i, p in enumerate(points, 1):
            if "lon" not in p or "lat" not in p:
                raise ValueError(f"point {i} lacks lon or lat")
            if not self.boundary.has_point(float(p["lon"]), float(p["lat"])):
                raise ValueError("the position is not inside the boundary")
        places = [(float(p["lon"]), float(p["lat"])) for p in points]
        found = search.nearest_of_each(self.pixels, places)
        rows = sorted(self.pixels.join(F.broadcast(found.select("point", "id")), "id").collect(), key=lambda r: r.point)  # one per point
        if not rows:
            raise ValueError("there are no pixels: build the index")
        n = len(rows)
        mean = [sum(v) / n for v in zip(*(r.embedding for r in rows), strict=True)]
        centre = {"lon": sum(x for x, _ in places) / n, "lat": sum(y for _, y in places) / n}
        box = square_box(centre["lon"], centre["lat"], search_radius_km)
        hits = self.search_by_embedding(mean, top_k, bbox=box, min_distance_m=min_distance_m, min_score=min_score)
        out = {
            "scene": "point-query", "point_count": n,
            "query_points": [{"lon": x, "lat": y, "tile_path": r.tile_path, "row": r.row, "col": r.col} for (x, y), r in zip(places, rows, strict=True)],
            "avg_embedding": mean, "search_center": centre, "search_bbox": box, **hits,
        }
        return out | ({"year": year} if year is not None else {})

    def region_cluster_scene(
        self, bbox: Sequence[float], *, total_samples: int = 5000, cluster_budget: int = 1000, k_min: int = 3, k_max: int = 6, random_seed: int = 42, max_iter: int = 100, k: int | None = None, year: int | None = None
    ) -> dict:
        """Clusters of a grid extract; ``k`` fixes their number."""
        validate_box(bbox)
        _number("total_samples", total_samples, 1)
        _number("cluster_budget", cluster_budget, 1)
        if k_min < 2 or k_max < k_min:
            raise ValueError("least and most clusters must be 2 or more, in this order")
        cells, grid, box = self.grid(bbox, total_samples)
        rows, fitted = [], None
        if cells is not None:
            kept = cells.cache()
            try:
                if kept.limit(1).count():
                    fitted = cluster(kept, budget=cluster_budget, k_min=k_min, k_max=k_max, seed=random_seed, rounds=max_iter, k=k)
                    rows = fitted.labelled.orderBy("grid_row", "grid_col").collect()
            finally:
                kept.unpersist()
        out = {
            "scene": "region-cluster", "count": len(rows), "selected_k": fitted.k if fitted else 0, "k_candidates": fitted.candidates if fitted else [],
            "k_scores": {str(n): s for n, s in fitted.scores.items()} if fitted else {}, "cluster_sample_size": fitted.sample_size if fitted else 0,
            "labels": [r.label for r in rows], "centroids": [list(c) for c in fitted.centroids] if fitted else [],
            "lons": [r.lon for r in rows], "lats": [r.lat for r in rows], "grid_rows": grid.rows if rows else 0, "grid_cols": grid.cols if rows else 0,
            "grid_row_indices": [r.grid_row for r in rows], "grid_col_indices": [r.grid_col for r in rows], "effective_bbox": box,
        }
        return out | ({"year": year} if year is not None else {})
