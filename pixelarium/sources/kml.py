"""Boundary sources: KML placemarks, a GeoJSON cache keyed by the KML's content."""

from __future__ import annotations

import hashlib
import json
import os
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from pixelarium.operators.boundary import Boundary


def parse_ring(text: str) -> list[tuple[float, float]]:
    """Closed ring of "lon,lat[,height]" items."""
    ring = [(float(p.split(",")[0]), float(p.split(",")[1])) for p in text.split()]
    return ring + ring[:1] if ring and ring[0] != ring[-1] else ring


def read_kml(spark: SparkSession, path: str) -> Boundary:
    """The first coordinates of each placemark, as one polygon each.

    Holes and further parts of a placemark are not read; rings of fewer than four
    points are skipped; a file without polygons is an error. Bytes that the
    encoding doesn't know are ignored.
    """
    content = spark.read.format("binaryFile").load(path).select("content").first()["content"]
    text = bytes(content).decode("gb2312", errors="ignore")
    frame = spark.createDataFrame([(text,)], "kml string")
    marks = frame.select(F.explode(F.regexp_extract_all("kml", F.lit(r"(?s)<(?:\w+:)?Placemark\b.*?</(?:\w+:)?Placemark>"), F.lit(0))).alias("mark"))
    first = marks.select(F.regexp_extract("mark", r"(?s)<(?:\w+:)?coordinates[^>]*>(.*?)</", 1).alias("c"))
    rings = [parse_ring(r.c) for r in first.where("trim(c) != ''").collect()]
    rings = [r for r in rings if len(r) >= 4]
    if not rings:
        raise ValueError(f"No polygons found in KML: {path}")
    return Boundary(rings)


def load_boundary(spark: SparkSession, path: str, cache: str | None = None) -> Boundary:
    """Read-through cache; a cache made from another KML is replaced."""
    if cache is None:
        return read_kml(spark, path)
    mark = hashlib.sha256(Path(path).read_bytes()).hexdigest() if os.path.exists(path) else None
    if os.path.exists(cache):
        payload = json.loads(Path(cache).read_text(encoding="utf-8"))
        if mark is None or payload.get("source_sha256") in (None, mark):
            return from_geojson(payload)
    boundary = read_kml(spark, path)
    os.makedirs(os.path.dirname(cache) or ".", exist_ok=True)
    Path(cache).write_text(json.dumps(to_geojson(boundary) | {"source_sha256": mark}), encoding="utf-8")
    return boundary


def to_geojson(boundary: Boundary) -> dict:
    return {"type": "MultiPolygon", "coordinates": [[list(map(list, ring))] for ring in boundary.rings]}


def from_geojson(payload: dict) -> Boundary:
    polygons = payload["coordinates"] if payload["type"] == "MultiPolygon" else [payload["coordinates"]]
    return Boundary([[tuple(p[:2]) for p in polygon[0]] for polygon in polygons])
