"""One local session for all tests, and raster fixtures."""

from __future__ import annotations

import os
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tests"), str(ROOT / "tests" / "llm")]
os.environ["PYTHONPATH"] = f"{ROOT}{os.pathsep}{os.environ.get('PYTHONPATH', '')}"

RING = [(122.1, 30.308), (122.108, 30.308), (122.108, 30.3), (122.1, 30.3), (122.1, 30.308)]


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    base = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g")
        .config("spark.sql.warehouse.dir", str(base / "warehouse")).config("spark.checkpoint.dir", f"file://{base}/checkpoints").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def write_kml(path: Path, ring=RING) -> None:
    text = " ".join(f"{x},{y},0" for x, y in ring)
    body = f"<Placemark><Polygon><outerBoundaryIs><LinearRing><coordinates>{text}</coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark>"
    path.write_text(f'<?xml version="1.0" encoding="gb2312"?><kml xmlns="http://www.opengis.net/kml/2.2"><Document>{body}</Document></kml>', encoding="gb2312")


def write_tile(path: Path, bands: np.ndarray, nodata: float | None, compress: bool = False) -> None:
    from pixelarium.functions.geo import Crs, from_lonlat
    from pixelarium.sources import tiff

    crs = Crs.from_epsg(32651)
    (x0, y0), (x1, y1) = from_lonlat(crs, *RING[0]), from_lonlat(crs, *RING[2])
    _, height, width = bands.shape
    tiff.write(str(path), bands, origin=(float(x0), float(y0)), pixel=(float(x1 - x0) / width, float(y0 - y1) / height), epsg=32651, nodata=nodata, compress=compress)


def constant_bands(count: int = 64, kind=np.int8) -> np.ndarray:
    return np.broadcast_to((np.arange(count) * 5 % 61 + 3).astype(kind)[:, None, None], (count, 4, 4)).copy()
