"""Reports on hand-made tables and rasters."""

import numpy as np
import pytest

from conftest import constant_bands, write_tile
from pixelarium.operators import diagnostics, histogram

PIXELS = "id long, lon double, lat double, tile_path string, row long, col long, embedding array<float>"


def table(spark, places, vectors):
    rows = [(i, x, y, "t", i, 0, [float(v) for v in e]) for i, ((x, y), e) in enumerate(zip(places, vectors, strict=True))]
    return spark.createDataFrame(rows, PIXELS)


def test_overview(spark):
    meta = spark.createDataFrame([(i, float(i), 0.0) for i in range(5)], "id long, lon double, lat double")
    vectors = spark.createDataFrame([(0, [1.0, 0.0, 0.0]), (1, [0.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0]), (3, [0.0, 0.0, 0.0])], "id long, embedding array<double>")
    got = diagnostics.overview(meta, vectors, {"vector_count": 5, "tile_count": 3, "other": 1})
    assert got["metadata_row_count"] == 5 and got["embedding_count"] == 4 and not got["row_count_match"]
    assert got["invalid_id_count"] == 1 and got["embedding_sample"]["sample_zero_ratio"] == 0.5
    assert got["build_info_comparison"] == {"vector_count_matches_metadata": True, "vector_count_matches_embeddings": False}
    assert got["build_info"] == {"vector_count": 5, "tile_count": 3}


def test_point_sampling(spark):
    places = [(0.0, 0.0), (0.005, 0.005), (10.0, 10.0), (10.005, 10.005), (20.0, 20.0), (20.005, 20.005)]
    got = diagnostics.point_sampling(table(spark, places, [[1, 0, 0], [0, 0, 0], [0, 1, 0], [0, 2, 0], [0, 0, 0], [0, 0, 1]]))
    assert (got["metadata_sample_point_count"], got["grid_point_count"]) == (6, 25)
    assert got["local_hit_count"] >= 6 and got["global_fallback_count"] > 0 and got["zero_return_count"] >= 2
    assert got["metadata_self_hit_ratio"] == 1.0 and any(q["used_global_fallback"] for q in got["query_results"])


def test_box_scan(spark):
    places = [(0.1, 0.1), (0.35, 0.35), (0.6, 0.6), (5.0, 5.0), (5.3, 5.3), (5.6, 5.6), (10.0, 10.0), (10.01, 10.01), (10.02, 10.02)]
    vectors = [[0, 0, 0], [0, 0, 0], [1, 0, 0], [0, 1, 0], [0, 2, 0], [0, 0, 0], [0, 0, 0], [0, 0, 0], [0, 0, 0]]
    got = diagnostics.box_report(table(spark, places, vectors), {"vector_count": 9})
    assert got["build_info_present"] and got["bbox_count"] == 36
    kinds = {b["classification"] for b in got["bbox_reports"] if b["candidate_count"]}
    assert {"all_zero", "mixed"} <= kinds
    assert any(b["classification"] == "all_zero" and b["selected_zero_ratio"] == 1.0 for b in got["bbox_reports"])


def test_distribution(spark, tmp_path):
    pixels = table(spark, [(121.0, 29.0), (121.2, 29.1), (121.4, 29.2), (121.6, 29.4)], [[1, 0]] * 4)
    cells = {(r.lon_bin, r.lat_bin): r.n for r in histogram.density(pixels, (121.0, 29.0, 121.6, 29.4)).collect()}
    assert cells == {(0, 0): 1, (256, 192): 1, (512, 384): 1, (767, 767): 1}
    got = diagnostics.distribution_report(pixels, str(tmp_path))
    assert got["metadata_row_count"] == 4 and got["nonzero_cell_count"] == 4 and got["max_cell_count"] == 1
    assert (tmp_path / "diagnostics" / "metadata_distribution.png").stat().st_size > 0
    empty = diagnostics.distribution_report(pixels.limit(0), str(tmp_path))
    assert empty["metadata_row_count"] == 0 and empty["bbox"] is None


@pytest.fixture()
def folder(tmp_path):
    a, b = constant_bands(64, np.int16), constant_bands(768, np.int16)
    a[:, 0, 0] = b[:, 0, 0] = -9999
    a[:, 1, 1] = a[:, 1, 2] = 0
    write_tile(tmp_path / "a.tiff", a, -9999)
    write_tile(tmp_path / "b.tiff", b, -9999)
    return str(tmp_path)


def test_tif_reports(spark, folder):
    got = diagnostics.tif_overview(spark, folder)
    assert got["tile_count"] == 2 and got["band_count_distribution"] == {"64": 1, "768": 1}
    west, south, east, north = got["overall_bbox_wgs84"]
    assert 122.09 < west < 122.101 and 30.299 < south < 30.301 and 122.107 < east < 122.109 and 30.307 < north < 30.309
    got = diagnostics.tif_pixel_sampling(spark, folder)
    assert got["tile_count"] == 2 and got["parallel_workers"] >= 1
    assert (got["sampled_pixel_total"], got["nodata_pixel_total"], got["all_zero_pixel_total"], got["nonzero_valid_pixel_total"]) == (32, 2, 2, 28)
