"""The build and the engine on small rasters."""

import logging

import numpy as np
import pytest

from conftest import RING, constant_bands, write_kml, write_tile
from pixelarium.operators import build, coarse
from pixelarium.plans.engine import Engine, Settings
from pixelarium.sources import rasters


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("build")
    (root / "tiles").mkdir()
    write_kml(root / "edge.kml")
    bands = constant_bands()
    bands[:, 0, 0] = -128
    write_tile(root / "tiles" / "test.tiff", bands, -128)
    result = build.build_index(spark, str(root / "tiles"), str(root / "edge.kml"), str(root / "derived"), block_size=2)
    return root, result


def engine_of(spark, root, **more):
    return Engine.open(spark, Settings(folder=str(root / "derived"), boundary_kml=str(root / "edge.kml"), **more))


def test_manifest_matches_table(spark, built):
    root, result = built
    engine = engine_of(spark, root)
    assert (result.tile_count, result.vector_count) == (1, 15)
    assert engine.info["vector_count"] == engine.vector_count == 15
    ids = [r.id for r in engine.pixels.orderBy("id").collect()]
    assert ids == list(range(15))
    assert engine.dimension == 64 and engine.health()["index_loaded"]


def test_ids_follow_blocks(spark, built):
    rows = engine_of(spark, built[0]).pixels.orderBy("id").collect()
    order = [(r.row // 2, r.col // 2, r.row, r.col) for r in rows]
    assert order == sorted(order)
    assert all(abs(sum(v * v for v in r.embedding) - 1) < 1e-5 for r in rows)


def test_point_lookup(spark, built):
    engine = engine_of(spark, built[0])
    found = engine.embedding_by_point(122.106, 30.304)
    assert len(found["embedding"]) == 64 and (found["lon"], found["lat"]) == (122.106, 30.304)
    with pytest.raises(ValueError, match="not inside the boundary"):
        engine.embedding_by_point(121.60, 30.10)


def test_search_rules(spark, built):
    engine = engine_of(spark, built[0])
    query = engine.embedding_by_point(122.106, 30.304)["embedding"]
    box = [122.1, 30.3, 122.108, 30.308]
    assert 1 <= engine.search_by_embedding(query, 3, bbox=box, min_distance_m=0)["result_count"] <= 3
    apart = engine.search_by_embedding(query, 10, bbox=box, min_distance_m=300)
    assert 1 <= apart["result_count"] < 10
    hits = apart["results"]
    for i, a in enumerate(hits):
        for b in hits[i + 1 :]:
            d = 6371000 * 2 * np.arcsin(
                np.sqrt(np.sin(np.radians(b["lat"] - a["lat"]) / 2) ** 2 + np.cos(np.radians(a["lat"])) * np.cos(np.radians(b["lat"])) * np.sin(np.radians(b["lon"] - a["lon"]) / 2) ** 2)
            )
            assert d >= 300 - 1e-6
    with pytest.raises(ValueError, match="dim"):
        engine.search_by_embedding([1, 2, 3], 3, bbox=box)
    with pytest.raises(ValueError, match="top_k"):
        engine.search_by_embedding(query, 1001)
    assert engine.search_by_embedding(query, 3, bbox=[0, 0, 1, 1])["results"] == []
    with pytest.raises(ValueError, match="no coarse index"):
        engine.search_by_embedding(query, 3, search_mode="coarse")


def test_coarse_roundtrip(spark, built, tmp_path):
    root, _ = built
    pixels = engine_of(spark, root).pixels
    index = coarse.build_coarse(pixels, stride=2, reduced=8, seed=123)
    info = coarse.save_coarse(index, str(tmp_path))
    assert info["coarse_vector_count"] == 3 and info["quantization"] == "symmetric_int8_scale_127"
    again = coarse.load_coarse(spark, str(tmp_path))
    query = list(pixels.first().embedding)
    hits = coarse.coarse_top_k(again, query, 3).collect()
    assert 1 <= len(hits) <= 3 and all(len(h.q) == 8 for h in hits)
    assert np.array_equal(coarse.projection_matrix(64, 64), np.eye(64, dtype=np.float32))
    with pytest.raises(ValueError, match="reduced_dim"):
        coarse.build_coarse(pixels)
    with pytest.raises(ValueError, match="stride"):
        coarse.build_coarse(pixels, stride=0)
    assert coarse.load_coarse(spark, str(tmp_path / "none")) is None


def test_zero_vector_stops_the_build(spark, tmp_path, caplog):
    (tmp_path / "tiles").mkdir()
    write_kml(tmp_path / "edge.kml")
    bands = constant_bands(64, np.int16)
    bands[:, 1, 2] = 0
    write_tile(tmp_path / "tiles" / "zero.tif", bands, -9999)
    with caplog.at_level(logging.INFO, "pixelarium.build"), pytest.raises(ValueError, match="all-zero vector.*zero.tif.*row=1, col=2"):
        build.build_index(spark, str(tmp_path / "tiles"), str(tmp_path / "edge.kml"), str(tmp_path / "out"), block_size=2)
    text = caplog.text
    assert all(mark in text for mark in ("tile_start", "block_scan", "zero_vector_error"))
    assert not (tmp_path / "out" / "build_info.json").exists()


def test_mixed_band_counts_are_refused(spark, tmp_path):
    (tmp_path / "tiles").mkdir()
    write_kml(tmp_path / "edge.kml")
    write_tile(tmp_path / "tiles" / "a.tif", constant_bands(4), None)
    write_tile(tmp_path / "tiles" / "b.tif", constant_bands(5), None)
    with pytest.raises(ValueError, match="inconsistent band count"):
        build.build_index(spark, str(tmp_path / "tiles"), str(tmp_path / "edge.kml"), str(tmp_path / "out"))


def test_empty_index(spark, tmp_path):
    write_kml(tmp_path / "edge.kml")
    (tmp_path / "derived").mkdir()
    engine = engine_of(spark, tmp_path)
    assert engine.dimension == 64 and not engine.health()["index_loaded"]
    assert engine.search_by_embedding([1.0] * 64)["results"] == []
    with pytest.raises(ValueError, match="no pixels"):
        engine.embedding_by_point(122.106, 30.304)
    got = engine.embeddings_by_bbox([122.1, 30.3, 122.108, 30.308], 100)
    assert got["count"] == 0 and got["effective_bbox"]


@pytest.fixture(scope="module")
def quadrants(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("quadrants")
    (root / "tiles").mkdir()
    write_kml(root / "edge.kml")
    row, col = np.mgrid[0:8, 0:8]
    bands = np.full((64, 8, 8), 10, np.int8)
    for q in range(4):
        inside = (row // 4 == q // 2) & (col // 4 == q % 2)
        bands[16 * q : 16 * q + 16, inside] = 90
    write_tile(root / "tiles" / "q.tif", (bands + ((row + col) % 3 - 1)).astype(np.int8), -128, compress=True)
    build.build_index(spark, str(root / "tiles"), str(root / "edge.kml"), str(root / "derived"), block_size=4)
    return engine_of(spark, root)


def test_region_clusters(quadrants):
    got = quadrants.region_cluster_scene([122.1, 30.3, 122.108, 30.308], total_samples=64, year=2024)
    assert got["selected_k"] in got["k_candidates"] == [3, 4, 5, 6] and got["year"] == 2024
    assert len(got["labels"]) == got["count"] == got["cluster_sample_size"]
    assert len(got["centroids"]) == got["selected_k"] and set(got["k_scores"]) == {"3", "4", "5", "6"}
    fixed = quadrants.region_cluster_scene([122.1, 30.3, 122.108, 30.308], total_samples=64, k=2)
    assert fixed["selected_k"] == 2
    tiny = quadrants.region_cluster_scene([122.1, 30.3, 122.101, 30.301], total_samples=1)
    assert tiny["selected_k"] == tiny["count"] if tiny["count"] <= 1 else tiny["selected_k"] >= 1
    away = quadrants.region_cluster_scene([0, 0, 1, 1])
    assert away["count"] == 0 and away["effective_bbox"] == []


def test_point_scene(quadrants):
    got = quadrants.point_query_scene([{"lon": 122.1025, "lat": 30.3055}, {"lon": 122.1035, "lat": 30.3045}], top_k=5, min_distance_m=0, min_score=0, search_radius_km=2)
    assert got["point_count"] == 2 and len(got["avg_embedding"]) == 64 and got["result_count"] >= 1
    with pytest.raises(ValueError, match="at least one"):
        quadrants.point_query_scene([])
    with pytest.raises(ValueError, match="point 1 lacks"):
        quadrants.point_query_scene([{"lon": 1.0}])


def test_grid_extract_layout(quadrants):
    got = quadrants.embeddings_by_bbox([122.09, 30.286, 122.12, 30.326], 100)
    assert got["effective_bbox"] == [RING[0][0], RING[2][1], RING[1][0], RING[0][1]]
    keys = [r * got["grid_cols"] + c for r, c in zip(got["grid_row_indices"], got["grid_col_indices"], strict=True)]
    assert keys == sorted(set(keys)) and got["count"] == len(keys)
    north = max(range(got["count"]), key=lambda i: got["lats"][i])
    assert got["grid_row_indices"][north] == min(got["grid_row_indices"])
    with pytest.raises(ValueError, match="total_samples"):
        quadrants.embeddings_by_bbox([122.09, 30.286, 122.12, 30.326], 99)


def test_basemap_tiles(spark, built, tmp_path):
    root, _ = built
    (tmp_path / "maps").mkdir()
    write_tile(tmp_path / "maps" / "m.tif", (np.arange(3 * 16).reshape(3, 4, 4) * 100).astype(np.uint16), None)
    (tmp_path / "maps" / "broken.tif").write_bytes(b"nothing")
    engine = engine_of(spark, root, basemap_dir=str(tmp_path / "maps"), basemap_cache_dir=str(tmp_path / "cache"))
    listed = {m["name"]: m for m in engine.basemaps()}
    assert listed["broken.tif"]["error"] and listed["m.tif"]["band_count"] == 3
    tile = engine.basemap_tile(listed["m.tif"]["id"], 1, 0, 1)
    assert tile[:8] == b"\x89PNG\r\n\x1a\n"
    assert engine.basemap_tile(listed["m.tif"]["id"], 1, 0, 1) == tile
    assert engine.basemap_tile(listed["m.tif"]["id"], 1, 2, 0) is None
    assert engine.basemap_tile(listed["m.tif"]["id"], 11, 0, 0) is None
    assert engine.basemap_tile("0" * 16, 0, 0, 0) is None


def test_pixels_by_ranges_equal_whole_files(spark, tmp_path, monkeypatch):
    """Strips of blocks are read apart; a store that Arrow doesn't reach is read whole."""
    bands = np.random.default_rng(1).integers(0, 90, (3, 23, 17)).astype(np.int16)
    (tmp_path / "tiles").mkdir()
    write_tile(tmp_path / "tiles" / "a.tif", bands, 7, compress=True)
    write_tile(tmp_path / "tiles" / "b.tif", bands[:, :9, :5], None)
    names = ["tile_path", "row", "col"]
    ranged = rasters.scan_pixels(spark, str(tmp_path / "tiles"), block=4)
    found = {tuple(r[n] for n in names): (r.valid, list(r.bands), r.block_row, r.block_col) for r in ranged.collect()}
    assert len(found) == 23 * 17 + 9 * 5
    for (path, row, col), (valid, values, i, j) in found.items():
        want = bands[:, row, col]
        assert values == want.tolist() and (i, j) == (row // 4, col // 4) and valid == (path.endswith("b.tif") or not (want == 7).any())

    def refuse(path):
        raise OSError(path)

    monkeypatch.setattr(rasters, "opened", refuse)
    whole = rasters.scan_pixels(spark, str(tmp_path / "tiles"), block=4).collect()
    assert {tuple(r[n] for n in names): (r.valid, list(r.bands), r.block_row, r.block_col) for r in whole} == found
