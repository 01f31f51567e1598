"""Geometry, grids, images and clustering against independent formulas."""

import math
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import write_kml
from pixelarium.functions import geo, grid, imaging
from pixelarium.operators import cluster, coarse, search
from pixelarium.operators.basemap import resample, tile_box
from pixelarium.operators.boundary import Boundary
from pixelarium.sources import kml, tiff

CONCAVE = Boundary([[(0, 0), (4, 0), (4, 4), (2, 2), (0, 4), (0, 0)]])


@settings(deadline=None, max_examples=60)
@given(st.floats(-80, 80), st.floats(-3, 3), st.integers(1, 60))
def test_utm_there_and_back(lat, away, zone):
    crs = geo.Crs.from_epsg((32700 if lat < 0 else 32600) + zone)
    lon = crs.central_meridian + away
    x, y = geo.from_lonlat(crs, lon, lat)
    lon2, lat2 = geo.to_lonlat(crs, x, y)
    assert abs(lon - lon2) < 1e-9 and abs(lat - lat2) < 1e-9


def test_utm_scale_and_origin():
    crs = geo.Crs.from_epsg(32631)
    assert np.allclose(geo.from_lonlat(crs, 3.0, 0.0), (500000.0, 0.0))
    arc = geo.from_lonlat(crs, 3.0, 45.0)[1] / 0.9996
    lat = np.radians(np.linspace(0, 45, 200001))
    e2 = geo.FLATTENING * (2 - geo.FLATTENING)
    m = geo.SEMI_MAJOR * (1 - e2) / (1 - e2 * np.sin(lat) ** 2) ** 1.5
    assert abs(arc - np.trapezoid(m, lat)) < 1e-3
    with pytest.raises(ValueError, match="unsupported"):
        geo.Crs.from_epsg(3857)


def test_square_box():
    w, s, e, n = geo.square_box(122.06, 29.5, 5.0)
    assert abs((n - s) / 2 * 111320 - 5000) < 1 and abs((e - w) / 2 * 111320 * math.cos(math.radians(29.5)) - 5000) < 1
    assert geo.square_box(0, 90, 1)[3] > 90


def test_grid_shape():
    g = grid.Grid.over((0, 0, 2, 1), 100)
    assert (g.rows, g.cols) == (7, 15)
    assert (grid.Grid.over((0, 0, 0, 0), 1).rows, grid.Grid.over((0, 0, 0, 0), 1).cols) == (2, 2)
    assert grid.even_indices(2000, 100)[-1] == 1999 and grid.even_indices(5, 10) == [0, 1, 2, 3, 4]


def test_concave_clip():
    assert CONCAVE.clip((1, 2.5, 3, 5)) == [1, 2.5, 3, 3]
    assert CONCAVE.clip((1.5, 2.6, 2.5, 5)) is None
    assert CONCAVE.clip((4, 0, 6, 1)) == [4, 0, 4, 1]
    assert CONCAVE.clip((1, 0.5, 2, 1)) == [1, 0.5, 2, 1]
    assert CONCAVE.box == [0, 0, 4, 4] and CONCAVE.meets_box((3, 3, 9, 9)) and not CONCAVE.meets_box((5, 5, 6, 6))


@settings(deadline=None, max_examples=40)
@given(st.floats(-1, 5), st.floats(-1, 5), st.floats(0, 4), st.floats(0, 4))
def test_clip_holds_dense_points(x, y, w, h):
    box = (x, y, x + w, y + h)
    xs, ys = np.linspace(x, x + w, 15), np.linspace(y, y + h, 15)
    inside = [(a, b) for a in xs for b in ys if CONCAVE.has_point(float(a), float(b))]
    got = CONCAVE.clip(box)
    if inside:
        assert got and got[0] <= min(a for a, _ in inside) + 1e-9 and got[3] >= max(b for _, b in inside) - 1e-9


def test_rows_inside(spark):
    rows = spark.createDataFrame([(1.0, 1.0), (2.0, 3.0), (0.0, 2.0), (2.0, 2.0), (5.0, 1.0)], "x double, y double")
    got = rows.select(CONCAVE.contains_strict(rows.x, rows.y), CONCAVE.contains(rows.x, rows.y)).collect()
    assert [tuple(r) for r in got] == [(True, True), (False, False), (False, True), (False, True), (False, False)]
    assert [CONCAVE.has_point(*p) for p in ((1, 1), (2, 3), (0, 2), (2, 2), (5, 1))] == [True, False, True, True, False]


def test_kml(spark, tmp_path):
    write_kml(tmp_path / "b.kml")
    got = kml.load_boundary(spark, str(tmp_path / "b.kml"), str(tmp_path / "c" / "cache.json"))
    assert got.box == [122.1, 30.3, 122.108, 30.308]
    assert kml.load_boundary(spark, str(tmp_path / "b.kml"), str(tmp_path / "c" / "cache.json")).box == got.box
    write_kml(tmp_path / "b.kml", [(0, 0), (1, 0), (1, 1), (0, 0)])
    assert kml.load_boundary(spark, str(tmp_path / "b.kml"), str(tmp_path / "c" / "cache.json")).box == [0, 0, 1, 1]
    (tmp_path / "none.kml").write_text("<kml><Placemark><Point><coordinates>1,2,0</coordinates></Point></Placemark></kml>")
    with pytest.raises(ValueError, match="No polygons"):
        kml.read_kml(spark, str(tmp_path / "none.kml"))


@pytest.mark.parametrize("kind", [np.int8, np.uint8, np.int16, np.float32, np.float64])
@pytest.mark.parametrize("compress", [False, True])
def test_tiff_roundtrip(tmp_path, kind, compress):
    bands = np.random.default_rng(1).integers(0, 100, (3, 7, 5)).astype(kind)
    tiff.write(str(tmp_path / "t.tif"), bands, origin=(10.0, 20.0), pixel=(0.5, 0.25), epsg=4326, nodata=3, compress=compress)
    t = tiff.read_header((tmp_path / "t.tif").read_bytes())
    assert (t.width, t.height, t.count, t.nodata, str(t.crs)) == (5, 7, 3, 3.0, "EPSG:4326")
    assert t.bounds == (10.0, 18.25, 12.5, 20.0)
    assert np.array_equal(t.window(0, 0, 7, 5), bands) and np.array_equal(t.window(2, 1, 3, 2), bands[:, 2:5, 1:3])


def test_decoders():
    assert tiff._packbits(bytes([2, 1, 2, 3, 254, 9])) == bytes([1, 2, 3, 9, 9, 9])
    codes, bits = [256, 65, 66, 258, 257], ""
    for c in codes:
        bits += format(c, "09b")
    bits += "0" * (-len(bits) % 8)
    assert tiff._lzw(bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)), 4) == b"ABAB"


def test_png():
    image = imaging.png(np.arange(12, dtype=np.uint8).reshape(3, 2, 2))
    at = image.index(b"IDAT")
    size = struct.unpack(">I", image[at - 4 : at])[0]
    assert zlib.decompress(image[at + 4 : at + 4 + size]) == bytes([0, 0, 4, 8, 1, 5, 9, 0, 2, 6, 10, 3, 7, 11])


def test_stretch_and_resample():
    band = np.linspace(0, 1000, 101)[None, None, :]
    got = imaging.stretch_uint8(band)
    assert got[0, 0, 0] == 0 and got[0, 0, -1] == 255 and got[0, 0, 50] == 127
    assert imaging.stretch_uint8(np.full((1, 2, 2), 5.0)).max() == 0
    same = np.arange(16, dtype=np.uint8).reshape(1, 4, 4)
    assert np.array_equal(resample(same, 4, 4), same)
    assert tile_box((0, 0, 4, 4), 1, 1, 0) == (2, 2, 4, 4)


def test_silhouette_by_loops():
    draw = np.random.default_rng(3)
    v, labels = draw.normal(size=(30, 4)).astype(np.float32), draw.integers(0, 3, 30)
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(2))
    want = []
    for i in range(30):
        own = [d[i, j] for j in range(30) if j != i and labels[j] == labels[i]]
        b = min(np.mean([d[i, j] for j in range(30) if labels[j] == k]) for k in set(labels) - {labels[i]})
        want.append((b - np.mean(own)) / max(np.mean(own), b) if own else 0)
    assert abs(cluster.silhouette(v, labels) - np.mean(want)) < 1e-5
    assert cluster.silhouette(v, np.zeros(30)) == -1


def test_candidate_ks():
    assert cluster.candidate_ks(3, 3, 6) == [2] and cluster.candidate_ks(2, 3, 6) == [] and cluster.candidate_ks(100, 3, 6) == [3, 4, 5, 6]


def test_spacing_of_crowded_hits(spark):
    """The best hits lie in one place: each fold keeps its size and finds the next."""
    rows = [(i, 10.0 + (i % 5) * 1e-5, 50.0, 1.0 - i / 1e4) for i in range(400)] + [(400 + i, 11.0 + i, 50.0, 0.5 - i / 100) for i in range(6)]
    hits = spark.createDataFrame(rows, "id long, lon double, lat double, score double")
    got = search.diversify(hits, 5, 1000.0, first=3).collect()
    assert sorted(r.id for r in got) == [0, 400, 401, 402, 403]
    few = search.diversify(hits, 5, 1000.0, first=3, bound=400).collect()
    assert [r.id for r in few] == [0]
    assert search.diversify(hits.limit(0), 5, 1000.0).count() == 0


def test_nearest_of_many_points(spark):
    draw = np.random.default_rng(3)
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(draw.uniform(0, 0.3, (400, 2)))]
    points = [(float(x), float(y)) for x, y in draw.uniform(-0.05, 0.35, (120, 2))] + [(rows[7][1] + 0.01, rows[7][2]), (5.0, -5.0)]
    got = {r.point: r for r in search.nearest_of_each(spark.createDataFrame(rows, "id long, lon double, lat double"), points).collect()}
    assert len(got) == len(points)
    for i, (x, y) in enumerate(points):
        best = min((not (x - 0.01 <= lon <= x + 0.01 and y - 0.01 <= lat <= y + 0.01), (lon - x) * (lon - x) + (lat - y) * (lat - y), j) for j, lon, lat in rows)
        assert (got[i].used_fallback, got[i].dist2, got[i].id) == best
    assert search.nearest_of_each(spark.createDataFrame([], "id long, lon double, lat double"), points).count() == 0


def test_running_sums_and_short_samples(spark):
    rows = spark.createDataFrame([(i * 37 - 900, i) for i in range(3000)], "id long, v long").repartition(5)
    got = {r.id: r.sum for r in cluster.running(rows, F.col("v"), "sum", block=100).collect()}
    assert got == {i * 37 - 900: i * (i + 1) // 2 for i in range(3000)}
    kept = sorted(r.id for r in cluster.even_sample_short(rows, 70).collect())
    assert kept == sorted((i * 3000 // 70) * 37 - 900 for i in range(70))
    assert cluster.even_sample_short(rows, 3000).count() == 3000


def test_ids_beyond_the_table(spark):
    from pyspark.sql import Row

    pixels = spark.createDataFrame([Row(id=i, lon=0.0, lat=0.0, tile_path="t", row=0, col=i, embedding=[1.0, 2.0]) for i in (0, 1, 5)])
    assert coarse.id_range(pixels).first().asDict() == {"n": 3, "invalid": 1}
    with pytest.raises(ValueError, match="1 ids"):
        coarse.build_coarse(pixels, stride=1, reduced=2)


def test_more_clusters_than_rows(spark):
    cells = spark.createDataFrame([(0, i, [float(i), 1.0]) for i in range(3)], "grid_row long, grid_col long, embedding array<float>")
    got = cluster.cluster(cells, k=5)
    assert sorted(r.label for r in got.labelled.collect()) == [0, 1, 2] and got.k == 5


def test_diversify_is_greedy_and_maximal(spark):
    draw = np.random.default_rng(5)
    rows = [(i, float(draw.uniform(0, 0.02)), float(draw.uniform(0, 0.02)), float(draw.uniform())) for i in range(300)]
    hits = spark.createDataFrame(rows, "id long, lon double, lat double, score double")
    got = [r.id for r in search.ranked(search.diversify(hits, 12, 400.0, first=5)).orderBy("rank").collect()]
    kept = []

    def metres(a, b):
        p, q = math.radians(a[2]), math.radians(b[2])
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
        return 2 * 6371000 * math.atan2(math.sqrt(h), math.sqrt(1 - h))

    for r in sorted(rows, key=lambda r: (-r[3], r[0])):
        if len(kept) < 12 and all(metres(r, k) >= 400 for k in kept):
            kept.append(r)
    assert got == [r[0] for r in kept]
