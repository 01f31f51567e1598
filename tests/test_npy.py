"""Vectors beside their metadata."""

import numpy as np

from pixelarium.sources import npy


def test_import(spark, tmp_path):
    rows = [(i, 1.0 * i, 2.0, "t", i, 0) for i in range(7)]
    spark.createDataFrame(rows, "id long, lon double, lat double, tile_path string, row long, col long").write.parquet(f"{tmp_path}/metadata.parquet")
    matrix = np.arange(18, dtype=np.float32).reshape(6, 3)
    np.save(tmp_path / "embeddings.npy", matrix)
    got = npy.import_pixels(spark, f"{tmp_path}/metadata.parquet", f"{tmp_path}/embeddings.npy").orderBy("id").collect()
    assert [r.id for r in got] == list(range(6)) and [list(r.embedding) for r in got] == matrix.tolist()
