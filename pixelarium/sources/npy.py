"""Import of tables whose vectors lie in a .npy matrix beside their metadata.

Row i of the matrix belongs to id i. The matrix is mapped, not loaded: each task reads
the rows of its ids from a path that all executors share.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shipping import map_arrow


def read_matrix(ids: DataFrame, path: str) -> DataFrame:
    """(id, embedding) for a column of ids; ids without a row are left out."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix = np.load(path, mmap_mode="r")
        for batch in batches:
            wanted = batch.column(0).to_numpy(zero_copy_only=False)
            wanted = wanted[(wanted >= 0) & (wanted < len(matrix))]
            rows = np.asarray(matrix[wanted], np.float32)
            at = pa.array(np.arange(0, rows.size + 1, max(1, matrix.shape[1])), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(wanted, pa.int64()), pa.ListArray.from_arrays(at, pa.array(rows.ravel()))], ["id", "embedding"])

    return map_arrow(ids.select(F.col("id").cast("long")), run, "id long, embedding array<float>")


def import_pixels(spark: SparkSession, metadata: str, matrix: str) -> DataFrame:
    """The pixel table of a metadata Parquet file and its matrix. Ids sorted within
    ranges keep each task's reads of the matrix in order."""
    rows = spark.read.parquet(metadata)
    ids = rows.select("id").repartitionByRange("id").sortWithinPartitions("id")
    return rows.join(read_matrix(ids, matrix), "id").select("id", "lon", "lat", "tile_path", "row", "col", "embedding")
