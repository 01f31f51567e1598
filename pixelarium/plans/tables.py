"""Pixel tables derived from the shared test tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A concave polygon over the derived pixels, and points asked for (fixed values).
POLYGON = [(121.540, 29.872), (121.548, 29.872), (121.548, 29.864), (121.544, 29.868), (121.540, 29.864), (121.540, 29.872)]
BOX = (121.541, 29.8655, 121.547, 29.8705)
NEAR_POINTS = [(121.5425, 29.8695), (121.5435, 29.8685)]
FAR_POINT = (121.60, 29.90)
SPREAD_BOX = (121.0, 29.0, 121.6, 29.4)

PIXELS_SQL = """pixels AS (
  SELECT vec_id AS id, vec_id // 25 AS prow, vec_id % 25 AS pcol,
         1.2154e2 + ((vec_id % 25) + 5e-1) * 3.2e-4 AS lon, 2.9872e1 - ((vec_id // 25) + 5e-1) * 4e-4 AS lat,
         'tile_' || (vec_id // 100) AS tile_path, embedding::DOUBLE[] AS e FROM embeddings)"""

SPREAD_SQL = """spread AS (
  SELECT 1.21e2 + ((l_partkey * 7919 + l_linenumber * 104729) % 60000) * 1e-5 AS lon,
         2.9e1 + ((l_orderkey * 7907 + l_suppkey) % 40000) * 1e-5 AS lat FROM lineitem)"""

#: The default query vector as a unit list named q.u.
QUERY_SQL = """q AS (
  SELECT list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) AS u FROM pixels WHERE id = 0)"""


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    row, col = F.expr("vec_id div 25"), F.col("vec_id") % 25
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(
        F.col("vec_id").alias("id"),
        row.alias("row"),
        col.alias("col"),
        (F.lit(1.2154e2) + (col + F.lit(0.5)) * F.lit(3.2e-4)).alias("lon"),
        (F.lit(2.9872e1) - (row + F.lit(0.5)) * F.lit(4e-4)).alias("lat"),
        F.concat(F.lit("tile_"), F.expr("vec_id div 100")).alias("tile_path"),
        "embedding",
    )


def spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions for the operators that need no vectors, one per line item."""
    x = (F.col("l_partkey") * 7919 + F.col("l_linenumber") * 104729) % 60000
    y = (F.col("l_orderkey") * 7907 + F.col("l_suppkey")) % 40000
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select((F.lit(1.21e2) + x * F.lit(1e-5)).alias("lon"), (F.lit(2.9e1) + y * F.lit(1e-5)).alias("lat"))


def query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return list(pixels(spark, sf_dir).where("id = 0").select("embedding").first()[0])
