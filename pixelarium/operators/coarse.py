"""The coarse index: strided pixels, randomly projected, quantised to int8."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from datetime import datetime, timezone

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelarium.functions import geo, vector
from pixelarium.sources.shipping import map_arrow

from .search import diversify, best_first, ranked, unit

STRIDE, REDUCED, SEED = 4, 128, 20240424
COARSE = "id long, q array<tinyint>"
LEAST_KEPT = 500


def projection_matrix(dim: int, reduced: int, seed: int = SEED) -> np.ndarray:
    """Normal draws with unit columns; the identity where nothing is reduced."""
    if reduced == dim:
        return np.eye(dim, dtype=np.float32)
    drawn = np.random.default_rng(seed).normal(size=(dim, reduced)).astype(np.float32)
    lengths = np.linalg.norm(drawn, axis=0, keepdims=True)
    return (drawn / np.where(lengths == 0, 1.0, lengths)).astype(np.float32)


def matrix_sha256(matrix: np.ndarray) -> str:
    return hashlib.sha256(np.ascontiguousarray(matrix, "<f4").tobytes()).hexdigest()


def strided(pixels: DataFrame, stride: int) -> DataFrame:
    """Pixels on every stride-th row and column; where there is none, every
    stride-th pixel by id."""
    if stride <= 1:
        return pixels
    kept = pixels.where((F.col("row") % stride == 0) & (F.col("col") % stride == 0))
    if kept.limit(1).count() or not pixels.limit(1).count():
        return kept
    return every_nth(pixels, stride)


def every_nth(pixels: DataFrame, n: int) -> DataFrame:
    """Rows 0, n, 2n, ... by id. Numbered within ranges of ids, then offset, so no
    task sees more than its range."""
    spark = pixels.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = pixels.agg(F.percentile_approx("id", [i / parts for i in range(1, parts)] or [0.5], 10_000).alias("c")).first()["c"] or []
    part = F.size(F.filter(F.array(*[F.lit(c).cast("long") for c in cuts]), lambda c: c < F.col("id")))
    placed = pixels.withColumn("__part", part)
    ahead = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    offsets = placed.groupBy("__part").agg(F.count("*").alias("__n")).withColumn("__ahead", F.coalesce(F.sum("__n").over(ahead), F.lit(0))).drop("__n")
    own = F.row_number().over(Window.partitionBy("__part").orderBy("id")) - 1
    return placed.withColumn("__at", own).join(F.broadcast(offsets), "__part").where((F.col("__at") + F.col("__ahead")) % n == 0).drop("__part", "__at", "__ahead")


@dataclass
class CoarseIndex:
    table: DataFrame  # id, q, lon, lat, tile_path, row, col
    matrix: np.ndarray
    info: dict


def quantise(pixels: DataFrame, matrix: np.ndarray) -> DataFrame:
    """id and q: each vector projected, made a unit vector and rounded to int8, by
    one matrix product per Arrow batch."""
    p = matrix.astype(float)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = pc.list_flatten(batch.column(1)).to_numpy(zero_copy_only=False).astype(float)
            v = flat.reshape(batch.num_rows, p.shape[0]) @ p
            length = np.sqrt((v * v).sum(1, keepdims=True))
            q = np.clip(np.rint(v / np.where(length == 0, 1, length) * 127), -127, 127).astype(np.int8)
            at = pa.array(np.arange(0, q.size + 1, p.shape[1]), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(at, pa.array(q.ravel(), pa.int8()))], ["id", "q"])

    return map_arrow(pixels.select("id", "embedding"), run, COARSE)


def id_range(pixels: DataFrame) -> DataFrame:
    """One row: how many rows there are, and how many ids are not from 0 to one less."""
    ids = pixels.agg(F.count("*").alias("n"), F.count_if(F.col("id") < 0).alias("below"))
    # one row
    above = pixels.crossJoin(F.broadcast(ids)).agg(F.max("n").alias("n"), F.max("below").alias("below"), F.count_if(F.col("id") >= F.col("n")).alias("above"))
    return above.select(F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("below", F.lit(0)) + F.col("above")).alias("invalid"))


def build_coarse(pixels: DataFrame, *, stride: int = STRIDE, reduced: int = REDUCED, seed: int = SEED, source_info: dict | None = None) -> CoarseIndex:
    if stride < 1:
        raise ValueError("stride must be >= 1")
    if reduced < 1:
        raise ValueError("reduced_dim must be >= 1")
    first = pixels.select(F.size("embedding").alias("n")).first()
    dim = first["n"] if first else 64
    if reduced > dim:
        raise ValueError("reduced_dim is more than the vectors have")
    ids = id_range(pixels).first()
    if ids["invalid"]:
        raise ValueError(f"{ids['invalid']} ids are beyond the {ids['n']} vectors")
    matrix = projection_matrix(dim, reduced, seed)
    chosen = strided(pixels, stride)
    table = quantise(chosen, matrix).join(chosen.select("id", "lon", "lat", "tile_path", "row", "col"), "id")
    info = {
        "source_vector_count": ids["n"], "source_dim": dim, "reduced_dim": reduced, "stride": stride, "projection_seed": seed, "quantization": "symmetric_int8_scale_127",
        "projection_sha256": matrix_sha256(matrix), "source_index_type": (source_info or {}).get("index_type"),
    }
    return CoarseIndex(table, matrix, info)


def save_coarse(index: CoarseIndex, folder: str) -> dict:
    """Table and projection as Parquet, the description as JSON, last."""
    spark = index.table.sparkSession
    index.table.write.mode("overwrite").parquet(f"{folder}/coarse.parquet")
    rows = [(i, j, float(index.matrix[i, j])) for i in range(index.matrix.shape[0]) for j in range(index.matrix.shape[1])]
    spark.createDataFrame(rows, "i int, j int, w float").coalesce(1).write.mode("overwrite").parquet(f"{folder}/projection.parquet")
    source = f"{folder}/pixels.parquet"
    info = {  # names of the manifest's entries (fixed values)
        "build_time": datetime.now(timezone.utc).isoformat(), "source_metadata_path": source, "source_embeddings_path": source, "source_build_info_path": f"{folder}/build_info.json",
        "coarse_embeddings_path": f"{folder}/coarse.parquet", "coarse_ids_path": f"{folder}/coarse.parquet", "coarse_projection_path": f"{folder}/projection.parquet",
        "coarse_vector_count": spark.read.parquet(f"{folder}/coarse.parquet").count(),
    } | index.info
    spark.createDataFrame([(json.dumps(info),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/coarse_info.json")
    return info


def load_coarse(spark, folder: str) -> CoarseIndex | None:
    """None unless all parts are there; a projection that isn't the one described,
    or whose shape doesn't fit, is an error."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    if not all(fs.exists(hadoop(f"{folder}/{x}")) for x in ("coarse.parquet", "projection.parquet", "coarse_info.json")):
        return None
    info = json.loads(spark.read.text(f"{folder}/coarse_info.json").first()["value"])
    rows = spark.read.parquet(f"{folder}/projection.parquet").collect()  # dim x reduced numbers
    matrix = np.zeros((max(r.i for r in rows) + 1, max(r.j for r in rows) + 1), np.float32)
    for r in rows:
        matrix[r.i, r.j] = r.w
    if matrix_sha256(matrix) != info["projection_sha256"]:
        raise ValueError("the stored projection is not the one described")
    table = spark.read.parquet(f"{folder}/coarse.parquet")
    width = table.select(F.size("q").alias("n")).first()
    if width is not None and width["n"] != matrix.shape[1]:
        raise ValueError("coarse vectors do not match the projection's columns.")
    return CoarseIndex(table, matrix, info)


def keep_count(k: int) -> int:
    """How many of the best coarse hits are looked at: 20 for each result, yet no
    more than 500 unless more results are wanted."""
    return max(k, min(20 * k, max(k, LEAST_KEPT)))


def coarse_top_k(index: CoarseIndex | None, query: Sequence[float], k: int, *, box: Sequence[float] | None = None, min_score: float = 0.0, min_distance_m: float = 0.0) -> DataFrame:
    """Top-k of the coarse index by (q . projected query) / 127, which rounding may
    push a little over 1. Spacing looks at ``keep_count`` hits only."""
    if index is None:
        raise ValueError("there is no coarse index: build one")
    if len(query) != index.matrix.shape[0]:
        raise ValueError(f"the query has {len(query)} dimensions, the coarse index was made of {index.matrix.shape[0]}")
    projected = unit(np.asarray(unit(query)) @ index.matrix.astype(float))
    rows = index.table if box is None else index.table.where(geo.in_box(F.col("lon"), F.col("lat"), box))
    hits = rows.withColumn("score", vector.dot(F.col("q"), vector.literal(projected)) / F.lit(127.0))
    if min_score > 0:
        hits = hits.where(F.col("score") >= F.lit(float(min_score)))
    if min_distance_m > 0:
        return ranked(diversify(hits, k, min_distance_m, first=keep_count(k), bound=keep_count(k)))
    return ranked(hits.orderBy(*best_first()).limit(k))
