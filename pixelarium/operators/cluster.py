"""Region clustering: k-means with the number of clusters chosen by silhouette.

Training happens on an even sample of at most the cluster budget (1000 rows), one
task for each candidate k; labels are then assigned to all rows by expressions over
the centroids.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelarium.functions import vector
from pixelarium.functions.grid import even_indices
from pixelarium.sources.shipping import ship

FIT = "k int, score double, centroids array<array<float>>"


def candidate_ks(rows: int, k_min: int, k_max: int) -> list[int]:
    """Cluster numbers worth trying, none where two clusters need more rows."""
    top = min(k_max, rows - 1)
    return [] if top < 2 else list(range(min(max(k_min, 2), top), top + 1))


def nearest_centroid(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Index of the nearest centroid, the lowest where several are."""
    gaps = ((vectors[:, None, :] - centroids[None, :, :]) ** 2).sum(axis=2)
    return gaps.argmin(axis=1)


def seed_centroids(vectors: np.ndarray, k: int, draw: np.random.Generator) -> np.ndarray:
    """k-means++: each next centroid is drawn by squared distance to those so far."""
    n = len(vectors)
    chosen = [vectors[int(draw.integers(0, n))]]
    gap = ((vectors - chosen[0]) ** 2).sum(axis=1)
    while len(chosen) < k:
        mass = float(gap.sum())
        if mass > 0:
            at = min(int(np.searchsorted(np.cumsum(gap), float(draw.random()) * mass, side="left")), n - 1)
            chosen.append(vectors[at])
            gap = np.minimum(gap, ((vectors - chosen[-1]) ** 2).sum(axis=1))
        else:
            chosen.append(vectors[int(draw.integers(0, n))])
    return np.array(chosen, np.float32)


def fit(vectors: np.ndarray, k: int, seed: int = 42, rounds: int = 100) -> np.ndarray:
    """Lloyd's iteration from k-means++ seeds. Labels count as all zero at first, so
    a first assignment to one cluster ends it; an empty cluster takes a random row."""
    draw = np.random.default_rng(seed + k)
    centroids, labels = seed_centroids(vectors, k, draw), np.zeros(len(vectors), int)
    for _ in range(rounds):
        now = nearest_centroid(vectors, centroids)
        if (now == labels).all():
            break
        labels = now
        for c in range(k):
            own = vectors[labels == c]
            centroids[c] = own.mean(axis=0) if len(own) else vectors[int(draw.integers(0, len(vectors)))]
    return centroids


def silhouette(vectors: np.ndarray, labels: np.ndarray) -> float:
    """Mean Euclidean silhouette; lone members count 0, fewer than two clusters -1."""
    kinds, code = np.unique(labels, return_inverse=True)
    if len(vectors) < 2 or len(kinds) < 2:
        return -1.0
    gaps = np.sqrt(((vectors[:, None, :] - vectors[None, :, :]) ** 2).sum(axis=2)).astype(np.float32)
    member = np.eye(len(kinds))[code]
    sizes = member.sum(axis=0)
    sums = gaps.astype(float) @ member
    own, rows = sizes[code], np.arange(len(code))
    a = sums[rows, code] / np.maximum(own - 1, 1)
    other = sums / sizes
    other[rows, code] = np.inf
    b = other.min(axis=1)
    widest = np.maximum(a, b)
    return float(np.where((own > 1) & (widest > 0), (b - a) / np.where(widest > 0, widest, 1), 0.0).mean())


def label_column(embedding: Column, centroids: Sequence[Sequence[float]]) -> Column:
    """Label of the nearest centroid as an expression, ties to the lower label."""
    gaps = F.array(*[F.struct(vector.squared_distance(embedding, vector.literal(c)).alias("gap"), F.lit(i).alias("label")) for i, c in enumerate(centroids)])
    return F.array_min(gaps)["label"]


def even_sample(cells: DataFrame, budget: int, order: Sequence[str], rows: int) -> DataFrame:
    """Rows at ``even_indices`` of a bounded table (a grid extract)."""
    if rows <= budget:
        return cells
    at = F.broadcast(cells.sparkSession.createDataFrame([(i,) for i in even_indices(rows, budget)], "at long"))
    numbered = cells.withColumn("at", (F.row_number().over(Window.orderBy(*order)) - 1).cast("long"))
    return numbered.join(at, "at").drop("at")


def running(rows: DataFrame, value: Column, name: str = "running", block: int = 4096) -> DataFrame:
    """``rows`` plus the sum of ``value`` over all rows up to each, by ``id`` (a long).
    Blocks of neighbouring ids are summed on their own; only their sums, one row for
    each block, meet in one task."""
    own, before = hidden(rows, "block"), hidden(rows, "before")
    placed = rows.withColumns({own: F.floor(F.col("id") / block), name: value})
    sums = placed.groupBy(own).agg(F.sum(name).alias("total"))
    ahead = Window.orderBy(own).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(own, F.coalesce(F.sum("total").over(ahead), F.lit(0)).alias(before))
    inner = Window.partitionBy(own).orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    return placed.withColumn(name, F.sum(name).over(inner)).join(starts, own).withColumn(name, F.col(name) + F.col(before)).drop(own, before)


def hidden(rows: DataFrame, name: str) -> str:
    while name in rows.columns:
        name = "_" + name
    return name


def even_sample_short(rows: DataFrame, budget: int = 1000) -> DataFrame:
    """Rows number floor(i n / budget) by id: the last one is left out. All rows where
    there are no more than the budget."""
    n = rows.count()
    if n <= budget:
        return rows
    number = hidden(rows, "number")
    at = F.broadcast(rows.sparkSession.range(budget).select(F.expr(f"id * {n}L div {budget}").alias(number)))
    numbered = running(rows, F.lit(1), number).withColumn(number, F.col(number) - 1)
    return numbered.join(at, number).select(*rows.columns)


@dataclass
class Clustering:
    labelled: DataFrame
    k: int
    candidates: list[int]
    scores: dict[int, float]
    centroids: list[list[float]]
    sample_size: int


def cluster(cells: DataFrame, *, budget: int = 1000, k_min: int = 3, k_max: int = 6, seed: int = 42, rounds: int = 100, order: Sequence[str] = ("grid_row", "grid_col"), k: int | None = None) -> Clustering:
    """Labels for all ``cells`` (a grid extract): every candidate k is fitted to the
    even sample in a task of its own and the best silhouette wins, the smaller k
    among equals. A given ``k`` is used as it is."""
    spark = cells.sparkSession
    rows = cells.count()
    if k is not None and rows and k >= rows:  # as many clusters as rows or more: each row is one
        at = F.row_number().over(Window.orderBy(*order)) - 1  # fewer rows than k
        labelled = cells.withColumn("label", F.pmod(at, F.lit(k)).cast("int"))
        centres = [list(map(float, r["embedding"])) for r in labelled.orderBy("label").select("embedding").collect()]
        return Clustering(labelled, k, [k], {}, centres, rows)
    sample = even_sample(cells, budget, order, rows).select(*order, "embedding").orderBy(*order).collect()  # at most ``budget`` rows
    vectors = np.array([r["embedding"] for r in sample], np.float32)
    ks = candidate_ks(len(vectors), k_min, k_max) if k is None else [k]
    if not ks or len(vectors) == 0:
        mean = vectors.mean(axis=0).tolist() if len(vectors) else []
        return Clustering(cells.withColumn("label", F.lit(0)), 1 if len(vectors) else 0, [], {}, [mean] if mean else [], len(vectors))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [(int(n), fit(vectors, int(n), seed, rounds)) for n in frame["k"]]
            yield pd.DataFrame([{"k": n, "score": silhouette(vectors, nearest_centroid(vectors, c)), "centroids": c.tolist()} for n, c in found], columns=["k", "score", "centroids"])

    ship(spark)
    fits = {r.k: r for r in spark.createDataFrame([(n,) for n in ks], "k int").repartition(len(ks), "k").mapInPandas(run, FIT).collect()}
    best = ks[0]
    for n in ks[1:]:
        if fits[n].score > fits[best].score + 1e-12:
            best = n
    centroids = fits[best].centroids
    labelled = cells.withColumn("label", label_column(F.col("embedding"), centroids))
    return Clustering(labelled, best, ks, {n: fits[n].score for n in ks}, centroids, len(vectors))


def cluster_sizes(labelled: DataFrame, k: int) -> DataFrame:
    """(label, n) for every label, empty ones with 0."""
    every = labelled.sparkSession.range(k).select(F.col("id").cast("int").alias("label"))
    return every.join(labelled.groupBy("label").agg(F.count("*").alias("n")), "label", "left").select("label", F.coalesce("n", F.lit(0)).alias("n"))


def mean_per_cluster(labelled: DataFrame) -> DataFrame:
    """(label, pos, mean): Lloyd's update as an aggregate combined map-side."""
    at = labelled.select("label", F.posexplode("embedding").alias("pos", "v"))
    return at.groupBy("label", "pos").agg(F.avg(F.col("v").cast("double")).alias("mean"))
