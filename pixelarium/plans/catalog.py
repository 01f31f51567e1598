"""Registered queries: each applies operators to whole tables; ORACLE_SQL states the
same result for an independent engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pixelarium.functions import geo, grid, imaging, vector
from pixelarium.operators import build, cluster, coarse, diagnostics, histogram, region, search
from pixelarium.operators.boundary import Boundary
from pixelarium.sources import rasters

from . import tables as t
from .engine import Engine, Settings

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL if there is any."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _with(*tables: str) -> str:
    return "WITH " + ", ".join(tables)


PIX, QUE, SPREAD = t.PIXELS_SQL, t.QUERY_SQL, t.SPREAD_SQL
SCORED = f"{_with(PIX, QUE)}, s AS (SELECT pixels.*, list_inner_product(e, u) AS score FROM pixels, q)"


def _box_sql(box, lon="lon", lat="lat") -> str:
    w, s, e, n = (f"{v!r}::DOUBLE" for v in box)
    return f"{lon} >= {w} AND {lon} <= {e} AND {lat} >= {s} AND {lat} <= {n}"


def _score(name: str = "score") -> Column:
    return F.round(F.col(name), 6).alias(name)


def _hits(top: DataFrame) -> DataFrame:
    return top.select(F.col("rank").cast("long").alias("rank"), "id", _score())


def _top_sql(source: str, k: int, where: str = "TRUE") -> str:
    return f"{source} SELECT row_number() OVER (ORDER BY score DESC, id) AS rank, id, round(score, 6) AS score FROM s WHERE {where} ORDER BY rank LIMIT {k}"


# -- search ---------------------------------------------------------------
@query(_top_sql(SCORED, 10))
def exact_topk(spark, sf_dir):
    return _hits(search.exact_top_k(t.pixels(spark, sf_dir), t.query_vector(spark, sf_dir), 10, batches=True))


@query(_top_sql(SCORED, 20, _box_sql(t.BOX)))
def bbox_topk(spark, sf_dir):
    return _hits(search.exact_top_k(t.pixels(spark, sf_dir), t.query_vector(spark, sf_dir), 20, box=t.BOX))


@query(_top_sql(SCORED, 50, "score >= 1e-1"))
def min_score_filter(spark, sf_dir):
    return _hits(search.exact_top_k(t.pixels(spark, sf_dir), t.query_vector(spark, sf_dir), 50, min_score=0.1))


WORLD = (121.0, 29.0, 122.0, 30.0)


@query(
    f"{SCORED}, f AS (SELECT row_number() OVER (ORDER BY score DESC, id) AS rank, * FROM s WHERE {_box_sql(t.BOX)} LIMIT 30), "
    f"m AS (SELECT row_number() OVER (ORDER BY score DESC, id) AS rank, * FROM s WHERE {_box_sql(WORLD)} AND score >= 1e-1 LIMIT 20) "
    "SELECT 'box' AS call, rank, prow AS row, pcol AS col, tile_path, round(score, 6) AS score FROM f "
    "UNION ALL SELECT 'score', rank, prow, pcol, tile_path, round(score, 6) FROM m"
)
def search_dispatch(spark, sf_dir):
    """The engine's dispatcher: a box without a least score, which lets negative scores
    through, and the boundary's box with one. Another box finds nothing."""
    w, s, e, n = WORLD
    engine = Engine(spark, Settings(), t.pixels(spark, sf_dir), {}, Boundary([[(w, s), (w, n), (e, n), (e, s), (w, s)]]))
    asked = t.query_vector(spark, sf_dir)
    calls = {
        "box": engine.search_by_embedding(asked, 30, bbox=t.BOX, min_distance_m=0), "score": engine.search_by_embedding(asked, 20, min_distance_m=0, min_score=0.1),
        "apart": engine.search_by_embedding(asked, 20, bbox=(10, 10, 11, 11), min_distance_m=0),
    }
    rows = [(name, h["rank"], h["row"], h["col"], h["tile_path"], round(h["score"], 6)) for name, found in calls.items() for h in found["results"]]
    return spark.createDataFrame(rows, "call string, rank long, row long, col long, tile_path string, score double")


HAVERSINE_SQL = (
    "2 * 6371000e0 * atan2(sqrt({a}), sqrt(greatest(1 - ({a}), 0e0)))".replace(
        "{a}",
        "pow(sin((radians({y2}) - radians({y1})) / 2), 2) + cos(radians({y1})) * cos(radians({y2})) * pow(sin((radians({x2}) - radians({x1})) / 2), 2)",
    )
)


def _haversine_sql(x1, y1, x2, y2) -> str:
    return HAVERSINE_SQL.format(x1=x1, y1=y1, x2=x2, y2=y2)


def _greedy_sql(source: str, k: int, metres: float, most: int) -> str:
    """``source`` defines s(id, lon, lat, score); a walk over the ranked rows."""
    far = _haversine_sql("o.lon", "o.lat", "p.lon", "p.lat")
    return f"""{source.replace("WITH ", "WITH RECURSIVE ", 1)},
    o AS (SELECT row_number() OVER (ORDER BY score DESC, id) AS r, id, lon, lat, score FROM s QUALIFY r <= {most}),
    walk AS (
      SELECT 0::BIGINT AS r, []::STRUCT(id BIGINT, lon DOUBLE, lat DOUBLE, score DOUBLE)[] AS kept
      UNION ALL
      SELECT o.r, CASE WHEN len(list_filter(kept, lambda p: {far} < {metres!r}::DOUBLE)) = 0
                       THEN list_append(kept, {{'id': o.id, 'lon': o.lon, 'lat': o.lat, 'score': o.score}}) ELSE kept END
      FROM walk JOIN o ON o.r = walk.r + 1 WHERE len(kept) < {k})
    SELECT i AS rank, kept[i].id AS id, round(kept[i].score, 6) AS score
    FROM (SELECT kept, unnest(range(1, len(kept) + 1)) AS i FROM (SELECT kept FROM walk ORDER BY r DESC LIMIT 1))"""


@query(_greedy_sql(SCORED, 10, 150.0, 1_000_000))
def diverse_topk(spark, sf_dir):
    return _hits(search.exact_top_k(t.pixels(spark, sf_dir), t.query_vector(spark, sf_dir), 10, min_distance_m=150.0))


def _nearest_sql(lon: float, lat: float) -> str:
    near = _box_sql((lon - 0.01, lat - 0.01, lon + 0.01, lat + 0.01))
    return f"""{_with(PIX)}, d AS (SELECT id, NOT ({near}) AS far, (lon - {lon!r}::DOUBLE) * (lon - {lon!r}::DOUBLE) + (lat - {lat!r}::DOUBLE) * (lat - {lat!r}::DOUBLE) AS dist2 FROM pixels)
    SELECT id, far AS used_fallback, round(dist2 * 1e9, 6) AS dist2 FROM d ORDER BY far, dist2, id LIMIT 1"""


def _nearest(spark, sf_dir, lon, lat):
    return search.nearest(t.pixels(spark, sf_dir), lon, lat).select("id", "used_fallback", F.round(F.col("dist2") * 1e9, 6).alias("dist2"))


@query(_nearest_sql(*t.NEAR_POINTS[0]))
def nearest_pixel(spark, sf_dir):
    return _nearest(spark, sf_dir, *t.NEAR_POINTS[0])


@query(_nearest_sql(*t.FAR_POINT))
def nearest_fallback(spark, sf_dir):
    return _nearest(spark, sf_dir, *t.FAR_POINT)


ASKED = [*t.NEAR_POINTS, t.FAR_POINT]


@query(" UNION ALL ".join(f"SELECT {i}::INT AS point, * FROM ({_nearest_sql(*p)})" for i, p in enumerate(ASKED)))
def multi_point_nearest(spark, sf_dir):
    found = search.nearest_of_each(t.pixels(spark, sf_dir), ASKED)
    return found.select("point", "id", "used_fallback", F.round(F.col("dist2") * 1e9, 6).alias("dist2"))


@query(f"{_with(PIX)} SELECT i - 1 AS pos, round(avg(e[i]), 6) AS mean FROM pixels, range(1, 65) r(i) GROUP BY i")
def mean_embedding(spark, sf_dir):
    means = search.mean_embedding(t.pixels(spark, sf_dir))
    return means.select(F.col("pos").cast("long").alias("pos"), F.round("mean", 6).alias("mean"))


_CENTRE = tuple(sum(p[i] for p in t.NEAR_POINTS) / 2 for i in (0, 1))


@query(
    f"""{_with(PIX)}, near AS ({" UNION ALL ".join(f"SELECT id FROM ({_nearest_sql(*p)})" for p in t.NEAR_POINTS)}),
    m AS (SELECT i, avg(e[i]) AS v FROM near JOIN pixels USING (id), range(1, 65) r(i) GROUP BY i),
    q AS (SELECT list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS u FROM (SELECT list(v ORDER BY i) AS v FROM m)),
    c AS (SELECT {_CENTRE[0]!r}::DOUBLE AS x, {_CENTRE[1]!r}::DOUBLE AS y, 2e3 / 111320e0 AS up),
    b AS (SELECT round_even(x - up / cos(radians(y)), 6) AS w, round_even(y - up, 6) AS s, round_even(x + up / cos(radians(y)), 6) AS e2, round_even(y + up, 6) AS n FROM c),
    hit AS (SELECT id, list_inner_product(e, u) AS score FROM pixels, q, b WHERE lon BETWEEN w AND e2 AND lat BETWEEN s AND n)
    SELECT row_number() OVER (ORDER BY score DESC, id) AS rank, id, round(score, 6) AS score FROM hit ORDER BY rank LIMIT 5"""
)
def point_scene(spark, sf_dir):
    """Two points, the mean of their vectors, a box of 2 km around their centre."""
    pixels = t.pixels(spark, sf_dir)
    found = search.nearest_of_each(pixels, t.NEAR_POINTS).select("point", "id")
    means = search.mean_embedding(pixels.join(F.broadcast(found), "id")).orderBy("pos").collect()  # one row per dimension
    return _hits(search.exact_top_k(pixels, [r["mean"] for r in means], 5, box=geo.square_box(*_CENTRE, 2.0)))


@query(f"{_with(PIX)} SELECT a.id, round({_haversine_sql('a.lon', 'a.lat', 'b.lon', 'b.lat')}, 4) AS metres FROM pixels a JOIN pixels b ON b.id = a.id + 1")
def haversine_pairs(spark, sf_dir):
    a = t.pixels(spark, sf_dir).select("id", "lon", "lat")
    b = a.select((F.col("id") - 1).alias("id"), F.col("lon").alias("lon2"), F.col("lat").alias("lat2"))
    return a.join(b, "id").select("id", F.round(geo.haversine_m(F.col("lon"), F.col("lat"), F.col("lon2"), F.col("lat2")), 4).alias("metres"))


@query(f"{SCORED}, h AS (SELECT * FROM s ORDER BY score DESC, id LIMIT 25) SELECT count(*) AS n, round(min(lon), 6) AS west, round(min(lat), 6) AS south, round(max(lon), 6) AS east, round(max(lat), 6) AS north FROM h")
def hit_bounds(spark, sf_dir):
    b = histogram.bounds(search.exact_top_k(t.pixels(spark, sf_dir), t.query_vector(spark, sf_dir), 25))
    return b.select("n", *[F.round(c, 6).alias(a) for c, a in (("min_lon", "west"), ("min_lat", "south"), ("max_lon", "east"), ("max_lat", "north"))])


@query(f"{_with(PIX)}, m AS (SELECT id, lon, lat FROM pixels) SELECT m.id, round(m.lon, 6) AS lon, round(list_inner_product(p.e, p.e), 5) AS norm2 FROM m JOIN pixels p USING (id)")
def metadata_vectors_join(spark, sf_dir):
    pixels = t.pixels(spark, sf_dir)
    e = F.col("embedding")
    return pixels.select("id", "lon").join(pixels.select("id", "embedding"), "id").select("id", F.round("lon", 6).alias("lon"), F.round(vector.dot(e, e), 5).alias("norm2"))


# -- vectors --------------------------------------------------------------
@query(
    f"""{_with(PIX)}, v AS (SELECT id, list_transform(e, lambda x: x * (id % 5)) AS w FROM pixels),
    n AS (SELECT id, w, sqrt(list_inner_product(w, w)) AS l FROM v)
    SELECT id, i - 1 AS pos, round(w[i] / CASE WHEN l = 0 THEN 1 ELSE l END, 6) + 0e0 AS v FROM n, range(1, 65) r(i)"""
)
def l2_normalize(spark, sf_dir):
    scaled = t.pixels(spark, sf_dir).select("id", F.transform(vector.doubles(F.col("embedding")), lambda x: x * (F.col("id") % 5)).alias("w"))
    at = scaled.select("id", F.posexplode(vector.l2_normalize(F.col("w"))).alias("pos", "v"))
    return at.select("id", F.col("pos").cast("long").alias("pos"), (F.round("v", 6) + F.lit(0.0)).alias("v"))


REDUCED = 8
MATRIX = coarse.projection_matrix(64, REDUCED).astype(float)
_COLUMNS = ", ".join("[" + ", ".join(f"{x!r}::DOUBLE" for x in MATRIX[:, j].tolist()) + "]" for j in range(REDUCED))
PROJECTION_SQL = f"proj AS (SELECT [{_COLUMNS}] AS ps)"


def _coarse_sql(where: str = "prow % 4 = 0 AND pcol % 4 = 0") -> str:
    return f"""{_with(PIX, QUE, PROJECTION_SQL)},
    v AS (SELECT id, lon, lat, list_transform(ps, lambda p: list_inner_product(e, p)) AS w FROM pixels, proj WHERE {where}),
    c AS (SELECT id, lon, lat, list_transform(w, lambda x: greatest(-127, least(127, round_even(127 * x / sqrt(list_inner_product(w, w)), 0)))) AS k FROM v),
    pq AS (SELECT list_transform(ps, lambda p: list_inner_product(u, p)) AS w FROM q, proj),
    uq AS (SELECT list_transform(w, lambda x: x / sqrt(list_inner_product(w, w))) AS w FROM pq),
    s AS (SELECT id, lon, lat, k, list_inner_product(k::DOUBLE[], w) / 127 AS score FROM c, uq)"""


def _coarse_index(spark, sf_dir):
    return coarse.build_coarse(t.pixels(spark, sf_dir), stride=4, reduced=REDUCED)


@query(_coarse_sql() + f" SELECT id, i - 1 AS pos, k[i]::INT AS v FROM c, range(1, {REDUCED + 1}) r(i)")
def project_quantize(spark, sf_dir):
    at = _coarse_index(spark, sf_dir).table.select("id", F.posexplode("q").alias("pos", "v"))
    return at.select("id", F.col("pos").cast("long").alias("pos"), F.col("v").cast("int").alias("v"))


@query(_top_sql(_coarse_sql(), 10))
def coarse_topk(spark, sf_dir):
    return _hits(coarse.coarse_top_k(_coarse_index(spark, sf_dir), t.query_vector(spark, sf_dir), 10))


@query(_top_sql(_coarse_sql(), 10, _box_sql(t.BOX) + " AND score >= 1e-2"))
def coarse_bbox_topk(spark, sf_dir):
    return _hits(coarse.coarse_top_k(_coarse_index(spark, sf_dir), t.query_vector(spark, sf_dir), 10, box=t.BOX, min_score=0.01))


@query(_greedy_sql(_coarse_sql(), 5, 400.0, coarse.keep_count(5)))
def coarse_diverse(spark, sf_dir):
    return _hits(coarse.coarse_top_k(_coarse_index(spark, sf_dir), t.query_vector(spark, sf_dir), 5, min_distance_m=400.0))


@query("SELECT k, greatest(k, least(20 * k, greatest(k, 500))) AS kept FROM range(1, 1001) r(k)")
def coarse_keep_count(spark, sf_dir):
    return spark.createDataFrame([(k, coarse.keep_count(k)) for k in range(1, 1001)], "k long, kept long")


@query(f"{_with(PIX)} SELECT id FROM pixels WHERE prow % 4 = 0 AND pcol % 4 = 0")
def stride_select(spark, sf_dir):
    return coarse.strided(t.pixels(spark, sf_dir), 4).select("id")


@query(f"{_with(PIX)}, p AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS n FROM pixels WHERE prow % 2 = 1) SELECT id FROM p WHERE n % 2 = 0")
def stride_fallback(spark, sf_dir):
    return coarse.strided(t.pixels(spark, sf_dir).where("row % 2 = 1"), 2).select("id")


@query(f"{_with(PIX)}, m AS (SELECT id * 3 - 50 AS id FROM pixels) SELECT count(*) AS n, count(*) FILTER (id < 0 OR id >= (SELECT count(*) FROM m)) AS invalid FROM m")
def id_range_check(spark, sf_dir):
    """Ids that are spread out and moved are partly beyond the table."""
    return coarse.id_range(t.pixels(spark, sf_dir).select((F.col("id") * 3 - 50).alias("id")))


# -- grids and density ----------------------------------------------------
def _grid_sql(g: grid.Grid) -> tuple[str, str]:
    w, _, _, n = g.box
    wide, high = g.steps
    row = f"least(greatest(floor(({n!r}::DOUBLE - lat) / {high!r}::DOUBLE), 0), {g.rows - 1})::BIGINT"
    col = f"least(greatest(floor((lon - {w!r}::DOUBLE) / {wide!r}::DOUBLE), 0), {g.cols - 1})::BIGINT"
    return row, col


EXTRACT = grid.Grid.over(t.BOX, 100)
_ER, _EC = _grid_sql(EXTRACT)


@query(f"{_with(PIX)} SELECT {_ER} AS grid_row, {_EC} AS grid_col, min(id) AS id FROM pixels WHERE {_box_sql(t.BOX)} GROUP BY 1, 2")
def grid_shape_sample(spark, sf_dir):
    cells, _ = region.grid_extract(t.pixels(spark, sf_dir), t.BOX, 100)
    return cells.select("grid_row", "grid_col", "id")


SPREAD_GRID = grid.Grid.over(t.SPREAD_BOX, 5000)
_SR, _SC = _grid_sql(SPREAD_GRID)


@query(f"{_with(SPREAD)} SELECT {_SR} AS grid_row, {_SC} AS grid_col, count(*) AS n FROM spread GROUP BY 1, 2")
def cell_assign(spark, sf_dir):
    cells = t.spread(spark, sf_dir).select(SPREAD_GRID.row(F.col("lat")).alias("grid_row"), SPREAD_GRID.col(F.col("lon")).alias("grid_col"))
    return cells.groupBy("grid_row", "grid_col").agg(F.count("*").alias("n"))


@query(f"{_with(SPREAD)} SELECT count(*) AS n, round(min(lon), 6) AS min_lon, round(min(lat), 6) AS min_lat, round(max(lon), 6) AS max_lon, round(max(lat), 6) AS max_lat FROM spread")
def metadata_bounds(spark, sf_dir):
    b = histogram.bounds(t.spread(spark, sf_dir))
    return b.select("n", *[F.round(c, 6).alias(c) for c in ("min_lon", "min_lat", "max_lon", "max_lat")])


_W, _S, _E, _N = t.SPREAD_BOX
HIST_SQL = f"""{_with(SPREAD)}, h AS (
  SELECT least(greatest(floor((lat - {_S!r}::DOUBLE) / {_N - _S!r}::DOUBLE * 768), 0), 767)::BIGINT AS lat_bin,
         least(greatest(floor((lon - {_W!r}::DOUBLE) / {_E - _W!r}::DOUBLE * 768), 0), 767)::BIGINT AS lon_bin, count(*) AS n FROM spread GROUP BY 1, 2)"""


@query(f"{HIST_SQL} SELECT * FROM h")
def hist2d(spark, sf_dir):
    return histogram.density(t.spread(spark, sf_dir), t.SPREAD_BOX)


@query(f"{HIST_SQL} SELECT count(*) AS nonzero_cells, coalesce(max(n), 0) AS max_cell FROM h")
def hist_summary(spark, sf_dir):
    return histogram.density_summary(histogram.density(t.spread(spark, sf_dir), t.SPREAD_BOX))


@query(f"{HIST_SQL} SELECT lat_bin, lon_bin, round(ln(1 + n), 9) AS level FROM h")
def log_density(spark, sf_dir):
    cells = histogram.density(t.spread(spark, sf_dir), t.SPREAD_BOX)
    return cells.select("lat_bin", "lon_bin", F.round(F.log1p("n"), 9).alias("level"))


# -- clusters -------------------------------------------------------------
CENTRE_IDS = (0, 1, 2, 3)
ASSIGN_SQL = f"""{_with(PIX)}, c AS (SELECT row_number() OVER (ORDER BY id) - 1 AS label, e AS ce FROM pixels WHERE id < {len(CENTRE_IDS)}),
  g AS (SELECT id, e, label, list_sum(list_transform(list_zip(e, ce), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS gap FROM pixels, c),
  a AS (SELECT id, e, label::INT AS label FROM g QUALIFY row_number() OVER (PARTITION BY id ORDER BY gap, label) = 1)"""


def _labelled(spark, sf_dir) -> DataFrame:
    pixels = t.pixels(spark, sf_dir)
    centroids = [list(r.embedding) for r in pixels.where(F.col("id") < len(CENTRE_IDS)).orderBy("id").collect()]
    return pixels.withColumn("label", cluster.label_column(F.col("embedding"), centroids))


@query(f"{ASSIGN_SQL} SELECT id, label FROM a")
def assign_centroids(spark, sf_dir):
    return _labelled(spark, sf_dir).select("id", "label")


@query(f"{ASSIGN_SQL} SELECT label, i - 1 AS pos, round(avg(e[i]), 6) AS mean FROM a, range(1, 65) r(i) GROUP BY ALL")
def lloyd_step(spark, sf_dir):
    return cluster.mean_per_cluster(_labelled(spark, sf_dir)).select("label", F.col("pos").cast("long").alias("pos"), F.round("mean", 6).alias("mean"))


@query(f"{ASSIGN_SQL} SELECT l::INT AS label, count(id) AS n FROM range(0, 6) r(l) LEFT JOIN a ON a.label = l GROUP BY 1")
def cluster_sizes(spark, sf_dir):
    return cluster.cluster_sizes(_labelled(spark, sf_dir), 6)


def silhouette_frame(rows: DataFrame) -> DataFrame:
    """Mean Euclidean silhouette of a sample of at most the cluster budget (id,
    label, embedding): all of it meets itself, so the sample must be bounded."""
    other = F.broadcast(rows.select(F.col("id").alias("oid"), F.col("label").alias("olabel"), F.col("embedding").alias("oe")))
    gaps = rows.crossJoin(other).where("id != oid").select("id", "label", "olabel", F.sqrt(vector.squared_distance(F.col("embedding"), F.col("oe"))).alias("gap"))
    per = gaps.groupBy("id", "label", "olabel").agg(F.avg("gap").alias("gap"))
    sides = per.groupBy("id").agg(F.min(F.when(F.col("label") == F.col("olabel"), F.col("gap"))).alias("a"), F.min(F.when(F.col("label") != F.col("olabel"), F.col("gap"))).alias("b"))
    widest = F.greatest("a", "b")
    value = F.when(F.col("a").isNull() | F.col("b").isNull() | (widest <= 0), 0.0).otherwise((F.col("b") - F.col("a")) / widest)
    return sides.agg(F.avg(value).alias("silhouette"))


SAMPLE = 1000


@query(
    f"""{ASSIGN_SQL}, n AS (SELECT count(*) AS n FROM a), k AS (SELECT CASE WHEN n <= {SAMPLE} THEN i WHEN i = {SAMPLE - 1} THEN n - 1 ELSE floor(i * ((n - 1)::DOUBLE / {SAMPLE - 1}))::BIGINT END AS id FROM n, range(0, {SAMPLE}) r(i) WHERE i < n),
    x AS (SELECT a.* FROM a JOIN k USING (id)),
    gaps AS (SELECT x.id, x.label, y.label AS ol, avg(sqrt(list_sum(list_transform(list_zip(x.e, y.e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))) AS gap FROM x JOIN x y ON x.id <> y.id GROUP BY ALL),
    s AS (SELECT id, min(gap) FILTER (label = ol) AS a, min(gap) FILTER (label <> ol) AS b FROM gaps GROUP BY id)
    SELECT round(avg(CASE WHEN a IS NULL OR b IS NULL OR greatest(a, b) <= 0 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM s"""
)
def silhouette(spark, sf_dir):
    rows = _labelled(spark, sf_dir)
    sample = cluster.even_sample(rows, SAMPLE, ["id"], rows.count()).select("id", "label", "embedding")
    return silhouette_frame(sample).select(F.round("silhouette", 6).alias("silhouette"))


@query(f"{_with(PIX)}, n AS (SELECT count(*) AS n FROM pixels) SELECT i AS at, CASE WHEN i = 99 THEN n - 1 ELSE floor(i * ((n - 1)::DOUBLE / 99))::BIGINT END AS id FROM n, range(0, 100) r(i)")
def even_sample(spark, sf_dir):
    pixels = t.pixels(spark, sf_dir).select("id")
    kept = cluster.even_sample(pixels, 100, ["id"], pixels.count())
    return kept.select((F.row_number().over(Window.orderBy("id")) - 1).cast("long").alias("at"), "id")


@query(
    """WITH o AS (SELECT o_orderkey * 7 AS id, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders), n AS (SELECT count(*) AS n FROM o)
    SELECT id FROM o, n WHERE n <= 1000 OR pos IN (SELECT (i * n) // 1000 FROM n, range(0, 1000) r(i))"""
)
def even_sample_ui(spark, sf_dir):
    """Of more rows than the budget, whose ids have gaps."""
    return cluster.even_sample_short(spark.read.parquet(f"{sf_dir}/orders.parquet").select((F.col("o_orderkey") * 7).alias("id")))


@query(
    f"""{ASSIGN_SQL}, d AS (SELECT id, list_sum(list_transform(list_zip(e, (SELECT e FROM pixels WHERE id = 0)), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM pixels),
    run AS (SELECT id, sum(d) OVER (ORDER BY id) AS cum, sum(d) OVER () AS total FROM d)
    SELECT f, min(id) AS id FROM run, (VALUES (1), (3), (5), (7), (9)) v(f) WHERE cum >= total * f / 1e1 GROUP BY f"""
)
def kmeanspp_threshold(spark, sf_dir):
    """First row whose running squared distance reaches a share of the total."""
    pixels = t.pixels(spark, sf_dir)
    origin = t.query_vector(spark, sf_dir)
    d = pixels.select("id", vector.squared_distance(F.col("embedding"), vector.literal(origin)).alias("d"))
    summed = cluster.running(d, F.col("d"), "cum").select("id", "cum")
    total = summed.agg(F.max("cum")).first()[0]
    shares = F.array(*[F.lit(f) for f in (1, 3, 5, 7, 9)])
    met = summed.select("id", "cum", F.explode(shares).alias("f")).where(F.col("cum") >= F.lit(total) * F.col("f") / 10.0)
    return met.groupBy("f").agg(F.min("id").alias("id"))


@query()
def region_cluster(spark, sf_dir):
    """The scene: grid extract, k chosen by silhouette, labels for all cells."""
    cells, _ = region.grid_extract(t.pixels(spark, sf_dir), t.BOX)
    return cluster.cluster(cells).labelled.select("grid_row", "grid_col", "id", "label")


@query(f"{ASSIGN_SQL} SELECT id, ['{"', '".join(imaging.PALETTE)}'][label % 10 + 1] AS colour, label FROM a")
def palette(spark, sf_dir):
    return _labelled(spark, sf_dir).select("id", imaging.palette_colour(F.col("label")).alias("colour"), "label")


# -- boundary -------------------------------------------------------------
SHAPE = Boundary([t.POLYGON])
EDGES_SQL = "edges(x1, y1, x2, y2) AS (VALUES " + ", ".join("(" + ", ".join(f"{v!r}::DOUBLE" for v in (*p, *q)) + ")" for p, q in SHAPE.edges()) + ")"
SIDE_SQL = f"""points AS (SELECT id, lon, lat FROM pixels UNION ALL SELECT -1 - row_number() OVER (ORDER BY x1, y1), x1, y1 FROM edges),
  side AS (SELECT id, sum(CASE WHEN (y1 > lat) <> (y2 > lat) THEN (lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1)::INT ELSE 0 END) % 2 = 1 AS odd,
    bool_or((x2 - x1) * (lat - y1) - (y2 - y1) * (lon - x1) = 0 AND lon BETWEEN least(x1, x2) AND greatest(x1, x2) AND lat BETWEEN least(y1, y2) AND greatest(y1, y2)) AS touching
    FROM points, edges GROUP BY id)"""


def _places(spark, sf_dir) -> DataFrame:
    corners = sorted(t.POLYGON[:-1])
    extra = spark.createDataFrame([(-2 - i, *p) for i, p in enumerate(corners)], "id long, lon double, lat double")
    return t.pixels(spark, sf_dir).select("id", "lon", "lat").unionAll(extra)


@query(f"{_with(PIX, EDGES_SQL, SIDE_SQL)} SELECT id FROM side WHERE odd AND NOT touching")
def pip_strict(spark, sf_dir):
    return _places(spark, sf_dir).where(SHAPE.contains_strict(F.col("lon"), F.col("lat"))).select("id")


@query(f"{_with(PIX, EDGES_SQL, SIDE_SQL)} SELECT id FROM side WHERE odd OR touching")
def pip_inclusive(spark, sf_dir):
    return _places(spark, sf_dir).where(SHAPE.contains(F.col("lon"), F.col("lat"))).select("id")


@query(f"{_with(EDGES_SQL)} SELECT min(x1) AS west, min(y1) AS south, max(x1) AS east, max(y1) AS north FROM edges")
def boundary_bbox(spark, sf_dir):
    return spark.createDataFrame([tuple(SHAPE.box)], "west double, south double, east double, north double")


CLIPS = [(121.541, 29.865, 121.547, 29.867), (121.5425, 29.86, 121.5455, 29.8695), (121.50, 29.80, 121.60, 29.90), (121.543, 29.860, 121.545, 29.8665)]


def _clip_sql(box) -> str:
    w, s, e, n = (f"{v!r}::DOUBLE" for v in box)
    inside = f"""SELECT px, py FROM (VALUES ({w}, {s}), ({w}, {n}), ({e}, {s}), ({e}, {n})) c(px, py), edges GROUP BY px, py
      HAVING sum(CASE WHEN (y1 > py) <> (y2 > py) THEN (px < (x2 - x1) * (py - y1) / (y2 - y1) + x1)::INT ELSE 0 END) % 2 = 1"""
    cross = [
        f"SELECT {v}, y1 + ({v} - x1) / (x2 - x1) * (y2 - y1) FROM edges WHERE x1 <> x2 AND {v} BETWEEN least(x1, x2) AND greatest(x1, x2) AND y1 + ({v} - x1) / (x2 - x1) * (y2 - y1) BETWEEN {s} AND {n}"
        for v in (w, e)
    ] + [
        f"SELECT x1 + ({v} - y1) / (y2 - y1) * (x2 - x1), {v} FROM edges WHERE y1 <> y2 AND {v} BETWEEN least(y1, y2) AND greatest(y1, y2) AND x1 + ({v} - y1) / (y2 - y1) * (x2 - x1) BETWEEN {w} AND {e}"
        for v in (s, n)
    ]
    found = " UNION ALL ".join([f"SELECT x1 AS px, y1 AS py FROM edges WHERE x1 BETWEEN {w} AND {e} AND y1 BETWEEN {s} AND {n}", inside, *cross])
    return f"SELECT round(min(px), 9) AS west, round(min(py), 9) AS south, round(max(px), 9) AS east, round(max(py), 9) AS north FROM ({found})"


@query(f"{_with(EDGES_SQL)} " + " UNION ALL ".join(f"SELECT {i}::INT AS box, * FROM ({_clip_sql(b)})" for i, b in enumerate(CLIPS)))
def clip_bbox(spark, sf_dir):
    rows = [(i, *(SHAPE.clip(b) or [None] * 4)) for i, b in enumerate(CLIPS)]
    frame = spark.createDataFrame(rows, "box int, west double, south double, east double, north double")
    return frame.select("box", *[F.round(c, 9).alias(c) for c in ("west", "south", "east", "north")])


# -- rasters --------------------------------------------------------------
TILES_SQL = "tiles AS (SELECT tile_path AS path, min(lon) AS min_lon, min(lat) AS min_lat, max(lon) AS max_lon, max(lat) AS max_lat, count(*) AS n FROM pixels GROUP BY 1)"
MEET = (121.5405, 29.8690, 121.5460, 29.8705)


def _tiles(spark, sf_dir) -> DataFrame:
    p = t.pixels(spark, sf_dir)
    return p.groupBy(F.col("tile_path").alias("path")).agg(
        F.min("lon").alias("min_lon"), F.min("lat").alias("min_lat"), F.max("lon").alias("max_lon"), F.max("lat").alias("max_lat"), F.count("*").alias("n")
    )


def _meet_sql(box) -> str:
    w, s, e, n = (f"{v!r}::DOUBLE" for v in box)
    return f"max_lon >= {w} AND max_lat >= {s} AND min_lon <= {e} AND min_lat <= {n}"


@query(f"{_with(PIX, TILES_SQL)} SELECT path, n FROM tiles WHERE {_meet_sql(MEET)}")
def tile_prefilter(spark, sf_dir):
    return _tiles(spark, sf_dir).where(geo.boxes_meet([F.col(c) for c in ("min_lon", "min_lat", "max_lon", "max_lat")], MEET)).select("path", "n")


@query(f"{_with(PIX, TILES_SQL)} SELECT path FROM tiles WHERE {_meet_sql(t.NEAR_POINTS[0] * 2)} ORDER BY path LIMIT 1")
def locate_tile(spark, sf_dir):
    return build.locate_tile(_tiles(spark, sf_dir), *t.NEAR_POINTS[0]).select("path")


AFFINE = (29.5, 1.25, 358000.0, -1.5, -30.25, 3305000.0)


@query(f"{_with(PIX)} SELECT id, round({AFFINE[2]!r} + (pcol + 5e-1) * {AFFINE[0]!r} + (prow + 5e-1) * {AFFINE[1]!r}, 6)::DOUBLE AS x, round({AFFINE[5]!r} + (pcol + 5e-1) * ({AFFINE[3]!r}) + (prow + 5e-1) * ({AFFINE[4]!r}), 6)::DOUBLE AS y FROM pixels")
def affine_centers(spark, sf_dir):
    x, y = geo.pixel_centre(F.col("row"), F.col("col"), AFFINE)
    return t.pixels(spark, sf_dir).select("id", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


def _utm_sql(crs: geo.Crs) -> str:
    num = lambda v: f"({v!r}::DOUBLE)"
    scale = num(geo.UTM_SCALE * geo.MERIDIAN_RADIUS)
    beta = list(enumerate(geo.BETA, 1))
    xi1 = "xi - " + " - ".join(f"{num(b)} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, b in beta)
    eta1 = "eta - " + " - ".join(f"{num(b)} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, b in beta)
    lat = "chi + " + " + ".join(f"{num(d)} * sin({2 * j} * chi)" for j, d in enumerate(geo.DELTA, 1))
    return f"""{_with(PIX)}, m AS (SELECT id, (3305000e0 - prow * 30e0) / {scale} AS xi, (358000e0 + pcol * 30e0 - 500000e0) / {scale} AS eta FROM pixels),
    k AS (SELECT id, {xi1} AS a, {eta1} AS b FROM m), c AS (SELECT id, a, b, asin(sin(a) / cosh(b)) AS chi FROM k)
    SELECT id, round({crs.central_meridian!r} + degrees(atan2(sinh(b), cos(a))), 9) AS lon, round(degrees({lat}), 9) AS lat FROM c"""


UTM = geo.Crs.from_epsg(32651)


@query(_utm_sql(UTM))
def utm_inverse(spark, sf_dir):
    x, y = F.lit(358000.0) + F.col("col") * F.lit(30.0), F.lit(3305000.0) - F.col("row") * F.lit(30.0)
    lon, lat = geo.utm_to_lonlat(UTM, x, y)
    return t.pixels(spark, sf_dir).select("id", F.round(lon, 9).alias("lon"), F.round(lat, 9).alias("lat"))


LEVELS_SQL = "levels AS (SELECT *, list_transform(e[1:4], lambda x: floor(x * 10)) AS bands FROM pixels)"


def _levels(spark, sf_dir) -> DataFrame:
    bands = F.transform(F.slice(vector.doubles(F.col("embedding")), 1, 4), lambda x: F.floor(x * 10).cast("double"))
    return t.pixels(spark, sf_dir).withColumn("bands", bands)


@query(f"{_with(PIX, LEVELS_SQL)} SELECT id FROM levels WHERE len(list_filter(bands, lambda b: b = -1)) = 0")
def nodata_filter(spark, sf_dir):
    """Valid pixels: every band differs from the nodata value."""
    return _levels(spark, sf_dir).where(grid.valid_bands(F.col("bands"), -1.0)).select("id")


@query(f"{_with(PIX, LEVELS_SQL)} SELECT id FROM levels WHERE len(list_filter(bands[1:2], lambda b: b <> 0)) = 0")
def zero_vector_scan(spark, sf_dir):
    return _levels(spark, sf_dir).where(vector.all_zero(F.slice("bands", 1, 2))).select("id")


BLOCK_SQL = "placed AS (SELECT *, (prow // 4)::INT AS block_row, (pcol // 8)::INT AS block_col, len(list_filter(bands, lambda b: b = -1)) = 0 AS valid FROM levels)"


def _placed(spark, sf_dir) -> DataFrame:
    rows = _levels(spark, sf_dir).withColumns({"block_row": F.expr("int(row div 4)"), "block_col": F.expr("int(col div 8)"), "valid": grid.valid_bands(F.col("bands"), -1.0)})
    return rows.withColumn("inside", F.col("valid") & SHAPE.contains_strict(F.col("lon"), F.col("lat")))


INSIDE_SQL = f"{_with(PIX, EDGES_SQL, SIDE_SQL, LEVELS_SQL, BLOCK_SQL)}, ins AS (SELECT placed.*, valid AND odd AND NOT touching AS inside FROM placed JOIN side USING (id))"


@query(
    f"""{INSIDE_SQL} SELECT tile_path, block_row, block_col, count(*) FILTER (valid) AS valid, count(*) FILTER (inside) AS inside_n,
    count(*) FILTER (inside AND len(list_filter(bands, lambda b: b <> 0)) = 0) AS zero FROM ins GROUP BY ALL"""
)
def build_counters(spark, sf_dir):
    return build.block_counts(_placed(spark, sf_dir)).select(*build.BLOCK, "valid", "inside_n", "zero")


@query(f"{INSIDE_SQL} SELECT row_number() OVER (ORDER BY tile_path, block_row, block_col, prow, pcol) - 1 AS new_id, id FROM ins WHERE inside")
def dense_ids(spark, sf_dir):
    placed = _placed(spark, sf_dir)
    kept = placed.where("inside").withColumnRenamed("id", "old")
    return build.dense_ids(kept, build.block_counts(placed)).select(F.col("id").alias("new_id"), F.col("old").alias("id"))


@query(
    f"""{_with(PIX, LEVELS_SQL, BLOCK_SQL)} SELECT tile_path, count(*) AS sampled_pixels, count(*) FILTER (NOT valid) AS nodata_pixels,
    count(*) FILTER (valid AND len(list_filter(bands, lambda b: b <> 0)) = 0) AS all_zero_pixels,
    count(*) FILTER (valid AND len(list_filter(bands, lambda b: b <> 0)) > 0) AS nonzero_valid_pixels FROM placed GROUP BY 1"""
)
def pixel_classes(spark, sf_dir):
    return diagnostics.pixel_classes(_placed(spark, sf_dir))


@query(f"{_with(PIX, LEVELS_SQL)} SELECT len(bands) - (id % 2) AS bands, count(*) AS n FROM levels GROUP BY 1")
def band_distribution(spark, sf_dir):
    return _levels(spark, sf_dir).groupBy((F.size("bands") - F.col("id") % 2).alias("bands")).agg(F.count("*").alias("n"))


@query(
    """WITH b AS (SELECT l_linenumber::INT AS band, l_extendedprice::DOUBLE AS v FROM lineitem),
    p AS (SELECT band, quantile_cont(v, 2e-2) AS low, quantile_cont(v, 98e-2) AS high FROM b GROUP BY band),
    s AS (SELECT band, low, high, floor(greatest(0, least(255, (v - low) * 255 / (CASE WHEN high <= low THEN low + 1 ELSE high END - low))))::INT AS level FROM b JOIN p USING (band))
    SELECT band, round(any_value(low), 4) AS low, round(any_value(high), 4) AS high, sum(level)::BIGINT AS total, count(*) AS n FROM s GROUP BY band"""
)
def percentile_stretch(spark, sf_dir):
    b = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_linenumber").cast("int").alias("band"), F.col("l_extendedprice").cast("double").alias("v"))
    p = b.groupBy("band").agg(F.percentile("v", [0.02, 0.98]).alias("p")).select("band", F.col("p")[0].alias("low"), F.col("p")[1].alias("high"))
    s = b.join(F.broadcast(p), "band").withColumn("level", imaging.stretched(F.col("v"), F.col("low"), F.col("high")))  # one row per band
    return s.groupBy("band").agg(F.round(F.first("low"), 4).alias("low"), F.round(F.first("high"), 4).alias("high"), F.sum("level").alias("total"), F.count("*").alias("n"))


@query(
    f"""{_with(PIX, TILES_SQL)} SELECT path, z::INT AS z, x, y, round(min_lon + x * ((max_lon - min_lon) / pow(2e0, z)), 9) AS left_, round(max_lat - (y + 1) * ((max_lat - min_lat) / pow(2e0, z)), 9) AS bottom_,
    round(min_lon + (x + 1) * ((max_lon - min_lon) / pow(2e0, z)), 9) AS right_, round(max_lat - y * ((max_lat - min_lat) / pow(2e0, z)), 9) AS top_
    FROM tiles, (SELECT 2 AS z), range(0, 4) a(x), range(0, 4) b(y)"""
)
def display_tile_bounds(spark, sf_dir):
    cells = F.explode(F.sequence(F.lit(0), F.lit(15))).alias("c")
    tiles = _tiles(spark, sf_dir).select("*", cells).withColumns({"z": F.lit(2), "x": F.expr("c div 4"), "y": (F.col("c") % 4).cast("long")})
    box = grid.display_tile_box([F.col(c) for c in ("min_lon", "min_lat", "max_lon", "max_lat")], F.col("z"), F.col("x"), F.col("y"))
    return tiles.select("path", "z", "x", "y", *[F.round(v, 9).alias(n) for v, n in zip(box, ("left_", "bottom_", "right_", "top_"), strict=True)])


@query(f"{_with(PIX)} SELECT id, greatest(pcol, 10) AS col_off, greatest(prow, 5) AS row_off, greatest(0, least(pcol + 8, 20) - greatest(pcol, 10)) AS width, greatest(0, least(prow + 6, 15) - greatest(prow, 5)) AS height FROM pixels")
def window_intersection(spark, sf_dir):
    met = grid.window_meet(F.col("col"), F.col("row"), 8, 6, (10, 5, 20, 15))
    return t.pixels(spark, sf_dir).select("id", *[v.alias(k) for k, v in met.items()])


@query(f"{_with(PIX, TILES_SQL)} SELECT path, substr(sha1(path), 1, 16) AS id FROM tiles")
def basemap_id(spark, sf_dir):
    return _tiles(spark, sf_dir).select("path", rasters.basemap_id(F.col("path")).alias("id"))


@query(f"{_with(PIX)} SELECT id, CASE WHEN id % 256 > 0 THEN 255 ELSE 0 END AS r, CASE WHEN id % 256 > 0 THEN 70 ELSE 0 END AS g, CASE WHEN id % 256 > 0 THEN 70 ELSE 0 END AS b, CASE WHEN id % 256 > 0 THEN floor((id % 256) * 6e-1 + 5e-1)::INT ELSE 0 END AS a FROM pixels")
def mask_tint(spark, sf_dir):
    tint = imaging.mask_tint(F.col("id") % 256)
    return t.pixels(spark, sf_dir).select("id", *[v.alias(k) for k, v in tint.items()])


@query(f"{_with(PIX)} SELECT id, greatest(0, least(255, floor(e[1] * 1000 + 5e-1)))::INT AS level FROM pixels")
def display_levels(spark, sf_dir):
    return t.pixels(spark, sf_dir).select("id", imaging.display_level(vector.doubles(F.col("embedding"))[0] * 1000).alias("level"))


_LEVEL = "greatest(0, least(255, floor(s[{i}] * 1e3 + 5e-1)))::INT"
_GREY = _LEVEL.format(i=1)


@query(
    f"{_with(PIX)}, p AS (SELECT id, e[1:1 + id % 5] AS s FROM pixels) SELECT id, CASE WHEN len(s) >= 3 THEN {_GREY} ELSE {_GREY} END AS r, CASE WHEN len(s) >= 3 THEN {_LEVEL.format(i=2)} ELSE {_GREY} END AS g, "
    f"CASE WHEN len(s) >= 3 THEN {_LEVEL.format(i=3)} ELSE {_GREY} END AS b, CASE WHEN len(s) >= 4 THEN {_LEVEL.format(i=4)} ELSE 255 END AS a FROM p"
)
def canvas_pixels(spark, sf_dir):
    """Pixels of one to five samples."""
    scaled = F.transform(vector.doubles(F.col("embedding")), lambda x: x * 1000.0)
    pixels = t.pixels(spark, sf_dir).select("id", F.slice(scaled, F.lit(1), (1 + F.col("id") % 5).cast("int")).alias("s"))
    rgba = pixels.select("id", imaging.canvas_pixel(F.col("s")).alias("c"))
    return rgba.select("id", *[F.col("c")[i].alias(n) for i, n in enumerate("rgba")])


@query(f"SELECT * FROM ({_top_sql(SCORED, 10)}) WHERE rank = 7")
def hit_of_rank(spark, sf_dir):
    hits = search.exact_top_k(t.pixels(spark, sf_dir), t.query_vector(spark, sf_dir), 10)
    return _hits(search.hit_by_rank(hits, 7))


@query(f"{_with(PIX)} SELECT id FROM pixels WHERE id % 3 <> 0 AND id % 5 <> 0")
def finite_filter(spark, sf_dir):
    odd = F.when(F.col("id") % 3 == 0, F.lit(float("nan"))).when(F.col("id") % 5 == 0, F.lit(float("-inf"))).otherwise(F.col("lon"))
    return t.pixels(spark, sf_dir).where(imaging.finite(odd)).select("id")


# -- diagnostics ----------------------------------------------------------
@query(
    f"{_with(PIX)} SELECT count(*) AS metadata_row_count, count(*) AS embedding_count, count(*) FILTER (id * 2 - 30 < 0 OR id * 2 - 30 >= (SELECT count(*) FROM pixels)) AS invalid_id_count, "
    "round(avg((id % 5 = 0)::INT), 6) AS zero_ratio FROM pixels"
)
def diag_overview(spark, sf_dir):
    pixels = t.pixels(spark, sf_dir)
    vectors = pixels.select("id", F.transform(vector.doubles(F.col("embedding")), lambda x: x * (F.col("id") % 5)).alias("embedding"))
    r = diagnostics.overview(pixels.withColumn("id", F.col("id") * 2 - 30), vectors)
    row = (r["metadata_row_count"], r["embedding_count"], r["invalid_id_count"], round(r["embedding_sample"]["sample_zero_ratio"], 6))
    return spark.createDataFrame([row], "metadata_row_count long, embedding_count long, invalid_id_count long, zero_ratio double")


LATTICE = diagnostics.lattice((121.50, 29.80, 121.60, 29.90))


@query(
    f"""{_with(PIX)}, p(point, x, y) AS (VALUES {", ".join(f"({i}, {x!r}::DOUBLE, {y!r}::DOUBLE)" for i, (x, y) in enumerate(LATTICE))}),
    d AS (SELECT point, id, NOT (lon >= x - 1e-2 AND lon <= x + 1e-2 AND lat >= y - 1e-2 AND lat <= y + 1e-2) AS far, (lon - x) * (lon - x) + (lat - y) * (lat - y) AS d2 FROM pixels, p)
    SELECT point, far AS used_fallback, id FROM d QUALIFY row_number() OVER (PARTITION BY point ORDER BY far, d2, id) = 1"""
)
def diag_point_sampling(spark, sf_dir):
    return search.nearest_of_each(t.pixels(spark, sf_dir), LATTICE).select("point", "used_fallback", "id")


SCAN_BOX = (121.53, 29.85, 121.56, 29.88)


def _scan_sql() -> str:
    parts = []
    for b, *box in diagnostics.split_boxes(SCAN_BOX):
        row, col = _grid_sql(grid.Grid.over(box, 100))
        parts.append(f"SELECT {b} AS box, id, {row} AS r, {col} AS c FROM pixels WHERE {_box_sql(box)}")
    return f"""{_with(PIX)}, m AS ({" UNION ALL ".join(parts)}), f AS (SELECT box, r, c, min(id) AS id, count(*) AS n FROM m GROUP BY ALL),
    g AS (SELECT box, sum(n) AS cand, count(*) AS sel, count(*) FILTER (id % 2 = 0) AS zero FROM f GROUP BY box),
    a AS (SELECT b::INT AS box, coalesce(cand, 0)::BIGINT AS candidate_count, coalesce(sel, 0) AS selected_count, coalesce(zero, 0) AS zero_count FROM range(0, 36) r(b) LEFT JOIN g ON box = b)
    SELECT *, CASE WHEN candidate_count = 0 THEN 'empty' WHEN zero_count = selected_count THEN 'all_zero' WHEN zero_count = 0 THEN 'nonzero' ELSE 'mixed' END AS classification FROM a"""


@query(_scan_sql())
def diag_bbox_scan(spark, sf_dir):
    """Vectors of even ids count as zero here."""
    rows = t.pixels(spark, sf_dir).withColumn("embedding", F.transform("embedding", lambda x: x * (F.col("id") % 2)))
    return diagnostics.box_scan(rows, SCAN_BOX).select("box", "candidate_count", "selected_count", "zero_count", "classification")
