"""Helpers shared by the training-data operators: tables, staging, components."""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from pixelarium.sources.shipping import map_arrow

#: Java/RE2/Python spelling of the word contract: everything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

_ROOTS: dict[str, str] = {}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _filesystem(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark._jsc.hadoopConfiguration())


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it is in; a missing one is fine."""
    hadoop, fs = _filesystem(spark, path)
    fs.delete(hadoop, True)


def work_root(spark: SparkSession) -> str:
    """This application's folder below ``spark.checkpoint.dir``.

    A folder of our own is made only where the setting is absent and the session is
    local, so that driver and executors share one disk; on a cluster that is an error.
    """
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not base and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        if not base:
            base = "file://" + tempfile.mkdtemp(prefix="pixelarium-")
        _ROOTS[app] = f"{base.rstrip('/')}/pixelarium-{app}"
        atexit.register(_forget, spark, _ROOTS[app])
    return _ROOTS[app]


def _forget(spark: SparkSession, root: str) -> None:
    try:
        drop_path(spark, root)
    except Exception:  # the JVM may be gone by the time the interpreter ends
        pass


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


@contextlib.contextmanager
def _arrays(spark: SparkSession, flat: bool):
    """Where ``flat``, arrays without nulls are written in Parquet's two levels meanwhile,
    not in three, which costs less for each number; Spark reads both."""
    key = "spark.sql.parquet.writeLegacyFormat"
    before = spark.conf.get(key)
    spark.conf.set(key, "true" if flat else before)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def stage(df: DataFrame, name: str, flat: bool = False, **options) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends here,
    and what was computed survives the loss of any executor."""
    path = new_path(df.sparkSession, name)
    with _arrays(df.sparkSession, flat):
        df.write.options(**({"compression": "zstd"} | options)).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def unstage(df: DataFrame) -> None:
    drop_path(df.sparkSession, df._staged_at)


def write_bucketed(df: DataFrame, keys: list[str], name: str, order: bool = True, flat: bool = False, **options) -> tuple[str, str]:
    """(table, path): a table of the session's catalogue, bucketed (and sorted) by
    keys in as many buckets as shuffles have partitions, below the shared folder.
    Joins on the keys read it as it lies."""
    spark = df.sparkSession
    path = new_path(spark, name)
    table = path.rsplit("/", 1)[1].replace("-", "_")
    writer = df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys)
    writer = writer.sortBy(*keys) if order else writer
    with _arrays(spark, flat):
        writer.options(**({"compression": "zstd"} | options)).option("path", path).format("parquet").saveAsTable(table)
    return table, path


def drop_table(spark: SparkSession, table: str, path: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    drop_path(spark, path)


def release(spark: SparkSession) -> None:
    """Let the context cleaner remove shuffle files nobody refers to any more."""
    gc.collect()
    spark._jvm.System.gc()


def hide_columns(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that clash with none of the table's own."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Distributed union-find over an edge table, DataFrame operations only.

    Alternates the large-star and small-star rewritings until the edge set stops
    changing; each round is staged, so lineage stays flat. Every rewriting is an
    aggregate to one row per node (combined map-side) and an equi-join whose other
    side is unique by key, so a hub never has its pairs multiplied.

    Returns ``node, component``: one row per node other than the smallest of its
    component, ``component`` being that smallest node. Self loops and nulls are
    ignored; no edges give no rows.
    """
    spark = edges.sparkSession
    e = (
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .distinct()
    )
    e, mark = _marked(e)
    while mark[0]:
        both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("m"))
        large = (
            both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u != v").distinct()
        )
        large = stage(large, "cc")
        small_min = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(small_min, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionAll(small_min.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        )
        nxt, after = _marked(small)
        unstage(large)
        unstage(e)
        e = nxt
        if after == mark:
            break
        mark = after
    return e.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _marked(e: DataFrame) -> tuple[DataFrame, tuple]:
    """An edge table, staged, with its number of rows and a hash of them all, both
    gathered while it is written."""
    seen = Observation()
    out = stage(e.observe(seen, F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x")), "cc")
    return out, (seen.get["n"], seen.get["x"])


def rank_within(df: DataFrame, group: str, salt, order: list, rank: str, rows_per_part: int = 250_000) -> DataFrame:
    """Gapless 0-based rank of each row within its group, without sending a group
    to one task.

    Rows are split by a salt; each (group, salt) part is numbered on its own and
    offset by the rows of the parts before it. The table of parts has at most
    groups x salts rows, and the number of salts follows the row count, so a part
    of any group has about ``rows_per_part`` rows at most.
    """
    part, n_part, g, p, ahead = hide_columns(df, "part", "n_in_part", "group", "of_part", "ahead")
    n = df.count()
    salts = max(8, -(-n // rows_per_part))
    salted = df.withColumn(part, F.pmod(salt, F.lit(salts)).cast("int"))
    parts = salted.groupBy(group, part).agg(F.count("*").alias(n_part))
    before = Window.partitionBy(group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(F.col(group).alias(g), F.col(part).alias(p), F.coalesce(F.sum(n_part).over(before), F.lit(0)).alias(ahead))
    own = F.row_number().over(Window.partitionBy(group, part).orderBy(*order)) - 1
    return (
        salted.withColumn(rank, own.cast("long"))
        .join(offsets, F.col(group).eqNullSafe(F.col(g)) & (F.col(part) == F.col(p)))
        .withColumn(rank, F.col(rank) + F.col(ahead))
        .drop(g, p, ahead, part)
    )
