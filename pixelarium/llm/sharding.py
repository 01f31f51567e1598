"""Two-pass external shuffle of records into shards, DataFrame operations only.

Pass one scatters records by a seeded hash into buckets of a size that fits a
task's memory; pass two applies a Fisher-Yates shuffle to each bucket and numbers
its records after those of the buckets before it. The numbering is one global
permutation, cut into shards of equal row counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, hide_columns, new_path, stage


def shuffle_to_shards(
    df: DataFrame, *, key: str = "doc_id", text: str = "text", shards: int = 40, seed: int = 20240607, bucket_bytes: int = 32 << 20, least_buckets: int = 64
) -> DataFrame:
    """All of ``df``'s records and columns, plus ``shard`` (int) and ``slot`` (long).

    Shards differ by one row at most; slots run from 0 without gaps. The order follows
    the records, the seed and the sizes asked for, not the cluster or the input's
    partitions: buckets hold their records sorted by a content hash before they are
    shuffled with the seed. Each bucket is one partition of about ``bucket_bytes``;
    there are ``least_buckets`` at least.

    Null keys and texts hash as nulls and are placed like any record; an empty
    table gives no rows. Exact repeats of a record (same key and text) hash alike.
    Where they overfill a bucket, all records get an ordinal, written out before it is
    used, which scatters them as well; in that case alone the order follows the input's
    partitions, too. Underscores are put before the new names if the table has them.
    """
    total = df.agg(F.sum(_size(text)).alias("b"), F.max(_size(text)).alias("m"), F.count("*").alias("n")).first()
    n = total["n"]
    shard, slot, bucket, order, at, rec, ahead, ordinal = hide_columns(df, "shard", "slot", "bucket", "order", "pos", "rec", "ahead", "ordinal")
    columns = [F.col(f"`{c}`") for c in df.columns]
    buckets = max(-(-(total["b"] or 0) // bucket_bytes), least_buckets)

    def scatter(rows: DataFrame, *more: str) -> DataFrame:
        hashed = lambda s: F.xxhash64(F.lit(s), F.col(key), F.col(text), *more)
        return rows.withColumns({bucket: F.pmod(hashed(seed), F.lit(buckets)).cast("int"), order: hashed(seed + 1)})

    def counted(placed: DataFrame) -> DataFrame:
        return stage(placed.groupBy(bucket).agg(F.count("*").alias("n"), F.sum(_size(text)).alias("b")), "shard-buckets")

    placed = scatter(df)
    counts = counted(placed)
    if (counts.agg(F.max("b")).first()[0] or 0) > 4 * bucket_bytes + (total["m"] or 0):
        placed = scatter(stage(df.withColumn(ordinal, F.monotonically_increasing_id()), "numbered"), ordinal)
        counts = counted(placed)

    # One row per bucket: the only rows that meet in one task here.
    before = Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col(bucket), F.coalesce(F.sum("n").over(before), F.lit(0)).alias(ahead))
    shuffled = (
        placed.repartitionById(buckets, F.col(bucket))
        .sortWithinPartitions(bucket, order, key)
        .groupBy(bucket)
        .agg(F.collect_list(F.struct(*columns)).alias(rec))
        .select(bucket, F.posexplode(F.shuffle(rec, F.lit(seed))).alias(at, rec))
    )
    rank = (F.col(ahead) + F.col(at)).cast("long")
    number = F.expr(f"(`{ahead}` + `{at}`) * {shards}L div {max(n, 1)}L").cast("int")
    # at most one row per bucket and as small as two numbers
    placed = shuffled.join(F.broadcast(offsets) if buckets <= 1_000_000 else offsets, bucket).withColumn(shard, number)
    first = F.expr(f"(`{shard}` * {max(n, 1)}L + {shards - 1}L) div {shards}L")
    return placed.select(f"{rec}.*", shard, (rank - first).cast("long").alias(slot))


def _size(text: str) -> F.Column:
    """UTF-8 bytes of a text, none for null, plus 16."""
    return (F.octet_length(F.coalesce(F.col(text).cast("string"), F.lit(""))) + F.lit(16)).cast("long")


def write_shards(placed: DataFrame, path: str, *, shard: str = "shard", slot: str = "slot") -> DataFrame:
    """One folder per shard, whose files hold its records in slot order; returns the
    table as read back. A bucket's records lie in a row of neighbouring shards, so
    buckets are written as they are, without another shuffle."""
    placed.sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)
    return placed.sparkSession.read.schema(placed.schema).parquet(path)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards, written out and read back."""
    placed = shuffle_to_shards(documents(spark, sf_dir).select("doc_id", F.col("text").cast("string").alias("text")), shards=40)
    written = write_shards(placed, new_path(spark, "shards"))
    text = F.coalesce("text", F.lit(""))
    return written.select(
        "doc_id",
        _size("text").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


QUERIES = {"op4_sharding": op4_sharding}
ORACLE_SQL: dict[str, str] = {}
