"""Threshold-scaled document sketches, DataFrame operations only.

A text's sketch is every hash of its word shingles that falls below a fixed
fraction of the hash space. Whether a hash is kept depends on the hash alone, so
sketches merge by union, and containment and Jaccard similarity are estimated
without bias between documents of very unequal length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, hide_columns, stage

SHINGLE = 3
#: One hash in so many is kept: those from 0 to 2**64 / SCALE, a fixed fraction.
SCALE = 8
SPACE = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\u000b\f\r"


def words(text: Column) -> Column:
    """A text's words in order; an empty array for null and blank texts."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE))


def hashes(words: Column) -> Column:
    """Distinct hashes of the shingles of a materialised array of words. Fewer words
    than a shingle make one shingle; no words make none."""
    n = F.greatest(F.size(words) - (SHINGLE - 1), F.least(F.size(words), F.lit(1)))
    rows = F.arrays_zip(
        F.slice(words, 1, n).alias("a"), *[F.slice(words, i + 1, n).alias(c) for i, c in zip(range(1, SHINGLE), "bcdefgh", strict=False)]
    )
    return F.array_distinct(F.transform(rows, lambda z: F.xxhash64(*[z[c] for c in "abcdefgh"[:SHINGLE]])))


def _below(hashed: Column) -> Column:
    return F.filter(hashed, lambda h: (h >= 0) & (h < (1 << 64) // SCALE))


def _sketch(hashed: Column, below: Column) -> Column:
    return F.sort_array(F.when((F.size(below) == 0) & (F.size(hashed) > 0), F.array(F.array_min(hashed))).otherwise(below))


def sketched(df: DataFrame, columns: dict[str, str], words: dict[str, str]) -> DataFrame:
    """Columns of ``df`` by new name, and the sketches of columns of words by new name:
    sorted distinct hashes below the fixed fraction or, if a text has others only, its
    least. A text that has words has a sketch that is not empty. Each step is a
    projection of its own, so that no text is hashed twice."""
    kept = [F.col(c).alias(n) for n, c in columns.items()]
    df = df.select(*kept, *[hashes(F.col(w)).alias(f"h_{n}") for n, w in words.items()])
    df = df.select(*columns, *[f"h_{n}" for n in words], *[_below(F.col(f"h_{n}")).alias(f"b_{n}") for n in words])
    return df.select(*columns, *[_sketch(F.col(f"h_{n}"), F.col(f"b_{n}")).alias(n) for n in words])


def sketch(words: Column) -> Column:
    """A sketch in one expression."""
    hashed = hashes(words)
    return _sketch(hashed, _below(hashed))


def spelled(sketch: Column) -> Column:
    """A sketch as text: hexadecimal hashes in order, comma-joined."""
    return F.lower(F.array_join(F.transform(sketch, F.hex), ","))


def merged(sketches: Column) -> Column:
    """The sketch of all texts of an array of sketches together: the hashes below the
    fraction, or the least of the texts' least ones."""
    every = F.array_distinct(F.flatten(sketches))
    return _sketch(every, _below(every))


def jaccard(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity; 1 for two empty sketches, which only texts without
    words have, and 0 for an empty one and another."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, F.lit(1.0)).otherwise(both / union)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has; 1 where a's sketch is empty."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def range_buckets(df: DataFrame, key: str, tie: str, bytes_: Column, bucket_bytes: int, least_ranges: int = 32) -> Column:
    """A column that numbers ranges of (key, tie), each of about ``bucket_bytes`` (of
    more where 20,000 ranges don't suffice; then ranges are sorted on disk). A key that
    holds many rows is a cut more than once, and its rows are divided by ``tie``, a
    hash. Only the cuts reach the driver; a row finds its place among them in two short
    steps."""
    total = df.agg(F.sum(bytes_).alias("b"), F.count(key).alias("n")).first()
    ranges = max(1, min(max(-(-(total["b"] or 0) // bucket_bytes), least_ranges), total["n"] or 1, 20_000))
    if ranges == 1:
        return F.lit(0)
    cuts = sorted(df.agg(F.percentile_approx(key, [i / ranges for i in range(1, ranges)], 20 * ranges).alias("c")).first()["c"])
    step = max(1, int(len(cuts) ** 0.5))
    array = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])

    def number(before) -> Column:
        count = lambda xs: F.coalesce(F.size(F.filter(xs, before)), F.lit(0))
        coarse = count(array(cuts[step - 1 :: step]))
        return coarse * step + count(F.slice(array(cuts), coarse * step + 1, F.lit(step)))

    low, high = number(lambda c: c < F.col(key)), number(lambda c: c <= F.col(key))
    part = (F.shiftright(tie, 32) + F.lit(1 << 31)) * (high - low + 1)
    return (low + F.shiftright(part, 32)).cast("int")


def with_next(df: DataFrame, *, key: str, text: str, bucket_bytes: int = 16 << 20) -> tuple[DataFrame, str]:
    """``df`` plus the text of the row that follows by descending key (rows
    without a key last; of equal keys, by descending hash of the text, and by text
    if that agrees), the first row following the last.

    Rows move once, to ranges of key and hash; inside a range the next row is read off
    the order, and the last row of a range finds the first of the following one
    in a table of one row per range. Rows of one key are spread over ranges; only those
    that repeat key and text stay in one.
    """
    bucket, after, last, at, order_key, tie, head, number, following = hide_columns(df, "bucket", "after", "last", "at", "order_key", "tie", "head", "number", "following")
    keyed = df.withColumns({order_key: F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))), tie: F.xxhash64(key, text)})
    placed = keyed.withColumn(bucket, range_buckets(keyed, order_key, tie, F.octet_length(text).cast("long") + 16, bucket_bytes))
    order = Window.partitionBy(bucket).orderBy(F.desc_nulls_last(key), F.desc(tie), F.desc(text))
    seen = placed.withColumns({after: F.lead(text).over(order), at: F.row_number().over(order), last: F.lead(F.lit(1)).over(order).isNull()})
    heads = stage(seen.where(F.col(at) == 1).select(F.col(bucket).alias(number), F.col(text).alias(head)), "heads")
    # one row per range
    falling = Window.orderBy(F.desc(number))
    lowest = heads.agg(F.min(number).alias("m")).first()["m"]
    follow = heads.select(F.coalesce(F.lag(number).over(falling), F.lit(lowest)).cast("int").alias(following), head)
    joined = seen.join(follow, (F.col(bucket) == F.col(following)) & F.col(last), "left")
    return joined.withColumn(after, F.coalesce(after, head)).select(*[f"`{c}`" for c in df.columns], after), after


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null texts count as empty; rows are neither added nor dropped, and an empty
    table gives none."""
    docs = documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows, after = with_next(docs, key="doc_id", text="text")
    rows = rows.withColumn("n_chars", F.char_length("text"))
    rows = rows.withColumn("edited", F.concat(F.expr("substring(text, 1, int(n_chars - n_chars div 3))"), F.expr(f"substring(`{after}`, 1, int(n_chars div 3))")))
    rows = rows.select(
        "doc_id",
        F.col("n_chars").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        words(F.col("text")).alias("w"),
        words(F.col("edited")).alias("we"),
        words(F.col(after)).alias("wn"),
    )
    own = {c: c for c in ("doc_id", "n_chars", "edited_sha256")}
    rows = sketched(rows, own, {"s_w": "w", "s_we": "we", "s_wn": "wn"})
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        spelled(F.col("s_w")).alias("fingerprint"),
        spelled(F.col("s_we")).alias("edited_fingerprint"),
        jaccard(F.col("s_w"), F.col("s_we")).alias("near_edited"),
        jaccard(F.col("s_w"), F.col("s_wn")).alias("near_next"),
        containment(F.col("s_w"), F.col("s_we")).alias("contained_in_edited"),
    )


QUERIES = {"op5_fingerprints": op5_fingerprints}
ORACLE_SQL: dict[str, str] = {}
