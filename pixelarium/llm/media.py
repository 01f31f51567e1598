"""Media columns as content-defined chunks.

A payload is cut where a rolling gear hash of its last bytes meets a mask, so cuts
follow the content. Chunks are named by digest; each distinct chunk is stored once
(compressed, in a table bucketed by digest), and a payload is stored as the ordered
list of its chunks' digests. Reading joins the lists with the store, puts the chunks
in order again, and checks the payload against its digest.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, drop_path, map_arrow, new_path, release, stage

FRAME = 192
#: Chunk sizes in bytes; a cut comes on average after about 2**13 more than the least.
LEAST, MOST, MASK = 2048, 65536, (1 << 13) - 1
DIGEST = 16
LEVEL = 9
#: The compression dictionary: its size, and the sample it is trained on (rows chosen
#: by a hash of their id, bytes of each). Everything else covers all rows.
DICTIONARY, SAMPLE_ROWS, SAMPLE_BYTES = 1 << 16, 2_000, 8_192


def padded(data: bytes) -> bytes:
    """Blanks are appended up to a positive multiple of the frame."""
    return data + b" " * (-len(data) % FRAME if data else FRAME)


@cache
def gear() -> np.ndarray:
    """256 pseudo-random 32-bit words: the first bytes of each byte's digest."""
    return np.array([int.from_bytes(hashlib.blake2b(bytes([b]), digest_size=4).digest(), "little") for b in range(256)], np.uint32)


def rolling(data: np.ndarray) -> np.ndarray:
    """Gear hash at each byte: the sum of the words of the last 32 bytes, each
    shifted by its age, computed by doubling the window five times."""
    h = gear()[data]
    for age in (1, 2, 4, 8, 16):
        if age < len(h):
            h[age:] = h[age:] + (h[:-age] << np.uint32(age))
    return h


def cuts(data: bytes) -> list[int]:
    """Ends of a payload's chunks."""
    ends, begin, n = [], 0, len(data)
    if n > LEAST:
        marks = np.flatnonzero((rolling(np.frombuffer(data, np.uint8)) & np.uint32(MASK)) == 0) + 1
        i = 0
        while n - begin > LEAST:
            i += int(np.searchsorted(marks[i:], begin + LEAST))
            end = min(int(marks[i]) if i < len(marks) else n, begin + MOST, n)
            ends.append(end)
            begin = end
    if begin < n:
        ends.append(n)
    return ends


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=DIGEST).digest()


def chunks_of(payload: bytes) -> Iterator[bytes]:
    begin = 0
    for end in cuts(payload):
        yield payload[begin:end]
        begin = end


def recipes(rows: DataFrame, payload: Callable[[object], bytes]) -> DataFrame:
    """One row per row of (id, value): id, n_bytes, payload_id (digest of the
    payload) and the ordered digests of its chunks."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, ids, lists = [], [], []
            for value in batch.column(1):
                data = value.as_py() or b""
                whole = payload(data)
                lengths.append(len(data))
                ids.append(digest(whole))
                lists.append([digest(c) for c in chunks_of(whole)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lengths, pa.int64()), pa.array(ids, pa.binary()), pa.array(lists, pa.list_(pa.binary()))],
                ["id", "n_bytes", "payload_id", "chunks"],
            )

    return map_arrow(rows, run, "id long, n_bytes long, payload_id binary, chunks array<binary>")


def train_dictionary(rows: DataFrame) -> bytes:
    """A dictionary for chunks of a few kilobytes, from a bounded sample (16 MB at
    most); empty where there is too little to train on."""
    import zstandard

    head = F.substring("value", 1, SAMPLE_BYTES).alias("head")
    chosen = rows.where("id IS NOT NULL").select("id").orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS)
    heads = [bytes(r.head) for r in rows.join(F.broadcast(chosen.distinct()), "id", "left_semi").select(head).limit(SAMPLE_ROWS).collect() if r.head]
    if sum(map(len, heads)) < 10 * DICTIONARY:
        return b""
    return zstandard.train_dictionary(DICTIONARY, sorted(heads)).as_bytes()


def chunk_rows(rows: DataFrame, payload: Callable[[object], bytes], dictionary: bytes = b"") -> DataFrame:
    """(digest, data) of each chunk, compressed; a task names each of its chunks
    once while it remembers it, so groups of copies shrink before they are dealt."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None).compress
        seen: set[bytes] = set()
        for batch in batches:
            names, data = [], []
            for value in batch.column(1):
                for chunk in chunks_of(payload(value.as_py() or b"")):
                    name = digest(chunk)
                    if name not in seen:
                        if len(seen) > 500_000:
                            seen.clear()
                        seen.add(name)
                        names.append(name)
                        data.append(pack(chunk))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(data, pa.binary())], ["digest", "data"])

    return map_arrow(rows, run, "digest binary, data binary")


class ChunkStore:
    """A table of distinct chunks, written bucketed and sorted by digest, so that
    joins on the digest read it as it lies."""

    def __init__(self, rows: DataFrame, dictionary: bytes = b""):
        self.spark, self.dictionary = rows.sparkSession, dictionary
        self.buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.path = new_path(self.spark, "chunks")
        self.table = "chunks_" + self.path.rsplit("-", 1)[1]
        distinct = rows.repartition(self.buckets, "digest").dropDuplicates(["digest"])
        (
            distinct.write.bucketBy(self.buckets, "digest").sortBy("digest")
            .option("path", self.path).option("compression", "uncompressed").format("parquet").saveAsTable(self.table)
        )

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        drop_path(self.spark, self.path)


def reconstruct(lists: DataFrame, store: ChunkStore, features: Callable[[bytes], str]) -> DataFrame:
    """One row per distinct payload of ``lists`` (payload_id, chunks), read back
    from the store: sizes and digests of payload and stored form, and its features.

    A payload whose chunks don't give its digest again raises an error. A payload
    is held whole by the task that reads it.
    """
    unpack_schema = "payload_id binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    places = lists.select("payload_id", F.posexplode("chunks").alias("at", "digest"))
    total = places.count()
    common = stage(places.groupBy("digest").agg(F.count("*").alias("n")).where(F.col("n") > max(10_000, total // 500)).select("digest"), "common")
    if common.count():
        # fewer than 500 chunks of 64 KB at most: 32 MB
        table = F.broadcast(store.read().join(F.broadcast(common), "digest", "left_semi"))
        found = places.join(F.broadcast(common), "digest", "left_anti").join(store.read(), "digest").unionByName(places.join(table, "digest"))
    else:
        found = places.join(store.read(), "digest")
    rows = (
        found.select("payload_id", "at", "data")
        .repartition(store.buckets, "payload_id").sortWithinPartitions("payload_id", "at")
    )

    dictionary = store.dictionary

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None).decompress

        def finish(name: bytes, parts: list[bytes]) -> tuple:
            payload = b"".join(map(unpack, parts))
            if digest(payload) != name:
                raise ValueError("a payload read back differs from the one stored")
            stored = hashlib.sha256()
            for p in parts:
                stored.update(len(p).to_bytes(4, "little") + p)
            return (
                name, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]),
                sum(len(p) + 4 for p in parts), stored.hexdigest(), features(payload),
            )

        def table(done: list[tuple]) -> pa.RecordBatch:
            types = (pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            names = [f.split()[0] for f in unpack_schema.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate(types)], names)

        now, parts = None, []
        for batch in batches:
            done = []
            for name, data in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if name != now:
                    if parts:
                        done.append(finish(now, parts))
                    now, parts = name, []
                parts.append(data)
            yield table(done)
        if parts:
            yield table([finish(now, parts)])

    return map_arrow(rows, run, unpack_schema)


def sample_features(payload: bytes) -> str:
    """Mean, deviation, crossings of the mean and number of distinct levels of the
    8-bit samples, and their entropy in bits, from the payload's bytes."""
    x = np.frombuffer(payload, np.uint8)
    counts = np.bincount(x, minlength=256)
    p = counts[counts > 0] / len(x)
    mean = float(x.mean())
    crossings = int(np.count_nonzero(np.diff((x > mean).view(np.int8))))
    return f"n={len(x)};mean={mean:.6f};std={float(x.std()):.6f};cross={crossings};levels={len(p)};bits={float(-(p * np.log2(p)).sum()):.6f}"


def store_media(rows: DataFrame, payload: Callable[[object], bytes] = padded, features: Callable[[bytes], str] = sample_features, keep: list | None = None) -> DataFrame:
    """Stores the binary values of ``rows`` (columns id, value) and reads them back.
    The store goes once it is read, unless a list ``keep`` is given, which gets the
    store and the table of ordered chunk lists.

    Returns id, n_bytes, and for the payload read back: payload_bytes,
    payload_sha256, tail_crc32, media_bytes and media_sha256 (its chunks as stored,
    each after its length), feature. Null values are empty ones. Equal values share
    one payload, stored and read once; repeated rows repeat in the result, an empty
    table gives none.
    """
    spark = rows.sparkSession
    own = stage(recipes(rows, payload), "recipes")
    dictionary = train_dictionary(rows)
    store = ChunkStore(chunk_rows(rows, payload, dictionary), dictionary)
    release(spark)
    lists = own.groupBy("payload_id").agg(F.first("chunks").alias("chunks"))
    read = stage(reconstruct(lists, store, features), "media")
    if keep is None:
        store.drop()
    else:
        keep += [store, own]
    release(spark)
    return own.select("id", "n_bytes", "payload_id").join(read, "payload_id").drop("payload_id")


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("binary").alias("value"))
    return store_media(rows).withColumnRenamed("id", "doc_id")


QUERIES = {"op9_media": op9_media}
ORACLE_SQL: dict[str, str] = {}
