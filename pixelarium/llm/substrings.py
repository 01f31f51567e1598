"""Substring deduplication over a log-structured fingerprint index.

Documents arrive in batches, in the order of doc_id. The index holds what earlier
batches left, as runs: immutable tables bucketed and sorted by hash, merge-joined
with each batch as they lie and compacted into one when there are too many.

* Anchor runs. From the windows of 20 words of each document, winnowing picks the
  least hash of 8 consecutive words in each window. Equal windows pick equal anchors,
  so a window can repeat only if its anchor was seen twice. One of about seven words
  is an anchor; a run keeps, by anchor, the first document and whether it was seen
  more than once.
* Window runs. Windows with a repeated anchor are verified: a 128-bit digest of all
  their 20 words is kept with the first document that has it. A document whose anchor
  is met for the second time is read again, once, to add its own windows.

The runs and a manifest lie in a folder that outlives the session: ``SubstringIndex``
opens it again and takes further batches.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelarium.sources import files

from .common import documents, drop_path, drop_table, map_arrow, new_path, release, stage, unstage, write_bucketed

WINDOW, GRAM = 20, 8
NULL_ID, NULL_PLACES = (1 << 63) - 1, 1 << 48
SPACES = np.zeros(256, np.int8)
SPACES[[0x20, *range(0x09, 0x0E)]] = 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _odd(seed: int, n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 32)) | np.uint64(1)


GRAM_FACTORS, HIGH_FACTORS, LOW_FACTORS = _odd(1, GRAM), _odd(2, WINDOW), _odd(3, WINDOW)
BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of each word, eight bytes at a time for all words at once."""
    edges = np.flatnonzero(np.diff(SPACES[np.frombuffer(data, np.uint8)], prepend=np.int8(1), append=np.int8(1)))
    starts, sizes = edges[::2], edges[1::2] - edges[::2]
    lanes = np.ndarray((len(data) + 1,), "<u8", data + b"\0" * 8, 0, (1,))
    h = mix(sizes.astype(np.uint64) + np.uint64(0x9E3779B9))
    live, at = np.arange(len(starts)), 0
    while len(live):
        h[live] = mix(h[live] * np.uint64(0x9E3779B97F4A7C15) + (lanes[starts[live] + at] & BYTES[np.minimum(sizes[live] - at, 8)]))
        at += 8
        live = live[sizes[live] > at]
    return h


def _slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over each ``width`` neighbours."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = pick(x[:-step], x[step:])
        done += step
    return x


def window_anchors(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(anchor of each window, anchors by place): the second has every place whose
    hash is some window's least, ties included."""
    if len(h) < WINDOW:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    n = len(h) - GRAM + 1
    g = mix(sum(h[j : j + n] * GRAM_FACTORS[j] for j in range(GRAM)))
    span = WINDOW - GRAM + 1
    least = _slide(g, span, np.minimum)
    pad = np.zeros(span - 1, np.uint64)
    reach = _slide(np.concatenate((pad, least, pad)), span, np.maximum)
    return least.view(np.int64), g[reach == g].view(np.int64)


def window_digests(h: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    high, low = np.zeros(len(starts), np.uint64), np.zeros(len(starts), np.uint64)
    for j in range(WINDOW):
        w = h[starts + j]
        high += w * HIGH_FACTORS[j]
        low += w * LOW_FACTORS[j]
    return mix(high).view(np.int64), mix(low).view(np.int64)


def _sha(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(d, text) to d, n_words, sha of all words, anchors."""
    for batch in batches:
        counts, shas, anchors = [], [], []
        for value in batch.column(1):
            data = (value.as_py() or "").encode()
            words = data.split()
            counts.append(len(words))
            shas.append(_sha(words))
            anchors.append(window_anchors(word_hashes(data))[1] if len(words) >= WINDOW else np.empty(0, np.int64))
        sizes = np.cumsum([0, *map(len, anchors)], dtype=np.int32)
        flat = pa.array(np.concatenate(anchors) if anchors else np.empty(0, np.int64), pa.int64())
        columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(shas, pa.string()), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), flat)]
        yield pa.RecordBatch.from_arrays(columns, ["d", "n_words", "sha", "anchors"])


def _windows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(d, text, anchors seen twice) to the digests of the windows on them; windows
    that repeat within the document are marked ``again``."""
    for batch in batches:
        out: list[list[np.ndarray]] = [[], [], [], [], []]
        size = 0
        for d, value, seen in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
            h = word_hashes((value.as_py() or "").encode())
            starts = np.flatnonzero(np.isin(window_anchors(h)[0], seen.values.to_numpy(zero_copy_only=False)))
            high, low = window_digests(h, starts)
            order = np.lexsort((starts, low, high))
            high, low, starts = high[order], low[order], starts[order]
            again = np.zeros(len(starts), bool)
            again[1:] = (high[1:] == high[:-1]) & (low[1:] == low[:-1])
            for column, x in zip(out, (high, low, np.full(len(starts), d, np.int64), starts.astype(np.int32), again), strict=True):
                column.append(x)
            size += len(starts)
            if size > 200_000:
                yield _table(out)
                out, size = [[], [], [], [], []], 0
        if size:
            yield _table(out)


def _table(out: list[list[np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["high", "low", "d", "start", "again"])


def _remove(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(d, text, starts of repeated windows) to d, n_removed, sha of what is left,
    and the text left."""
    for batch in batches:
        removed, shas, texts = [], [], []
        for value, starts in zip(batch.column(1), batch.column(2), strict=True):
            words = (value.as_py() or "").encode().split()
            edge = np.zeros(len(words) + 1, np.int64)
            at = starts.values.to_numpy(zero_copy_only=False)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + WINDOW, -1)
            covered = np.cumsum(edge[:-1]) > 0
            kept = [w for w, c in zip(words, covered.tolist(), strict=True) if not c]
            removed.append(int(covered.sum()))
            shas.append(_sha(kept))
            texts.append(b" ".join(kept).decode())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(removed, pa.int64()), pa.array(shas, pa.string()), pa.array(texts, pa.string())], ["d", "n_removed", "kept_sha", "kept"])


class RunIndex:
    """Sorted immutable runs of one key and the values merged over them. Runs are
    tables bucketed and sorted by the key, ``(table, path, buckets)`` each."""

    def __init__(self, spark: SparkSession, folder: str, name: str, keys: list[str], values: dict[str, str], most_runs: int = 2):
        self.spark, self.folder, self.name, self.keys, self.values, self.most_runs = spark, folder, name, keys, values, most_runs
        self.runs: list[list] = []

    def write(self, df: DataFrame, dealt: bool) -> list:
        """``dealt``: whether rows lie by key already, as after a join of runs."""
        table = f"{self.name}_{uuid.uuid4().hex[:12]}"
        path, buckets = f"{self.folder}/{table}", int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        writer = (df if dealt else df.repartition(buckets, *self.keys)).write.bucketBy(buckets, *self.keys).sortBy(*self.keys)
        writer.option("path", path).option("compression", "zstd").format("parquet").saveAsTable(table)
        return [table, path, buckets]

    def attach(self, runs: list[list]) -> None:
        """Makes runs that another session wrote known to this one's catalogue."""
        for table, path, buckets in runs:
            columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in self.spark.read.parquet(path).schema.fields)
            key = ", ".join(self.keys)
            self.spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS LOCATION '{path}'")
        self.runs = [list(r) for r in runs]

    def look_up(self, batch: DataFrame) -> DataFrame:
        """``batch`` plus ``old_<value>``, null where no run has the key: one merge
        join for each run."""
        for i, (table, *_) in enumerate(self.runs):
            run = self.spark.table(table).select(*self.keys, *[F.col(v).alias(f"r{i}_{v}") for v in self.values])
            batch = batch.join(run, self.keys, "left")
        merged = {}
        for v, how in self.values.items():
            seen = [F.col(f"r{i}_{v}") for i in range(len(self.runs))]
            pick = F.least if how == "min" else F.greatest
            merged[f"old_{v}"] = pick(*seen) if len(seen) > 1 else seen[0] if seen else F.lit(None).cast("long")
        return batch.withColumns(merged).drop(*[f"r{i}_{v}" for i in range(len(self.runs)) for v in self.values])

    def add(self, batch: DataFrame) -> DataFrame:
        """Appends a run, returns it as written."""
        self.runs.append(self.write(batch, False))
        return self.spark.table(self.runs[-1][0])

    def compact(self) -> list[list]:
        """Merges all runs into one when there are more than ``most_runs``; returns
        the runs that it replaces, which are still there."""
        if len(self.runs) <= self.most_runs:
            return []
        merged = None
        for table, *_ in self.runs:
            run = self.spark.table(table).select(*self.keys, *self.values)
            if merged is None:
                merged = run
                continue
            other = run.select(*self.keys, *[F.col(v).alias(f"new_{v}") for v in self.values])
            pick = {v: (F.least if how == "min" else F.greatest)(F.col(v), F.col(f"new_{v}")) for v, how in self.values.items()}
            merged = merged.join(other, self.keys, "full").select(*self.keys, *[p.alias(v) for v, p in pick.items()])
        old, self.runs = self.runs, [self.write(merged, True)]
        return old


def join_spread(rows: DataFrame, table: DataFrame, keys: list[str], total: int) -> DataFrame:
    """Join with a table that is unique by key and has ``n``, how many rows hold
    it. Keys of more than a thousandth of the rows, so fewer than a thousand, are
    broadcast; the others are joined by sorting."""
    hot = stage(table.where(F.col("n") > max(20_000, total // 1000)), "hot")
    if not hot.limit(1).count():
        return rows.join(table, keys)
    few = F.broadcast(hot)
    return rows.join(few, keys).unionByName(rows.join(F.broadcast(hot.select(keys)), keys, "left_anti").join(table, keys))


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``d, text``: null ids get places after all others, one for each text."""
    whole = F.col(text).cast("string")
    own = F.lit(NULL_ID) - F.xxhash64(whole).bitwiseAND(F.lit(NULL_PLACES - 1))
    return docs.select(F.coalesce(F.col(key).cast("long"), own).alias("d"), whole.alias("text"))


def _bounds(docs: DataFrame, batches: int, key: str) -> list[int]:
    """Largest id of each batch but the last: equal shares of the documents."""
    own = F.col(key).cast("long")
    found = docs.agg(F.percentile_approx(own, [i / batches for i in range(1, max(2, batches))], 10_000).alias("c"), F.max(own).alias("m")).first()
    if found.m is not None and found.m > NULL_ID - NULL_PLACES:
        raise ValueError(f"ids must not be above {NULL_ID - NULL_PLACES}")
    return sorted(set(found.c or [])) if batches > 1 else []


class SubstringIndex:
    """The index of all batches added so far, in a folder that any session can open.

    ``add`` looks a batch up and adds it, and writes the manifest last: a session that
    is lost in between leaves the index as it was before the batch. Batches come in the
    order of doc_id.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.last = spark, folder, None
        self.anchors = RunIndex(spark, folder, "anchors", ["h"], {"doc": "min", "shared": "max"})
        self.windows = RunIndex(spark, folder, "windows", ["high", "low"], {"first": "min"})
        if known := files.read_json(spark, f"{folder}/manifest.json"):
            self.last = known["last"]
            self.anchors.attach(known["anchors"])
            self.windows.attach(known["windows"])

    def add(self, docs: DataFrame, earlier: DataFrame | None = None, *, key: str = "doc_id", text: str = "text") -> DataFrame:
        """The result of :func:`deduplicate_substrings` for ``docs``, as it would be
        with all earlier batches before them. ``earlier`` has those documents (others,
        too, it may be the whole corpus): a text in which an anchor was met once is
        read again when it is met for the second time. Needed but in the first call."""
        if self.last is not None and earlier is None:
            raise ValueError("the earlier documents are needed")
        known = None if earlier is None else _keyed(earlier, key, text)
        done, top = _take_in(known, _keyed(docs, key, text), self.last, self.anchors, self.windows)
        self.last = top if self.last is None or (top is not None and top > self.last) else self.last
        old = self.anchors.compact() + self.windows.compact()
        files.write_json(self.spark, f"{self.folder}/manifest.json", {"last": self.last, "anchors": self.anchors.runs, "windows": self.windows.runs})
        for table, path, _ in old:
            drop_table(self.spark, table, path)
        release(self.spark)
        real = F.when(F.col("d") <= NULL_ID - NULL_PLACES, F.col("d"))
        return done.select(real.alias("doc_id"), "n_words", "n_removed", "kept_sha256", "kept")

    def drop(self) -> None:
        for table, path, _ in self.anchors.runs + self.windows.runs:
            drop_table(self.spark, table, path)
        drop_path(self.spark, self.folder)


def deduplicate_substrings(docs: DataFrame, *, batches: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_sha256 and
    ``kept``, the words left joined by single blanks where any were removed (else
    null: the document's own words are all kept).

    A word goes if a window of 20 words covers it that starts earlier, too: in a
    document of smaller id, or before in the same. Null texts have no words; null
    ids come last, in the order of a hash of their texts, and those of one text count
    as one document, as rows sharing an id do (windows at the same start of such rows
    are one). An empty table gives no rows.
    """
    spark = docs.sparkSession
    bounds = _bounds(docs, batches, key)
    index = SubstringIndex(spark, new_path(spark, "substrings"))
    own, out = F.col(key).cast("long"), None
    for low, high in zip([None, *bounds], [*bounds, None], strict=True):
        batch = docs if low is None else docs.where((own > low) if high is not None else (own > low) | own.isNull())
        batch = batch if high is None else batch.where(own <= high)
        part = index.add(batch, docs, key=key, text=text)
        out = part if out is None else out.unionAll(part)
    index.drop()
    return out


def _take_in(docs: DataFrame | None, batch: DataFrame, low: int | None, anchors: RunIndex, windows: RunIndex) -> tuple[DataFrame, int | None]:
    """The batch's result and its last place."""
    spark = docs.sparkSession
    read = stage(map_arrow(batch, _read, "d long, n_words long, sha string, anchors array<long>"), "read")
    span = read.agg(F.min("d").alias("least"), F.max("d").alias("top"), F.sum(F.size("anchors")).alias("n")).first()
    if low is not None and span.least is not None and span.least <= low:
        raise ValueError(f"ids must be above {low}, the last in the index")
    places = read.select("d", F.explode("anchors").alias("h"))
    keys = places.groupBy("h").agg(F.min("d").alias("new_doc"), F.count("*").alias("n"))
    seen = anchors.look_up(keys).select(
        "h",
        "n",
        F.least("new_doc", "old_doc").alias("doc"),
        ((F.col("n") > 1) | F.col("old_doc").isNotNull()).cast("long").alias("shared"),
        F.when(F.col("old_shared") == 0, F.col("old_doc")).alias("reopen"),
    )
    run = anchors.add(seen)
    total = span.n or 0

    repeated = run.where("shared = 1")
    wanted = join_spread(places, repeated.select("h", "n"), ["h"], total).select("d", "h")
    reopened = repeated.where("reopen IS NOT NULL").select(F.col("reopen").alias("d"), "h")
    needs = wanted.unionAll(reopened).groupBy("d").agg(F.collect_set("h").alias("seen"))
    sources = batch
    if low is not None:
        old = stage(reopened.select("d").distinct(), "reopened")
        n = old.count()
        if n:
            # 8 bytes an id: a list of up to a million is broadcast
            sources = sources.unionAll(docs.where(F.col("d") <= low).join(F.broadcast(old) if n <= 1_000_000 else old, "d", "left_semi"))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table, path = write_bucketed(sources.join(needs, "d").repartition(buckets, "d"), ["d"], "texts")
    texts = spark.table(table)

    found = stage(map_arrow(texts.select("d", "text", "seen"), _windows, "high long, low long, d long, start int, again boolean"), "windows")
    once = found.where("NOT again").select("high", "low", "d", "start")
    firsts = once.groupBy("high", "low").agg(F.min("d").alias("new"), F.count("*").alias("n"))
    known = windows.look_up(firsts).select("high", "low", F.least("new", "old_first").alias("first"), "n")
    named = windows.add(known)
    later = named.where((F.col("n") > 1) | (F.col("first") < F.lit(low if low is not None else -(1 << 63)) + F.lit(1)))
    number = named.agg(F.sum("n")).first()[0] or 0
    repeats = join_spread(once, later, ["high", "low"], number).where("first < d").select("d", "start").unionAll(found.where("again").select("d", "start"))
    if low is not None:
        repeats = repeats.where(F.col("d") > low)
    starts = repeats.groupBy("d").agg(F.collect_list("start").alias("starts"))
    cut = map_arrow(texts.select("d", "text").join(starts, "d").select("d", "text", "starts"), _remove, "d long, n_removed long, kept_sha string, kept string")
    done = read.drop("anchors").join(cut, "d", "left").select(
        "d", "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("kept_sha", "sha").alias("kept_sha256"), "kept"
    )
    done = stage(done, "kept")
    drop_table(spark, table, path)
    unstage(found)
    unstage(read)
    return done, span.top


def op1_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate_substrings(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")


QUERIES = {"op1_substrings": op1_substrings}
ORACLE_SQL: dict[str, str] = {}
