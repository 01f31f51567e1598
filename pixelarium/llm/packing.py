"""Best-fit packing planned over the histogram of lengths.

Tokenised documents are cut into pieces of at most one sequence. Only the
histogram of piece lengths (one count per length, so never more than the sequence
length) reaches the driver, where best-fit decreasing places whole runs of equal
pieces at once. Each piece then finds its planned slot by its rank among the
pieces of its length.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, hide_columns, map_arrow, rank_within, stage

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The byte behind each letter of a byte-level vocabulary: printable Latin-1
    characters stand for themselves, the other bytes for 256 and up in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = (b for b in range(256) if b not in shown)
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(others)}


def load_tokenizer(path: str) -> Callable[[str], bytes]:
    """Ids of a whole text as little-endian unsigned 32-bit bytes; strings of added
    tokens get those tokens' ids, as in the library.

    The file is one of the ``tokenizers`` library, and so are the ids. A byte-level
    vocabulary lists its merges in order of rank, so its own ids serve as the ranks
    of a tiktoken encoding, which needs a third of the time.
    """
    if path not in _LOADED:
        import tiktoken
        from public_tokenizers import PATTERN

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t[flag] for t in spec["added_tokens"] for flag in ("lstrip", "rstrip", "single_word", "normalized")):
            raise ValueError("added tokens that take in or ask for blanks beside them are not supported")
        letters = byte_letters()
        ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        encode = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special).encode_to_numpy
        _LOADED[path] = lambda text: encode(text, allowed_special="all").astype("<u4", copy=False).tobytes()
    return _LOADED[path]


#: By file, in each Python worker.
_LOADED: dict[str, Callable[[str], bytes]] = {}


def cut_pieces(n: int, most: int) -> Iterator[tuple[int, int]]:
    """(start, length) of a document's pieces: all full but perhaps the first."""
    first = n % most or most
    yield 0, min(first, n)
    for start in range(first, n, most):
        yield start, most


def tokenised_pieces(docs: DataFrame, *, sequence: int = 2048, end_id: int = 0, tokenizer: str | None = None) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32``.

    A null text counts as empty and gives one piece that holds the end id alone.
    """
    path = tokenizer or default_tokenizer()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = load_tokenizer(path)
        last = struct.pack("<I", end_id)
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = ids_of(text.as_py() or "") + last
                for i, (start, length) in enumerate(cut_pieces(len(ids) // 4, sequence)):
                    for column, x in zip(out, (doc.as_py(), i, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])), strict=True):
                        column.append(x)
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, PIECES)


def plan_best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts.

    Returns slots (length, first rank, number, first sequence, offset): pieces of
    that length with ranks from the first on, one to each sequence from the first
    on, at the offset. Sequences with equal room are kept as runs of ids, so the
    plan's size follows the distinct lengths, not the pieces.
    """
    free: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by room: runs (first sequence, number)
    slots, opened = [], 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            room = next((r for r in range(length, capacity) if free[r]), capacity)
            each = room // length
            if room == capacity and not free[room]:
                need = -(-left // each)
                free[room].append((opened, need))
                opened += need
            base, number = free[room].pop()
            if left >= each:
                take = min(number, left // each)
            else:
                take, each = 1, left
            for j in range(each):
                slots.append((length, rank, take, base, capacity - room + j * length))
                rank += take
            left -= take * each
            free[room - each * length].append((base, take))
            if number > take:
                free[room].append((base + take, number - take))
    return slots


def pack(pieces: DataFrame, *, sequence: int = 2048, order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """``pieces`` (any table with a ``length`` column from 1 to ``sequence``) plus
    ``sequence_id`` and ``offset``.

    Equal lengths are ranked in salted parts, so a length that holds most of the
    pieces is spread over tasks. Repeated rows are separate pieces. Columns that are
    named like the two new ones are replaced, as packing anew means. An empty table
    gives no rows; a length outside the range is an error.
    """
    spark = pieces.sparkSession
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    if histogram and not (1 <= min(histogram) and max(histogram) <= sequence):
        raise ValueError(f"lengths must be from 1 to {sequence}")
    slots = plan_best_fit(histogram, sequence)
    own, lo, number, base, rank = hide_columns(pieces, "planned_length", "lo", "number", "base", "rank")
    pieces = pieces.drop("sequence_id", "offset")
    shape = f"{own} long, {lo} long, {number} long, {base} long, offset long"
    plan = spark.createDataFrame(slots, shape)
    if len(slots) <= 1_000_000:  # 40 MB; the plan follows the distinct lengths
        plan = F.broadcast(plan)
    ranked = rank_within(pieces, "length", F.xxhash64(*order), list(order), rank)
    at = (F.col("length") == F.col(own)) & (F.col(rank) >= F.col(lo)) & (F.col(rank) < F.col(lo) + F.col(number))
    return ranked.join(plan, at).withColumn("sequence_id", F.col(base) + F.col(rank) - F.col(lo)).drop(own, lo, number, base, rank)


def pack_documents(docs: DataFrame, sequence: int = 2048) -> DataFrame:
    """One row per piece of each of ``docs`` (doc_id, text): ``doc_id, piece, start,
    length, ids_crc32, sequence_id, offset``.

    A null or empty text is one piece, its end id. A null doc_id stays null, and rows
    that repeat an id are packed each on its own. Other columns are not read. An empty
    table gives no rows.
    """
    pieces = stage(tokenised_pieces(docs, sequence=sequence), "pieces")
    packed = pack(pieces, sequence=sequence)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs all documents; edge cases as in :func:`pack_documents`."""
    return pack_documents(documents(spark, sf_dir))


QUERIES = {"op8_packing": op8_packing}
ORACLE_SQL: dict[str, str] = {}
