"""SimHash near-duplicates by anchor-point covering.

The anchors are the words of a covering code on 46 of the 64 fingerprint bits: the
product of two binary Golay codes of length 23, each of covering radius 3 and each
perfect, so that every fingerprint has exactly one *home* anchor. A fingerprint is
copied to every anchor that lies, factor by factor, within covering radius plus
what is left of the threshold. If two fingerprints differ in at most two bits, each
is therefore present at the other's home, and homes are compared with all that is
present there, anchor by anchor.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, documents, map_arrow, stage

THRESHOLD = 2
CODE_LENGTH = 23
#: Generator polynomial of the binary Golay code (fixed value).
GOLAY = 0b110001110101
RADIUS = 3
#: Homes compared at one anchor; beyond, the anchor's rows meet at midpoints.
MOST_HOMES = 4096
SMALL = 64


def simhash(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of the lower-cased (A-Z) text's word shingles, repeats
    included; 0 for texts without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    size = min(shingle, len(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - size + 1].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends[size - 1 :].tolist(), strict=True)], dtype="<u8")
    count = np.zeros(64, np.int64)
    for at in range(0, len(h), 65536):
        part = h[at : at + 65536]
        count += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(count * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id, text_hash, fp`` (the fingerprint's bits as a signed long)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([simhash(t.as_py()) for t in batch.column(1)], dtype="<u8").view("<i8")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fps, pa.int64())], ["doc_id", "text_hash", "fp"])

    whole = F.col(text).cast("string")
    return map_arrow(docs.select(F.col("doc_id").cast("long"), whole, F.xxhash64(whole)), run, "doc_id long, text_hash long, fp long")


def _syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders modulo the generator polynomial."""
    rest = words.astype(np.int64)
    for bit in range(CODE_LENGTH - 1, CODE_LENGTH - 13, -1):
        rest = np.where(rest >> bit & 1, rest ^ (GOLAY << (bit - 11)), rest)
    return rest


@cache
def _patterns() -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For excess 0, 1, 2 over the radius: (first, number, patterns) by syndrome.
    A word plus a pattern of its syndrome is a code word, at the pattern's weight."""
    out = []
    for excess in range(THRESHOLD + 1):
        weights = range(RADIUS + 1) if not excess else (RADIUS + excess,)
        p = np.array([sum(1 << b for b in bits) for w in weights for bits in combinations(range(CODE_LENGTH), w)], np.int64)
        s = _syndromes(p)
        order = np.argsort(s, kind="stable")
        number = np.bincount(s, minlength=1 << 11)
        out.append((np.cumsum(number) - number, number, p[order]))
    return out


def anchors_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, index of fingerprint, is home) for all replicas of ``fps``."""
    u = fps.view(np.uint64)
    mask = np.uint64((1 << CODE_LENGTH) - 1)
    x1, x2 = (u & mask).astype(np.int64), (u >> np.uint64(CODE_LENGTH) & mask).astype(np.int64)
    s1, s2 = _syndromes(x1), _syndromes(x2)
    anchors, index, home = [], [], []
    for a in range(THRESHOLD + 1):
        for b in range(THRESHOLD + 1 - a):
            (f1, n1, p1), (f2, n2, p2) = _patterns()[a], _patterns()[b]
            times = n1[s1] * n2[s2]
            i = np.repeat(np.arange(len(u)), times)
            within = np.arange(len(i)) - np.repeat(np.cumsum(times) - times, times)
            k1, k2 = within // n2[s2[i]], within % n2[s2[i]]
            anchors.append((x1[i] ^ p1[f1[s1[i]] + k1]) << CODE_LENGTH | (x2[i] ^ p2[f2[s2[i]] + k2]))
            index.append(i)
            home.append(np.full(len(i), not a and not b))
    return np.concatenate(anchors), np.concatenate(index), np.concatenate(home)


def replicate(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        for at in range(0, len(fps), 2048):
            part = np.ascontiguousarray(fps[at : at + 2048])
            anchor, i, home = anchors_of(part)
            yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(part[i]), pa.array(home)], ["anchor", "fp", "home"])


class _Meeting:
    """One anchor's comparison, fed in pieces, homes first. Memory follows the
    homes only; at most one link leaves for each member and home."""

    def __init__(self, anchor: int):
        self.anchor, self.homes, self.parent = anchor, np.empty(0, np.int64), []

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = i = self.parent[self.parent[i]]
        return i

    def feed(self, fps: np.ndarray, home: np.ndarray) -> list[tuple[int, int]]:
        links, first_new = [], len(self.homes)
        if home.any():
            self.homes = np.concatenate([self.homes, fps[home]])
            self.parent.extend(range(first_new, len(self.homes)))
        own = np.concatenate([np.arange(first_new, len(self.homes)), np.full(int((~home).sum()), -1)])
        rows = np.concatenate([fps[home], fps[~home]])
        step = max(1, (1 << 20) // max(1, len(self.homes)))
        for at in range(0, len(rows) if len(self.homes) else 0, step):
            near = np.bitwise_count((rows[at : at + step, None] ^ self.homes[None, :]).view(np.uint64)) <= THRESHOLD
            r, h = np.nonzero(near)
            for row, hs in zip(*_grouped(r, h), strict=True):
                roots = {self.find(int(x)) for x in hs}
                low = min(roots)
                for x in roots:
                    self.parent[x] = low
                if own[at + row] < 0:
                    links.append((int(rows[at + row]), int(self.homes[low])))
        return links

    def close(self) -> list[tuple[int, int]]:
        return [(int(self.homes[i]), int(self.homes[r])) for i in range(len(self.homes)) if (r := self.find(i)) != i]


def _grouped(r: np.ndarray, h: np.ndarray) -> tuple[list, list]:
    if not len(r):
        return [], []
    cut = np.flatnonzero(np.diff(r)) + 1
    return r[np.concatenate(([0], cut))].tolist(), np.split(h, cut)


def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of rows that come sorted by anchor, homes first."""
    meeting: _Meeting | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        anchor, fps, home = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        cut = np.concatenate(([0], np.flatnonzero(np.diff(anchor)) + 1))
        size = np.diff(np.concatenate((cut, [len(anchor)])))
        links: list[tuple[int, int]] = []
        begin = 0
        if meeting and meeting.anchor == anchor[0]:
            links += meeting.feed(fps[: size[0]], home[: size[0]])
            begin = 1
        if meeting and (begin < len(cut) or anchor[0] != meeting.anchor):
            links += meeting.close()
            meeting = None
        homes = np.add.reduceat(home.astype(np.int64), cut)
        inner = np.arange(begin, len(cut) - 1)
        inner = inner[(homes[inner] > 0) & (size[inner] > 1)]
        for g in inner[size[inner] > SMALL].tolist():
            one = _Meeting(int(anchor[cut[g]]))
            links += one.feed(fps[cut[g] : cut[g] + size[g]], home[cut[g] : cut[g] + size[g]]) + one.close()
        few = inner[size[inner] <= SMALL]
        times = homes[few] * size[few]
        g = np.repeat(few, times)
        within = np.arange(len(g)) - np.repeat(np.cumsum(times) - times, times)
        x, y = fps[cut[g] + within // size[g]], fps[cut[g] + within % size[g]]
        near = (x != y) & (np.bitwise_count((x ^ y).view(np.uint64)) <= THRESHOLD)
        a, b = x[near], y[near]
        if begin < len(cut):
            last = cut[-1]
            meeting = _Meeting(int(anchor[last]))
            links += meeting.feed(fps[last:], home[last:])
        if links:
            more = np.array(links, np.int64)
            a, b = np.concatenate((a, more[:, 0])), np.concatenate((b, more[:, 1]))
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
    if meeting and (links := meeting.close()):
        more = np.array(links, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(more[:, 0]), pa.array(more[:, 1])], ["a", "b"])


def midpoint_links(fps: DataFrame) -> DataFrame:
    """The same links for distinct fingerprints crowded around one anchor: two
    words differ in at most two bits exactly if some word differs from each in at
    most one. At most 65 rows share such a word, whatever the data."""
    flips = F.array(F.lit(0).cast("long"), *[F.lit((1 << b) - (1 << 64) if b == 63 else 1 << b).cast("long") for b in range(64)])
    at = fps.select("fp", F.explode(F.transform(flips, lambda m: F.col("fp").bitwiseXOR(m))).alias("mid"))
    least = at.groupBy("mid").agg(F.min("fp").alias("low"), F.count("*").alias("n")).where("n > 1")
    return at.join(least, "mid").where("fp != low").select(F.col("fp").alias("a"), F.col("low").alias("b"))


def links(fps: DataFrame, most_homes: int = MOST_HOMES) -> DataFrame:
    """Links among distinct fingerprints (column ``fp``) whose components are those
    of all pairs within the threshold."""
    spark = fps.sparkSession
    rows = map_arrow(fps, replicate, "anchor long, fp long, home boolean")
    crowded = stage(rows.where("home").groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > most_homes).select("anchor"), "crowded")
    n = crowded.count()
    more = None
    if n:
        # at most (fingerprints / most_homes) anchors; broadcast while that is small
        table = F.broadcast(crowded) if n <= 100_000 else crowded
        more = midpoint_links(rows.join(table, "anchor", "left_semi").select("fp").distinct())
        rows = rows.join(table, "anchor", "left_anti")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = map_arrow(rows.repartition(parts, "anchor").sortWithinPartitions("anchor", F.desc("home")), compare, "a long, b long")
    return met.unionAll(more) if more is not None else met


def near_duplicates(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id, text_hash, fp, component_id, root``: one row per row of ``docs``;
    text_hash tells rows of one id apart, root is the least fingerprint of the class.

    Equal fingerprints are one class, so copies never meet each other. Texts that
    are null or hold no word have fingerprint zero and are linked like any other.
    A row without doc_id takes part in links; a class made of such rows alone has
    a null component_id. Repeated rows repeat in the result; an empty table gives
    none.
    """
    own = stage(fingerprints(docs, text), "simhash")
    classes = own.groupBy("fp").agg(F.min("doc_id").alias("first"))
    tree = connected_components(links(classes.select("fp")), "a", "b")
    linked = classes.join(tree, classes.fp == tree.node, "left").select("fp", "first", F.coalesce("component", "fp").alias("root"))
    linked = stage(linked, "simhash-classes")
    least = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    named = linked.join(least, "root").select("fp", "component_id", "root")
    return own.join(named, "fp").select("doc_id", "text_hash", "fp", "component_id", "root")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op7_simhash": op7_simhash}
ORACLE_SQL: dict[str, str] = {}
