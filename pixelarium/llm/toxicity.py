"""Toxicity by a weighted lexicon.

Texts are folded (case, accents, homoglyphs, digit substitutions) and matched
against a lexicon of word beginnings with an Aho-Corasick automaton. Each hit
counts with its entry's weight unless an exception phrase covers it; the sum, and
the sum by length of the text, give the score. Entries, weights, exception phrases
and calibration are learned from a bounded sample of labelled rows.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, map_arrow, stage

#: Labelled rows used for training, at most, chosen by a hash of doc_id.
TRAIN_ROWS = 20_000
#: Entries of the lexicon, at most.
MOST_ENTRIES = 2_000
PREFIXES = range(4, 13)
#: Twice the log-likelihood ratio that an entry's counts must reach.
EVIDENCE = 30.0

#: Look-alikes of Latin letters (fixed values).
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m",
    "н": "h", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u",
    "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g", "ł": "l", "ø": "o", "đ": "d", "ħ": "h", "ß": "ss", "æ": "ae", "œ": "oe",
}
#: Digits and signs written for letters (fixed values).
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "|": "l"}
#: Zero-width and soft characters that split words invisibly (fixed values).
INVISIBLE = "­​‌‍⁠﻿"


class _Fold(dict):
    """Folding of one character, worked out when first met."""

    def __missing__(self, point: int) -> str:
        c = chr(point)
        out = ""
        for x in unicodedata.normalize("NFKD", c):
            x = x.lower()
            x = DIGITS.get(x) or HOMOGLYPHS.get(x) or x
            out += "".join(y for y in x if not unicodedata.combining(y) and y not in INVISIBLE)
        if c not in INVISIBLE and not unicodedata.combining(c):
            out = out if out and all(y.isalnum() or y == "'" for y in out) else " "
        self[point] = out
        return out


_FOLD = _Fold()


def fold(text: str | None) -> str:
    """Folded words, each with one space before it."""
    words = (text or "").translate(_FOLD).split()
    return " " + " ".join(words) if words else ""


@dataclass
class Lexicon:
    """weights: entry (a folded word's beginning) to weight. exceptions: folded
    phrases of two words within which an entry doesn't count."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: set[str] = field(default_factory=set)
    bias: float = -4.0
    by_sum: float = 1.0
    by_rate: float = 0.5

    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for entry, weight in self.weights.items():
            a.add_word(" " + entry, (len(entry), weight))
        a.make_automaton()
        return a

    def hits(self, folded: str, automaton) -> Iterator[tuple[float, str, str, str]]:
        """(weight, word before, word, word after) of each hit."""
        for end, (size, weight) in automaton.iter(folded):
            start = end - size + 1
            stop = folded.find(" ", start)
            stop = len(folded) if stop < 0 else stop
            after = folded[stop + 1 : (folded.find(" ", stop + 1) + 1 or len(folded) + 1) - 1]
            yield weight, folded[folded.rfind(" ", 0, max(0, start - 1)) + 1 : max(0, start - 1)], folded[start:stop], after

    def features(self, folded: str, automaton) -> tuple[float, float]:
        if not self.weights:
            return 0.0, 0.0
        if self.exceptions:
            total = sum(w for w, a, x, b in self.hits(folded, automaton) if f"{a} {x}" not in self.exceptions and f"{x} {b}" not in self.exceptions)
        else:
            total = sum(w for _, (_, w) in automaton.iter(folded))
        words = folded.count(" ")
        return math.log1p(total), math.log1p(1000.0 * total / max(words, 20))

    def score(self, features: tuple[float, float]) -> float:
        z = self.bias + self.by_sum * features[0] + self.by_rate * features[1]
        return 1.0 / (1.0 + math.exp(-max(-60.0, min(60.0, z))))


def is_held_out(doc_id) -> F.Column:
    """Whether crc32 of a row's id mod 3 is 1; a null id has no remainder and is not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """``text, toxic`` of at most ``most`` labelled rows, by a hash of doc_id."""
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(~is_held_out(F.col("doc_id")))
    chosen = known.groupBy("doc_id").agg(F.max("toxic").alias("__toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    # at most ``most`` pairs of numbers
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(F.col("text").cast("string").alias("text"), F.col("__toxic").cast("int").alias("toxic"))


def _entry_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: tuple[Counter, Counter] = (Counter(), Counter())

    def flush():
        keys = list(seen[0].keys() | seen[1].keys())
        out = pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.string()), pa.array([seen[1][k] for k in keys], pa.int64()), pa.array([seen[0][k] for k in keys], pa.int64())], ["entry", "toxic", "clean"]
        )
        for c in seen:
            c.clear()
        return out

    for batch in batches:
        for text, toxic in zip(batch.column(0), batch.column(1), strict=True):
            entries = {w[:n] for w in set(fold(text.as_py()).split()) for n in PREFIXES if len(w) >= n}
            seen[1 if toxic.as_py() else 0].update(entries)
            if sum(map(len, seen)) > 300_000:
                yield flush()
    yield flush()


def _evidence(a: F.Column, n: float, b: F.Column, m: float) -> F.Column:
    """Twice the log-likelihood ratio of two rates, a of n against b of m."""
    rate = (a + b) / (n + m)
    part = lambda k, size: F.when(k > 0, k * F.log(k / (size * rate))).otherwise(0.0) + F.when(k < size, (size - k) * F.log((size - k) / (size * (1 - rate)))).otherwise(0.0)
    return 2 * (part(a, n) + part(b, m))


def learn(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> Lexicon:
    """Lexicon, exceptions and calibration from at most ``most`` labelled rows.

    Without labels of both kinds the lexicon is empty and every score is low.
    """
    rows = stage(training_rows(docs, labels, most), "toxic-train")
    totals = {bool(r.toxic): r.n for r in rows.groupBy((F.col("toxic") != 0).alias("toxic")).agg(F.count("*").alias("n")).collect()}
    n, m = totals.get(True, 0), totals.get(False, 0)
    if not n or not m:
        return Lexicon()
    counts = map_arrow(rows, _entry_counts, "entry string, toxic long, clean long").groupBy("entry").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    weight = F.log((F.col("t") + 0.5) / (n + 1.0)) - F.log((F.col("c") + 0.5) / (m + 1.0))
    strong = counts.where("t >= 3").withColumns({"weight": weight, "evidence": _evidence(F.col("t"), float(n), F.col("c"), float(m))})
    strong = strong.where((F.col("weight") >= 3.0) & (F.col("evidence") >= EVIDENCE))
    found = strong.orderBy(F.desc("evidence"), F.desc(F.length("entry")), "entry").limit(20 * MOST_ENTRIES).collect()
    weights: dict[str, float] = {}
    support: dict[str, int] = {}
    # Of nested beginnings that are about as common, the longest is kept.
    for r in sorted(found, key=lambda r: (-round(math.log(r.t) * 20), -len(r.entry), r.entry)):
        if len(weights) < MOST_ENTRIES and not any(r.entry.startswith(e) or e.startswith(r.entry) for e in weights):
            weights[r.entry], support[r.entry] = r.weight, r.t
    lexicon = Lexicon(weights)
    lexicon.exceptions = _exceptions(rows, lexicon)
    x, y = _training_features(rows, lexicon)
    _calibrate(lexicon, x, y)
    return lexicon


def _exceptions(rows: DataFrame, lexicon: Lexicon, most: int = 2_000) -> set[str]:
    """Phrases of an entry and its neighbour met in at least 3 clean texts and at
    least 10 times as often there as in toxic ones."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            out: list[tuple[str, int]] = []
            for text, toxic in zip(batch.column(0), batch.column(1), strict=True):
                phrases = {p for _, a, x, b in (lexicon.hits(fold(text.as_py()), automaton) if lexicon.weights else ()) for p in (f"{a} {x}", f"{x} {b}")}
                out += [(p, 1 if toxic.as_py() else 0) for p in phrases]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.string()), pa.array([t for _, t in out], pa.int32())], ["phrase", "toxic"])

    phrases = map_arrow(rows, run, "phrase string, toxic int").groupBy("phrase").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
    return {r.phrase for r in phrases.where("c >= 3 AND c >= 10 * t").orderBy(F.desc("c"), "phrase").limit(most).collect()}


def _feature_rows(lexicon: Lexicon):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            xs = [lexicon.features(fold(t.as_py()), automaton) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in xs], pa.float64()), pa.array([x[1] for x in xs], pa.float64()), batch.column(1)], ["a", "b", "toxic"])

    return run


def _training_features(rows: DataFrame, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    got = map_arrow(rows, _feature_rows(lexicon), "a double, b double, toxic int").collect()  # at most TRAIN_ROWS rows
    return np.array([[1.0, r.a, r.b] for r in got]), np.array([1.0 if r.toxic else 0.0 for r in got])


def _calibrate(lexicon: Lexicon, x: np.ndarray, y: np.ndarray, ridge: float = 0.05, steps: int = 40) -> None:
    """Logistic regression by Newton's method."""
    w = np.zeros(3)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -60, 60)))
        grad = x.T @ (p - y) + ridge * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(3)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    lexicon.bias, lexicon.by_sum, lexicon.by_rate = map(float, w)


def score(docs: DataFrame, lexicon: Lexicon, text: str = "text", name: str = "toxicity") -> DataFrame:
    """``docs`` with a column ``name`` (double, 0 to 1), replaced if there.

    Null and empty texts are scored as texts without hits. Rows are neither added
    nor dropped; an empty table gives no rows.
    """
    fields = [f for f in docs.schema.fields if f.name != name]
    shape = "struct<" + ",".join([*(f"`{f.name}`:{f.dataType.simpleString()}" for f in fields), f"`{name}`:double"]) + ">"
    at = [f.name for f in fields].index(text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            found = [lexicon.score(lexicon.features(fold(t.as_py()), automaton)) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], [*batch.schema.names, name])

    return map_arrow(docs.select(*[F.col(f"`{f.name}`") for f in fields]), run, shape)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    lexicon = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, lexicon).select(
        "doc_id", is_held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.7).cast("int").alias("predicted")
    )


QUERIES = {"op2_toxicity": op2_toxicity}
ORACLE_SQL: dict[str, str] = {}
