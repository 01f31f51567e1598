"""Secret scanning: fixed patterns, plus character Markov models.

Two first-order Markov models over characters, one of random strings and one of
ordinary identifiers and words, are trained: on what the fixed patterns find
(random), everything else of all documents (ordinary), and
seeded draws from the usual secret alphabets (random), so that a corpus without
secrets still trains a model. A token's log-likelihood ratio decides.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, map_arrow

ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # the same matches as runs of 32 and more
ASSIGN_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "markov")

SYMBOLS = string.ascii_letters + string.digits + "+/_-="
INDEX = {c: i for i, c in enumerate(SYMBOLS)}
START = len(SYMBOLS)
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")
SHORT_TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{3,}")
#: Log-likelihood ratio that outweighs the odds against a token being a secret.
PRIOR = math.log(1e6)
#: Share of a token's ratio that each character must carry on average.
PER_CHAR = 0.4
SECRET_ALPHABETS = (string.ascii_letters + string.digits, string.hexdigits[:16], string.ascii_letters + string.digits + "+/", string.ascii_letters + string.digits + "_-", string.ascii_uppercase + string.digits)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns' matches, ordered by start, then
    kind; code points, end exclusive."""
    found = []
    low = text.lower()
    if any(h in low for h in ASSIGN_HINTS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    found.sort()
    return found


def _pairs(token: str) -> Iterator[tuple[int, int]]:
    before = START
    for c in token:
        now = INDEX[c]
        yield before, now
        before = now


def random_counts(number: int = 4000, seed: int = 11) -> Counter:
    """Pairs of characters in seeded draws from the usual secret alphabets."""
    rng, out = random.Random(seed), Counter()
    for i in range(number):
        alphabet = SECRET_ALPHABETS[i % len(SECRET_ALPHABETS)]
        out.update(_pairs("".join(rng.choices(alphabet, k=rng.randint(16, 44)))))
    return out


def corpus_counts(docs: DataFrame) -> tuple[Counter, Counter]:
    """Pairs of characters (random, ordinary) in all documents. At most 2 x 69 x 69
    sums reach the driver."""
    chosen = docs.select(F.col("text").cast("string"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for value in batch.column(0):
                text = value.as_py() or ""
                spans = base_spans(text)
                for start, _, end in spans:
                    for m in SHORT_TOKEN.finditer(text[start:end].split("=")[-1].split(":")[-1]):
                        sums[0].update(_pairs(m[0]))
                at = 0
                for start, _, end in [*spans, (len(text), 0, len(text))]:
                    for m in SHORT_TOKEN.finditer(text, at, max(at, start)):
                        sums[1].update(_pairs(m[0]))
                    at = max(at, end)
        rows = [(k, a, b, n) for k in (0, 1) for (a, b), n in sums[k].items()]
        columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["kind", "a", "b", "n"])

    out: tuple[Counter, Counter] = (Counter(), Counter())
    for r in map_arrow(chosen, run, "kind int, a int, b int, n long").groupBy("kind", "a", "b").agg(F.sum("n").alias("n")).collect():
        out[r.kind][r.a, r.b] = r.n
    return out


def ratio_table(random_pairs: Counter, ordinary_pairs: Counter, smooth: float = 0.5) -> list[list[float]]:
    """Log-likelihood ratio, random over ordinary, of each character after each."""
    table = []
    for a in range(len(SYMBOLS) + 1):
        row_r = [random_pairs[a, b] + smooth for b in range(len(SYMBOLS))]
        row_o = [ordinary_pairs[a, b] + smooth for b in range(len(SYMBOLS))]
        shift = math.log(sum(row_o)) - math.log(sum(row_r))
        table.append([math.log(r) - math.log(o) + shift for r, o in zip(row_r, row_o, strict=True)])
    return table


def train(docs: DataFrame) -> list[list[float]]:
    found, ordinary = corpus_counts(docs)
    return ratio_table(random_counts() + found, ordinary)


def looks_random(token: str, table: list[list[float]]) -> bool:
    """Digits alone (numbers, cards) and capitalized words are ordinary by
    definition; the ratio decides on the rest."""
    if token.isdigit() or (token.isalpha() and token.istitle()):
        return False
    ratio = sum(table[a][b] for a, b in _pairs(token))
    return ratio > PRIOR and ratio > PER_CHAR * len(token)


def scan_text(text: str, table: list[list[float]]) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans); a model's span touches no base span."""
    base = base_spans(text)
    more, i, reach = [], 0, 0
    for m in TOKEN.finditer(text):
        while i < len(base) and base[i][0] < m.end():
            reach = max(reach, base[i][2])
            i += 1
        if reach <= m.start() and looks_random(m[0], table):
            more.append((m.start(), 3, m.end()))
    return base, sorted(base + more)


def spell(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, table: list[list[float]] | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_assign, n_access, n_hex, n_markov,
    base (spans of the fixed patterns) and spans (all), spelled kind:start:end.

    Null and empty texts hold no secret. Repeated rows repeat in the result, an
    empty table gives none; other columns of the table are not read.
    """
    ratios = table or train(docs)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column(1):
                base, spans = scan_text(value.as_py() or "", ratios)
                kinds = Counter(k for _, k, _ in spans)
                rows.append((*(kinds[k] for k in range(4)), spell(base), spell(spans)))
            types = [pa.int64()] * 4 + [pa.string()] * 2
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_assign", "n_access", "n_hex", "n_markov", "base", "spans"])

    return map_arrow(
        docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")),
        run,
        "doc_id long, n_assign long, n_access long, n_hex long, n_markov long, base string, spans string"
    )


def base_sha256(spelled: str) -> str:
    return hashlib.sha256(spelled.encode()).hexdigest()


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(documents(spark, sf_dir))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "n_markov", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")


QUERIES = {"op6_secrets": op6_secrets}
ORACLE_SQL: dict[str, str] = {}
