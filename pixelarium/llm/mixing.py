"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources they belong
to). A small network routes each pattern's words to the sources' quotas: the
k-th copy of a pattern costs more than the one before (convex repetition costs),
so words are repeated only where fresh ones don't suffice. The flow is then cut
into ranges of a seeded hash, which pick whole documents without sorting them.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, documents, hide_columns, stage

HASH_BITS, DIGIT_BITS = 48, 8
#: Offsets looked for in one query, each with 256 sums at most; more take more queries.
ASKED = 2000
NULL_SOURCE = "~"


def word_count(text) -> F.Column:
    """Number of words by the contract's word class; null texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sizes: dict[str, int], weights: dict[str, float], total: float, cap: float) -> dict[str, float]:
    """Shares of ``total`` by weight, none above ``cap`` times its source's size;
    what a cap cuts off is shared again among the others."""
    fixed: dict[str, float] = {}
    while len(fixed) < len(sizes):
        rest = total - sum(fixed.values())
        mass = sum(weights[s] for s in sizes if s not in fixed)
        share = {s: rest * weights[s] / mass for s in sizes if s not in fixed}
        above = {s: cap * sizes[s] for s, x in share.items() if x > cap * sizes[s]}
        if not above:
            return fixed | share
        fixed |= above
    return fixed


def min_cost_flow(supply: dict[tuple, int], quotas: dict[str, int], max_copies: int) -> dict[tuple, dict[str, int]]:
    """Words each pattern sends to each of its sources.

    Successive shortest augmenting paths with potentials. The arc for copy k of a
    pattern holds its size and costs k, sources hold their quotas; no source gets
    more than its quota, and as much of the quotas as possible is met at the least
    total cost. The network has one node per pattern and source, whatever the
    number of documents.
    """
    names = ["<in>", "<out>", *supply, *quotas]
    index = {x: i for i, x in enumerate(names)}
    graph: list[list[int]] = [[] for _ in names]
    head: list[int] = []
    room: list[int] = []
    cost: list[int] = []

    def arc(a: int, b: int, most: int, price: int) -> int:
        for x, y, r, c in ((a, b, most, price), (b, a, 0, -price)):
            graph[x].append(len(head))
            head.append(y)
            room.append(r)
            cost.append(c)
        return len(head) - 2

    routes = {}
    for pattern, words in supply.items():
        for copy in range(max_copies):
            arc(0, index[pattern], words, copy)
        for source in pattern:
            if source in quotas:
                routes[pattern, source] = arc(index[pattern], index[source], words * max_copies, 0)
    for source, quota in quotas.items():
        arc(index[source], 1, quota, 0)

    potential = [0] * len(names)
    while True:
        far: list[float] = [float("inf")] * len(names)
        came = [-1] * len(names)
        far[0], queue = 0, [(0, 0)]
        while queue:
            d, x = heapq.heappop(queue)
            if d > far[x]:
                continue
            for e in graph[x]:
                if room[e] and (nd := d + cost[e] + potential[x] - potential[head[e]]) < far[head[e]]:
                    far[head[e]], came[head[e]] = nd, e
                    heapq.heappush(queue, (nd, head[e]))
        if came[1] < 0:
            break
        for i, d in enumerate(far):
            if d < float("inf"):
                potential[i] += d
        path, x = [], 1
        while x:
            path.append(came[x])
            x = head[came[x] ^ 1]
        step = min(room[e] for e in path)
        for e in path:
            room[e] -= step
            room[e ^ 1] += step
    out: dict[tuple, dict[str, int]] = {p: {} for p in supply}
    for (pattern, source), e in routes.items():
        if room[e ^ 1]:
            out[pattern][source] = room[e ^ 1]
    return out


def route(supply: dict[tuple, int], quotas: dict[str, int], max_copies: int, max_patterns: int) -> dict[tuple, dict[str, int]]:
    """The least-cost flow, by the network only for patterns that share a source
    with others: a source's only pattern, if it has no other source, sends all that
    its quota takes."""
    uses: dict[str, int] = {}
    for pattern in supply:
        for source in pattern:
            uses[source] = uses.get(source, 0) + 1
    alone = {p for p in supply if len(p) == 1 and uses[p[0]] == 1}
    rest = {p: words for p, words in supply.items() if p not in alone}
    if len(rest) > max_patterns:
        raise ValueError(f"more than {max_patterns} membership patterns that share sources")
    shared = {s for p in rest for s in p}
    routed = min_cost_flow(rest, {s: q for s, q in quotas.items() if s in shared}, max_copies)
    sent = {p: min(quotas.get(p[0], 0), supply[p] * max_copies) for p in alone}
    return {p: ({p[0]: sent[p]} if sent[p] else {}) if p in alone else routed[p] for p in supply}


def _cuts(drawn: DataFrame, wanted: dict[str, set[int]], sizes: dict[str, int]) -> dict[tuple[str, int], int]:
    """For each pattern and offset, the hash below which its documents hold about
    that many words: a radix search over sums, one byte of the hash a round, that
    sends at most 256 sums per offset to the driver in each."""
    spark = drawn.sparkSession
    found = {(p, o): (0 if o <= 0 else 1 << HASH_BITS) for p, os in wanted.items() for o in os if o <= 0 or o >= sizes[p]}
    open_ = {(p, o): (0, o) for p, os in wanted.items() for o in os if (p, o) not in found}
    last: dict = {}
    for done in range(0, HASH_BITS, DIGIT_BITS):
        if not open_:
            break
        every = sorted({(p, prefix) for (p, _), (prefix, _) in open_.items()})
        digits = drawn.withColumns(
            {
                "prefix": F.shiftright("h", HASH_BITS - done),
                "digit": F.shiftright("h", HASH_BITS - done - DIGIT_BITS).bitwiseAND(F.lit((1 << DIGIT_BITS) - 1)),
            }
        )
        sums: dict = {}
        for at in range(0, len(every), ASKED):
            ask = F.broadcast(spark.createDataFrame(every[at : at + ASKED], "pattern string, prefix long"))
            for r in digits.join(ask, ["pattern", "prefix"]).groupBy("pattern", "prefix", "digit").agg(F.sum("size").alias("s")).collect():
                sums.setdefault((r.pattern, r.prefix), []).append((r.digit, r.s))
        for at, (prefix, rest) in open_.items():
            for digit, s in sorted(sums[at[0], prefix]):
                if rest < s:
                    break
                rest -= s
            open_[at] = ((prefix << DIGIT_BITS) | digit, rest)
            last[at] = s
    return found | {at: prefix + (2 * rest >= last[at]) for at, (prefix, rest) in open_.items()}


def mix(
    df: DataFrame,
    *,
    members: str,
    size: str,
    key: str = "doc_id",
    quotas: Callable[[dict[str, int], int], dict[str, float]],
    max_copies: int = 2,
    seed: int = 7,
    max_patterns: int = 2000,
) -> DataFrame:
    """``df`` plus ``copies``: one struct (copy, source) per time that a document
    is taken, an empty array where it is not. Underscores are put before the name
    if the table has a column of it.

    ``members`` is an array of source names; nulls in it are a source of their own
    that sorts last, a null or empty array belongs to none and is never taken.
    ``quotas`` maps the sources' sizes (and the size of all documents) to words
    wanted. Documents are drawn whole by a hash of seed and key: reruns agree, rows
    that repeat a key share its fate, and each range misses its offset by half a
    document at most. More than ``max_patterns`` distinct patterns are refused,
    as the network is solved on the driver. Empty tables give no rows.
    """
    named = F.array_sort(F.array_distinct(F.transform(members, lambda x: F.coalesce(F.concat(F.lit("="), x.cast("string")), F.lit(NULL_SOURCE)))))
    added, mark, hashed, spans = hide_columns(df, "copies", "pattern", "h", "ranges")
    tagged = df.withColumns(
        {mark: F.coalesce(F.to_json(named), F.lit("[]")), hashed: F.xxhash64(F.lit(seed), F.col(key)).bitwiseAND(F.lit((1 << HASH_BITS) - 1))}
    )
    drawn = stage(tagged.select(F.col(mark).alias("pattern"), F.col(size).cast("long").alias("size"), F.col(hashed).alias("h")), "mix")
    rows = drawn.groupBy("pattern").agg(F.sum("size").alias("s")).collect()  # one row per pattern
    labels = {tuple(json.loads(r.pattern)): r.pattern for r in rows}
    label = labels.__getitem__
    supply = {tuple(json.loads(r.pattern)): r.s or 0 for r in rows if r.pattern != "[]"}
    source_sizes: dict[str, int] = {}
    for pattern, s in supply.items():
        for source in pattern:
            source_sizes[source] = source_sizes.get(source, 0) + s
    plain = lambda s: None if s == NULL_SOURCE else s[1:]
    wanted = quotas(source_sizes, sum(r.s or 0 for r in rows))
    flow = route(supply, {s: round(q) for s, q in sorted(wanted.items())}, max_copies, max_patterns)

    ranges: dict[str, list] = {}
    for pattern, sent in flow.items():
        at, whole = 0, supply[pattern]
        for source, words in sorted(sent.items()):
            end = at + words
            while at < end:
                copy = at // whole
                upto = min(end, (copy + 1) * whole)
                ranges.setdefault(label(pattern), []).append((copy, at - copy * whole, upto - copy * whole, source))
                at = upto
    sizes = {label(p): s for p, s in supply.items()}
    cut = _cuts(drawn, {p: {x for r in rs for x in r[1:3]} for p, rs in ranges.items()}, sizes)
    plan = [
        (p, [(copy, cut[p, lo], cut[p, hi], plain(source)) for copy, lo, hi, source in ranges.get(p, [])])
        for p in (label(t) for t in supply)
    ]
    shape = f"{mark} string, {spans} array<struct<copy:int,lo:long,hi:long,source:string>>"
    # one row per pattern
    table = F.broadcast(df.sparkSession.createDataFrame(plan, shape))
    hit = F.filter(spans, lambda r: (r.lo <= F.col(hashed)) & (F.col(hashed) < r.hi))
    copies = F.transform(hit, lambda r: F.struct(r.copy.alias("copy"), r.source.alias("source")))
    none = F.array().cast("array<struct<copy:int,source:string>>")
    return tagged.join(table, mark, "left").withColumn(added, F.coalesce(copies, none)).drop(mark, hashed, spans)


def cyclic_quotas(cycle=(3, 1, 2), share: float = 1.5, cap: float = 2.0):
    """Weights that repeat over the sources by code point (null last), sharing
    ``share`` of all words, no source above ``cap`` times its own size."""

    def quotas(sizes: dict[str, int], total: int) -> dict[str, float]:
        order = sorted(sizes, key=lambda s: (s == NULL_SOURCE, s))
        return water_fill(sizes, {s: cycle[i % len(cycle)] for i, s in enumerate(order)}, share * total, cap)

    return quotas


def mix_documents(docs: DataFrame, seed: int = 7) -> DataFrame:
    """``docs`` plus ``mix_size`` and ``copies`` (named by ``hide_columns``), mixed by
    its ``source`` column. Edge cases as in :func:`mix`; null texts have size 0."""
    size, members = hide_columns(docs, "mix_size", "members")
    sized = docs.withColumns({size: word_count("text"), members: F.array("source")})
    return mix(sized, members=members, size=size, quotas=cyclic_quotas(), seed=seed).drop(members)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Takes of all documents. Null sources are a source of their own, null texts have
    size 0, rows without an id share one fate, an empty table gives no rows. The
    driver holds one number per source."""
    docs = documents(spark, sf_dir).select("doc_id", "source", "text")
    sized = stage(docs.select("doc_id", "source", word_count("text").alias("size"), F.array("source").alias("members")), "sizes")
    quotas = cyclic_quotas()
    per = sized.groupBy("source").agg(F.sum("size").alias("s")).collect()
    name = lambda s: NULL_SOURCE if s is None else f"={s}"
    sizes = {name(r.source): r.s for r in per}
    targets = quotas(sizes, sum(sizes.values()))
    table = spark.createDataFrame([(r.source, r.s, targets[name(r.source)]) for r in per], "src string, source_size long, target double")
    mixed = mix(sized, members="members", size="size", quotas=quotas)
    return mixed.join(F.broadcast(table), F.col("source").eqNullSafe(F.col("src"))).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.size("copies")).cast("long").alias("taken")
    )


QUERIES = {"op10_mixing": op10_mixing}
ORACLE_SQL: dict[str, str] = {}
