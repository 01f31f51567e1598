"""Fuzzy line deduplication by MinHash, DataFrame operations only.

Distinct lines get a MinHash signature over character shingles: 18 minima of one
shingle hash under 18 masks, gathered by a plain aggregate. Six bands of three
values bring lines of similarity 0.8 together with a probability of 0.98. In bands of
up to ``SMALL`` lines every pair is a candidate; in larger ones every line is one with
eight pivots, and lines that are then not yet joined meet by a prefix of their shingles,
rarest first, which misses no similar pair. Candidates whose signatures agree too little
to be similar go at once, the others are verified by the exact Jaccard similarity of
their shingle sets, unless a path of verified pairs joins them already. Verified pairs
are joined by distributed union-find, and each component keeps its first line.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import connected_components, documents, drop_table, hide_columns, release, stage, unstage, write_bucketed

SHINGLE = 8
BANDS, ROWS = 6, 3
SIMILARITY = 0.8
BLANKS = " \t\n\u000b\f\r"
#: Shingles that are hashed in one row.
BLOCK = 32
#: Equal signature values that a pair needs for its texts to be compared. A pair of
#: similarity 0.8 has fewer with a probability of 0.004.
AGREE = 10
#: Lines of a band up to which all its pairs are compared, and pivots of larger ones.
SMALL, PIVOTS = 32, 8
#: Groups of shingles whose numbers order those of lines of crowded bands.
GROUPS = 1 << 14
#: Words of 64 parity bits by which lines of crowded bands are told apart.
PARITIES = 16
NULL_ID = (1 << 63) - 1
#: Of tables of hashes, whose values hardly repeat.
HASHES = {"flat": True, "compression": "snappy", "parquet.enable.dictionary": "false"}
#: Bits of a line's place that its locator holds; the others name the document.
PLACE = 20
#: 32-bit masks: the golden ratio's multiples, spread over the hash's range.
MASKS = [((i + 1) * 0x9E3779B9 & 0xFFFFFFFF) - (1 << 31) for i in range(BANDS * ROWS)]


def document_key() -> Column:
    """A hash of a row's id and text: rows that repeat both have one key."""
    return F.xxhash64(F.col("doc_id").cast("long"), "text")


def _encoded(line: Column) -> Column:
    """Four bytes for each character, so that a shingle is cut out of a line at no
    cost of its length."""
    return F.encode(line, "UTF-32")


def in_units(lines: DataFrame) -> DataFrame:
    """``line`` becomes ``chars``, two bytes for each character: half of what a shingle's
    hash reads. Of a character beyond 16 bits these are the lower ones, so two shingles
    that differ have one hash only if their characters differ by 65,536 and multiples;
    signatures, which are compared by chance anyway, use that, sets do not."""
    wide = lines.withColumn("wide", F.encode("line", "UTF-16BE"))
    lower = F.unhex(F.regexp_replace(F.hex(_encoded(F.col("line"))), ".{4}(.{4})", "$1"))
    chars = F.when(F.octet_length("wide") == 2 * F.char_length("line"), F.col("wide")).otherwise(lower)
    return wide.select(*[c for c in lines.columns if c != "line"], chars.alias("chars"))


def _blocks(chars: DataFrame, width: int) -> DataFrame:
    """Rows with a line's ``chars`` of ``width`` bytes become one row for each ``BLOCK`` shingles,
    with their 32-bit hashes ``h0`` and up; ``begins`` is 1 in a line's first row. A line
    shorter than a shingle is one shingle. The last block repeats the last shingle, which
    neither minima nor sets notice. Written out like this, no shingle is a row."""
    size = width * SHINGLE
    last = (F.greatest(F.octet_length("chars"), F.lit(size)) - (size - 1)).alias("last")
    at = chars.select("*", last).select("*", F.explode(F.sequence(F.lit(1), F.col("last"), F.lit(width * BLOCK))).alias("i"))
    hashes = [F.hash(F.substring("chars", F.least(F.col("i") + width * j, F.col("last")), F.lit(size))).alias(f"h{j}") for j in range(BLOCK)]
    others = [c for c in chars.columns if c != "chars"]
    return at.select(*others, F.when(F.col("i") == 1, 1).otherwise(0).alias("begins"), *hashes)


def split_lines(docs: DataFrame) -> DataFrame:
    """``d, t, line_no, line, a, b``: the lines that are not blank, with two hashes
    that together name the text; d is the doc_id, null ids last, t the row's key."""
    own = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("d")
    # keys first: made beside the split, they would be made of the whole text for each line
    keyed = docs.select(own, document_key().alias("t"), "text")
    lines = keyed.select("d", "t", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).where(F.ltrim("line", F.lit(BLANKS)) != "")
    return lines.withColumns({"a": F.xxhash64("line"), "b": F.xxhash64(F.lit(7), "line")})


def signatures(lines: DataFrame) -> DataFrame:
    """``a, b, loc, times, sig``: one row per distinct line, with a locator of a
    place that has it, the number of its places and its signature. Every aggregate is
    a minimum or a sum of numbers and is combined in the task that reads the text."""
    locator = F.expr(f"shiftleft(shiftrightunsigned(t, {PLACE + 1}), {PLACE}) | (line_no & {(1 << PLACE) - 1})")
    hashed = _blocks(in_units(lines.select("a", "b", locator.alias("loc"), "line")), 2)
    mins = [F.min(F.least(*[F.col(f"h{j}").bitwiseXOR(F.lit(m)) for j in range(BLOCK)])).alias(f"m{i}") for i, m in enumerate(MASKS)]
    each = hashed.groupBy("a", "b").agg(F.min("loc").alias("loc"), F.sum("begins").alias("times"), *mins)
    return each.select("a", "b", "loc", "times", F.array(*[f"m{i}" for i in range(len(MASKS))]).alias("sig"))


def bands(sig: Column) -> Column:
    """A hash for each band of a signature, its place included."""
    return F.array(*[F.xxhash64(F.lit(i), *[sig[i * ROWS + j] for j in range(ROWS)]) for i in range(BANDS)])


def line_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``id, line`` of wanted lines (id, a, b, loc): documents are opened by their
    key, and only wanted lines leave, each read at its place."""
    needs = wanted.groupBy(F.shiftrightunsigned("loc", PLACE).alias("k")).agg(
        F.collect_list(F.struct("id", "a", "b", F.expr(f"CAST(loc & {(1 << PLACE) - 1} AS INT)").alias("r"))).alias("needs")
    )
    opened = docs.select(F.shiftrightunsigned(document_key(), PLACE + 1).alias("k"), "text").join(needs.hint("shuffle_hash"), "k")
    # read twice below, so that a text is split on its own, before its lines are picked
    opened = opened.select("needs", F.split("text", "\n").alias("parts"))

    def read(need: Column) -> Column:
        # the locator holds the lower bits of a place, so later ones may be meant
        places = F.sequence(need["r"], F.greatest(F.size("parts") - 1, need["r"]), F.lit(1 << PLACE))
        return F.struct(need["id"].alias("id"), need["a"].alias("a"), need["b"].alias("b"), F.transform(places, lambda i: F.get("parts", i)).alias("lines"))

    found = opened.select(F.explode(F.transform("needs", read)).alias("x")).select("x.id", "x.a", "x.b", F.explode("x.lines").alias("line"))
    named = found.where((F.col("a") == F.xxhash64("line")) & (F.col("b") == F.xxhash64(F.lit(7), "line")))
    # rows that repeat id and text each hold the line
    return named.select("id", "line").dropDuplicates(["id"])


def shingle_sets(lines: DataFrame) -> DataFrame:
    """``id, set``: the distinct 32-bit hashes of the shingles of lines (id, chars)."""
    blocks = _blocks(lines, 4).select("id", F.array(*[f"h{j}" for j in range(BLOCK)]).alias("block"))
    return blocks.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("block"))).alias("set"))


class ShingleSets:
    """The shingle sets of wanted lines (id, a, b, loc): each is made once, however
    many pairs ask for it, and lies bucketed by id."""

    def __init__(self, docs: DataFrame, wanted: DataFrame):
        self.spark = docs.sparkSession
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        texts = line_texts(docs, wanted).repartition(parts, "id")
        sets = shingle_sets(texts.select("id", _encoded(F.col("line")).alias("chars")))
        self.table, self.path = write_bucketed(sets, ["id"], "sets", **HASHES)
        release(self.spark)

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def drop(self) -> None:
        drop_table(self.spark, self.table, self.path)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of distinct pairs (id, p) those whose lines are similar by the exact Jaccard
    similarity of their shingle ``sets`` (id, set), staged. In whole numbers: of n shingles in both
    sets together, 4 n / 9 at least are shared: those of one that it doesn't have alone."""
    y = sets.select(F.col("id").alias("p"), F.col("set").alias("y"))
    read = pairs.select("id", "p").join(sets.select("id", F.col("set").alias("x")), "id").join(y, "p")
    least = 4 * (F.size("x") + F.size("y"))
    shared = F.size("x") - F.size(F.array_except("x", "y"))
    similar = (9 * F.least(F.size("x"), F.size("y")) >= least) & (9 * shared >= least)
    return stage(read.where(similar).select("id", "p"), "links")


def candidates(shared: DataFrame, lines: DataFrame) -> DataFrame:
    """Distinct pairs (id, p) of lines that share a band and agree enough, staged;
    ``star`` marks those with the least line of a band."""
    signed = stage(lines.select("id", "sig").join(shared.hint("shuffle_hash"), "id"), "signed", **HASHES)
    def agree(x: Column, y: Column) -> Column:
        return reduce(add, [(x[i] == y[i]).cast("int") for i in range(len(MASKS))]) >= AGREE

    # both sides need the same columns of the same rows, which are dealt once for both
    x = signed.where(F.col("n") <= SMALL).select("band", "low", "id", "sig")
    both = (F.col("x.band") == F.col("y.band")) & (F.col("x.low") == F.col("y.low")) & (F.col("x.id") < F.col("y.id"))
    few = x.alias("x").join(x.alias("y"), both & agree(F.col("x.sig"), F.col("y.sig")))
    few = few.select(F.col("x.id").alias("id"), F.col("y.id").alias("p"), F.col("x.low").alias("low"))
    large = signed.where(F.col("n") > SMALL)
    pivots = large.groupBy("band", F.pmod(F.xxhash64("id"), F.lit(PIVOTS)).alias("part")).agg(F.min("id").alias("p"))
    pivots = pivots.select("band", "p").join(large.select("band", F.col("id").alias("p"), F.col("sig").alias("other")), ["band", "p"])
    many = large.alias("x").join(pivots.alias("y"), (F.col("x.band") == F.col("y.band")) & (F.col("id") != F.col("p")) & agree(F.col("sig"), F.col("other")))
    met = [part.select(F.least("id", "p").alias("id"), F.greatest("id", "p").alias("p"), (F.least("id", "p") == F.col("low")).alias("star")) for part in (few, many)]
    pairs = stage(met[0].unionAll(met[1]).groupBy("id", "p").agg(F.max("star").alias("star")), "likely")
    unstage(signed)
    return pairs


def two_hops(links: DataFrame) -> DataFrame:
    """``node, component``: the least line within two links of each. Lines that agree
    in it are joined; many that don't may be, too."""
    both = links.unionAll(links.select(F.col("p").alias("id"), F.col("id").alias("p")))
    near = both.groupBy("id").agg(F.min("p").alias("p")).select("id", F.least("id", "p").alias("m"))
    other = near.select(F.col("id").alias("m"), F.col("m").alias("far"))
    return stage(near.join(other, "m").select(F.col("id").alias("node"), F.least("m", "far").alias("component")), "hops")


def with_roots(pairs: DataFrame, tree: DataFrame) -> DataFrame:
    """Pairs (id, p) with the components c and pc of their lines."""
    one = tree.select(F.col("node").alias("id"), F.col("component").alias("c"))
    other = tree.select(F.col("node").alias("p"), F.col("component").alias("pc"))
    both = pairs.join(one, "id", "left").join(other, "p", "left")
    return both.withColumns({"c": F.coalesce("c", "id"), "pc": F.coalesce("pc", "p")})


def joined(tree: DataFrame, links: DataFrame) -> DataFrame:
    """The components ``node, component`` of a tree with links (id, p) added; only
    components that the links touch are worked on."""
    if not links.limit(1).count():
        return tree
    more = connected_components(with_roots(links, tree).select("c", "pc"), "c", "pc")
    old = tree.join(more.select(F.col("node").alias("component"), F.col("component").alias("root")), "component", "left")
    return stage(old.select("node", F.coalesce("root", "component").alias("component")).unionAll(more), "tree")


def similar_lines(lines: DataFrame, docs: DataFrame) -> DataFrame:
    """``node, component``: the components of two and more similar lines among
    ``lines`` (id, a, b, loc, sig), whose texts are in ``docs``, for every line but
    the least of each.

    Pairs with the least line of a band are verified first. Of the others, only those
    of lines that no path joins yet are read. ``crowded`` finds what bands of more than
    ``SMALL`` lines have left. The documents are opened once.
    """
    spark = docs.sparkSession
    # dealt once for both: nearly all bands have one line, so that counts before would not shrink them
    rows = lines.select("id", F.explode(bands(F.col("sig"))).alias("band")).repartition("band")
    counted = rows.groupBy("band").agg(F.count("*").alias("n"), F.min("id").alias("low")).where("n > 1")
    shared = stage(rows.join(counted.hint("shuffle_hash"), "band"), "bands", **HASHES)
    release(spark)
    pairs = candidates(shared, lines)
    large = stage(shared.where(F.col("n") > SMALL).select("band", "id"), "large")
    unstage(shared)
    release(spark)
    ends = pairs.select("id").unionAll(pairs.select("p")).unionAll(large.select("id")).distinct()
    sets = ShingleSets(docs, lines.select("id", "a", "b", "loc").join(ends.hint("shuffle_hash"), "id"))
    first = verified(pairs.where("star"), sets.read())
    rest = verified(with_roots(pairs.where("NOT star"), two_hops(first)).where("c != pc"), sets.read())
    tree = connected_components(first.unionAll(rest), "id", "p")
    unstage(pairs)
    tree = joined(tree, crowded(large, tree, sets.read()))
    unstage(large)
    sets.drop()
    release(spark)
    return tree


def crowded(large: DataFrame, tree: DataFrame, sets: DataFrame) -> DataFrame:
    """Distinct pairs (id, p) of similar lines of large bands (band, id) that are of
    different components, staged. None is missed.

    Bands whose lines are all of one component have nothing left. A line of n shingles
    shares 0.8 n of them at least with any similar line, so if both order their shingles
    alike (those of rare groups first), they share one of the first n - 0.8 n + 1. A group
    is a ``GROUPS``-th of all hashes, so the driver holds that many counts and the order
    needs no join; frequent shingles make theirs frequent. Lines that share
    such a shingle are paired if they are of two components and nothing rules it out:
    their sizes, the places of the shingle, after which too few may be left, or the bits
    in which their parities differ, which are never more than the shingles that only one
    of them has. The lines of a shingle's commonest component are never paired with each
    other, so a family of copies costs its size only.
    """
    slack = 1e-6
    named = large.join(tree, F.col("id") == F.col("node"), "left").select("band", "id", F.coalesce("component", "id").alias("c"))
    open_bands = named.groupBy("band").agg(F.min("c").alias("x"), F.max("c").alias("y")).where("x != y").select("band")
    known = stage(named.join(open_bands, "band", "left_semi").select("id", "c").distinct(), "crowd")
    every = stage(known.join(sets, "id").select("id", "c", "set"), "crowd-sets", **HASHES)
    shingles = every.select("id", F.explode("set").alias("h"))
    # at most GROUPS numbers
    often = {r.g: r.n for r in shingles.groupBy(F.pmod("h", F.lit(GROUPS)).alias("g")).agg(F.count("*").alias("n")).collect()}
    weights = F.split(F.lit(",".join(str(often.get(g, 0)) for g in range(GROUPS))), ",").cast("array<bigint>")
    bit = F.expr("shiftleft(1L, shiftrightunsigned(h, 8) & 63)")
    words = [f"b{i}" for i in range(PARITIES)]
    parity = shingles.groupBy("id").agg(*[F.bit_xor(F.when(F.pmod("h", F.lit(PARITIES)) == i, bit).otherwise(F.lit(0).cast("long"))).alias(w) for i, w in enumerate(words)])
    # weight and hash in one number, as numbers are sorted faster than structs
    # never null, or else they would be sorted as objects
    ordered = F.sort_array(F.transform("set", lambda h: F.coalesce(F.shiftleft(F.get(weights, F.pmod(h, F.lit(GROUPS))), 32).bitwiseOR(h.cast("long") + (1 << 31)), F.lit(0).cast("long"))))
    sized = every.select("id", "c", F.size("set").alias("n"), ordered.alias("hs"))
    length = F.col("n") - F.ceil(SIMILARITY * F.col("n") - slack).cast("int") + 1
    heads = stage(sized.select("id", "c", "n", F.posexplode(F.slice("hs", 1, length)).alias("at", "e")).select("id", "c", "n", "at", F.expr("CAST((e & 4294967295) - 2147483648 AS INT)").alias("h")), "heads")
    split = stage(shared_heads(heads).join(parity, "id"), "split-heads")
    x = split.where("c != main")
    y = split.select("h", F.col("id").alias("p"), F.col("c").alias("pc"), F.col("n").alias("pn"), F.col("at").alias("pat"), *[F.col(w).alias(f"p{w}") for w in words])
    differ = reduce(add, [F.bit_count(F.col(w).bitwiseXOR(F.col(f"p{w}"))) for w in words])
    size = F.col("n") + F.col("pn")
    met = (
        (x.h == y.h) & (F.col("c") != F.col("pc")) & ((F.col("pc") == F.col("main")) | (F.col("id") < F.col("p")))
        & (F.least("n", "pn") >= SIMILARITY * F.greatest("n", "pn") - slack)
        & (F.least(F.col("n") - F.col("at"), F.col("pn") - F.col("pat")) >= SIMILARITY / (1 + SIMILARITY) * size - slack)
        & (differ <= (1 - SIMILARITY) / (1 + SIMILARITY) * size + slack)
    )
    pairs = stage(x.join(y, met).select(F.least("id", "p").alias("id"), F.greatest("id", "p").alias("p")).distinct(), "crowded")
    # the sets of these lines alone are read, not all that there are
    links = verified(pairs, every.select("id", "set"))
    for used in (known, every, heads, split, pairs):
        unstage(used)
    return links


def shared_heads(heads: DataFrame) -> DataFrame:
    """Rows of ``heads`` (h, c and others) whose shingle h has lines of two components
    at least, with the commonest, ``main``. Numbered where they lie: no row is joined."""
    each = Window.partitionBy("h")
    counted = heads.repartition("h").withColumn("m", F.count("*").over(Window.partitionBy("h", "c")))
    seen = counted.withColumns({"main": F.max(F.struct("m", "c")).over(each)["c"], "low": F.min("c").over(each), "high": F.max("c").over(each)})
    return seen.where("low != high").drop("m", "low", "high")


def line_classes(docs: DataFrame) -> DataFrame:
    """``a, b, root``, staged: the class of each distinct line that has more than one
    place or a similar line; no other line can repeat one."""
    distinct = stage(signatures(split_lines(docs)).withColumn("id", F.monotonically_increasing_id()), "lines", **HASHES)
    release(docs.sparkSession)
    tree = similar_lines(distinct, docs)
    roots = tree.select(F.col("component").alias("node"), F.col("component").alias("root")).distinct()
    named = distinct.select("id", "a", "b", "times").join(tree.unionAll(roots).hint("shuffle_hash"), F.col("id") == F.col("node"), "left")
    linked = stage(named.where("times > 1 OR node IS NOT NULL").select("a", "b", F.coalesce("component", "id").alias("root")), "line-classes")
    unstage(distinct)
    release(docs.sparkSession)
    return linked


def deduplicate_lines(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, any other columns) with every line removed that is
    not the first of its class, in the order of doc_id, text (by a hash of it, where
    rows share an id) and place in the text.

    Adds ``n_lines`` and ``n_removed`` (longs; underscores are put before a name that
    the table has already). Blank lines are never removed; null texts stay null, empty
    ones empty, and a text may become empty. No document is dropped. Null ids come last.
    Rows that repeat an id and its text are one document, which each of them shows. An
    empty table gives no rows.
    """
    number, removed, d, t, parts, gone = hide_columns(docs, "n_lines", "n_removed", "d", "t", "parts", "gone")
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    classes = line_classes(texts)
    found = split_lines(texts).select("d", "t", "line_no", "a", "b").join(classes.hint("shuffle_hash"), ["a", "b"])
    places = stage(found.select("root", F.struct("d", "t", "line_no").alias("at")), "line-places")
    unstage(classes)
    release(docs.sparkSession)
    # written out, so that a class that holds many rows can be divided in the join
    firsts = stage(places.groupBy("root").agg(F.min("at").alias("first")), "line-first")
    later = places.join(firsts, "root").where("at != first").select("at.*")
    lists = later.groupBy(F.col("d").alias(d), F.col("t").alias(t)).agg(F.collect_set("line_no").alias(gone))
    whole = F.col("text").cast("string")
    keys = {d: F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)), t: document_key(), "text": whole}
    rest = docs.withColumns(keys).join(lists.hint("shuffle_hash"), [d, t], "left")
    # only texts that lose lines are split; read twice below, so on its own
    rest = rest.withColumn(parts, F.when(F.col(gone).isNotNull(), F.split("text", "\n")))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), gone), lambda i: F.get(parts, i))
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    breaks = F.octet_length("text") - F.octet_length(F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    lines = F.when(F.col(gone).isNull(), breaks + 1).otherwise(F.size(parts))
    counts = {number: F.coalesce(lines, F.lit(0)).cast("long"), removed: F.coalesce(F.size(gone), F.lit(0)).cast("long")}
    return rest.withColumns(counts | {"text": text}).select(*[f"`{c}`" for c in docs.columns], number, removed)


def op3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = deduplicate_lines(documents(spark, sf_dir).select("doc_id", "text"))
    text = F.coalesce("text", F.lit(""))
    return kept.select("doc_id", "n_lines", "n_removed", F.char_length(text).cast("long").alias("n_chars_kept"), F.sha2(text.cast("binary"), 256).alias("kept_sha256"))


QUERIES = {"op3_lines": op3_lines}
ORACLE_SQL: dict[str, str] = {}
