"""Substring, line and SimHash deduplication against brute force."""

import hashlib
import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

from corpus import corpus, frame, saved
from pixelarium.llm import lines, simhash, substrings
from pixelarium.llm.common import connected_components, stage


def brute_windows(rows):
    """Per row: (n_words, n_removed, sha of the words kept)."""
    seen, out = {}, []
    ordered = sorted(rows, key=lambda r: r[0])
    for d, text, *_ in ordered:
        w = (text or "").encode().split()
        for i in range(len(w) - 19):
            seen.setdefault(tuple(w[i : i + 20]), (d, i))
    for d, text, *_ in ordered:
        w = (text or "").encode().split()
        gone = set()
        for i in range(len(w) - 19):
            if seen[tuple(w[i : i + 20])] < (d, i):
                gone.update(range(i, i + 20))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("batches", [1, 4])
def test_substrings_match_brute_force(spark, batches):
    rows = corpus()
    got = substrings.deduplicate_substrings(frame(spark, rows), batches=batches).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute_windows(rows)
    assert any(r.n_removed for r in got)
    for r in got:
        if r.kept is not None:
            assert hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256


def test_substrings_compact_many_runs(spark):
    rng = random.Random(4)
    common = " ".join(f"w{i}" for i in range(200))
    rows = [(i, f"a{i} " + " ".join(common.split()[rng.randint(0, 60) :][: rng.randint(15, 90)]) + f" z{i}", "en", "s", 1) for i in range(60)]
    got = substrings.deduplicate_substrings(frame(spark, rows), batches=7).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute_windows(rows)


def test_substrings_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(substrings, "max", lambda *a: 3, raising=False)
    rows = [(i, " ".join(f"w{j}" for j in range(40)) + f" tail{i}", "en", "s", 1) for i in range(30)]
    got = substrings.deduplicate_substrings(frame(spark, rows), batches=2).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute_windows(rows)


def test_substrings_edges(spark):
    assert substrings.deduplicate_substrings(frame(spark, [])).collect() == []
    text = " ".join(f"w{i}" for i in range(30))
    got = substrings.deduplicate_substrings(frame(spark, [(None, text, "", "", 0), (1, text, "", "", 0), (7, None, "", "", 0), (7, None, "", "", 0)])).collect()
    assert sorted(((r.doc_id is None, r.doc_id or 0), r.n_removed) for r in got) == [((False, 1), 0), ((False, 7), 0), ((False, 7), 0), ((True, 0), 30)]


def test_substring_index_outlives_the_call(spark, tmp_path):
    """Three calls, each over a reopened folder, equal one call over all."""
    rows = corpus(90)
    df, folder = frame(spark, rows), f"file://{tmp_path}/index"
    found = []
    for low, high in ((0, 30), (30, 61), (61, 90)):
        part = df.where((F.col("doc_id") >= low) & (F.col("doc_id") < high))
        index = substrings.SubstringIndex(spark, folder)
        found += index.add(part, df.where(F.col("doc_id") < low)).collect()
        for table, *_ in index.anchors.runs + index.windows.runs:
            spark.sql(f"DROP TABLE {table}")  # as in a new session, whose catalogue is empty
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in found) == brute_windows(rows)
    assert len(substrings.SubstringIndex(spark, folder).anchors.runs) == 1
    with pytest.raises(ValueError, match="above"):
        substrings.SubstringIndex(spark, folder).add(df.where("doc_id = 89"), df)
    substrings.SubstringIndex(spark, folder).drop()


def test_substrings_of_rows_without_ids(spark):
    rng = random.Random(3)
    shared = " ".join(f"w{i}" for i in range(30))
    rows = [(None, f"{i} {shared} tail{i} " + " ".join(rng.choices("abcdefgh", k=5)), "", "", 0) for i in range(40)]
    got = substrings.deduplicate_substrings(frame(spark, rows)).collect()
    assert {r.doc_id for r in got} == {None} and sorted(r.n_removed for r in got) == [0] + [30] * 39


@pytest.mark.parametrize("size", [1, 7, 8, 9, 16, 17, 40])
def test_word_hashes_depend_on_words_alone(size):
    a, b = b"q" * size, b"q" * (size - 1) + b"r"
    h = substrings.word_hashes(b"\t" + a + b"  " + b + b"\n" + a + b" x")
    assert len(h) == 4 and h[0] == h[2] and h[0] != h[1]
    assert substrings.word_hashes(b"").size == 0 and substrings.word_hashes(b" \n ").size == 0
    assert substrings.word_hashes(a)[0] == h[0]


def brute_lines(rows):
    found = {}
    for d, text, *_ in sorted(rows, key=lambda r: r[0]):
        for i, line in enumerate((text or "").split("\n")):
            if re.search(r"\S", line):
                found.setdefault(line, (d, i))
    names = list(found)
    sets = [{x[i : i + lines.SHINGLE] for i in range(max(1, len(x) - lines.SHINGLE + 1))} for x in names]
    parent = list(range(len(names)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(names)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    first = {}
    for i, x in enumerate(names):
        first[find(i)] = min(first.get(find(i), (1 << 60, 0)), found[x])
    at = {x: first[find(i)] for i, x in enumerate(names)}
    return {d: "\n".join(x for i, x in enumerate(text.split("\n")) if not re.search(r"\S", x) or at[x] == (d, i)) for d, text, *_ in rows if text is not None}


def test_lines_match_brute_force(spark):
    rows = corpus(80)
    got = {r.doc_id: r.text for r in lines.deduplicate_lines(frame(spark, rows)).collect()}
    want = brute_lines(rows)
    assert got.pop(2) is None and got.keys() == want.keys()
    assert sum(got[d] != want[d] for d in want) <= 1  # bands have a recall of 0.98 for pairs at the threshold


def test_lines_keep_columns_and_blanks(spark):
    rows = [(1, "one line of some length here\n\n  \nanother line that is different", 5), (2, "one line of some length here\n", 6), (None, None, 7), (3, "", 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_lines int")
    got = {r.doc_id: r for r in lines.deduplicate_lines(df).collect()}
    assert got[1].text == rows[0][1] and got[2].text == "" and got[2].n_removed == 1
    assert got[None].text is None and got[3].text == "" and got[3]._n_lines == 1 and got[3].n_lines == 8
    assert lines.deduplicate_lines(df.limit(0)).count() == 0


def hot_family(pairs: int, shared: int, own: int, edit: int) -> list[str]:
    """2 x pairs lines with one long passage in common; each second one differs from
    the line before it by an edit, and from all others by far more."""
    rng = random.Random(9)
    text = lambda letters, k: "".join(rng.choices(letters, k=k))
    common, out = text("abcdefghijklmnopqrstuvwxyz ", shared), []
    for _ in range(pairs):
        mine = text("ABCDEFGHIJKLMNOPQRSTUVWXYZ", own)
        out += [common + mine, common + mine[: own - edit] + text("0123456789", edit)]
    return out


def similarity(x: str, y: str) -> float:
    x, y = ({t[i : i + lines.SHINGLE] for i in range(len(t) - lines.SHINGLE + 1)} for t in (x, y))
    return len(x & y) / len(x | y)


@pytest.mark.parametrize("shared", [330, 400])
def test_lines_recall_in_hot_bands(spark, shared):
    """All lines meet in the same bands; only pairs at 0.8 to 0.85 are similar."""
    texts = hot_family(400, shared, 100, 38 + shared // 100)
    likeness = [similarity(texts[i], texts[i + 1]) for i in range(0, 800, 2)]
    assert min(likeness) >= 0.8 and max(likeness) < 0.85 and 0.55 < similarity(texts[0], texts[2]) < 0.7
    rows = [(i, t, "", "", 0) for i, t in enumerate(texts)]
    got = {r.doc_id: r.n_removed for r in lines.deduplicate_lines(frame(spark, rows)).collect()}
    assert not any(got[i] for i in range(0, 800, 2))
    assert sum(got[i] for i in range(1, 800, 2)) >= 0.97 * 400


def test_lines_recall_of_pairs(spark):
    """Pairs at 0.8 to 0.85 that share nothing with other lines, short ones included."""
    rng, texts = random.Random(5), []
    while len(texts) < 600:
        n = rng.choice([25, 60, 200, 600])
        base = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=n)).strip() + "."
        for edit in range(1, n):
            other = base[: len(base) - edit] + "0" * edit
            if similarity(base, other) < 0.85:
                break
        if similarity(base, other) >= 0.8:
            texts += [base, other]
    rows = [(i, t, "", "", 0) for i, t in enumerate(texts)]
    got = {r.doc_id: r.n_removed for r in lines.deduplicate_lines(frame(spark, rows)).collect()}
    assert not any(got[i] for i in range(0, 600, 2))
    assert sum(got[i] for i in range(1, 600, 2)) >= 0.95 * 300


def test_lines_of_repeated_rows_and_ids(spark):
    """Null ids come last, repeated rows show the same, rows of one id are apart."""
    x, y, z = "the first line of a text that is long", "quite another line of some other text", "and the third of these unlike lines!"
    rows = [(None, f"{x}\n{z}", 1, "a"), (None, f"{x}\n{z}", 2, "b"), (4, f"{y}\n{x}", 3, "c"), (4, f"{y}\n{x}", 3, "c"), (5, f"{y}\n{y}\n", 4, "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, d int, Gone string").repartition(3)
    got = sorted((r.doc_id or 99, r.text, r.n_lines, r.n_removed, r.d, r.Gone) for r in lines.deduplicate_lines(df).collect())
    assert got == [(4, f"{y}\n{x}", 2, 0, 3, "c")] * 2 + [(5, "", 3, 2, 4, "d"), (99, z, 2, 1, 1, "a"), (99, z, 2, 1, 2, "b")]


def test_line_shingles_of_long_lines(spark):
    text = "".join(random.Random(2).choices("abcé 😀", k=9000))
    df = spark.createDataFrame([(0, text), (1, "short"), (2, "abcdefgh")], "id long, line string").select("id", F.encode("line", "UTF-32").alias("chars"))
    got = [set(r.set) for r in lines.shingle_sets(df).orderBy("id").collect()]
    for own, line in zip(got, (text, "short", "abcdefgh"), strict=True):
        cut = {line[i : i + 8] for i in range(max(1, len(line) - 7))}
        want = spark.createDataFrame([(x,) for x in cut], "s string").select(F.hash(F.encode("s", "UTF-32")).alias("h")).collect()
        assert own == {r.h for r in want}


def test_line_signatures_read_two_bytes_a_character(spark):
    """Of a character beyond 16 bits the lower ones; similar lines with such are found."""
    rng = random.Random(3)
    plain, odd = ("".join(rng.choices(letters, k=300)) for letters in ("abcdé ", "abc 😀😁🎉𐍈é"))
    df = spark.createDataFrame([(0, plain), (1, odd), (2, "x")], "id long, line string")
    got = {r.id: bytes(r.chars) for r in lines.in_units(df).collect()}
    assert got == {i: b"".join((ord(c) & 0xFFFF).to_bytes(2, "big") for c in t) for i, t in enumerate((plain, odd, "x"))}
    rows = [(i, t, "", "", 0) for i, t in enumerate((odd, odd[:-3] + "zzz", odd[::-1]))]
    assert [r.n_removed for r in lines.deduplicate_lines(frame(spark, rows)).orderBy("doc_id").collect()] == [0, 1, 0]


def test_line_heads_shared_by_components_are_not_joined(spark):
    """A row for each line and shingle is made by no join, whose rows would grow with a family."""
    rng = random.Random(7)
    rows = [(i, rng.choice([1, 1, 1, 2, 3]), rng.randint(0, 40)) for i in range(150)] + [(200 + i, 9, 50) for i in range(20)]
    got = lines.shared_heads(spark.createDataFrame(rows, "id long, c long, h int"))
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    count = Counter((h, c) for _, c, h in rows)
    want = {(i, c, h, max((n, k) for (g, k), n in count.items() if g == h)[1]) for i, c, h in rows if len({k for g, k in count if g == h}) > 1}
    assert want and {(r.id, r.c, r.h, r.main) for r in got.collect()} == want


def test_lines_are_counted_whether_or_not_they_leave(spark):
    line = "a line that is long enough to be here twice"
    rows = [(1, f"{line}\n\n", "", "", 0), (2, f"é\n{line}\n\n{line}\n", "", "", 0), (3, "\n\n", "", "", 0), (4, "", "", "", 0), (5, None, "", "", 0)]
    got = lines.deduplicate_lines(frame(spark, rows)).orderBy("doc_id").collect()
    assert [(r.n_lines, r.n_removed, r.text) for r in got] == [(3, 0, f"{line}\n\n"), (5, 2, "é\n\n"), (3, 0, "\n\n"), (1, 0, ""), (0, 0, None)]


def test_line_keys_are_made_once_for_each_text(spark):
    """A key is a hash of the whole text: made for each line, its cost is the square of the text's."""
    plan = lines.split_lines(frame(spark, [(1, "a\nb", "", "", 0)]))._jdf.queryExecution().optimizedPlan().toString()
    generate = plan[plan.index("Generate") :]
    assert "xxhash64(cast(doc_id" in generate or "xxhash64(doc_id" in generate
    carried = plan[: plan.index("Generate")]
    assert "xxhash64(doc_id" not in carried and "text" not in carried


def test_numbers_of_staged_arrays_have_two_levels(spark, tmp_path):
    """What is staged flat comes back as it was, and the session's setting too."""
    key = "spark.sql.parquet.writeLegacyFormat"
    before = spark.conf.get(key)
    df = spark.range(5).select("id", F.expr("sequence(0, CAST(id AS INT))").alias("x"), F.expr("array(IF(id > 2, id, NULL))").alias("y"), F.expr("slice(array(1), 2, 1)").alias("z"))
    paths = {}
    for flat in (False, True):
        staged = stage(df, "test-flat", flat=flat)
        assert sorted(staged.collect()) == sorted(df.collect())
        paths[flat] = next(Path(staged._staged_at.removeprefix("file:")).glob("*.parquet"))
    names = {flat: pq.ParquetFile(path).schema.column(1).path for flat, path in paths.items()}
    assert names == {False: "x.list.element", True: "x.array"} and spark.conf.get(key) == before


def test_line_pairs_of_crowds_are_verified_by_their_own_sets(spark):
    """What comes back is similar, and was found without the sets of other lines."""
    rng = random.Random(4)
    near, far = (sorted(rng.sample(range(-(1 << 30), 1 << 30), 40)) for _ in range(2))
    rows = [(1, near), (2, near[:-1] + [7]), (3, far), (4, far[:20] + near[:20])]
    sets = spark.createDataFrame(rows, "id long, set array<int>")
    large = spark.createDataFrame([(7, i) for i, _ in rows], "band long, id long")
    tree = spark.createDataFrame([], "node long, component long")
    links = lines.crowded(large, tree, sets)
    assert [tuple(r) for r in links.select("id", "p").collect()] == [(1, 2)]


def brute_simhash(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_bits():
    for _, text, *_ in corpus():
        assert simhash.simhash(text) == brute_simhash(text)


def brute_components(fps):
    ids = sorted(fps)
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in ids:
        for j in ids:
            if j < i and bin(fps[i] ^ fps[j]).count("1") <= 2:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("most", [2, 4096])
def test_simhash_links_are_exact(spark, most):
    """Chains, dense balls and far points, by either way of comparing."""
    rng = random.Random(6)
    fps = set()
    for _ in range(25):
        x = rng.getrandbits(64)
        for _ in range(12):
            fps.add(x)
            for _ in range(rng.randint(1, 4)):
                x ^= 1 << rng.randint(0, 63)
    signed = np.array(sorted(fps), np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(x,) for x in signed], "fp long").repartition(3)
    tree = {r.node: r.component for r in connected_components(simhash.links(df, most), "a", "b").collect()}
    got = {x: tree.get(x, x) for x in signed}
    want = brute_components({x: x & (1 << 64) - 1 for x in signed})
    classes = lambda m: {frozenset(k for k in m if m[k] == v) for v in set(m.values())}
    assert classes(got) == classes(want)


def test_golay_anchors_cover():
    fps = np.random.default_rng(1).integers(-(1 << 63), 1 << 63, 200, dtype=np.int64)
    anchor, index, home = simhash.anchors_of(fps)
    assert np.array_equal(np.sort(index[home]), np.arange(200))
    own = dict(zip(index[home].tolist(), anchor[home].tolist(), strict=True))
    there = {}
    for a, i in zip(anchor.tolist(), index.tolist(), strict=True):
        there.setdefault(i, set()).add(a)
    for i, x in enumerate(fps[:40].tolist()):
        for b in ((0, 1), (0, 40), (22, 23), (5, 63), (62, 63)):
            y = np.array([(x ^ (1 << b[0]) ^ (1 << b[1])) & (1 << 64) - 1], np.uint64).view(np.int64)
            assert own[i] in set(simhash.anchors_of(y)[0].tolist())


def test_simhash_query_and_edges(spark, tmp_path):
    rows = corpus()
    rows += [(None, rows[0][1], "", "", 0), (0, rows[0][1], "", "", 0)]
    got = simhash.op7_simhash(spark, saved(spark, tmp_path, rows)).collect()
    assert len(got) == len(rows)
    fps = {r.doc_id: int(r.fingerprint, 16) for r in got if r.doc_id is not None}
    want = brute_components(fps)
    assert all(r.component_id == want[r.doc_id] for r in got if r.doc_id is not None)
    assert {r.component_id for r in got if r.doc_id is None} == {want[0]}
    empty = {r.doc_id: r for r in got}
    assert empty[2].fingerprint == "0" * 16 and empty[5].component_id == empty[6].component_id == 2
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


def test_components(spark):
    rng = random.Random(8)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5), (None, 7)]
    df = spark.createDataFrame(edges, "a long, b long")
    parent = {}

    def find(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for a, b in edges:
        if a is not None:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    want = {i: find(i) for i in parent if find(i) != i}
    assert {r.node: r.component for r in connected_components(df, "a", "b").collect()} == want
    assert connected_components(df.limit(0), "a", "b").count() == 0




def test_lines_large_band_around_a_pivot(spark):
    """Lines similar to others of a crowded band, but not to its pivots, are found."""
    rng = random.Random(4)
    shared = "".join(rng.choices("abcdefgh", k=150))
    texts = []
    for _ in range(60):
        own = shared + "".join(rng.choices("ijklmnop", k=26))
        texts += [own, own[:-14] + "".join(rng.choices("qrstuvwx", k=14))]
    rng.shuffle(texts)
    docs = frame(spark, [(i, x, "", "", 0) for i, x in enumerate(texts)])
    number = {r.t: r.d for r in lines.split_lines(docs).collect()}
    distinct = lines.signatures(lines.split_lines(docs)).withColumn("id", F.monotonically_increasing_id())
    distinct = stage(distinct, "test-lines")
    named = distinct.join(lines.split_lines(docs).select("a", "b", "t"), ["a", "b"])
    number = {r.id: number[r.t] for r in named.collect()}
    crowd = {}
    for r in distinct.select("id", F.explode(lines.bands(F.col("sig"))).alias("band")).collect():
        crowd.setdefault(r.band, set()).add(number[r.id])
    tree = lines.similar_lines(distinct, docs).collect()
    root = {number[r.node]: r.component for r in tree} | {number[r.component]: r.component for r in tree}
    sets = [{x[i : i + lines.SHINGLE] for i in range(len(x) - lines.SHINGLE + 1)} for x in texts]
    alike = lambda x, y: len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y])
    pairs = {(x, y) for b in crowd.values() if len(b) > lines.SMALL for x in b for y in b if x < y and alike(x, y)}
    assert len(pairs) > 10
    assert all(root.get(x, -1) == root.get(y, -2) for x, y in pairs)
