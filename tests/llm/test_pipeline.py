"""The pipeline on a small corpus."""

import pytest

from corpus import COLUMNS, corpus, saved

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_in_turn(spark, tmp_path):
    folder = saved(spark, tmp_path, corpus(60), [(i, 1, 0) for i in range(20)])
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash_near_dedup", "mixing", "packing"]
    kept = {}
    for name, step in corpus_pipeline.STAGES:
        out = step(spark, docs, folder)
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = [r.doc_id for r in docs.select("doc_id").collect()]
        if name != "packing":
            assert docs.columns == names
    assert sorted(kept["toxicity"]) == sorted(kept["line_dedup"]) == list(range(60))
    assert len(set(kept["simhash_near_dedup"])) == len(kept["simhash_near_dedup"]) < 60
    assert max(kept["mixing"].count(i) for i in kept["mixing"]) <= 2
    assert set(kept["packing"]) == set(kept["mixing"])


def test_run_of_an_empty_table(spark, tmp_path):
    assert corpus_pipeline.run(spark, saved(spark, tmp_path, [])).count() == 0


ODD = "doc_id long, text string, lang string, source string, n_chars long, copies int, Copy string, own int, d string, toxicity int, rank long, n_lines long"


def odd_rows():
    """Nulls in every column, empty texts, ties, repeated rows, names that clash."""
    rest = (1, "x", 2, "y", 3, 4, 5)
    lines = "a line that is here more than once and is long enough\nand another line of this text, which is its own"
    return [
        (1, lines, "en", "a", 9, *rest), (1, lines, "en", "a", 9, *rest), (1, "a second text under the same id, with other words in it", "en", "a", 9, *rest),
        (None, lines, "en", None, 9, *rest), (None, None, None, None, None, *[None] * 7), (2, "", "en", "b", 0, *rest),
        (3, None, "en", "b", None, *rest), (4, "word " * 5000, "en", "a", 25000, *rest), (None, "a text without an id that nobody else has", "de", "b", 5, *rest),
    ]


def test_stages_on_odd_rows(spark, tmp_path):
    df = spark.createDataFrame(odd_rows(), ODD).repartition(3)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert {(r.copies, r.Copy, r.own, r.d, r.toxicity, r.rank, r.n_lines) for r in rows} <= {(1, "x", 2, "y", 3, 4, 5), (None,) * 7}, name
        texts = sorted((r.doc_id or 0, r.text or "") for r in rows)
        if name in ("toxicity", "line_dedup"):
            assert len(rows) == 9
        if name == "simhash_near_dedup":
            # the empty fingerprint is one class, and the copy without an id is no longer there
            assert [t[0] for t in texts] == [0, 1, 1, 2, 4]
    pieces = corpus_pipeline.pack_sequences(spark, docs, str(tmp_path)).collect()
    assert len({(r.doc_id, r.piece) for r in pieces}) >= 6 and sum(r.length for r in pieces) > 5000
    empty = docs.limit(0)
    assert all(step(spark, empty, str(tmp_path)).count() == 0 for _, step in corpus_pipeline.STAGES)


def test_near_duplicates_of_one_id_leave(spark):
    """Two texts share an id; the one that repeats another document goes."""
    words = [f"w{i}" for i in range(60)]
    first, other = " ".join(words), " ".join(reversed(words))
    rows = [(3, first, "", "", 0), (5, first, "", "", 0), (5, other, "", "", 0), (7, other, "", "", 0), (7, other, "", "", 0)]
    kept = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, COLUMNS), "").collect()
    assert sorted((r.doc_id, r.text) for r in kept) == [(3, first), (5, other)]
