"""A small corpus with copies, near copies, shared passages and awkward rows."""

from __future__ import annotations

import random

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choices(["the", "on", "er", "ti", "ba", "lo", "mü", "é"], k=rng.randint(1, 3))) for _ in range(n))


def corpus(n: int = 120, seed: int = 1) -> list[tuple]:
    rng = random.Random(seed)
    passage = sentence(rng, 60)
    texts: list[str | None] = []
    for i in range(n):
        text = "\n".join(sentence(rng, rng.randint(5, 60)) for _ in range(rng.randint(1, 5)))
        if i % 7 == 3:
            text = f"{text} {passage} {sentence(rng, 8)}"
        if i % 9 == 4 and i:
            text = texts[i // 2] or text
        if i % 11 == 5 and texts[i - 1]:
            words = texts[i - 1].split(" ")
            words[len(words) // 2] = "changed"
            text = " ".join(words)
        texts.append(text)
    texts[2], texts[5], texts[6], texts[8] = None, "", "   \n\t ", "word"
    texts[10] = " ".join(["again"] * 90)
    texts[11] = "x" * 30_000
    texts[12] = sentence(rng, 6000)
    return [(i, t, "en", [None, "b", "a", "c"][i % 4], len(t or "")) for i, t in enumerate(texts)]


def frame(spark, rows=None, schema: str = COLUMNS):
    return spark.createDataFrame(corpus() if rows is None else rows, schema).repartition(3)


def saved(spark, tmp_path, rows=None, labels=None) -> str:
    frame(spark, rows).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels or [], "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)
