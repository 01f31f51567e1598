"""The corpus pipeline: five stages over ``documents``, each written and reread.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and
returns the columns of documents; the last returns packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pixelarium.llm import lines, mixing, packing, simhash, toxicity
from pixelarium.llm.common import documents, hide_columns, release, stage

#: Documents scored at least this are rejected.
TOXIC = 0.7


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the lexicon scores 0.7 or more; null and empty texts stay."""
    lexicon = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored, = hide_columns(docs, "toxicity")
    return toxicity.score(docs, lexicon, name=scored).where(F.col(scored) < TOXIC).select(*_names(docs))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps each class of similar lines once; no document is dropped, and n_chars
    follows the text (null texts have none). Edge cases as in ``lines.deduplicate_lines``."""
    kept = lines.deduplicate_lines(docs)
    return kept.withColumn("n_chars", F.char_length("text").cast("long")).select(*_names(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class: that of smallest id, null ids last, then that
    of the least text hash; of rows that repeat id and text one stays."""
    found = simhash.near_duplicates(docs)
    own, of, copy = hide_columns(docs, "own", "of", "copy")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")
    first = found.groupBy("root").agg(F.min(order).alias("x")).select(F.col("x.doc_id").alias(own), F.col("x.text_hash").alias(of))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(own)) & (F.xxhash64(F.col("text").cast("string")) == F.col(of))
    copies = Window.partitionBy(own, of).orderBy(own)
    kept = docs.join(first, same).withColumn(copy, F.row_number().over(copies)).where(F.col(copy) == 1)
    return kept.select(*_names(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each time that the mix takes a document. Null sources are a source,
    null texts have no words; rows without an id share one fate."""
    taken, = hide_columns(docs, "copies")
    return mixing.mix_documents(docs).select(*_names(docs), F.explode(taken).alias(hide_columns(docs, "copy")[0])).select(*_names(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces in sequences of 2048 tokens; edge cases as in ``packing.pack_documents``."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Learned lexicons, MinHash classes and tokenizers are beyond SQL.
ORACLE_SQL = None


def _names(docs: DataFrame) -> list[str]:
    return [f"`{c}`" for c in docs.columns]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
        release(spark)
    return STAGES[-1][1](spark, docs, sf_dir)
