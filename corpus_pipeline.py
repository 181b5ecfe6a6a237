"""Cleaning of the documents in stages; counts as part of the text operators (voxelspark.llm).

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept. All but the last hand on the
columns they get, whatever their names. An empty table stays empty. Nulls, empty texts and repeated rows: the
quality rules reject texts without words, so null and empty ones go; of equal texts the near duplicates keep
the row with the smallest id, rows that repeat that id stay together, and a null id always stays; very long texts
are taken whole. What else a stage does in such cases its operator's docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelspark.llm import decontaminate, minhash, pieces, quality, suffix_dedup
from voxelspark.llm.common import discard, table, tables, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality.keep_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays."""
    return minhash.keep_first(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 200 bytes or more that stand elsewhere too are cut from the texts; n_chars follows."""
    return suffix_dedup.remove_repeats(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts are encoded to sampled pieces and decoded again: the digest of each document."""
    return pieces.round_trip(docs)


STAGES = [
    ("quality", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontamination", decontamination),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents; what a stage returns is written before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    before = set(tables())
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
        # only the stage's result is read from here on
        discard(spark, [t for t in tables()[:-1] if t not in before])
    return STAGES[-1][1](spark, docs, sf_dir)


#: Components of near duplicates by minimum hashing, suffix arrays and sampled pieces are beyond SQL; tests use plain versions.
ORACLE_SQL = None
