"""The corpus pipeline: quality rules, near-duplicates, repeated passages, benchmark passages, packing.

Each stage takes all rows that the one before it kept. Stages up to the last return the columns of
``documents``; ``n_chars`` follows the text. A document whose whole text is cut stays as an empty one.

Defined cases: a null or empty text has too few words and goes with the first stage; a null id is kept, and so are
rows that share an id with different texts; repeated rows are near-duplicates, of which one stays; other columns of
``documents``, whatever their names, reach the stage before the last unchanged; an empty ``documents`` gives an
empty plan, and an empty ``benchmark`` cuts nothing; texts of any length are read whole.
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from medialake.llm import decontamination, near_dedup, packing, quality, repeats
from medialake.llm.common import discard, settled, table
from medialake.llm.queries import vocabulary


def _measured(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).cast(docs.schema["n_chars"].dataType))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules, weighed by weak supervision, take for good."""
    return quality.filter_documents(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return near_dedup.drop_near_duplicates(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 200-byte strings that occur elsewhere."""
    return _measured(repeats.remove_repeats(docs))


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without benchmark passages; documents that are mostly benchmark go."""
    return _measured(decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packing plan of what is left, a row for each piece."""
    return packing.pack(docs, vocabulary())


STAGES = [
    ("quality", keep_quality),
    ("near-duplicates", drop_near_duplicates),
    ("repeats", cut_repeats),
    ("decontamination", cut_benchmark),
    ("packing", pack),
]

#: Label-model fitting, MinHash classes and tokenisation are not SQL; tests/llm/test_pipeline.py compares the stages with
#: brute force, except the label model's verdicts and the packing plan, which it takes from their operators.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packing plan of ``documents``. What a stage wrote is deleted when the next one has been written."""
    docs = table(spark, sf_dir, "documents")
    for turn, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, settled(lambda: stage(spark, docs, sf_dir), f"stage-{name}")
        if turn:
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
