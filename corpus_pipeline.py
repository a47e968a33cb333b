"""A cleaning pipeline for training text: filters, near-duplicates, repeated
passages, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run`` writes
every stage's rows as a table in the shared folder and reads them again, so that a
lost executor never sends a job back behind the last table.

In every stage null and empty texts are texts without words, null ids stay null, rows
that repeat are rows of their own, texts of any length are read whole, an empty table
gives no rows, and further columns, whatever their names, pass through all stages but
the last.  What a stage does with such rows stands in its docstring.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from strataq.llm import bpe, jaccard, packing, quality, substrings, toxicity
from strataq.operators.groups import shared_folder
from strataq.sources.segment import delete


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go: those that score the threshold
    of their language or more (0.7 for a null or unknown one).  A text without words
    scores what an empty one scores, which is low.  Without labels of both kinds no row
    goes."""
    return toxicity.clean(docs, toxicity.fit(docs, _labels(spark, sf_dir)))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go: those that score under 0.5.  A
    text without words, or without any term that the labelled rows have, scores the
    share of good labels, and 0.5 where there are no labels: it stays if that is 0.5 or
    more."""
    return quality.good(docs, quality.fit(docs, _labels(spark, sf_dir)))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: of the rows of the smallest
    id the one whose text has the smallest hash.  Rows without words or with a null id
    stay."""
    return jaccard.representatives(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words that start in a document of a smaller id go from the texts.
    No row goes; texts of under 50 words, null texts and rows with a null id stay as
    they are; rows of one id are one document."""
    return substrings.cleaned(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of all texts, in pieces packed into sequences.  A null or empty text is a
    piece of the end id alone."""
    return packing.pack(docs, bpe.vocabulary(), keep_ids=True)


STAGES = [
    ("toxicity", toxicity_stage),
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("substrings", substring_stage),
    ("packing", packing_stage),
]

ORACLE_SQL = None  # trained classifiers can't be expressed; tests hold a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last stage's rows.  A stage's table goes when
    the next one's is written; the last one stays, for the result reads it."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            delete(spark, before)
        before = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
