"""A training corpus from `documents`: filter, dedup, redact, pack.

Each stage takes (spark, docs, folder of the tables) and returns a DataFrame, which is written and
read again as the next stage's input. All but the last keep the columns of the documents.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import jaccard, lines, packing, pii, quality
from millrace.llm._store import release, spill, tracked


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _follows(stage: Stage) -> Stage:
    """A stage after the first: the one before is written by now, and the tables it was made from go."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, docs)
        with tracked():
            return stage(spark, docs, sf_dir)

    return run


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars follows the text."""
    return docs.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised rules reject go."""
    with tracked():
        return quality.keep(docs)


@_follows
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated lines, alone or in runs, go, and documents of which no line is left."""
    out = lines.dedup_lines(docs, min_lines=1)
    some = (F.col("_l_removed") == 0) | (F.col("_l_removed") < F.col("_l_lines"))
    return _counted(out.filter(some).select(*[F.col(f"`{c}`") for c in docs.columns]))


@_follows
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five-word shingles, similarity of 0.8 or more."""
    return jaccard.one_of_each(docs, n=5, numerator=80, denominator=100)


@_follows
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind."""
    return _counted(pii.redact(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 1,024 tokens."""
    release(spark, docs)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), length=1024, end_id=0)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("packing", packing_stage),
]

#: Estimation, boosted trees and the tokenizer are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, over the whole of `documents`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs, _ = spill(stage(spark, docs, sf_dir), name, keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)
