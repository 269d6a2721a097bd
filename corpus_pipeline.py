"""The corpus pipeline: language ID, quality, near duplicates, decontamination, mixing.

Each stage takes ``(spark, docs, sf_dir)``; what it returns is written as Parquet and read again as
the next one's ``docs``.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.llm import decontamination, jaccard_join, language_id, mixing, quality
from gridspark.llm.shared import materialize

ORACLE_SQL = None


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without letters (null and empty ones too) or further from all languages than texts of their length are.

    Ties go to the first language by name; repeated rows stay or go together, whatever columns there are.
    """
    model = language_id.learn(docs)
    return language_id.keep_identified(docs, model, language_id.least_cosines(docs, model))


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents more likely bad than good; at even odds they stay.

    Null, empty and wordless texts go; nulls are sources and languages of their own; repeated rows
    stay or go together, whatever columns there are.
    """
    return quality.keep_good(docs, _table(spark, sf_dir, "labels"))


def join_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near duplicates (five words, similarity 0.8): that of the smallest id, of ties the first.

    Rows repeated whole and rows of null ids are rows of groups like others; null and empty texts
    are in no group and stay.  Columns of any names are kept.
    """
    return jaccard_join.keep_one(docs, k=5, num=8, den=10)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes documents that hold a benchmark item, of any length.

    Null, empty and wordless texts hold none and stay; repeated rows stay or go together, whatever
    columns there are.
    """
    return decontamination.drop_leaks(docs, _table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often each remaining row is taken: id, source, size, its source's size and target, copies, words taken.

    Null and empty texts are taken never; a null source is one of its own; repeated rows are rounded
    apart.  An empty table has an empty plan.
    """
    plan = mixing.plan(docs)
    return plan.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


STAGES = [
    ("language_id", identify_language),
    ("quality", classify_quality),
    ("jaccard_join", join_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
