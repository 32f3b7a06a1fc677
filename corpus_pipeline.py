"""Quality rules, language ID, near-duplicate removal and packing, one after another over ``documents``.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. The first three return rows
of ``docs`` unchanged, all columns; the last one returns the packing plan, a row for each document that is left.
SQL can't express the stages (ORACLE_SQL is None); the tests hold the run against a plain version of all four.

Rows: null and empty texts go in the first stage; rows with a null id are judged by their text; repeated rows are
judged alike and one stays; extra columns, whatever their names, are kept to the third stage. Each stage says the rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomnote import session
from loomnote.llm import langid, packing, quality, queries, simhash


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the calibrated classifier, trained on labelled rows of ``docs``, rejects (probability under 0.5).

    Null, empty and blank texts go; null ids and labels train nothing; very long texts are scored whole; equal texts share
    their fate. Without labels of two classes all texts with a word stay if most labelled ones are good. Empty in, empty out.
    """
    session.ship(spark)
    return quality.filter_quality(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts without a known main language, or whose main language has under 0.3 of the words.

    Null and empty texts, and those without letters, go; null ids stay; null labels train nothing; very long texts are
    labelled whole; of languages with equal shares the first by name is the main one. Empty in, empty out.
    """
    session.ship(spark)
    return langid.filter_language(docs, langid.train(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates: the first by id and hash of the text, null ids first.

    Null texts and those without words are in no group and stay; of repeated rows one stays; very long texts are compared
    whole. Empty in, empty out.
    """
    session.ship(spark)
    return simhash.drop_duplicates(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Give each document its length bucket and token-budget batch.

    A null or empty text has length 0; a text beyond the budget is a batch of its own; repeated rows and null ids are
    packed each; ties go by hash, then id. Empty in, empty out.
    """
    session.ship(spark)
    return packing.pack(docs, queries.ranks_path())


STAGES = [("quality_rules", quality_rules), ("language_id", language_id), ("near_duplicates", near_duplicates), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each one's rows are written as Parquet and read again by the next."""
    docs = session.spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = session.scratch(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{base}/{k}-{name}")
            docs = spark.read.parquet(f"{base}/{k}-{name}")
    return docs
