"""From raw documents to a training mix: STAGES in order, each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import decontamination, language_id, mixing, ngram_join, substring_dedup
from vellum.session import stage_table


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn from the labelled part of the input; documents without a letter or torn between languages go."""
    model = language_id.fit(docs.filter(~language_id.held_out(F.col("doc_id"))))
    return language_id.keep_known(docs, model)


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word n-grams at 0.8 stays: that with the smallest id."""
    return ngram_join.keep_one(docs)


def passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 13 words and more that an earlier document holds are cut out; documents of which nothing is left go."""
    return substring_dedup.drop_repeats(docs).withColumn("n_chars", F.length("text").cast("long"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold any benchmark window go."""
    return decontamination.drop_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words, whole repetitions and part of one, each document gives to the mix; those not taken go."""
    return mixing.mix(docs).filter("taken > 0")


STAGES = [
    ("language", language_stage),
    ("near copies", near_copy_stage),
    ("passages", passage_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]
#: Learning a language model and the seeded mix cannot be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is staged in the shared folder, so a lost executor costs one stage at most."""
    docs = _table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage_table(stage(spark, docs, sf_dir))
    return docs
