"""The corpus pipeline: stages over documents, each written as Parquet and reread as the next one's input.

Language ID drops documents without a language; of each group of near-duplicates (five-word shingles, similarity 0.8 or more) the one with the smallest
doc_id stays; documents in which a benchmark item is found go; mixing takes each document as often as its source's weight asks; the last stage
writes token ids and reports each document's place in them. A document that mixing takes twice has two rows from there on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factweave.llm import decontam, langid, mixing, neardup, tokenbin
from factweave.plans.storage import remove, scratch, shared_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_identified(docs, langid.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tokenbin.token_output(spark, docs)


STAGES = [
    ("language ID", language_id),
    ("near-duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("source mixing", source_mixing),
    ("token ids", token_ids),
]

#: Language models and the tokenizer can't be put in SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage has written on its way, and its input, go once its output is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, name.replace(" ", "-"))
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
