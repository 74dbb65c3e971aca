"""Corpus cleaning in five stages, each of which reads what the one before has kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes each result as Parquet in
the folder of spark.checkpoint.dir and reads it back as the next stage's docs. All but the last
return the columns of documents, whatever they are; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mediaframe.llm import decontaminate, exact_dedup, jaccard_join, langid, piece_transducer
from mediaframe.llm.common import release, stage, table, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the models reject go (no letters, or like no learned language; null
    and empty texts too). Rows that repeat, ids that are null and all columns stay as they are."""
    return langid.keep_known(docs, langid.fit(docs))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row with the largest doc_id stays; a null id loses, null text is empty text."""
    return exact_dedup.keep_first(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of five-word shingles with Jaccard 0.8 or more connect, the one with
    the smallest doc_id stays. Unlike texts under one id, or under none, are apart; documents without
    words stay."""
    return jaccard_join.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more of the words is in windows of test items go; those
    without words stay."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of what is left, and whether they decode to the text."""
    return piece_transducer.tokenize(docs)


STAGES = [
    ("language_id", language_id),
    ("exact_duplicates", exact_duplicates),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("sentencepiece", sentencepiece),
]

#: Language models and merges of pieces are beyond SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn; a stage's tables go once the result that it has made of them is written."""
    docs, mark = table(spark, sf_dir, "documents"), written()
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
        release(spark, mark)
    return docs
