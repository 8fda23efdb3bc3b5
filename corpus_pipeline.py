"""A training corpus from documents, in stages; each is written and read again before the next.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept,
and returns the columns of documents; the last returns what the token files hold.

All stages keep extra columns, whatever their names, read texts of any length
whole, and give an empty table for an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from affinix.llm import decontamination, ngram_jaccard, quality_classifier, source_mixing, token_output
from affinix.llm._shared import free_name, shared_folder, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    Null and empty texts are scored as empty, repeated rows alike; labels, not docs, decide how texts are scored.
    """
    model = quality_classifier.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    names = tuple(free_name(docs, x) for x in quality_classifier.NAMES)
    return quality_classifier.score(docs, model, names).where(names[1]).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the lowest doc_id; of equal rows one.

    Texts without words (null, empty) are near nothing and stay.
    """
    return ngram_jaccard.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are contaminated by the benchmark go; null and empty texts, and rows with a null doc_id, stay."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources, null among them, get equal weight: rows are repeated or left out by a Poisson draw, and shuffled.

    Rows with one doc_id draw one count; null and empty texts are rows like others.
    """
    return source_mixing.mixed(docs, names=tuple(free_name(docs, x) for x in source_mixing.NAMES)).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in ascending doc_id order, and per document what they hold; null and empty texts hold the end id, repeated rows come as often."""
    return token_output.token_output(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Stage]] = [("quality classifier", quality), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", decontaminate), ("source mixing", mix), ("token output", tokens)]

#: The quality classifier and the tokenizer can't be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    folder = shared_folder(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = written(stage(spark, docs, sf_dir), f"{folder}/stage-{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
