"""A corpus pipeline: language ID, exact and near deduplication, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns rows; all but the last return the columns
of ``documents``. ``run`` writes what a stage returns as Parquet into the shared folder and
reads it again for the next one. An empty table goes through as an empty table; columns that
``documents`` has beyond its own come through all stages but the last, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomline.llm import bpe, exact_dedup, langid, mixing, ngram_join
from loomline.llm._common import materialize
from loomline.llm.queries import VOCABULARY

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no language is found (null text, or no letter) go. Rows with null ids or
    sources stay, repeated rows all stay, and very long texts are read whole."""
    return langid.keep_identified(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, white space aside, the one with the smallest id stays: null
    ids come last, null text counts as empty, and of rows repeated with that id one stays."""
    return exact_dedup.drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that near duplicates connect, the one with the smallest id stays: null ids come
    last. Texts without words are copies of each other; rows repeated with their id stay together."""
    return ngram_join.keep_first_of_near(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it: a null source is a source, and rows
    with equal ids are taken together."""
    return mixing.mixed_rows(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document that the mix holds, a row for each time; null text has none."""
    return bpe.encode_documents(docs, VOCABULARY, keep_ids=True)


STAGES: list[tuple[str, Stage]] = [
    ("language", language),
    ("exact", exact),
    ("near", near),
    ("mix", mixed),
    ("tokens", tokens),
]

#: Language ID and near duplicates by MinHash are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
