"""A training corpus in five stages: language, exact copies, near copies, secrets, packing.

Each stage reads all that its predecessor kept and its decisions take effect; a stage's rows are written as Parquet
and read again as the documents of the next. All stages but the last keep the columns of documents, whatever further
ones there are. An empty table passes through all stages as an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.llm import exact_dedup, language, near_dedup, packing, secrets
from meterlake.llm.common import table
from meterlake.session import written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the classifier accepts.

    Null and empty texts and those without a letter have no language and go; where no row is labelled, none is known and
    all go. Copies and repeated rows are decided alike.
    """
    return language.keep_known(docs, language.train(docs))


def first_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest doc_id, of repeated rows one.

    Null counts as empty, and all empty texts are equal; a row without doc_id stays only where its text has no other.
    """
    return exact_dedup.keep_first(docs)


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8): the smallest doc_id of its component.

    Null, empty and blank texts and rows without doc_id are near nothing and stay.
    """
    return near_dedup.keep_one(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark; n_chars follows the text. Null and empty texts stay as they are."""
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the training sequences, with checksums of their ids. Null and empty texts are the end id alone."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)


STAGES: list[tuple[str, Stage]] = [
    ("language", known_language),
    ("exact_dedup", first_copies),
    ("near_dedup", distinct_texts),
    ("secrets", without_secrets),
    ("packing", packed),
]

#: No stage's decisions can be written in SQL as a whole: the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
