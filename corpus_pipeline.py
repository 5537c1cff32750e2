"""The corpus pipeline: language ID, exact dedup, near dedup, mixing and packing, one after the other.

Each stage works on all rows that its predecessor kept, which are written as Parquet and read again. All
stages but the last return the columns of `docs`, whatever others there are; an empty table stays empty.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession

from pricelane.llm import exact_dedup, language, mixing, near_dedup, packing
from pricelane.llm.queries import TARGETS, table, tokenizer
from pricelane.llm.work import staged


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go, null, empty and blank texts among them, and those of which no language
    knows a quarter of the n-grams. Rows without a lang or doc_id teach nothing but are judged like others."""
    return language.accepted(docs, language.train(docs, language.learnable()))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (null counts as empty) the row with the largest doc_id stays, of repeated rows one; rows
    without a doc_id lose against rows with one."""
    return exact_dedup.without_duplicates(docs, keep="max")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the smallest doc_id stays. Texts without words have no links and
    stay; rows without a doc_id go where they are linked to one with a doc_id."""
    return near_dedup.without_near_duplicates(docs, percent=85)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are poor or toxic, by their label or else most likely, are thinned out towards the
    target shares; all others stay, and no document is repeated. Texts without words weigh nothing; rows
    without a doc_id have no label and are judged by their text."""
    labelled = mixing.quality_domains(table(spark, sf_dir, "labels"))
    return mixing.sampled(docs, labelled, TARGETS, max_rate=1.0)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of at most 4096 ids. A null or empty text is
    the end id alone."""
    return packing.packed_documents(docs, tokenizer("word_bpe_49k.json"))


STAGES = [("language", known_language), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mix),
          ("packing", pack)]
#: SQL cannot express language ID, mixing and packing; tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. Of the stages before, only what they kept remains in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(partial(stage, spark, docs, sf_dir), spark, name)
    return STAGES[-1][1](spark, docs, sf_dir)
