"""The corpus pipeline: documents through five stages, each written as Parquet and read again.

Stages filter or rewrite whole documents and return their columns; the last, the
mix, adds `copies`, the number of epochs in which a document is taken.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobledger.llm import decontaminate, linededup, mixing, simhash, toxicity
from jobledger.llm.queries import WEIGHTS, levels
from jobledger.llm.tables import shared_folder, table


def _count_again(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else docs


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from `labels` outside its held-out fold, does not reject.

    Null and empty texts have the bias's score and stay; repeated rows share their
    fate; without labelled rows nothing is rejected; no rows give none.
    """
    return toxicity.reject_toxic(docs, table(spark, sf_dir, "labels"))


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their source's boilerplate lines, n_chars counted again.

    Two pages suffice, so that the ratio decides on sites of any size; one page alone
    repeats nothing.  Every row stays, null and empty texts as they are.
    """
    return _count_again(linededup.drop_boilerplate(docs, min_pages=2)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near fingerprints, that with the smallest id; null, empty and blank texts are one group, equal rows count once."""
    return simhash.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without benchmark passages, n_chars counted again; documents of which more than half the words are hit go.  Null and empty texts, and those without a hit, stay as they are."""
    return _count_again(decontaminate.remove_spans(docs, table(spark, sf_dir, "benchmark"))).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with `copies`; null names are a leaf of their own, documents without words follow their leaf's whole epochs."""
    return mixing.mix_sources(docs, levels(), WEIGHTS)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate_lines),
    ("simhash_dedup", drop_near_duplicates),
    ("decontamination", decontaminated),
    ("source_mix", mixed),
]

#: The classifier and the fingerprints cannot be expressed in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
