"""A training corpus from raw documents, in stages that each write a table.

Each stage takes the table that the one before it left, works on all of it and
returns the rows that stay with the columns of `documents`; the last returns
the packed pieces. Rows with null or empty text have no language and go in the
first stage; an empty table stays empty through all of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rowguard.llm import decontam, langid, packing, quality, simhash
from rowguard.llm.common import drop, new_path, release


def fresh_start(docs: DataFrame) -> DataFrame:
    """A stage's documents have been written, so nothing that earlier stages stored is needed any more."""
    release(docs)
    return docs


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_known(fresh_start(docs))


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(fresh_start(docs), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(fresh_start(docs), shingle=5, similarity=0.8)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(fresh_start(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(fresh_start(docs)))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language", language),
    ("quality", good),
    ("near_duplicates", distinct),
    ("decontamination", clean),
    ("packing", packed),
]

#: Models, fingerprints and packing have no SQL form; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. The tables of the others are dropped once the next one is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = new_path(spark, f"corpus-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        release(docs)
        if before:
            drop(spark, before)
        before = path
    return docs
