"""Corpus pipeline: documents in, cleaned and encoded documents out.

Stages, in order: language ID (documents like no learned language go), line dedup,
near dedup (one document of each group stays), benchmark decontamination, SentencePiece
encoding and decoding.  Each stage is written as Parquet and reread as the next one's input.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import decontamination, language, line_dedup, near_dedup, pieces, scratch
from lodestone.llm.queries import piece_model


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.drop_rejected(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.drop_repeated_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.drop_near_duplicates(docs, width=5, threshold=(80, 100))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with n_tokens, their ids, and whether these decode to the text again."""
    return pieces.with_ids(docs, piece_model()).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", lines),
    ("near_dedup", near_duplicates),
    ("decontamination", decontaminate),
    ("sentencepiece", encode),
]

#: None: SQL has neither the classifier nor the tokenizer; tests compare each stage's operator with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return docs
