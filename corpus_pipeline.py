"""A corpus from raw documents to token shards: each stage works on all that the one before it kept.

A null text counts as empty in every stage. Repeated rows are one group of near-duplicates, so one of them stays; all
rows of a doc_id are judged each by its own text. Texts are judged and encoded whole, however long. An empty table gives
an empty result. Stages hand on all columns they are given, whatever their names; run() gives them those of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from notelake.llm.byte_cnn import accepted
from notelake.llm.common import DOCUMENT, remainder, stored, table
from notelake.llm.decontaminate import decontaminated
from notelake.llm.mixing import domain_of_labels, mixed
from notelake.llm.simhash import simhash_unique
from notelake.llm.token_ids import read_tokens, token_files


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below 0.7 go; an empty text has a score like any other."""
    return accepted(docs, table(spark, sf_dir, "labels"), remainder(4) == 2)


def simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: that of the smallest doc_id (null last)."""
    return simhash_unique(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; empty texts hold none, and empty items are in no text."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its fitted rate says; without labels, once."""
    return mixed(docs, table(spark, sf_dir, "labels").select("doc_id", domain_of_labels().alias("domain")))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards in doc_id order (null first), read back: one row per document, copies one after another."""
    return read_tokens(token_files(docs, public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [("quality_classifier", quality_classifier), ("simhash", simhash), ("decontaminate", decontaminate), ("mixing", mixing), ("token_ids", token_ids)]

#: No stage but the third could be said in SQL; tests/llm/test_pipeline.py holds the stages against plain loops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*DOCUMENT)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
