"""A training corpus from raw documents, in five stages.

Each stage takes all that the one before it kept; its input and output are tables.

Defined cases: documents without text, and those of few words, are rejected by the first
stage; rows with equal ids are judged by their contents and stay rows of their own; a null
id is no near duplicate of anything and gets tokens like any other; a null source is a
source; columns beyond those of documents are handed on up to the last stage, whatever
their names; an empty table gives no rows, and an empty benchmark hits nothing.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ensemblar.llm.decontaminate import decontaminate
from ensemblar.llm.minhash import keep_first
from ensemblar.llm.mixing import mix
from ensemblar.llm.quality import keep_good
from ensemblar.llm.scratch import as_table, new_path
from ensemblar.llm.tables import documents, table
from ensemblar.llm.token_files import read_token_files, write_token_files


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; boilerplate lines go from the others."""
    return keep_good(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; test phrases are cut from the others."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark")).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy that the mix takes."""
    return mix(docs).select(docs.columns)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in the shared folder, and what is read back of each document."""
    path = new_path(spark, "tokens")
    write_token_files(docs, path, public_tokenizers.path("word_bpe_49k.json"))
    return read_token_files(spark, path)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing), ("token_output", token_output)]

#: Hash draws and token files cannot be expressed in SQL; a brute-force version checks the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = as_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
