"""A corpus pipeline: each stage works on all that the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of ``documents``. Results are written as Parquet in the shared folder and read again.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sinoplan.llm import common
from sinoplan.llm.bpe import bpe_encode
from sinoplan.llm.decontam import clean_documents
from sinoplan.llm.langid import fit_languages, rows_with_language
from sinoplan.llm.nearcopies import keep_one
from sinoplan.llm.repeats import without_repeats


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter go on as they are, also where no language could be learned; those without are rejected."""
    found = rows_with_language(docs, fit_languages(docs), "__lang", "__letters")
    return found.filter(F.col("__letters") > 0).drop("__lang", "__letters")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest doc_id."""
    return keep_one(docs)


def exact_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 100 bytes and more that also stand earlier are taken out of the texts."""
    return without_repeats(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item are rejected."""
    return clean_documents(docs, common.table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left: doc_id, n_tokens, ids, decoded text."""
    return bpe_encode(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_id),
    ("near_copies", near_copies),
    ("exact_repeats", exact_repeats),
    ("decontaminate", decontaminate),
    ("encode", encode),
]

#: No SQL can state n-gram classes of components, repeats or BPE; the stages are tested by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = common.table(spark, sf_dir, "documents")
    folder = f"{common.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for n, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if n:  # what this stage has read is no longer needed
            common.remove_folder(spark, f"{folder}/{STAGES[n - 1][0]}")
    return docs
