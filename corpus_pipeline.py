"""Corpus pipeline: from raw documents to token files.

Five stages, each a function (spark, docs, sf_dir) -> DataFrame over all that
the stage before it kept:

1. ``quality_rules`` drops documents that the weakly supervised rules reject;
2. ``near_dedup`` keeps one document of each near-duplicate class;
3. ``decontaminate`` drops documents that hold a benchmark passage;
4. ``mix_sources`` repeats and thins sources towards their target weights;
5. ``token_output`` writes the token files and returns their digest.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from prefspark.llm import decontaminate as leaks
from prefspark.llm import mixing, near_dedup, quality, token_files
from prefspark.session import ship_library, write_and_read

TOKENIZER = "byte_bpe_50k.json"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; null and empty texts go, all columns stay (``quality.keep_documents``)."""
    return quality.keep_documents(docs)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every near-duplicate class; rows with a null text stay (``near_dedup.keep_one``)."""
    ship_library(spark)
    return near_dedup.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of ``benchmark``; null and empty texts stay (``decontaminate.drop_leaks``)."""
    ship_library(spark)
    return leaks.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources mixed to their targets; documents without a drawn word go (``mixing.mix_documents``)."""
    ship_library(spark)
    return mixing.mix_documents(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all documents, read back as digests; a null text is the end id (``token_files.token_output``)."""
    import public_tokenizers
    ship_library(spark)
    return token_files.token_output(docs, public_tokenizers.path(TOKENIZER))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_dedup", dedup),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
    ("token_output", token_output),
]

#: SQL can express neither the signatures nor the tokenizer; the tests compare
#: the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written and
    read again by the next.  An empty table passes through every stage;
    repeated rows are documents of their own until the near-duplicates go."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = write_and_read(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
