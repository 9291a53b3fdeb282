"""The flagship query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from prefspark.plans.registry import QUERIES, load_all

FLAGSHIP = "a17_seed_statistics_sections"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    load_all()
    return QUERIES[FLAGSHIP](spark, sf_dir)
