"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prefspark.session import write_and_read

#: A word is a run of characters other than ASCII white space.
SPACE = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text in order; an empty array for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row.

    An expression used inside a lambda would be evaluated for every element;
    a lambda variable is not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running_total(df: DataFrame, group: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """Add ``name``: the sum of ``value`` over the rows of the same group that
    come earlier in ``order`` (0 for the first).

    A group may hold any share of the rows: rows are cut into range
    partitions, totals of the cuts are summed over (one row per group and
    cut), and each cut adds its own running sum.  Rows equal in all of
    ``group`` and ``order`` take any order among themselves.  The cuts are
    written once, so recomputed tasks see the same ones.
    """
    cut = df.withColumn("__spread", F.monotonically_increasing_id())
    cut = cut.repartitionByRange(*group, *order, "__spread").withColumn("__cut", F.spark_partition_id())
    cut = write_and_read(cut, "cuts")
    before = Window.orderBy("__cut").rowsBetween(Window.unboundedPreceding, -1)
    keys = [F.col(g) for g in group]
    sums = cut.groupBy(*keys, "__cut").agg(F.sum(value).alias("__sum"))
    part = before.partitionBy(*keys) if group else before
    sums = sums.select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)], F.col("__cut").alias("__at"),
                       F.coalesce(F.sum("__sum").over(part), F.lit(0)).alias("__base"))
    own = (Window.partitionBy(*keys, "__cut").orderBy(*order, "__spread")
           .rowsBetween(Window.unboundedPreceding, -1))
    cond = F.col("__cut") == F.col("__at")
    for i, g in enumerate(group):
        cond = cond & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    out = cut.withColumn("__own", F.coalesce(F.sum(value).over(own), F.lit(0))).join(sums, cond)
    return out.select(*df.columns, (F.col("__own") + F.col("__base")).cast("long").alias(name))
