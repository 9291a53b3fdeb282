"""Sharding by jump consistent hashing.

A stable key and the number of shards alone decide a row's shard; adding a
shard moves only the rows that the new shard takes.  No ring table exists.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prefspark.llm.common import running_total, table

#: Fixed values of the published algorithm (linear congruential step).
MULTIPLIER = np.uint64(2862933555777941757)
SCALE = float(1 << 31)

N_SHARDS = 16


def jump_hash(keys: np.ndarray, n_shards: int) -> np.ndarray:
    """Shard of each unsigned 64-bit key; all keys advance together."""
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    state = keys.astype(np.uint64)
    shard = np.zeros(len(state), dtype=np.int64)
    live = np.arange(len(state))
    jump = np.zeros(len(state), dtype=np.int64)
    while len(live):
        shard[live] = jump
        with np.errstate(over="ignore"):
            state[live] = state[live] * MULTIPLIER + np.uint64(1)
        step = SCALE / ((state[live] >> np.uint64(33)).astype(np.float64) + 1.0)
        jump = np.floor((shard[live] + 1) * step).astype(np.int64)
        more = jump < n_shards
        live, jump = live[more], jump[more]
    return shard


def key64(column: Column, dtype: str) -> Column:
    """Integer keys as they are, any other type hashed; null counts as key 0."""
    key = column.cast("long") if dtype in ("bigint", "int", "smallint", "tinyint") else F.xxhash64(column)
    return F.coalesce(F.when(column.isNotNull(), key), F.lit(0).cast("long"))


def shard_of(key: Column, n_shards: int) -> Column:
    """Shard column (int) of a long key column."""
    @F.pandas_udf("int")
    def shard(k: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(k.to_numpy(np.int64).view(np.uint64), n_shards).astype(np.int32))
    return shard(key)


def assign_shards(df: DataFrame, key: str, n_shards: int = N_SHARDS) -> DataFrame:
    """Add ``shard`` and ``grown_shard`` (with one more shard) to any table.

    A narrow step: no shuffle.  A null key counts as key 0; equal keys share
    a shard; an empty table stays empty; columns named ``shard`` or
    ``grown_shard`` are replaced.
    """
    k = key64(F.col(key), dict(df.dtypes)[key])
    return df.withColumns({"shard": shard_of(k, n_shards), "grown_shard": shard_of(k, n_shards + 1)})


def write_shards(df: DataFrame, path: str, key: str, n_shards: int = N_SHARDS) -> None:
    """Write the table as one folder per shard; tasks keep their rows (no
    shuffle), so a shard that holds many rows is many files."""
    assign_shards(df, key, n_shards).drop("grown_shard").write.partitionBy("shard").parquet(path)


def sharded_documents(docs: DataFrame, n_shards: int = N_SHARDS) -> DataFrame:
    """Placement of every document: size, checksum, shard and its slot there.

    ``slot`` numbers a shard's rows from 0 without gaps in doc_id order (null
    first; repeated doc_ids by checksum and size).  A null text has size 1
    and checksum 0.  Only doc_id, size and checksum are shuffled.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = assign_shards(rows, "doc_id", n_shards).withColumn("one", F.lit(1))
    rows = running_total(rows, ["shard"], ["doc_id", "text_crc32", "size"], "one", "slot")
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded_documents(table(spark, sf_dir, "documents"))
