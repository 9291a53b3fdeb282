"""Plan checks: filters and projections reach the parquet scan, scoring
stays a single Arrow node, and the adaptation's final plan has no shuffle of
pairs by group."""

import re

from pyspark.sql import functions as F

from conftest import SF_MID
from prefspark.operators import adapt as ad
from prefspark.operators import pairs as pr
from prefspark.operators import scoring as sc
from prefspark.plans import fixtures as fx
from prefspark.session import scratch_path
from prefspark.sources import readers as rd
from prefspark.sources import writers as wr


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_take_first_and_projection_reach_the_scan(spark):
    path = scratch_path(spark, "plan-emb")
    wr.write_embeddings(fx.vec_pairs(spark, SF_MID), path, n_buckets=4)
    df = pr.take_first(rd.read_embeddings(spark, path), 10).select("pair_id", "subset")
    plan = _plan(df)
    assert re.search(r"PushedFilters: \[IsNotNull\(pair_id\), LessThan\(pair_id,10\)\]", plan)
    assert "ReadSchema: struct<pair_id:bigint,subset:int>" in plan
    assert df.count() == 10


def test_bucket_filter_prunes_partitions(spark):
    path = scratch_path(spark, "plan-bucket")
    wr.write_embeddings(fx.vec_pairs(spark, SF_MID), path, n_buckets=4)
    df = rd.read_embeddings(spark, path).filter(F.col("bucket") == 1).select("pair_id")
    assert "PartitionFilters: [isnotnull(bucket" in _plan(df)
    assert all(r.pair_id % 4 == 1 for r in df.collect())


def test_scoring_is_one_arrow_node_without_shuffle_of_pairs(spark):
    pairs = spark.read.parquet(f"{SF_MID}/embeddings.parquet").select(
        F.col("vec_id").alias("pair_id"), F.col("embedding").alias("chosen"), F.col("embedding").alias("rejected"))
    packed, _ = sc.score_heads_packed(pairs, fx.heads(spark, SF_MID))
    plan = _plan(packed)
    assert plan.count("ArrowEvalPython") == 1
    assert "Exchange" not in plan


def test_adaptation_final_plan_broadcasts_small_sides(spark):
    pairs = spark.read.parquet(f"{SF_MID}/embeddings.parquet").select(
        F.col("vec_id").alias("pair_id"), (F.col("label") % 3).alias("grp"),
        F.col("embedding").alias("chosen"), F.col("embedding").alias("rejected"))
    a = ad.adapt_from_vectors(pairs, fx.heads(spark, SF_MID), 5, 4)
    acc = ad.with_agg_win(a.agg).groupBy("seed").agg(F.avg("win"))
    plan = _plan(acc)
    # the pairs are scanned once, re-scored in Arrow batches, and only partial
    # aggregates per seed are shuffled
    assert plan.count("FileScan parquet") == 1
    assert plan.count("Exchange") == 1 and "hashpartitioning(seed" in plan


def test_lookup_pairs_prunes_bucket_folders(spark):
    path = scratch_path(spark, "plan-lookup")
    wr.write_embeddings(fx.vec_pairs(spark, SF_MID), path, n_buckets=8)
    ids = spark.range(0, 250).select((F.col("id") * 8 + 3).alias("pair_id")).filter(F.col("pair_id") < 250)
    df = rd.lookup_pairs(spark, path, ids, 8)
    plan = _plan(df)
    assert "dynamicpruningexpression" in plan.lower()
    got = sorted(r.pair_id for r in df.select("pair_id").collect())
    assert got == list(range(3, 250, 8))
    assert df.columns == spark.read.parquet(path).columns
