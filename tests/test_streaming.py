"""Incremental scoring: a rerun without new files adds nothing; new files
are scored exactly once."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from prefspark.plans import fixtures as fx
from prefspark.session import scratch_path
from prefspark.streaming.incremental import score_new_pairs


def test_incremental_scoring_is_exactly_once(spark):
    src, sink, ckpt = (scratch_path(spark, n) for n in ("t-src", "t-sink", "t-ckpt"))
    pairs = fx.vec_pairs(spark, SF_SMALL)
    heads = fx.heads(spark, SF_SMALL)
    pairs.filter(F.col("pair_id") < 100).write.parquet(src)
    schema = spark.read.parquet(src).schema
    n_heads = 2 * fx.N_COMPONENTS
    score_new_pairs(spark, src, schema, heads, sink, ckpt)
    first = spark.read.parquet(sink).count()
    score_new_pairs(spark, src, schema, heads, sink, ckpt)          # nothing new
    assert spark.read.parquet(sink).count() == first == 100 * n_heads
    pairs.filter(F.col("pair_id") >= 100).write.mode("append").parquet(src)
    score_new_pairs(spark, src, schema, heads, sink, ckpt)
    out = spark.read.parquet(sink)
    assert out.count() == pairs.count() * n_heads
    assert out.select("pair_id", "head_id").distinct().count() == out.count()


def test_other_heads_or_sources_are_other_streams(spark):
    from prefspark.operators.scoring import collect_heads
    from prefspark.streaming.incremental import stream_key
    hm = collect_heads(fx.heads(spark, SF_SMALL))
    few = collect_heads(fx.heads(spark, SF_SMALL).filter("head_id < 2"))
    keys = {stream_key("/a", "/s", hm), stream_key("/a", "/s", few), stream_key("/b", "/s", hm), stream_key("/a", "/t", hm)}
    assert len(keys) == 4 and stream_key("/a", "/s", hm) in keys
