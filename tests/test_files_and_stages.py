"""Splittable manifests, file layout by counted size, stripped text, and
stages that run again."""

import sys

import pytest
from conftest import SF_SMALL
from pyspark.sql import functions as F

from prefspark.functions import messages as msg
from prefspark.operators import encode as en
from prefspark.plans import fixtures as fx
from prefspark.plans import stages
from prefspark.session import scratch_path
from prefspark.sources import readers as rd
from prefspark.sources import writers as wr

AWKWARD = [r"\N", r"\\N", r"\b\n\r", "cr\rlf\nboth\r\n", "", " ", None, '"quoted", comma', "\\", "\n", "\\\n", 'a "b\nc', "é 中 \u2028"]


def test_manifest_keeps_every_text_and_splits(spark):
    rows = [(i, t, AWKWARD[(i + 1) % len(AWKWARD)], "x" * 200, f"v#{i}") for i, t in enumerate(AWKWARD * 200)]
    df = spark.createDataFrame(rows, "pair_id long, prompts string, chosen_responses string, rejected_responses string, cls_emb string")
    path = scratch_path(spark, "manifest-split")
    wr.write_manifest(df.coalesce(1), path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(64 << 10))
    try:
        back = rd.read_manifest(spark, path)
        assert back.rdd.getNumPartitions() >= 5  # one file, several tasks
        got = sorted((int(r[0]), *r[1:]) for r in back.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == rows


def test_manifest_with_line_ends_as_they_are(spark):
    path = scratch_path(spark, "manifest-plain")
    spark.createDataFrame([("a\nb", "c")], "prompts string, chosen_responses string").write.options(**rd.MANIFEST_OPTIONS).csv(path)
    assert [tuple(r) for r in rd.read_manifest(spark, path, escaped=False).collect()] == [("a\nb", "c")]


def test_files_follow_the_counted_size(spark, monkeypatch):
    """A hot head and a hot bucket get many files of about the size wanted,
    small ones a single file."""
    monkeypatch.setattr(wr, "FILE_BYTES", 64 * wr.SCORE_BYTES)
    rows = [(0, i, 0, 0.5, 0.25) for i in range(2000)] + [(1, i, 0, 0.5, 0.25) for i in range(30)]
    scores = spark.createDataFrame(rows, "head_id long, pair_id long, subset int, s_chosen double, s_rejected double").repartition(16)
    path = scratch_path(spark, "head-layout")
    wr.write_head_scores(scores, path)
    files = spark.read.json(path).groupBy("head_id", F.input_file_name().alias("f")).count().collect()
    hot = [r["count"] for r in files if r.head_id == 0]
    assert len(hot) == 32 and max(hot) <= 64 * 2 and sum(hot) == 2000
    assert [r["count"] for r in files if r.head_id == 1] == [30]
    vectors = spark.createDataFrame([(i * 4 if i < 900 else i, [1.0] * 4, [0.0] * 4) for i in range(1000)],
                                    "pair_id long, chosen array<double>, rejected array<double>")
    path = scratch_path(spark, "bucket-layout")
    wr.write_embeddings(vectors, path, 4)
    files = spark.read.parquet(path).groupBy("bucket", F.input_file_name().alias("f")).count().collect()
    by = {b: [r["count"] for r in files if r.bucket == b] for b in range(4)}
    assert len(by[0]) >= 8 and sum(map(sum, by.values())) == 1000 and all(len(by[b]) == 1 for b in (1, 2, 3))
    wr.write_embeddings(vectors.limit(0), scratch_path(spark, "bucket-empty"), 4)


def test_strip_equals_python(spark):
    blanks = [chr(c) for c in range(sys.maxunicode + 1) if chr(c).isspace()]
    texts = ["".join(blanks) + "a b" + "".join(blanks), "\ufeffx\u200b", "\n", "", "x\n"] + [f"{b}y{b}" for b in blanks]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(msg.py_strip(F.col("t"))).collect()] == [t.strip() for t in texts]


def test_evaluate_runs_again(spark):
    vectors, heads = fx.vec_pairs(spark, SF_SMALL), fx.heads(spark, SF_SMALL)
    path = scratch_path(spark, "evaluate-twice")
    first = stages.evaluate(vectors, heads, out_path=path)["subset_accuracy"].orderBy("head_id", "subset").collect()
    again = stages.evaluate(vectors, heads, out_path=path)["subset_accuracy"].orderBy("head_id", "subset").collect()
    assert first == again and len(first) > 0


def test_resume_does_not_take_faults_for_a_first_run(spark):
    """A damaged sink raises instead of being encoded and appended again."""
    pairs = fx.msg_pairs(spark, SF_SMALL).limit(6)
    path = scratch_path(spark, "damaged")
    vecs = stages.extract(spark, pairs, en.hashing_encoder(8), path, n_buckets=2)
    n = vecs.count()
    assert stages.extract(spark, pairs, en.hashing_encoder(8), path, n_buckets=2).count() == n
    other = scratch_path(spark, "renamed")
    vecs.withColumnRenamed("pair_id", "id").withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(other)
    with pytest.raises(Exception, match="pair_id"):
        stages.extract(spark, pairs, en.hashing_encoder(8), other, n_buckets=2)


def test_scores_are_handed_over_without_a_shuffle_of_pairs(spark):
    """Packed scores reach the adaptation with no exchange but the broadcast
    of the section map; long rows give the same report, and a folder that is
    written again holds only the form written last."""
    vectors, heads = fx.vec_pairs(spark, SF_SMALL), fx.heads(spark, SF_SMALL)
    how = {"section_map": fx.SECTION_MAP, "counts": fx.EXAMPLE_COUNTS}
    path, other = scratch_path(spark, "handed-over"), scratch_path(spark, "handed-long")

    def report(at):
        rows = stages.adapt_from_scores(spark, at, None, [3], seeds=2, **how)["statistics"].collect()
        return sorted((r.metric, round(r.mean, 9), round(r.std, 9)) for r in rows)
    stages.evaluate(vectors, heads, n_tasks=fx.N_TASKS, out_path=path)
    packed, ids, _ = stages.handed_over(spark, path, **how)
    plan = packed._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.replace("BroadcastExchange", "") and "Sort" not in plan
    scores, accuracy = rd.read_combined_scores(spark, path)
    assert ids == list(range(2 * fx.N_COMPONENTS)) and accuracy.count() > 0
    plan = scores._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    wr.write_combined_scores(scores, accuracy, other)
    want = report(path)
    assert len(want) > 0 and report(other) == want
    assert rd.read_combined_scores(spark, other)[0].exceptAll(scores).count() == 0
    stages.evaluate(vectors, heads.filter("head_id < 4"), n_tasks=fx.N_TASKS, out_path=other)
    assert {r[0] for r in rd.read_combined_scores(spark, other)[0].select("head_id").distinct().collect()} == {0, 1, 2, 3}


def test_packed_hand_over_of_edge_rows(spark):
    """Null scores and repeated rows stay; an empty table is an empty one."""
    rows = [(1, [1.0, 2.0], [0.0, 1.0]), (1, [1.0, 2.0], [0.0, 1.0]), (None, None, [3.0, 4.0])]
    packed = spark.createDataFrame(rows, "pair_id long, sc array<double>, sr array<double>")
    path = scratch_path(spark, "packed-edges")
    wr.write_packed_scores(packed, [7, 9], path)
    back, ids = rd.read_packed_scores(spark, path)
    assert ids == [7, 9] and sorted(map(repr, back.collect())) == sorted(map(repr, packed.collect()))
    wr.write_packed_scores(packed.limit(0), [7, 9], path)
    assert rd.read_packed_scores(spark, path)[0].count() == 0
