"""The three stages end to end on sf0.001, with the stand-in encoder."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from prefspark.operators import encode as en
from prefspark.plans import fixtures as fx
from prefspark.plans import stages
from prefspark.session import scratch_path


def test_extract_decompose_evaluate_adapt(spark):
    pairs = fx.msg_pairs(spark, SF_SMALL).withColumn("subset", (F.col("pair_id") % 3).cast("int")) \
        .withColumn("task_id", (F.col("pair_id") % 2).cast("int"))
    out = scratch_path(spark, "stage-vectors")
    man = scratch_path(spark, "stage-manifest")
    vecs = stages.extract(spark, pairs, en.hashing_encoder(32), out, n_buckets=4, manifest_path=man)
    n = vecs.count()
    assert n == pairs.count() == vecs.select("pair_id").distinct().count()   # every pair, none twice
    m = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(man)
    assert m.count() == n
    blank = m.filter(F.col("prompts").isNull() & F.col("chosen_responses").isNull()).count()
    from prefspark.functions import messages as msg
    assert blank == pairs.filter(~msg.is_consistent_pair("chosen", "rejected")).count()
    again = stages.extract(spark, pairs, en.hashing_encoder(32), out, n_buckets=4)
    assert again.count() == n                       # resume: nothing written twice

    dec = stages.decompose(spark, vecs, 4, scratch_path(spark, "stage-heads"))
    assert dec.heads.count() == 8

    sections = {0: "a", 1: "a", 2: "b"}
    counts = {0: 10, 1: 20, 2: 30}
    ev = stages.evaluate(vecs, dec.heads, sections, counts, n_tasks=2)
    assert ev["leaderboard"].count() == 8 * 3       # 8 heads x (2 sections + overall)
    assert ev["task_accuracy"].count() == 8 * 3

    rep = stages.adapt_and_report(vecs, dec.heads, {4: [0, 1, 4, 5], 8: list(range(8))}, [2], seeds=3,
                                  section_map=sections, counts=counts, out_path=scratch_path(spark, "stage-m"))
    st = rep["statistics"].collect()
    assert {(r.num_heads, r.metric) for r in st} == {(h, m) for h in (4, 8) for m in ("a", "b", "overall")}
    w = rep["weights"].groupBy("num_heads", "seed", "grp").agg(F.sum("weight").alias("s")).collect()
    assert all(abs(r.s - 1) < 1e-9 for r in w)


def test_a_sink_that_was_missed_is_completed(spark):
    """A run that wrote vectors but no manifest: the rerun writes the manifest."""
    from prefspark.sources import readers as rd
    pairs = fx.msg_pairs(spark, SF_SMALL)
    out, man = scratch_path(spark, "resume-vectors"), scratch_path(spark, "resume-manifest")
    n = stages.extract(spark, pairs, en.hashing_encoder(8), out, n_buckets=2).count()
    stages.extract(spark, pairs, en.hashing_encoder(8), out, n_buckets=2, manifest_path=man)
    assert rd.read_manifest(spark, man).count() == n == pairs.count()
    stages.extract(spark, pairs, en.hashing_encoder(8), out, n_buckets=2, manifest_path=man)
    assert rd.read_manifest(spark, man).count() == n


def test_killed_runs_show_nothing_and_are_done_again(spark, monkeypatch):
    """Killed inside the first sink, between the sinks and before the mark:
    the rerun equals a clean run; later pairs are a run of their own."""
    from prefspark.sources import writers as wr
    pairs = fx.msg_pairs(spark, SF_SMALL).withColumn("task_id", (F.col("pair_id") % 2).cast("int"))
    some, encoder = pairs.filter("pair_id % 3 > 0"), en.hashing_encoder(8)

    def rows(tables):
        return [sorted(map(repr, t.drop("run", "cls_emb").collect())) for t in tables]

    def run(data, out):
        return stages.extract_run(spark, data, encoder, out, n_buckets=2)

    out, clean = scratch_path(spark, "runs"), scratch_path(spark, "runs-clean")
    assert run(some.limit(0), out) is None and wr.committed_runs(spark, out) == []
    for broken in ("write_manifest", "write_embeddings", "_commits"):
        whole = getattr(wr, broken)
        calls = []

        def killed(*args, **kwargs):
            calls.append(1)
            if broken == "_commits" and len(calls) < 3:  # read twice before the mark is set
                return whole(*args, **kwargs)
            if broken != "_commits":
                whole(*args, **kwargs)  # what it wrote stays behind
            raise InterruptedError
        monkeypatch.setattr(wr, broken, killed)
        with pytest.raises(InterruptedError):
            run(some if broken != "write_embeddings" else pairs, out)
        monkeypatch.undo()
        assert wr.committed_runs(spark, out) == []
    got, want = rows(run(some, out)), rows(run(some, clean))
    assert got == want and len(got[0]) == len(got[1]) == some.count()
    vectors, manifest = run(pairs, out)
    assert wr.committed_runs(spark, out) == [0, 1]
    assert vectors.select("pair_id").distinct().count() == vectors.count() == manifest.count() == pairs.count()
    assert {r.run for r in vectors.filter("pair_id % 3 > 0").select("run").distinct().collect()} == {0}
    run(pairs, out)
    assert wr.committed_runs(spark, out) == [0, 1]      # nothing new, no run


def test_missing_constants_raise(spark):
    vecs = fx.vec_pairs(spark, SF_SMALL)
    with pytest.raises(ValueError):
        stages.evaluate(vecs, fx.heads(spark, SF_SMALL), fx.SECTION_MAP)
    for kw in ({"section_map": fx.SECTION_MAP}, {}, {"n_tasks": 5, "group_by": "colour"}):
        with pytest.raises(ValueError):
            stages.adapt_and_report(vecs, fx.heads(spark, SF_SMALL), None, [3], **kw)


def test_scratch_folder_without_the_setting(tmp_path):
    """With ``spark.checkpoint.dir`` unset a local session gets a private
    folder, an explicit one is used, and a cluster master raises."""
    from prefspark.session import ensure_checkpoint_dir

    class Context:
        def __init__(self, master):
            self.master, self.dir = master, None

        def getCheckpointDir(self):
            return self.dir

        def setCheckpointDir(self, d):
            self.dir = d

    class Session:
        def __init__(self, master):
            self.sparkContext = Context(master)
            self.conf = type("Conf", (), {"get": lambda self, key, default: default})()

    local = Session("local[2]")
    assert ensure_checkpoint_dir(local) == local.sparkContext.dir
    given = Session("spark://host:7077")
    assert ensure_checkpoint_dir(given, str(tmp_path)) == str(tmp_path) == given.sparkContext.dir
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1024]"):
        with pytest.raises(RuntimeError):
            ensure_checkpoint_dir(Session(master))
