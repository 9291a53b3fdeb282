"""Registered queries: sources, sinks and incremental runs.

Each query writes a fixture view in the source layout to a fresh folder
under the shared checkpoint folder, reads it back through the operator and
returns what was read; the oracle states the expected rows from the base
tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from prefspark.operators import adapt as ad
from prefspark.operators import evaluate as ev
from prefspark.operators import pairs as pr
from prefspark.plans import fixtures as fx
from prefspark.plans.q_adapt import K_SECTION, adapt_sql, board_sql, STATS_SELECT, W
from prefspark.plans.registry import query, rnd
from prefspark.session import scratch_path
from prefspark.sources import objects as ob
from prefspark.sources import readers as rd
from prefspark.sources import writers as wr
from prefspark.streaming.incremental import score_new_pairs


@query("s1_read_pairs_json", "SELECT pair_id, chosen, rejected, ' ' AS source FROM fx_msg_pairs")
def s1_read_pairs_json(spark, sf):
    path = scratch_path(spark, "pairs-json")
    fx.msg_pairs(spark, sf).write.json(path)
    p = pr.source_or_blank(rd.read_pairs(spark, path, "json"))
    return p.select("pair_id", "chosen", "rejected", "source")


@query("s1_read_pairs_parquet", "SELECT pair_id, chosen, rejected, CAST(NULL AS DOUBLE) AS margin FROM fx_msg_pairs")
def s1_read_pairs_parquet(spark, sf):
    path = scratch_path(spark, "pairs-parquet")
    fx.msg_pairs(spark, sf).write.parquet(path)
    return rd.read_pairs(spark, path).select("pair_id", "chosen", "rejected", "margin")


N_TASK_FILES = 5


@query("s2_read_tagged", f"""
SELECT CAST(row_number() OVER (ORDER BY pair_id % {N_TASK_FILES}, pair_id) - 1 AS BIGINT) AS data_idx,
       CAST(pair_id % {N_TASK_FILES} AS INTEGER) AS task_id, pair_id, input
FROM fx_choice""")
def s2_read_tagged(spark, sf):
    root = scratch_path(spark, "tagged")
    c = fx.choice_records(spark, sf)
    paths = []
    for t in range(N_TASK_FILES):
        p = f"{root}/task{t}"
        c.filter(F.col("pair_id") % N_TASK_FILES == t).write.json(p)
        paths.append(p)
    tagged = rd.read_tagged(spark, paths)
    return pr.with_pair_id(tagged, ["task_id", "pair_id"], "data_idx").select(
        "data_idx", "task_id", "pair_id", "input")


@query("s3_read_embeddings", "SELECT pair_id, subset, chosen, rejected FROM fx_vec_pairs")
def s3_read_embeddings(spark, sf):
    path = scratch_path(spark, "embeddings")
    wr.write_embeddings(fx.vec_pairs(spark, sf), path, n_buckets=4)
    return rd.read_embeddings(spark, path).select("pair_id", "subset", "chosen", "rejected")


@query("s3_lookup_pairs", "SELECT pair_id, subset, chosen, rejected FROM fx_vec_pairs WHERE subset = 3")
def s3_lookup_pairs(spark, sf):
    path = scratch_path(spark, "embeddings-lookup")
    p = fx.vec_pairs(spark, sf)
    wr.write_embeddings(p, path, n_buckets=8)
    wanted = p.filter(F.col("subset") == 3).select("pair_id")
    return rd.lookup_pairs(spark, path, wanted, 8).select("pair_id", "subset", "chosen", "rejected")


# Three of seven rows have no path or share one, one of seven names a missing file.
PATH_SQL = """CASE pair_id % 7 WHEN 0 THEN NULL WHEN 1 THEN '/new/emb_1.npy' WHEN 2 THEN '/old/none.npy'
  ELSE CASE WHEN pair_id % 3 = 0 THEN '/old' ELSE '/new' END || '/emb_' || CAST(pair_id AS VARCHAR) || '.npy' END"""


@query("s4_read_manifest", f"""
SELECT m.pair_id, m.cls_emb, m.task_id AS task_ids, 'prompt ' || CAST(m.pair_id AS VARCHAR) AS prompts,
       v.chosen, v.rejected
FROM (SELECT pair_id, task_id, {PATH_SQL} AS cls_emb FROM fx_vec_pairs) m
LEFT JOIN fx_vec_pairs v ON replace(m.cls_emb, '/old/', '/new/') = '/new/emb_' || CAST(v.pair_id AS VARCHAR) || '.npy'""")
def s4_read_manifest(spark, sf):
    root = scratch_path(spark, "manifest")
    p = fx.vec_pairs(spark, sf)
    own = F.concat(F.when(F.col("pair_id") % 3 == 0, F.lit("/old")).otherwise(F.lit("/new")), F.lit("/emb_"),
                   F.col("pair_id").cast("string"), F.lit(".npy"))
    seventh = F.col("pair_id") % 7
    path = (F.when(seventh == 1, "/new/emb_1.npy").when(seventh == 2, "/old/none.npy").when(seventh > 2, own))
    man = p.select("pair_id", F.concat(F.lit("prompt "), F.col("pair_id").cast("string")).alias("prompts"),
                   F.lit("a").alias("chosen_responses"), F.lit("b").alias("rejected_responses"),
                   path.alias("cls_emb"),
                   F.col("task_id").alias("task_ids"))
    wr.write_manifest(man, f"{root}/csv")
    vectors = p.select(F.concat(F.lit("/new/emb_"), F.col("pair_id").cast("string"),
                                F.lit(".npy")).alias("path"), "chosen", "rejected")
    m = rd.read_manifest(spark, f"{root}/csv")
    r = rd.resolve_paths(m, vectors, "/old/", "/new/")
    return r.select(F.col("pair_id").cast("bigint").alias("pair_id"), "cls_emb",
                    F.col("task_ids").cast("int").alias("task_ids"), "prompts", "chosen", "rejected")


@query("s5_read_bundle", "SELECT pair_id AS id, subset, chosen, rejected FROM fx_vec_pairs")
def s5_read_bundle(spark, sf):
    path = scratch_path(spark, "bundle")
    fx.vec_pairs(spark, sf).select(F.col("pair_id").alias("id"), "subset", "chosen", "rejected") \
        .write.parquet(path)
    return rd.read_bundle(spark, path)


@query("s6_read_head_scores", """
SELECT head_id, pair_id, 'set-' || CAST(subset AS VARCHAR) AS subset, round(s_chosen, 6) + 0.0 AS s_chosen,
       round(s_rejected, 6) + 0.0 AS s_rejected
FROM fx_scores""")
def s6_read_head_scores(spark, sf):
    path = scratch_path(spark, "head-scores")
    named = fx.scores(spark, sf).withColumn("subset", F.concat(F.lit("set-"), F.col("subset").cast("string")))
    wr.write_head_scores(named, path)
    s = rd.read_head_scores(spark, path)
    return s.select("head_id", "pair_id", "subset", F.round("s_chosen", 6).alias("s_chosen"),
                    F.round("s_rejected", 6).alias("s_rejected"))


@query("s6_read_head_score_objects", """
SELECT head_id, CAST(row_number() OVER (PARTITION BY head_id ORDER BY pair_id) - 1 AS BIGINT) AS pair_index,
       CAST(pair_id AS VARCHAR) AS id, 'set "' || CAST(subset AS VARCHAR) || '",' AS subset,
       round(s_chosen, 6) + 0.0 AS s_chosen, round(s_rejected, 6) + 0.0 AS s_rejected
FROM fx_scores""")
def s6_read_head_score_objects(spark, sf):
    """One object a head, written and read as lines."""
    path = scratch_path(spark, "head-objects")
    named = fx.scores(spark, sf).withColumn("subset", F.concat(F.lit('set "'), F.col("subset").cast("string"), F.lit('",')))
    ob.write_head_score_objects(named, path)
    s = ob.read_head_score_objects(spark, path)
    return s.select("head_id", "pair_index", "id", "subset", F.round("s_chosen", 6).alias("s_chosen"),
                    F.round("s_rejected", 6).alias("s_rejected"))


WIN_SQL = "CASE WHEN round(s_chosen - s_rejected, 9) > 0 THEN 1 ELSE 0 END"


@query("s7_read_combined_scores", f"""
WITH per AS (SELECT head_id, task_id, avg(CAST({WIN_SQL} AS DOUBLE)) AS a FROM fx_scores GROUP BY head_id, task_id),
heads AS (SELECT head_id, avg(CAST({WIN_SQL} AS DOUBLE)) AS a FROM fx_scores GROUP BY head_id)
SELECT h.head_id, 'task_' || CAST(t.task_id AS VARCHAR) AS metric, {rnd('p.a', 3)} AS value
FROM heads h CROSS JOIN fx_tasks t LEFT JOIN per p ON p.head_id = h.head_id AND p.task_id = t.task_id
UNION ALL SELECT head_id, 'overall' AS metric, {rnd('a', 3)} AS value FROM heads""")
def s7_read_combined_scores(spark, sf):
    path = scratch_path(spark, "combined")
    s = ev.with_win(fx.scores(spark, sf))
    wr.write_combined_scores(s, ev.task_accuracy(s, fx.N_TASKS), path)
    _, acc = rd.read_combined_scores(spark, path)
    return acc


@query("s7_combined_score_positions", """
SELECT head_id, CAST(row_number() OVER (PARTITION BY head_id ORDER BY pair_id) - 1 AS BIGINT) AS pair_index,
       task_id AS subset, round(s_chosen, 6) + 0.0 AS s_chosen, round(s_rejected, 6) + 0.0 AS s_rejected
FROM fx_scores""")
def s7_combined_score_positions(spark, sf):
    """The split layout, with the positions that the single-object form gives its arrays."""
    path = scratch_path(spark, "combined-positions")
    s = ev.with_win(fx.scores(spark, sf))
    wr.write_combined_scores(s, ev.task_accuracy(s, fx.N_TASKS), path)
    back = rd.with_pair_index(rd.read_combined_scores(spark, path)[0])
    return back.select("head_id", "pair_index", F.col("task_id").alias("subset"), F.round("s_chosen", 6).alias("s_chosen"),
                       F.round("s_rejected", 6).alias("s_rejected"))


@query("s7_read_combined_score_object", """
SELECT head_id, CAST(row_number() OVER (PARTITION BY head_id ORDER BY pair_id) - 1 AS BIGINT) AS pair_index,
       CAST(task_id AS INTEGER) AS subset, round(s_chosen, 6) + 0.0 AS s_chosen, round(s_rejected, 6) + 0.0 AS s_rejected
FROM fx_scores""")
def s7_read_combined_score_object(spark, sf):
    """One object with all heads, written and read as lines."""
    path = scratch_path(spark, "combined-object")
    s = ev.with_win(fx.scores(spark, sf))
    ob.write_combined_score_object(s, ev.task_accuracy(s, fx.N_TASKS), path)
    back = ob.read_combined_score_pieces(spark, path)
    return back.select("head_id", "pair_index", "subset", F.round("s_chosen", 6).alias("s_chosen"),
                       F.round("s_rejected", 6).alias("s_rejected"))


@query("s8_read_heads", """
SELECT name, CAST(row_number() OVER (ORDER BY CASE WHEN name = 'extra-head' THEN 1 ELSE 0 END, head_id) - 1 AS BIGINT)
       AS head_id, component, sign
FROM (SELECT 'head-PCA-component' || CAST(head_id AS VARCHAR) AS name, head_id, component, sign FROM fx_heads
      UNION ALL SELECT 'extra-head' AS name, CAST(-1 AS BIGINT), CAST(-1 AS INTEGER), CAST(1 AS INTEGER)
      FROM fx_original) t""")
def s8_read_heads(spark, sf):
    root = scratch_path(spark, "heads")
    wr.write_heads(fx.heads(spark, sf), root)
    extra = fx.original_head(spark, sf).select(
        F.lit(-1).cast("bigint").alias("head_id"), F.lit(-1).cast("int").alias("component"),
        F.lit(1).cast("int").alias("sign"), "w", F.lit("extra-head").alias("name"))
    extra.write.mode("append").parquet(f"{root}/heads")
    h = rd.read_heads(spark, f"{root}/heads")
    return h.select("name", "head_id", "component", "sign")


@query("k1_write_embeddings", """
SELECT pair_id, subset, CAST(pair_id % 4 AS INTEGER) AS bucket, chosen, rejected FROM fx_vec_pairs""")
def k1_write_embeddings(spark, sf):
    path = scratch_path(spark, "k1")
    wr.write_embeddings(fx.vec_pairs(spark, sf), path, n_buckets=4)
    # plain reader: the bucket comes back from the folder names
    return spark.read.parquet(path).select("pair_id", "subset", "bucket", "chosen", "rejected")


@query("k2_write_manifest", """
SELECT CAST(doc_id AS VARCHAR) AS pair_id, CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE text || chr(10) END AS prompts,
       '  ' || text || chr(9) AS chosen_responses, 'a,"b" ' || lang || chr(13) || chr(10) || ' c' AS rejected_responses,
       source AS task_ids
FROM documents""")
def k2_write_manifest(spark, sf):
    path = scratch_path(spark, "k2")
    fifth = F.col("doc_id") % 5
    man = fx.table(spark, sf, "documents").select(
        F.col("doc_id").alias("pair_id"),
        F.when(fifth == 0, "").when(fifth > 1, F.concat("text", F.lit("\n"))).alias("prompts"),
        F.concat(F.lit("  "), "text", F.lit("\t")).alias("chosen_responses"),
        F.concat(F.lit('a,"b" '), "lang", F.lit("\r\n c")).alias("rejected_responses"),
        F.col("source").alias("task_ids"))
    wr.write_manifest(man, path)
    return rd.read_manifest(spark, path).select("pair_id", "prompts", "chosen_responses", "rejected_responses", "task_ids")


@query("k3_write_heads", """
SELECT 'head-PCA-component' || CAST(head_id AS VARCHAR) AS name, head_id, component, sign, w, 'heads' AS part
FROM fx_heads
UNION ALL SELECT 'original-head' AS name, CAST(-1 AS BIGINT), CAST(-1 AS INTEGER), CAST(1 AS INTEGER), w,
       'original' AS part FROM fx_original""")
def k3_write_heads(spark, sf):
    root = scratch_path(spark, "k3")
    orig = fx.original_head(spark, sf).select(
        F.lit(-1).cast("bigint").alias("head_id"), F.lit(-1).cast("int").alias("component"),
        F.lit(1).cast("int").alias("sign"), "w")
    wr.write_heads(fx.heads(spark, sf), root, original=orig)
    h = spark.read.parquet(f"{root}/heads").withColumn("part", F.lit("heads"))
    o = spark.read.parquet(f"{root}/original").withColumn("part", F.lit("original"))
    return h.unionByName(o).select("name", "head_id", "component", "sign", "w", "part")


@query("k4_write_head_scores", """
SELECT head_id, pair_id, subset, round(s_chosen - s_rejected, 6) + 0.0 AS s_delta FROM fx_scores""")
def k4_write_head_scores(spark, sf):
    path = scratch_path(spark, "k4")
    wr.write_head_scores(fx.scores(spark, sf), path)
    # plain reader: one folder per head, head_id from the folder name
    back = spark.read.json(path)
    return back.select(F.col("head_id").cast("bigint").alias("head_id"), F.col("pair_id").cast("bigint"),
                       F.col("subset").cast("int"), F.round(F.col("s_chosen") - F.col("s_rejected"), 6).alias("s_delta"))


@query("k5_write_combined_scores", f"""
SELECT head_id, pair_id, task_id, {WIN_SQL} AS win FROM fx_scores""")
def k5_write_combined_scores(spark, sf):
    path = scratch_path(spark, "k5")
    s = ev.with_win(fx.scores(spark, sf))
    wr.write_combined_scores(s, ev.task_accuracy(s, fx.N_TASKS), path)
    scores, _ = rd.read_combined_scores(spark, path)
    return scores.select("head_id", "pair_id", "task_id", "win")


@query("k6_write_metrics", "SELECT 20 AS num_heads, 15 AS k, CAST(1.0 AS DOUBLE) AS temperature, q.* FROM ("
       + W(adapt_sql("section", K_SECTION), board_sql()) + STATS_SELECT + ") q")
def k6_write_metrics(spark, sf):
    from prefspark.plans.q_adapt import run
    a = run(spark, sf)
    tag = [F.lit(2 * fx.N_COMPONENTS).alias("num_heads"), F.lit(15).alias("k"), F.lit(1.0).alias("temperature")]
    metrics = ad.seed_statistics(ad.tta_section_scores(a.agg, fx.SECTION_MAP, fx.EXAMPLE_COUNTS))
    path = scratch_path(spark, "metrics")
    wr.write_metrics(metrics.select(*tag, "*"), a.weights.select(*tag, "*"), path)
    m = spark.read.parquet(f"{path}/metrics")
    return m.select("num_heads", "k", "temperature", "metric", "mean", "std")


@query("k6_write_weights", "SELECT 20 AS num_heads, 15 AS k, CAST(1.0 AS DOUBLE) AS temperature, q.* FROM ("
       + W(adapt_sql("section", K_SECTION)) + "SELECT seed, grp, head_id, round(weight, 6) AS weight FROM weights) q")
def k6_write_weights(spark, sf):
    from prefspark.plans.q_adapt import run
    a = run(spark, sf)
    tag = [F.lit(2 * fx.N_COMPONENTS).alias("num_heads"), F.lit(15).alias("k"), F.lit(1.0).alias("temperature")]
    path = scratch_path(spark, "weights")
    wr.write_metrics(a.stats.select(*tag, "*"), a.weights.select(*tag, "*"), path)
    w = spark.read.parquet(f"{path}/weights")
    return w.select("num_heads", "k", "temperature", "seed", "grp", "head_id", F.round("weight", 6).alias("weight"))


@query("k7_missing_pairs", "SELECT pair_id FROM fx_vec_pairs WHERE pair_id % 3 <> 0")
def k7_missing_pairs(spark, sf):
    path = scratch_path(spark, "done")
    p = fx.vec_pairs(spark, sf)
    wr.write_embeddings(p.filter(F.col("pair_id") % 3 == 0), path, n_buckets=4)
    return wr.missing_pairs(p.select("pair_id"), rd.read_embeddings(spark, path))


@query("k7_committed_runs", """
SELECT pair_id, subset, CASE WHEN pair_id % 3 = 0 THEN 0 ELSE 1 END AS run, 'prompt ' || CAST(pair_id AS VARCHAR) AS prompts
FROM fx_vec_pairs""")
def k7_committed_runs(spark, sf):
    """Two sinks in runs: a third of the pairs, a run that breaks between its
    sinks, and the rest; a reader sees both sinks of the finished ones."""
    path = scratch_path(spark, "runs")
    p = fx.vec_pairs(spark, sf)

    def sinks(df, broken=False):
        def texts(folder):
            if broken:
                raise InterruptedError
            wr.write_manifest(df.select("pair_id", F.concat(F.lit("prompt "), F.col("pair_id").cast("string")).alias("prompts")), folder)
        return {"vectors": lambda folder: wr.write_embeddings(df, folder, n_buckets=4), "manifest": texts}

    def read(name, reader):
        return wr.read_runs(spark, path, name, lambda folder: reader(spark, folder))
    wr.append_run(spark, path, sinks(p.filter(F.col("pair_id") % 3 == 0)))
    try:
        wr.append_run(spark, path, sinks(p.filter(F.col("pair_id") % 3 == 1), broken=True))
    except InterruptedError:
        pass
    wr.append_run(spark, path, sinks(p.join(read("vectors", rd.read_embeddings).select("pair_id"), "pair_id", "left_anti")))
    texts = read("manifest", rd.read_manifest).select(F.col("pair_id").cast("bigint").alias("pair_id"), "run", "prompts")
    return read("vectors", rd.read_embeddings).join(texts, ["pair_id", "run"]).select("pair_id", "subset", "run", "prompts")


@query("k7_incremental_scoring_stream", """
SELECT pair_id, subset, head_id, round(s_chosen, 6) + 0.0 AS s_chosen, round(s_rejected, 6) + 0.0 AS s_rejected
FROM fx_scores""")
def k7_incremental_scoring_stream(spark, sf):
    src, sink = scratch_path(spark, "stream-src"), scratch_path(spark, "stream-sink")
    ckpt = scratch_path(spark, "stream-ckpt")
    p = fx.vec_pairs(spark, sf)
    heads = fx.heads(spark, sf)
    p.filter(F.col("pair_id") % 2 == 0).write.parquet(src)
    schema = spark.read.parquet(src).schema
    score_new_pairs(spark, src, schema, heads, sink, ckpt)
    p.filter(F.col("pair_id") % 2 == 1).write.mode("append").parquet(src)
    score_new_pairs(spark, src, schema, heads, sink, ckpt)
    out = spark.read.parquet(sink)
    return out.select("pair_id", "subset", "head_id", F.round("s_chosen", 6).alias("s_chosen"),
                      F.round("s_rejected", 6).alias("s_rejected"))


@query("k8_materialise_once", """
SELECT pair_id, head_id, round(s_chosen, 6) + 0.0 AS s_chosen FROM fx_scores""")
def k8_materialise_once(spark, sf):
    path = scratch_path(spark, "materialised")
    build = lambda: fx.scores(spark, sf).select("pair_id", "head_id", "s_chosen")
    wr.materialise_once(spark, path, build)
    again = wr.materialise_once(spark, path, lambda: (_ for _ in ()).throw(RuntimeError("rebuilt")))
    return again.select("pair_id", "head_id", F.round("s_chosen", 6).alias("s_chosen"))


@query("k9_write_subset_accuracy_lines", f"""
SELECT head_id, subset, avg(CAST({WIN_SQL} AS DOUBLE)) AS accuracy, count(*) AS n
FROM fx_scores GROUP BY head_id, subset""")
def k9_write_subset_accuracy_lines(spark, sf):
    path = scratch_path(spark, "subset-acc-lines")
    wr.write_subset_accuracy(ev.subset_accuracy(ev.with_win(fx.scores(spark, sf))), path)
    return spark.read.json(path, schema="head_id bigint, subset int, accuracy double, n bigint")


@query("k9_write_subset_accuracy", f"""
SELECT head_id, CAST(subset AS VARCHAR) AS subset, avg(CAST({WIN_SQL} AS DOUBLE)) AS accuracy
FROM fx_scores GROUP BY head_id, subset""")
def k9_write_subset_accuracy(spark, sf):
    path = scratch_path(spark, "subset-acc")
    acc = ev.subset_accuracy(ev.with_win(fx.scores(spark, sf)))
    wr.write_subset_accuracy(acc, path, as_object=True)
    back = spark.read.text(path)
    m = back.select(F.col("head_id").cast("bigint").alias("head_id"),
                    F.explode(F.from_json("value", "map<string,double>")).alias("subset", "accuracy"))
    return m
