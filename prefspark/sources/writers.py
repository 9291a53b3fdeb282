"""Sinks and incremental runs (K1-K9).

Writers are plain DataFrame writes: one file per task, never one file per
row, never one record holding a whole table.  Outputs land under paths
the caller chooses (on a cluster: a shared folder).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prefspark.session import path_exists, remove_path
from prefspark.sources.readers import MANIFEST_OPTIONS, manifest_cell

N_BUCKETS_DEFAULT = 64


#: Bytes of a file wanted, and of a row of scores as JSON (about).
FILE_BYTES, SCORE_BYTES = 128 << 20, 128


def _dealt(df: DataFrame, folder: str, files: int | None, groups: int, row_bytes: int) -> DataFrame:
    """Rows of a folder in ``files`` tasks, whatever the number of input
    tasks; without a number, in as many as its counted rows need for files of
    about ``FILE_BYTES``, so a folder with a third of all rows gets many files
    and a small one gets one."""
    if files is not None:
        salt = F.pmod(F.xxhash64("pair_id"), F.lit(files))
        return df.repartition(groups * files, F.col(folder), salt).sortWithinPartitions(folder, "pair_id")
    need = F.ceil(F.count(F.lit(1)) * row_bytes / FILE_BYTES).cast("int")
    sizes = df.groupBy(F.col(folder).alias("_folder")).agg(need.alias("_files"))  # a row for each folder
    sizes = sizes.withColumn("_from", F.sum("_files").over(Window.orderBy("_folder")) - F.col("_files"))
    n = int(sizes.agg(F.sum("_files")).first()[0] or 1)
    rows = df.join(F.broadcast(sizes), F.col(folder).eqNullSafe(F.col("_folder")))
    task = (F.col("_from") + F.pmod(F.xxhash64("pair_id"), F.col("_files"))).cast("int")
    return rows.repartitionById(n, task).sortWithinPartitions(folder, "pair_id").drop("_folder", "_files", "_from")


def write_embeddings(df: DataFrame, path: str, n_buckets: int = N_BUCKETS_DEFAULT,
                     mode: str = "overwrite", files_per_bucket: int | None = None) -> None:
    """K1: pair vectors keyed by ``pair_id``, split into ``pmod(pair_id, n)``
    bucket folders so a reader can prune by key.  One shuffle deals each
    bucket to ``files_per_bucket`` tasks, or, without a number, to as many as
    its counted rows need, so the number of files does not depend on the
    number of input tasks; files are sorted by ``pair_id``, so row-group
    statistics let filters skip data inside a file."""
    first = df.select(F.size("chosen").alias("d")).where("d > 0").first() if files_per_bucket is None else None
    width = 64 + 16 * (first.d if first else 1)  # two vectors of doubles
    keyed = df.withColumn("bucket", F.pmod(F.col("pair_id"), F.lit(n_buckets)).cast("int"))
    _dealt(keyed, "bucket", files_per_bucket, n_buckets, width).write.mode(mode).partitionBy("bucket").parquet(path)


def write_manifest(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K2: prompt, answers, key of the vector and task id (if any), as CSV with
    a record on each line (line ends and backslashes of texts escaped)."""
    cols = [c for c in ("pair_id", "prompts", "chosen_responses", "rejected_responses", "cls_emb", "task_ids")
            if c in df.columns]
    texts = {c for c, kind in df.dtypes if kind == "string"}
    df.select(*[manifest_cell(F.col(c)).alias(c) if c in texts else F.col(c) for c in cols]).write.mode(mode).options(
        **MANIFEST_OPTIONS).csv(path)


def write_heads(heads: DataFrame, path: str, original: DataFrame | None = None,
                name_prefix: str = "head-PCA-component", mode: str = "overwrite") -> None:
    """K3: heads with a ``name`` ending in ``component<k>`` (k = head id); the
    original head, when given, is kept apart under ``<path>/original``."""
    named = heads.withColumn("name", F.concat(F.lit(name_prefix), F.col("head_id").cast("string")))
    named.write.mode(mode).parquet(f"{path}/heads")
    if original is not None:
        original.withColumn("name", F.lit("original-head")).write.mode(mode).parquet(f"{path}/original")


def write_head_scores(scores: DataFrame, path: str, mode: str = "overwrite", n_heads: int = 64,
                      files_per_head: int | None = None) -> None:
    """K4: per-head scores, one folder per head, JSON lines (replaces old
    output).  One shuffle deals a head's rows to ``files_per_head`` tasks, or,
    without a number, to as many as its counted rows need; ``n_heads`` sizes
    the shuffle for a given number."""
    rows = scores.select("head_id", "pair_id", "subset", "s_chosen", "s_rejected")
    _dealt(rows, "head_id", files_per_head, n_heads, SCORE_BYTES).write.mode(mode).partitionBy("head_id").json(path)


def write_combined_scores(scores: DataFrame, accuracy: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K5: the combined result as two tables: scores per (head, pair) and
    per-head accuracies (overall and per task).  Overwriting replaces packed
    scores at the path too: a folder holds one form."""
    if mode == "overwrite":
        remove_path(scores.sparkSession, f"{path}/packed")
    scores.write.mode(mode).parquet(f"{path}/scores")
    accuracy.write.mode(mode).parquet(f"{path}/accuracy")


def write_packed_scores(packed: DataFrame, head_ids: Sequence[int], path: str, mode: str = "overwrite") -> None:
    """K5, hand-over form: one row per pair with ``sc`` / ``sr`` in the order of
    ``head_ids``, and the order as a table of its own, written first.  A pair
    stays one row from scoring to adaptation, so neither side shuffles pairs;
    ``read_combined_scores`` gives the long rows.  Null scores stay null, other
    columns are kept, an empty table gives an empty one.  Overwriting replaces
    long rows at the path too: a folder holds one form."""
    spark = packed.sparkSession
    if mode == "overwrite":
        remove_path(spark, f"{path}/scores")
    order = spark.createDataFrame(list(enumerate(map(int, head_ids))), "position int, head_id bigint")
    order.coalesce(1).write.mode(mode).parquet(f"{path}/packed_heads")
    packed.write.mode(mode).parquet(f"{path}/packed")


def write_subset_accuracy(acc: DataFrame, path: str, as_object: bool = False, mode: str = "overwrite") -> None:
    """K9: per-head subset accuracies.  Default: JSON lines; ``as_object``:
    one sorted JSON object per head (``{subset: accuracy}``), grouped by head
    (bounded by the number of subsets)."""
    if as_object:
        obj = acc.groupBy("head_id").agg(
            F.to_json(F.map_from_entries(F.sort_array(F.collect_list(
                F.struct(F.col("subset").cast("string"), F.col("accuracy")))))).alias("value"))
        obj.select("head_id", "value").write.mode(mode).partitionBy("head_id").text(path)
    else:
        acc.write.mode(mode).json(path)


def write_metrics(metrics: DataFrame, weights: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K6: metric and weight tables per configuration (heads, k, temperature)."""
    keys = ["num_heads", "k", "temperature"]
    metrics.write.mode(mode).partitionBy(*keys).parquet(f"{path}/metrics")
    weights.write.mode(mode).partitionBy(*keys).parquet(f"{path}/weights")


def missing_pairs(all_pairs: DataFrame, done: DataFrame, key: str = "pair_id") -> DataFrame:
    """K7: pairs not yet written (skip finished work on restart)."""
    return all_pairs.join(done.select(key).distinct(), key, "left_anti")


def _commits(spark: SparkSession, out_path: str):
    """The folder of commit marks and its file system."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{out_path.rstrip('/')}/_commits")
    return folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def committed_runs(spark: SparkSession, out_path: str) -> list[int]:
    """K7: the numbers of the runs that ``append_run`` finished, ascending."""
    folder, files = _commits(spark, out_path)
    if not files.exists(folder):
        return []
    return sorted(int(f.getPath().getName().removeprefix("run-")) for f in files.listStatus(folder))


def append_run(spark: SparkSession, out_path: str, sinks: Mapping[str, Callable[[str], None]]) -> int:
    """K7 with several sinks: every sink writes its folder ``<name>/run=<n>``,
    then one mark commits them all; its number is returned.

    Readers (``read_runs``) see the sinks of committed runs alone, so a run
    that was killed between two sinks, or inside one, shows nothing, and the
    next run takes its number and replaces what it left.  The mark is an empty
    file made only if it is not there: of two writers with one number the
    second raises (their data would mix: let one writer run at a time).
    """
    done = committed_runs(spark, out_path)
    run = done[-1] + 1 if done else 0
    root = out_path.rstrip("/")
    for name in sinks:  # all leftovers first, so that no sink sees another's
        remove_path(spark, f"{root}/{name}/run={run}")
    for name, write in sinks.items():
        write(f"{root}/{name}/run={run}")
    folder, files = _commits(spark, out_path)
    files.create(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder, f"run-{run}"), False).close()
    return run


def read_runs(spark: SparkSession, out_path: str, name: str, read: Callable[[str], DataFrame]) -> DataFrame | None:
    """The rows of a sink over all committed runs, with ``run``; None before
    the first.  ``read`` reads one run's folder."""
    out = None
    for run in committed_runs(spark, out_path):
        rows = read(f"{out_path.rstrip('/')}/{name}/run={run}").withColumn("run", F.lit(run))
        out = rows if out is None else out.unionByName(rows)
    return out


def materialise_once(spark: SparkSession, path: str, builder: Callable[[], DataFrame]) -> DataFrame:
    """K8: reuse the finished table at ``path``; build and write it when it is
    missing or lacks the success mark that Spark's committer leaves last (an
    aborted write, or one whose parts were removed with its mark)."""
    if not path_exists(spark, f"{path.rstrip('/')}/_SUCCESS"):
        builder().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
