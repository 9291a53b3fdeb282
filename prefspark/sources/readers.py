"""Sources (S1-S8).

Every reader returns a DataFrame with an explicit schema.  The reference's
single-object layouts (one JSON object per head holding every pair, one
JSON object holding every head) are read as they are; such a file is one
record and so one task; ``objects.py`` reads and writes indented ones in
pieces, and the writers in ``writers.py`` default to row-per-pair layouts.
"""

from __future__ import annotations

import io
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefspark.operators.adapt import checked_broadcast
from prefspark.operators.pairs import with_pair_id
from prefspark.operators.scoring import explode_scores
from prefspark.session import path_exists

MESSAGE = T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])
MESSAGES = T.ArrayType(MESSAGE)
PAIR_SCHEMA = T.StructType([
    T.StructField("pair_id", T.LongType()),
    T.StructField("chosen", MESSAGES),
    T.StructField("rejected", MESSAGES),
    T.StructField("source", T.StringType()),
    T.StructField("margin", T.DoubleType()),
])
CHOICE_SCHEMA = T.StructType([
    T.StructField("pair_id", T.LongType()),
    T.StructField("input", T.StringType()),
    T.StructField("targets", T.StructType([
        T.StructField("choices", T.ArrayType(T.StringType())),
        T.StructField("labels", T.ArrayType(T.IntegerType()))])),
])
VEC = T.ArrayType(T.FloatType())


def read_pairs(spark: SparkSession, path: str, fmt: str = "parquet",
               schema: T.StructType = PAIR_SCHEMA) -> DataFrame:
    """Message-pair source (``chosen``/``rejected`` arrays of role/content)."""
    return spark.read.schema(schema).format(fmt).load(path)


def read_tagged(spark: SparkSession, paths: Sequence[str], fmt: str = "json",
                schema: T.StructType = CHOICE_SCHEMA) -> DataFrame:
    """One file (or folder) per task, tagged with its ordinal in ``paths``
    and concatenated in that order."""
    out = None
    for i, p in enumerate(paths):
        df = spark.read.schema(schema).format(fmt).load(p).withColumn("task_id", F.lit(i).cast("int"))
        out = df if out is None else out.unionByName(df)
    return out


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """S3: pair vectors written as parquet (any number of files / buckets)."""
    return spark.read.parquet(path)


def _npy_rows(batches):
    for pdf in batches:
        out = {"pair_id": [], "chosen": [], "rejected": [], "prompt_prev": [], "prompt_last": []}
        for path, content in zip(pdf["path"], pdf["content"]):
            arr = np.load(io.BytesIO(content))
            if arr.ndim == 2:
                arr = arr[None, ...]
            name = path.rsplit("/", 1)[-1]
            out["pair_id"].append(int(name[len("emb_"):].split(".")[0]))
            out["chosen"].append(arr[0, 0].astype(np.float32))
            out["rejected"].append(arr[0, 1].astype(np.float32))
            out["prompt_prev"].append(arr[0, 2].astype(np.float32) if arr.shape[1] > 2 else None)
            out["prompt_last"].append(arr[0, 3].astype(np.float32) if arr.shape[1] > 3 else None)
        yield pd.DataFrame(out)


def read_npy_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    """S3 (.npy import): ``emb_<id>.npy`` files of shape (1, 2|4, d) or (2, d);
    slots are chosen, rejected and the two prompt-boundary vectors.  Files
    are read in parallel by ``binaryFile``; order is irrelevant."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "emb_*.npy").load(folder)
    schema = T.StructType([T.StructField("pair_id", T.LongType()), T.StructField("chosen", VEC),
                           T.StructField("rejected", VEC), T.StructField("prompt_prev", VEC),
                           T.StructField("prompt_last", VEC)])
    return files.select("path", "content").mapInPandas(_npy_rows, schema)


def resolve_paths(manifest: DataFrame, vectors: DataFrame, old_prefix: str, new_prefix: str,
                  path_col: str = "cls_emb", key: str = "path") -> DataFrame:
    """S4 lookup: each manifest row tries its path, then the path with the
    prefix rewritten (the reference's fallback); the first that exists wins.

    Two left joins, so every manifest row stays (repeated and null paths
    too), with nulls where neither path has a vector.  ``vectors`` has one
    row per ``key``.
    """
    cols = [c for c in vectors.columns if c != key]

    def side(n: int) -> DataFrame:
        return vectors.select(F.col(key).alias(f"_k{n}"), *[F.col(c).alias(f"_{c}_{n}") for c in cols])
    path = F.col(path_col)
    alt = F.when(path.startswith(old_prefix), F.concat(F.lit(new_prefix), F.substring(
        path, len(old_prefix) + 1, F.length(path))))
    j = manifest.join(side(0), path == F.col("_k0"), "left").withColumn("_alt", F.when(F.col("_k0").isNull(), alt))
    j = j.join(side(1), F.col("_alt") == F.col("_k1"), "left")
    found = [F.when(F.col("_k0").isNotNull(), F.col(f"_{c}_0")).otherwise(F.col(f"_{c}_1")).alias(c) for c in cols]
    return j.select(*manifest.columns, *found)


#: How the manifest CSV tells null from the empty string and keeps blanks
#: (fixed values of the format).
MANIFEST_OPTIONS = {"header": True, "quote": '"', "escape": '"', "nullValue": "\\N",
                    "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "lineSep": "\n"}
#: What stands in a cell for a backslash and for line ends, in the order of
#: writing; a text never holds a bare backslash, so ``\\N`` is null alone.
MANIFEST_ESCAPES = (("\\", "\\b"), ("\n", "\\n"), ("\r", "\\r"))


def manifest_cell(text: Column) -> Column:
    """A text on one line."""
    for plain, cell in MANIFEST_ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(cell))
    return text


def manifest_text(cell: Column) -> Column:
    """The text of a cell."""
    for plain, escaped in reversed(MANIFEST_ESCAPES):
        cell = F.replace(cell, F.lit(escaped), F.lit(plain))
    return cell


def read_manifest(spark: SparkSession, path: str, escaped: bool = True) -> DataFrame:
    """Manifest CSV (prompts, chosen/rejected responses, vector path,
    optional task id).  Texts come back as they were written; ``\\N`` is null.
    A record is a line, so large files are split among tasks.  ``escaped=False``
    reads manifests whose quoted cells hold line ends as they are (one task a
    file)."""
    if not escaped:
        return spark.read.options(**MANIFEST_OPTIONS).option("multiLine", True).csv(path)
    rows = spark.read.options(**MANIFEST_OPTIONS).csv(path)
    return rows.select(*[manifest_text(F.col(c)).alias(c) for c in rows.columns])


def read_bundle(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation bundle (id, subset, chosen, rejected) as a table."""
    return spark.read.parquet(path)


def bundle_from_aligned(df: DataFrame) -> DataFrame:
    """S5 (aligned-array form): one record of aligned ``ids``/``subsets``/
    ``embs`` arrays -> one row per pair.  The record is one task; use only
    for bounded bundles."""
    z = F.arrays_zip(F.col("ids").alias("id"), F.col("subsets").alias("subset"), F.col("embs").alias("e"))
    return df.select(F.inline(z)).select("id", "subset", F.col("e")[0].alias("chosen"),
                                         F.col("e")[1].alias("rejected"))


def _head_number(path_col) -> F.Column:
    """Integer after the last ``_`` of a file name (without extension)."""
    name = F.regexp_extract(path_col, r"([^/]+?)(\.[^./]*)?$", 1)
    return F.regexp_extract(name, r"_(\d+)$", 1).try_cast("bigint")


def read_head_scores_files(spark: SparkSession, folder: str) -> DataFrame:
    """S6 (one JSON object per head, as the reference writes it): head order
    is the integer after the last ``_`` of the file name; ``[x]`` becomes
    ``x``; the ``results_leaderboard`` key is ignored; the position in the
    arrays is the pair's index.  Each file is one record (one task)."""
    schema = T.StructType([
        T.StructField("id", T.ArrayType(T.StringType())),
        T.StructField("subset", T.ArrayType(T.StringType())),
        T.StructField("scores_chosen", T.ArrayType(T.ArrayType(T.DoubleType()))),
        T.StructField("scores_rejected", T.ArrayType(T.ArrayType(T.DoubleType())))])
    df = (spark.read.schema(schema).option("multiLine", True).json(folder)
          .withColumn("_path", F.input_file_name()))
    df = df.withColumn("head_id", _head_number(F.col("_path")))
    z = F.arrays_zip(F.col("id"), F.col("subset"), F.col("scores_chosen").alias("c"),
                     F.col("scores_rejected").alias("r"))
    ex = df.select("head_id", F.posexplode(z).alias("pair_index", "t"))
    return ex.select("head_id", F.col("pair_index").cast("bigint").alias("pair_index"),
                     F.col("t.id").alias("id"), F.col("t.subset").alias("subset"),
                     F.try_element_at("t.c", F.lit(1)).alias("s_chosen"),
                     F.try_element_at("t.r", F.lit(1)).alias("s_rejected"))


def read_head_scores(spark: SparkSession, folder: str, subset_type: str = "string") -> DataFrame:
    """S6 (row-per-pair layout written by ``write_head_scores``); subsets are
    names unless the caller gives another type."""
    return spark.read.json(folder, schema=f"pair_id bigint, subset {subset_type}, s_chosen double, "
                                          "s_rejected double, head_id bigint")


def read_combined_scores_object(spark: SparkSession, path: str) -> DataFrame:
    """S7 (one JSON object ``head_i -> {scores_chosen, scores_rejected,
    overall_accuracy, per_task_accuracy, task_ids}``): one row per
    (head, pair position); ``task_ids`` becomes ``subset``."""
    entry = ("struct<scores_chosen: array<double>, scores_rejected: array<double>, "
             "overall_accuracy: double, per_task_accuracy: map<string,double>, task_ids: array<int>>")
    raw = spark.read.text(path, wholetext=True)
    m = raw.select(F.explode(F.from_json("value", f"map<string,{entry}>")).alias("key", "v"))
    z = F.arrays_zip(F.col("v.scores_chosen").alias("c"), F.col("v.scores_rejected").alias("r"),
                     F.col("v.task_ids").alias("t"))
    return m.select(F.regexp_extract("key", r"_(\d+)$", 1).cast("bigint").alias("head_id"),
                    F.posexplode(z).alias("pair_index", "x")).select(
        "head_id", F.col("pair_index").cast("bigint").alias("pair_index"),
        F.col("x.t").alias("subset"), F.col("x.c").alias("s_chosen"), F.col("x.r").alias("s_rejected"))


def read_packed_scores(spark: SparkSession, folder: str) -> tuple[DataFrame, list[int]]:
    """S7 (hand-over form written by ``write_packed_scores``): one row per pair
    and the head ids in the order of its arrays (a row a head)."""
    order = spark.read.schema("position int, head_id bigint").parquet(f"{folder}/packed_heads").orderBy("position")
    return spark.read.parquet(f"{folder}/packed"), [r.head_id for r in order.toLocalIterator()]


def read_combined_scores(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Scores and per-head accuracies, from the long rows that
    ``write_combined_scores`` leaves or, where there are none, from the packed
    ones of ``write_packed_scores`` (exploded in place, no shuffle)."""
    if path_exists(spark, f"{folder}/scores"):
        scores = spark.read.parquet(f"{folder}/scores")
    else:
        scores = explode_scores(*read_packed_scores(spark, folder))
    acc = spark.read.parquet(f"{folder}/accuracy")
    return scores, acc


def with_pair_index(scores: DataFrame) -> DataFrame:
    """Add ``pair_index``, the 0-based position of a pair among its head's
    pairs in the order of ``pair_id``: dense ids over (head, pair) less the
    head's first one.  No head is gathered in one task or record."""
    ids = with_pair_id(scores, ["head_id", "pair_id"], "_id")
    first = ids.groupBy("head_id").agg(F.min("_id").alias("_first"))
    return (ids.join(checked_broadcast(first), "head_id")
            .withColumn("pair_index", F.col("_id") - F.col("_first")).drop("_id", "_first"))


def read_heads(spark: SparkSession, path: str, name_col: str = "name") -> DataFrame:
    """Head vectors ordered by the number in their ``component<k>`` name
    suffix; names without one sort last.  ``head_id`` = 0-based rank."""
    from pyspark.sql import Window
    df = spark.read.parquet(path)
    num = F.regexp_extract(F.col(name_col), r"component(\d+)$", 1)
    k = F.when(num == "", None).otherwise(num).cast("bigint")
    w = Window.orderBy(F.col("_k").asc_nulls_last(), F.col(name_col))
    return (df.withColumn("_k", k).withColumn("head_id", (F.row_number().over(w) - 1).cast("bigint"))
            .drop("_k"))


def lookup_pairs(spark: SparkSession, path: str, ids: DataFrame, n_buckets: int) -> DataFrame:
    """Rows of a bucketed pair-vector table (written by ``write_embeddings``
    with ``n_buckets``) for the pairs in ``ids``, in the table's columns.

    A join on (bucket, pair_id): dynamic partition pruning skips the folders
    of buckets that no id falls in, whatever the number of ids."""
    table = read_embeddings(spark, path)
    keys = ids.select(F.col("pair_id").alias("_id")).distinct()
    keys = keys.withColumn("_bucket", F.pmod(F.col("_id"), F.lit(n_buckets)).cast("int"))
    hit = (table["bucket"] == keys["_bucket"]) & (table["pair_id"] == keys["_id"])
    return table.join(keys, hit).select(*[table[c] for c in table.columns])
