"""Scoring pairs under linear heads.

A head is a row ``(head_id, w array<double>)``; the score of a side is
``w . e`` with no bias.  The head set is small and its size is checked
before it is shipped to executors (H x d doubles: 100 x 2048 = 1.6 MB,
4096 x 2048 = 67 MB).  Pairs are never shuffled: every pair row gains its
scores in place, as packed ``array<double>`` columns in head-id order.

* ``method="arrow"`` (default): Arrow batches, one numpy matrix product per
  batch against a broadcast head matrix.  Head sets larger than
  ``max_broadcast_bytes`` are split into blocks, one broadcast each.
* ``score_heads_tiled``: a block matrix product for head sets that do not fit
  the driver; head blocks are rows of a table, nothing is broadcast.
* ``method="native"``: the head matrix as a plan literal and built-in
  ``transform``/``aggregate`` expressions; for small head sets.

The long form (G1) is the packed form exploded by position, so no pair x
head join is ever planned.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefspark.functions.vectors import dot
from prefspark.session import write_and_read

DEFAULT_MAX_BROADCAST_BYTES = 256 * 1024 * 1024
DEFAULT_MAX_LITERAL_BYTES = 4 * 1024 * 1024
MAX_HEADS = 1 << 20


@dataclass(frozen=True)
class HeadMatrix:
    """Head ids in ascending order and the matching (H, d) weight matrix."""

    ids: list[int]
    w: np.ndarray

    @property
    def nbytes(self) -> int:
        return int(self.w.nbytes)


def collect_heads(heads: DataFrame, id_col: str = "head_id", w_col: str = "w",
                  max_bytes: int = 512 * 1024 * 1024) -> HeadMatrix:
    """Bring a head table to the driver after checking its size.

    The head table is a model (H x d), not data: it does not grow with the
    number of pairs.  The check refuses a head set that would not fit.
    """
    heads = write_and_read(heads.select(id_col, w_col), "heads")  # made once, then measured and fetched
    stats = heads.agg(F.count(F.lit(1)).alias("n"),
                      F.max(F.size(w_col)).alias("d")).first()
    n, d = int(stats["n"]), int(stats["d"] or 0)
    if n > MAX_HEADS or n * d * 8 > max_bytes:
        raise ValueError(f"head set of {n} x {d} doubles exceeds {max_bytes} bytes")
    rows = heads.select(F.col(id_col).cast("long").alias("i"),
                        F.col(w_col).cast("array<double>").alias("w")).collect()
    rows.sort(key=lambda r: r["i"])
    ids = [int(r["i"]) for r in rows]
    w = np.array([r["w"] for r in rows], dtype=np.float64).reshape(len(rows), d)
    return HeadMatrix(ids, w)


def vector_rows(column, d: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(matrix, usable): the usable vectors of an Arrow list column as rows of
    doubles, from its flat buffer (no Python object per row), and which rows
    they are.  A vector is usable when neither it nor an element of it is
    null and it has ``d`` elements (by default as many as the first)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    usable = np.ones(n, bool) if not column.null_count else column.is_valid().to_numpy(zero_copy_only=False)
    lengths = np.diff(column.offsets.to_numpy()) * usable
    if d is None:
        d = int(lengths[usable][0]) if usable.any() else 0
    flat = column.flatten()  # without what null rows may hold
    if flat.null_count:
        row = np.repeat(np.arange(n), lengths)
        usable = usable & (np.bincount(row[flat.is_null().to_numpy(zero_copy_only=False)], minlength=n) == 0)
    usable = usable & (lengths == d)
    values = flat.to_numpy(zero_copy_only=False)
    if not usable.all():
        values = values[np.repeat(usable, lengths)]
    return values.reshape(int(usable.sum()), d).astype(np.float64, copy=False), usable


def list_matrix(column) -> np.ndarray:
    """An Arrow list column as one (n, d) double matrix; raises unless every
    vector is present, whole and as long as the first."""
    x, usable = vector_rows(column)
    if not usable.all():
        raise ValueError("vectors must be present, without nulls and of one length")
    return x


def list_column(matrix: np.ndarray, usable: np.ndarray | None = None):
    """An (n, h) matrix as an Arrow list column over its flat buffer; with
    ``usable``, its rows go to the places that are, the others are null."""
    n, h = matrix.shape
    if usable is None or usable.all():
        return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * h), pa.array(matrix.reshape(-1)))
    ends = np.concatenate(([0], np.cumsum(usable))).astype(np.int32) * np.int32(h)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(matrix.reshape(-1)), mask=pa.array(~usable))


def _block_udf(bc):
    """An Arrow UDF scoring one side against one broadcast block of heads;
    vectors that are null, hold a null or have another length get null."""

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def block_scores(v: pa.Array) -> pa.Array:
        m, shift = bc.value
        x, usable = vector_rows(v, m.shape[0])
        return list_column((x if shift is None else x - shift) @ m, usable)

    return block_scores


def _arrow_scores(vec: Column, hm: HeadMatrix, spark, max_bytes: int, shift=None) -> Column:
    """Packed scores of one side via Arrow batches and numpy matmul."""
    d = hm.w.shape[1]
    rows_per_block = max(1, max_bytes // max(1, d * 8))
    blocks = []
    for start in range(0, len(hm.ids), rows_per_block):
        bc = spark.sparkContext.broadcast((hm.w[start:start + rows_per_block].T.copy(), shift))
        blocks.append(_block_udf(bc)(vec))
    return blocks[0] if len(blocks) == 1 else F.concat(*blocks)


def score_column(vec: Column, hm: HeadMatrix, spark, method: str = "arrow",
                 max_broadcast_bytes: int = DEFAULT_MAX_BROADCAST_BYTES, shift=None) -> Column:
    """Packed ``w . v`` of one vector column under every row of ``hm``, or
    ``w . (v - shift)`` (Arrow only)."""
    if method == "native":
        if hm.nbytes > DEFAULT_MAX_LITERAL_BYTES:
            raise ValueError(f"method 'native' takes head sets up to {DEFAULT_MAX_LITERAL_BYTES} bytes")
        return _native_scores(vec, hm)
    return _arrow_scores(vec, hm, spark, max_broadcast_bytes, shift)


def _native_scores(vec: Column, hm: HeadMatrix) -> Column:
    w_lit = F.lit(hm.w.tolist()).cast("array<array<double>>")
    return F.transform(w_lit, lambda w: dot(vec, w))


def score_heads_packed(pairs: DataFrame, heads: DataFrame | HeadMatrix,
                       chosen: str = "chosen", rejected: str = "rejected",
                       method: str = "arrow",
                       max_broadcast_bytes: int = DEFAULT_MAX_BROADCAST_BYTES,
                       drop_vectors: bool = True) -> tuple[DataFrame, list[int]]:
    """Add ``sc``/``sr`` (scores of chosen / rejected under every head,
    in ascending head-id order).  Returns the frame and the head ids."""
    hm = heads if isinstance(heads, HeadMatrix) else collect_heads(heads)
    if method == "native" and hm.nbytes > DEFAULT_MAX_LITERAL_BYTES:
        raise ValueError(f"method 'native' takes head sets up to {DEFAULT_MAX_LITERAL_BYTES} bytes")
    spark = pairs.sparkSession
    if method == "arrow":
        sc = _arrow_scores(F.col(chosen), hm, spark, max_broadcast_bytes)
        sr = _arrow_scores(F.col(rejected), hm, spark, max_broadcast_bytes)
    elif method == "native":
        sc = _native_scores(F.col(chosen), hm)
        sr = _native_scores(F.col(rejected), hm)
    else:
        raise ValueError(f"unknown method {method!r}")
    out = pairs.withColumn("sc", sc).withColumn("sr", sr)
    if drop_vectors:
        out = out.drop(chosen, rejected)
    return out, hm.ids


def explode_scores(packed: DataFrame, head_ids: list[int], keep: list[str] | None = None) -> DataFrame:
    """Packed scores -> long rows ``(..., head_id, s_chosen, s_rejected)``; a
    side without scores has null under every head."""
    keep = keep if keep is not None else [c for c in packed.columns if c not in ("sc", "sr")]
    ids = F.lit([int(i) for i in head_ids]).cast("array<bigint>")
    none = F.array_repeat(F.lit(None).cast("double"), len(head_ids))
    z = F.arrays_zip(ids.alias("head_id"), F.coalesce("sc", none).alias("s_chosen"),
                     F.coalesce("sr", none).alias("s_rejected"))
    return packed.select(*keep, F.inline(z))


def score_heads(pairs: DataFrame, heads: DataFrame | HeadMatrix, keep: list[str] | None = None,
                method: str = "arrow", **kw) -> DataFrame:
    """G1: long table ``(pair_id, ..., head_id, s_chosen, s_rejected)``."""
    packed, ids = score_heads_packed(pairs, heads, method=method, **kw)
    return explode_scores(packed, ids, keep)


def single_head_score(pairs: DataFrame, heads: DataFrame, head_id: int, **kw) -> DataFrame:
    """The scores of one head (e.g. the original or a replaced head)."""
    return score_heads(pairs, heads.filter(F.col("head_id") == F.lit(head_id)), **kw)


def score_delta(scores: DataFrame) -> DataFrame:
    """``s_delta = s_chosen - s_rejected`` for every head."""
    return scores.withColumn("s_delta", F.col("s_chosen") - F.col("s_rejected"))


def score_heads_tiled(pairs: DataFrame, heads: DataFrame, key: str = "pair_id", chosen: str = "chosen",
                      rejected: str = "rejected", head_rows: int = 1024, pair_rows: int = 4096) -> DataFrame:
    """G1 for head sets of any size: ``(key, block, head_ids, sc, sr)``, one
    row per pair and block of heads.

    A block matrix product with two-dimensional tiles.  Heads are numbered in
    id order and cut into blocks of about ``head_rows``, pairs are dealt to
    blocks of about ``pair_rows``; a tile is one block of each, joined by a
    cogroup, so a task holds ``head_rows + pair_rows`` vectors whatever the
    sizes of the tables.  Nothing is collected and nothing broadcast.  Pairs
    are sent once per block of heads, heads once per block of pairs: with
    ``collect_heads`` possible, ``score_heads_packed`` is the cheaper way.
    Null, ragged and incomplete vectors get null scores; rows that repeat the
    key stay rows of their own; an empty table gives no rows.
    """
    w = heads.select(F.col("head_id").cast("long").alias("head_id"), F.col("w").cast("array<double>").alias("w"))
    n_heads, n_pairs = w.count(), pairs.count()
    head_blocks, pair_blocks = max(1, -(-n_heads // head_rows)), max(1, -(-n_pairs // pair_rows))
    # written, so that every reader sees the same ranges
    tiles = write_and_read(w.repartitionByRange(head_blocks, "head_id").withColumn("block", F.spark_partition_id()), "head-blocks")
    tiles = tiles.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(pair_blocks - 1))))
    sent = (pairs.select(F.col(key).alias("key"), F.col(chosen).alias("c"), F.col(rejected).alias("r"))
            .withColumn("part", F.pmod(F.xxhash64("key", "c", "r"), F.lit(pair_blocks)).cast("int"))
            .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(head_blocks - 1)))))

    def product(vectors: pa.Table, rows: pa.Table) -> pa.Table:
        order = np.argsort(rows["head_id"].to_numpy(), kind="stable")
        m, n = list_matrix(rows["w"])[order].T if len(rows) else np.zeros((0, 0)), len(vectors)
        out = {"key": vectors["key"], "block": vectors["block"],
               "head_ids": pa.array([rows["head_id"].to_numpy()[order].tolist()] * n, pa.list_(pa.int64()))}
        for name, column in (("sc", "c"), ("sr", "r")):
            x, usable = vector_rows(vectors[column], m.shape[0]) if n else (np.zeros((0, m.shape[0])), np.zeros(0, bool))
            out[name] = list_column(x @ m, usable)
        return pa.table(out)
    kind = dict(pairs.dtypes)[key]
    out = sent.groupBy("part", "block").cogroup(tiles.groupBy("part", "block")).applyInArrow(
        product, f"key {kind}, block int, head_ids array<bigint>, sc array<double>, sr array<double>")
    return out.where(F.size("head_ids") > 0).withColumnRenamed("key", key)


def pack_scores(scores: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Long scores -> one row per pair with ``head_ids``, ``sc``, ``sr`` arrays.

    The group per pair holds exactly H rows, so it is bounded by the head set.
    """
    keys = keys or ["pair_id"]
    s = F.sort_array(F.collect_list(F.struct("head_id", "s_chosen", "s_rejected")))
    return (scores.groupBy(*keys).agg(s.alias("_s"))
            .select(*keys, F.col("_s.head_id").alias("head_ids"),
                    F.col("_s.s_chosen").alias("sc"), F.col("_s.s_rejected").alias("sr")))
