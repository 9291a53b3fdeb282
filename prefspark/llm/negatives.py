"""Hard negatives by an inverted multi-index.

Vectors are cut into two halves, each with a codebook of its own; a pair of
codes is a cell, and every row lies in one.  The rows are dealt at random to
shards, so no cell, however full, is the work of one task.  Within a shard an
anchor has a bound for every half code, the inner product with the code plus
the anchor's norm times the code's radius; the multi-sequence heap pops cells
by the sum of the two bounds, highest first.  The walk ends when what is asked
for is certified: when no cell left can hold a better row than the last one
found, or, for a score window, anything inside the window.

Two walks make the result: the first finds each anchor's positives; the
second, told their scores, fills the windows they open.  The shards' finds are
merged in windows that keep the best in every task first.  The index is exact;
the codebooks, fitted on a bounded sample, only decide how early walks end.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prefspark.llm.common import table
from prefspark.session import write_and_read

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
#: A negative's score lies between these percentages of the positive's.
LOW, HIGH = 30, 90
#: Rows that the codebooks are fitted on, codes of a half, rounds of fitting.
SAMPLE, CODES, ROUNDS = 16_384, 16, 8
#: Rows of a shard and anchors of a block at most (on average); fewer rows make at least a shard a core.
SHARD_ROWS, BLOCK_ANCHORS = 1 << 18, 1 << 16
#: Rows scored together.
STEP_ROWS = 1024


def prepared(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, label, x (whole numbers): the rows that take part."""
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return embeddings.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite).select(
        "vec_id", label.cast("int").alias("label"),
        F.transform("embedding", lambda v: F.floor(v.cast("double") * scale)).alias("x"))


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """A list column as rows of d numbers; shorter vectors end in zeros."""
    lens = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if len(lens) and (lens == d).all():
        return flat.reshape(-1, d)
    out = np.zeros((len(lens), d), np.int64)
    out[np.arange(d) < lens[:, None]] = flat
    return out


def fit_codes(x: np.ndarray, n: int, rounds: int = ROUNDS) -> np.ndarray:
    """Codebook of n codes: the means of their nearest rows, round by round,
    from rows spread evenly over the sample; a code without rows keeps still."""
    if not len(x):
        return np.zeros((1, x.shape[1]))
    codes = x[np.linspace(0, len(x) - 1, min(n, len(x))).astype(int)].astype(np.float64)
    for _ in range(rounds):
        near = nearest(x, codes)
        count = np.bincount(near, minlength=len(codes))
        for j in range(x.shape[1]):
            total = np.bincount(near, x[:, j], len(codes))
            codes[:, j] = np.where(count > 0, total / np.maximum(count, 1), codes[:, j])
    return codes


def nearest(x: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return ((codes**2).sum(axis=1) - 2 * (x.astype(np.float64) @ codes.T)).argmin(axis=1)


def inner(x: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Exact inner products: as doubles while every sum stays below 2**53."""
    top = float(np.abs(x).max(initial=0)) * float(np.abs(a).max(initial=0)) * len(a)
    if top < 2.0**53:
        return (x.astype(np.float64) @ a.astype(np.float64)).astype(np.int64)
    return x @ a


class Index:
    """The rows of one shard by cell, with the radius of every half code."""

    def __init__(self, x: np.ndarray, label: np.ndarray, vec_id: np.ndarray, order: np.ndarray, codes: tuple):
        d, half = x.shape[1], codes[0].shape[1]
        a, b = nearest(x[:, :half], codes[0]), nearest(x[:, half:], codes[1])
        by = np.lexsort((b, a))
        self.x, self.label, self.vec_id, self.order = x[by], label[by], vec_id[by], order[by]
        self.float = self.x.astype(np.float64)
        self.half, self.codes = half, codes
        self.exact = float(np.abs(x).max(initial=0))
        cell = (a * len(codes[1]) + b)[by]
        self.ends = np.searchsorted(cell, np.arange(len(codes[0]) * len(codes[1]) + 1))
        self.radius = []
        for part, code, at in ((x[:, :half], codes[0], a), (x[:, half:], codes[1], b)):
            r = np.full(len(code), -1.0)
            np.maximum.at(r, at, np.sqrt(((part - code[at])**2).sum(axis=1)))
            self.radius.append(r)

    def half_bounds(self, anchor: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per half: the codes that hold rows, highest bound first, and the bounds."""
        out = []
        for part, code, r in zip((anchor[:self.half], anchor[self.half:]), self.codes, self.radius):
            bound = code @ part + np.sqrt((part.astype(np.float64)**2).sum()) * r
            used = np.flatnonzero(r >= 0)
            used = used[np.argsort(-bound[used], kind="stable")]
            out.append((used, bound[used]))
        return out

    def cells(self, anchor: np.ndarray) -> Iterator[tuple[float, int, int]]:
        """(bound, first row, end) of the cells with rows, by falling bound:
        the multi-sequence walk over the two sorted halves."""
        (left, lb), (right, rb) = self.half_bounds(anchor)
        if not len(left) or not len(right):
            return
        wide = len(self.codes[1])
        heap, seen = [(-(lb[0] + rb[0]), 0, 0)], {(0, 0)}
        while heap:
            bound, i, j = heapq.heappop(heap)
            for p in ((i + 1, j), (i, j + 1)):
                if p[0] < len(left) and p[1] < len(right) and p not in seen:
                    seen.add(p)
                    heapq.heappush(heap, (-(lb[p[0]] + rb[p[1]]), *p))
            cell = left[i] * wide + right[j]
            a, b = self.ends[cell], self.ends[cell + 1]
            if a < b:  # a little more than rounding can take away
                yield -bound * (1 + 1e-9) + 1 if bound < 0 else -bound + 1, a, b

    def scored(self, anchor: np.ndarray, done) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows, scores) of cells in the order of the walk, some at a time,
        until ``done(bound of the next cell)``."""
        held, size = [], 0
        wide = self.exact * float(np.abs(anchor).max(initial=0)) * len(anchor) >= 2.0**53
        real = anchor.astype(np.float64)

        def scores():
            rows = np.concatenate([np.arange(a, b) for a, b in held])
            return rows, (self.x[rows] @ anchor if wide else (self.float[rows] @ real).astype(np.int64))
        for bound, a, b in self.cells(anchor):
            if held and size >= STEP_ROWS:
                yield scores()
                held, size = [], 0
            if not held and done(bound):
                return
            held.append((a, b))
            size += b - a
        if held:
            yield scores()

    def best(self, rows: np.ndarray, scores: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The first n by score, ties by order; ties at the end included whole."""
        if len(rows) > 4 * n:
            keep = scores >= np.partition(scores, len(scores) - n)[len(scores) - n]
            rows, scores = rows[keep], scores[keep]
        by = np.lexsort((self.order[rows], -scores))[:n]
        return rows[by], scores[by]

    def positives(self, anchor: np.ndarray, label: int, vec_id: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        found = np.empty(0, np.int64), np.empty(0, np.int64)
        last = [None]
        for rows, scores in self.scored(anchor, lambda bound: last[0] is not None and bound < last[0]):
            keep = (self.label[rows] == label) & (self.vec_id[rows] != vec_id)
            if last[0] is not None:
                keep &= scores >= last[0]
            if keep.any():
                found = self.best(np.concatenate((found[0], rows[keep])), np.concatenate((found[1], scores[keep])), n)
                if len(found[0]) == n:
                    last[0] = found[1][-1]
        return found

    def windows(self, anchor: np.ndarray, label: int, asked: np.ndarray, n: int, low: int, high: int):
        """Per score in ``asked`` the first n rows of other labels whose score
        times 100 lies between low and high times it."""
        floor, roof = -(-low * asked // 100), high * asked // 100
        found = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in asked]
        least = floor.copy()  # below it a window takes no more rows
        least[floor > roof] = np.iinfo(np.int64).max
        for rows, scores in self.scored(anchor, lambda bound: bool((bound < least).all())):
            keep = (scores >= least.min()) & (self.label[rows] != label)
            rows, scores = rows[keep], scores[keep]
            if not len(rows):
                continue
            for k in range(len(asked)):
                take = (scores >= least[k]) & (scores <= roof[k])
                if take.any():
                    found[k] = self.best(np.concatenate((found[k][0], rows[take])),
                                         np.concatenate((found[k][1], scores[take])), n)
                    if len(found[k][0]) == n:
                        least[k] = max(least[k], found[k][1][-1])
        return found


_FAR = np.iinfo(np.int64).max


def _index(rows: pa.Table, codes: tuple, d: int) -> Index:
    rows = rows.combine_chunks()
    ids = rows["vec_id"].combine_chunks()
    order = ids.fill_null(_FAR).to_numpy(zero_copy_only=False).astype(np.int64)
    return Index(matrix(rows["x"].combine_chunks(), d), rows["label"].to_numpy().astype(np.int64), order, order, codes)


def _per_shard(rows: DataFrame, anchors: DataFrame, shards: int, blocks: int, run, schema: str) -> DataFrame:
    """``run(rows, anchors)`` for every shard and block of anchors."""
    left = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = anchors.withColumn("block", F.pmod("anchor", F.lit(blocks)).cast("int")).withColumn(
        "shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    return left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(run, schema)


def mine(embeddings: DataFrame, every: int = 100, positives: int = POSITIVES, negatives: int = NEGATIVES,
         low: int = LOW, high: int = HIGH, codes: int = CODES, sample: int = SAMPLE, shards: int | None = None,
         block_anchors: int = BLOCK_ANCHORS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score: for every anchor (vec_id divisible by ``every``) and each
    of its best ``positives`` rows of the same label, the first ``negatives``
    rows of other labels whose score is within ``low`` to ``high`` percent of
    the positive's.

    ``embeddings`` has vec_id, label and x, whole numbers (see ``prepared``).
    Equal scores go by vec_id, null last; a null vec_id is no anchor.  A row
    that repeats an id is a row of its own, but no positive of its namesake; a
    repeated anchor is mined once for each row.  Shorter vectors count as
    ending in zeros.  A window of a negative score is empty.  Scores are exact
    while they fit 64 bits.  An empty table, or one without anchors, gives no
    rows; other columns are not read.
    """
    spark = embeddings.sparkSession
    rows = embeddings.select("vec_id", "label", "x")
    rows = write_and_read(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
    n, d, n_anchors = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("x")), F.lit(0)),
                               F.count_if(F.col("vec_id") % every == 0)).first()
    d = max(d, 2)
    drawn = rows.orderBy(F.xxhash64("row", F.lit(1)), "row").limit(sample).select("x").toArrow()
    drawn = matrix(drawn["x"].combine_chunks(), d) if len(drawn) else np.zeros((0, d), np.int64)
    half = d // 2
    books = fit_codes(drawn[:, :half], codes), fit_codes(drawn[:, half:], codes)
    shards = shards or max(spark.sparkContext.defaultParallelism * 2, -(-n // SHARD_ROWS))
    blocks = max(1, -(-n_anchors // block_anchors))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int")).select("shard", "vec_id", "label", "x")
    anchors = rows.where(F.col("vec_id") % every == 0).select(
        F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"), F.col("label").alias("anchor_label"),
        F.col("x").alias("ax"))

    def each(left: pa.Table, right: pa.Table):
        if not len(left) or not len(right):
            return None, []
        index, right = _index(left, books, d), right.combine_chunks()
        ax = matrix(right["ax"].combine_chunks(), d)
        return index, zip(right["anchor"].to_pylist(), ax, right["anchor_label"].to_pylist(),
                          right["anchor_id"].to_pylist(), right["asked"].to_pylist() if "asked" in right.column_names
                          else [None] * len(right))

    def filled(out: list, names: list[str]) -> pa.Table:
        cols = list(zip(*out)) or [()] * len(names)
        nulls = [[None if n.endswith("_id") and v == _FAR else v for v in c] for n, c in zip(names, cols)]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, nulls)})

    def near(left: pa.Table, right: pa.Table) -> pa.Table:
        index, todo = each(left, right)
        out = []
        for anchor, x, label, vec_id, _ in todo:
            at, scores = index.positives(x, label, vec_id, positives)
            out += [(anchor, int(index.vec_id[i]), int(s)) for i, s in zip(at, scores)]
        return filled(out, ["anchor", "positive_id", "positive_score"])

    def hard(left: pa.Table, right: pa.Table) -> pa.Table:
        index, todo = each(left, right)
        out = []
        for anchor, x, label, _, asked in todo:
            asked = np.array(asked, np.int64)
            for p, (at, scores) in zip(asked, index.windows(x, label, asked, negatives, low, high)):
                out += [(anchor, int(p), int(index.vec_id[i]), int(s)) for i, s in zip(at, scores)]
        return filled(out, ["anchor", "positive_score", "negative_id", "negative_score"])

    first = Window.partitionBy("anchor").orderBy(F.desc("positive_score"), F.asc_nulls_last("positive_id"))
    found = _per_shard(dealt, anchors, shards, blocks, near, "anchor long, positive_id long, positive_score long")
    found = write_and_read(found.withColumn("__at", F.row_number().over(first)).where(F.col("__at") <= positives), "positives")
    asked = found.groupBy("anchor").agg(F.sort_array(F.collect_set("positive_score")).alias("asked"))  # ``positives`` at most
    asked = anchors.join(asked.withColumnRenamed("anchor", "__anchor"), F.col("anchor") == F.col("__anchor")).drop("__anchor")
    last = Window.partitionBy("anchor", "positive_score").orderBy(F.desc("negative_score"), F.asc_nulls_last("negative_id"))
    hits = _per_shard(dealt, asked, shards, blocks, hard,
                      "anchor long, positive_score long, negative_id long, negative_score long")
    hits = hits.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= negatives)
    named = found.join(anchors.select(F.col("anchor").alias("__anchor"), "anchor_id"), F.col("anchor") == F.col("__anchor"))
    named = named.select("anchor", "anchor_id", "positive_id", "positive_score")
    return named.join(hits, ["anchor", "positive_score"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(prepared(table(spark, sf_dir, "embeddings")))


ORACLE = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same,
         CAST(list_dot_product(a.x, b.x) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
), n AS (
  SELECT anchor_id, positive_id, positive_score, other AS negative_id, score AS negative_score,
         CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) AS INTEGER) AS rank
  FROM p JOIN s USING (anchor_id)
  WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
