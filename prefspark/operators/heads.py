"""Heads: difference vectors, PCA, signed heads and head selection.

PCA reads the difference vectors once: tasks reduce them to centred d x d
partial moments, which are merged row by row in a shuffle; only the d x d
eigen step runs on the driver.  For wide vectors a block Krylov form makes no
d x d matrix at all.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prefspark.functions.vectors import diff as diff_expr
from prefspark.functions.vectors import l2_norm, l2_normalise, md5_uniform
from prefspark.session import write_and_read

def pair_diff(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected",
              keep: list[str] | None = None) -> DataFrame:
    """H1: ``diff = chosen - rejected`` element-wise in double."""
    keep = keep if keep is not None else ["pair_id"]
    return pairs.select(*keep, diff_expr(chosen, rejected).alias("diff"))


@dataclass
class PCAResult:
    components: np.ndarray        # (k, d), rows are unit directions, sign-fixed
    explained_variance_ratio: np.ndarray  # (k,)
    mean: np.ndarray              # (d,)
    total_variance: float         # trace of the sample covariance

    @property
    def explained_variance(self) -> np.ndarray:
        """H5: eigenvalues with the n-1 divisor."""
        return self.explained_variance_ratio * self.total_variance

    def components_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(i, [float(x) for x in self.components[i]],
                 float(self.explained_variance_ratio[i]), float(self.explained_variance[i]))
                for i in range(self.components.shape[0])]
        return spark.createDataFrame(
            rows, "component int, w array<double>, explained_variance_ratio double, "
                  "explained_variance double")


def fix_signs(components: np.ndarray) -> np.ndarray:
    """Flip each direction so its largest-magnitude loading is positive
    (lowest index on ties)."""
    out = components.copy()
    for i in range(out.shape[0]):
        j = int(np.argmax(np.abs(out[i])))
        if out[i, j] < 0:
            out[i] = -out[i]
    return out


class Moments:
    """Count, mean and centred second moments (M2) of vectors, mergeable.
    Nothing is ever summed uncentred, so a common offset costs no precision."""

    def __init__(self):
        self.n, self.mean, self.m2 = 0, None, None

    def add(self, x: np.ndarray) -> None:
        if not len(x):
            return
        mean = x.mean(axis=0)
        centred = x - mean
        mean = mean + centred.mean(axis=0)  # what rounding left of the first mean
        centred = x - mean
        m2 = centred.T @ centred
        if self.mean is None:
            self.n, self.mean, self.m2 = len(x), mean, m2
            return
        if self.mean.shape != mean.shape:
            raise ValueError(f"vectors of {len(self.mean)} and of {len(mean)} numbers")
        step, n = mean - self.mean, self.n + len(x)
        self.m2 += m2 + np.outer(step, step * (self.n * len(x) / n))
        self.mean = self.mean + step * (len(x) / n)
        self.n = n


def _merged_rows(batches):
    """Rows (i, part, n, mean, v) ordered by i and part to one row for each i:
    the pairwise merge, one row of M2 at a time."""
    import pyarrow as pa
    at, n, mean, v, out = None, 0.0, None, None, []

    def batch_of(rows):
        vectors = pa.list_(pa.float64())
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.float64()),
                                           pa.array([r[2] for r in rows], vectors), pa.array([r[3] for r in rows], vectors)],
                                          ["i", "n", "mean", "v"])
    for batch in batches:
        for k in range(len(batch)):
            i, more = batch.column(0)[k].as_py(), batch.column(2)[k].as_py()
            mean_b, v_b = (batch.column(c)[k].values.to_numpy() for c in (3, 4))
            if i != at:
                if at is not None:
                    out.append((at, n, mean, v))
                    if len(out) >= 64:
                        yield batch_of(out)
                        out = []
                at, n, mean, v = i, more, mean_b, v_b
                continue
            if len(mean) != len(mean_b):
                raise ValueError(f"vectors of {len(mean)} and of {len(mean_b)} numbers")
            step, total = mean_b - mean, n + more
            v = v + v_b + step[i] * step * (n * more / total)
            mean, n = mean + step * (more / total), total
    if at is not None:
        out.append((at, n, mean, v))
    yield batch_of(out)


def moment_rows(diffs: DataFrame, col: str = "diff") -> DataFrame:
    """Centred moments of the vectors in one pass: ``(i, n, mean, v)`` with
    row i of ``M2 = (X - mean)' (X - mean)``.

    Each task reduces its vectors with one BLAS product per Arrow batch and
    emits d rows; tasks are first merged to at most four per core, so the
    shuffle holds that many d x d partial moments whatever the number of
    pairs.  Partial moments merge by the pairwise formula, row by row, so a
    mean far larger than the spread costs no precision.  Null vectors, and
    vectors that hold a null, take no part; vectors of two lengths raise.
    """
    sc = diffs.sparkSession.sparkContext

    def partial(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        from prefspark.operators.scoring import list_matrix
        m = Moments()
        for batch in batches:
            m.add(list_matrix(batch.column(0)))
        if m.n:
            d, part = len(m.mean), TaskContext.get().partitionId()
            for at in range(0, d, 64):
                rows = m.m2[at:at + 64]
                yield pa.RecordBatch.from_pydict({
                    "i": pa.array(range(at, at + len(rows)), pa.int32()), "part": pa.array([part] * len(rows), pa.int32()),
                    "n": pa.array([float(m.n)] * len(rows)), "mean": pa.array([m.mean] * len(rows), pa.list_(pa.float64())),
                    "v": pa.array(list(rows), pa.list_(pa.float64()))})
    parts = _vectors(diffs, col).coalesce(4 * sc.defaultParallelism).mapInArrow(
        partial, "i int, part int, n double, mean array<double>, v array<double>")
    rows = parts.repartition("i").sortWithinPartitions("i", "part").mapInArrow(
        _merged_rows, "i int, n double, mean array<double>, v array<double>")
    return write_and_read(rows, "moments")


def _vectors(diffs: DataFrame, col: str) -> DataFrame:
    x = diffs.select(F.col(col).cast("array<double>").alias("x"))
    return x.where(F.col("x").isNotNull() & ~F.exists("x", lambda v: v.isNull()))


def _moments(diffs: DataFrame, col: str) -> tuple[np.ndarray, np.ndarray]:
    """Mean and d x d sample covariance (d x d numbers reach the driver)."""
    rows = moment_rows(diffs, col)
    first = rows.where("i = 0").first()
    if first is None:
        raise ValueError("no vectors")
    mean = np.array(first.mean)
    cov = np.empty((len(mean), len(mean)))
    for r in rows.select("i", "v").toLocalIterator():
        cov[r.i] = r.v
    cov /= max(first.n - 1, 1)
    return mean, (cov + cov.T) / 2


def fit_pca(diffs: DataFrame, k: int | None = None, col: str = "diff", method: str = "eigh") -> PCAResult:
    """H2/H3/H4: centred PCA of the difference vectors.

    ``k=None`` is the full decomposition (k = d).  Mean, covariance and total
    variance come from one pass over the vectors (``moment_rows``).

    ``method="eigh"`` (default) decomposes the d x d covariance with
    ``numpy.linalg.eigh`` on the driver (d = 2048: 34 MB, seconds).
    ``method="krylov"`` needs no d x d matrix anywhere (``fit_pca_krylov``).
    ``method="ml"`` takes the directions of the ``pyspark.ml.feature.PCA``
    estimator instead, which reads the vectors again.
    """
    if method == "krylov":
        if k is None:
            raise ValueError("the full decomposition is a d x d matrix")
        return fit_pca_krylov(diffs, k, col)
    mean, cov = _moments(diffs, col)
    total_var = float(np.trace(cov))
    d = mean.shape[0]
    k = d if k is None else int(k)
    if not 1 <= k <= d:
        raise ValueError(f"k must be in [1, {d}], got {k}")
    if method == "ml":
        feats = diffs.select(array_to_vector(F.col(col)).alias("features"))
        model = PCA(k=k, inputCol="features", outputCol="pca").fit(feats)
        return PCAResult(fix_signs(model.pc.toArray().T), model.explainedVariance.toArray(), mean, total_var)
    if method != "eigh":
        raise ValueError(f"unknown method {method!r}")
    lam, vec = np.linalg.eigh(cov)
    order = np.argsort(lam)[::-1][:k]
    ratio = lam[order] / total_var if total_var > 0 else np.zeros(k)
    return PCAResult(fix_signs(vec[:, order].T), ratio, mean, total_var)


def _mean_rows(diffs: DataFrame, col: str) -> tuple[float, np.ndarray]:
    """Count and mean of the vectors: a row of d numbers from each task,
    merged in the order of the tasks."""
    def partial(batches):
        import pyarrow as pa

        from prefspark.operators.scoring import list_matrix
        n, mean = 0, None
        for batch in batches:
            x = list_matrix(batch.column(0))
            if len(x):
                own = x.mean(axis=0)
                own = own + (x - own).mean(axis=0)
                n += len(x)
                mean = own if mean is None else mean + (own - mean) * (len(x) / n)
        if n:
            yield pa.RecordBatch.from_pydict({"n": pa.array([float(n)]), "mean": pa.array([mean], pa.list_(pa.float64()))})
    n, mean = 0.0, None
    sc = diffs.sparkSession.sparkContext
    parts = _vectors(diffs, col).coalesce(4 * sc.defaultParallelism).mapInArrow(partial, "n double, mean array<double>")
    for r in parts.toLocalIterator():  # one row a task, read one at a time
        own = np.array(r.mean)
        if mean is not None and len(own) != len(mean):
            raise ValueError(f"vectors of {len(mean)} and of {len(own)} numbers")
        n += r.n
        mean = own if mean is None else mean + (own - mean) * (r.n / n)
    if mean is None:
        raise ValueError("no vectors")
    return n, mean


def _spread_times(diffs: DataFrame, col: str, mean, basis: np.ndarray) -> np.ndarray:
    """``(X - mean)' (X - mean) basis`` in one pass: every task adds up a d x l
    block, its rows are added in a shuffle."""
    def partial(batches):
        import pyarrow as pa

        from prefspark.operators.scoring import list_matrix
        mu, v = shared.value
        total = None
        for batch in batches:
            x = list_matrix(batch.column(0))
            if len(x):
                x = x - mu
                part = x.T @ (x @ v)
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_pydict({"i": pa.array(range(len(total)), pa.int32()),
                                              "v": pa.array(list(total), pa.list_(pa.float64()))})
    sc = diffs.sparkSession.sparkContext
    shared = sc.broadcast((mean, basis))  # d x (l + 1) numbers
    parts = _vectors(diffs, col).coalesce(4 * sc.defaultParallelism).mapInArrow(partial, "i int, v array<double>")
    sums = parts.groupBy("i").agg(Summarizer.sum(array_to_vector("v")).alias("v")).select("i", vector_to_array("v").alias("v"))
    out = np.zeros(basis.shape)
    for r in sums.toLocalIterator():
        out[r.i] = r.v
    return out


def tall_qr(diffs: DataFrame, col: str, mean, basis: np.ndarray, fan: int = 16) -> tuple[np.ndarray, float]:
    """(R, total) of the tall product ``Y = (X - mean) basis``: its m x m
    triangular factor by a QR tree, and the sum of squares of X - mean.

    A task folds each batch into its R; then ``fan`` factors at a time are
    stacked and factored again, level by level, until one is left.  No group
    holds more than ``fan`` factors.
    """
    m = basis.shape[1]

    def rows_of(r: np.ndarray, part: int, total: float):
        import pyarrow as pa
        return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "total": pa.array([total]),
                                           "r": pa.array([r.reshape(-1)], pa.list_(pa.float64()))})

    def partial(batches):
        from pyspark import TaskContext

        from prefspark.operators.scoring import list_matrix
        mu, v = shared.value
        r, total = np.zeros((0, m)), 0.0
        for batch in batches:
            x = list_matrix(batch.column(0))
            if len(x):
                x = x - mu
                total += float((x * x).sum())
                r = np.linalg.qr(np.concatenate((r, x @ v)), mode="r")
        if total or len(r):
            yield rows_of(r, TaskContext.get().partitionId(), total)

    def fold(rows):
        import pyarrow as pa
        rows = rows.sort_by("part").combine_chunks()
        stacked = np.concatenate([x.values.to_numpy().reshape(-1, m) for x in rows["r"]])
        return pa.Table.from_batches([rows_of(np.linalg.qr(stacked, mode="r"), rows["part"][0].as_py(),
                                              sum(rows["total"].to_pylist()))])
    sc = diffs.sparkSession.sparkContext
    shared = sc.broadcast((mean, basis))
    schema, n = "part int, total double, r array<double>", 4 * sc.defaultParallelism
    level = _vectors(diffs, col).coalesce(n).mapInArrow(partial, schema)
    while n > 1:
        n = -(-n // fan)
        level = level.withColumn("part", F.floor(F.col("part") / fan).cast("int")).groupBy("part").applyInArrow(fold, schema)
    row = level.first()  # one m x m factor
    return (np.array(row.r).reshape(-1, m), row.total) if row else (np.zeros((0, m)), 0.0)


def fit_pca_krylov(diffs: DataFrame, k: int, col: str = "diff", extra: int = 16, rounds: int = 12, tolerance: float = 1e-11,
                   seed: int = 0) -> PCAResult:
    """H2/H4 for wide vectors: the first k directions without a d x d matrix.

    A randomised range finder: a random block of k + ``extra`` columns is
    multiplied by the covariance, one read of the vectors a round, and every
    product joins an orthonormal basis (block Krylov).  Rounds end when the
    residuals of the first k directions are below ``tolerance`` of the
    largest variance, when the basis spans all there is, or after ``rounds``.
    The directions come from the QR tree of the vectors in that basis
    (``tall_qr``), which squares nothing.  Driver and tasks hold d x
    (k + extra) x rounds numbers at most.
    """
    n, mean = _mean_rows(diffs, col)
    d = len(mean)
    if not 1 <= k <= d:
        raise ValueError(f"k must be in [1, {d}], got {k}")
    block = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, min(d, k + extra))))[0]
    basis, image = np.zeros((d, 0)), np.zeros((d, 0))
    for _ in range(rounds):
        product = _spread_times(diffs, col, mean, block)
        basis, image = np.hstack((basis, block)), np.hstack((image, product))
        small = basis.T @ image
        value, vector = np.linalg.eigh((small + small.T) / 2)
        value, vector = value[::-1][:k], vector[:, ::-1][:, :k]
        residual = np.linalg.norm(image @ vector - (basis @ vector) * value, axis=0)
        if (residual <= tolerance * max(value[0], 0)).all():
            break
        scale = np.linalg.norm(product, axis=0).max()
        for _ in range(2):  # twice: what rounding leaves of the first time
            product = product - basis @ (basis.T @ product)
        u, s, _ = np.linalg.svd(product, full_matrices=False)
        block = u[:, s > 1e-13 * scale][:, :d - basis.shape[1]]
        block = np.linalg.qr(block - basis @ (basis.T @ block))[0]
        if not block.shape[1]:
            break
    r, total = tall_qr(diffs, col, mean, basis)
    _, s, w = np.linalg.svd(r, full_matrices=False)
    s = np.concatenate((s, np.zeros(max(0, k - len(s)))))[:k]
    w = np.vstack((w, np.eye(basis.shape[1])[len(w):]))[:k] if len(w) < k else w[:k]
    ratio = s**2 / total if total > 0 else np.zeros(k)
    return PCAResult(fix_signs(w @ basis.T), ratio, mean, total / max(n - 1, 1))


def covariance(diffs: DataFrame, col: str = "diff", method: str = "gram") -> DataFrame:
    """H6: ``covar_samp`` for every dimension pair (i <= j), long form.

    ``gram`` (default): from the one-pass sums; the d(d+1)/2 cells are made
    in the executors.  ``relational``: d(d+1)/2 products per row under the
    built-in ``covar_samp``, for checks on narrow vectors only.
    """
    if method == "gram":
        cells = moment_rows(diffs, col).select("i", "n", F.posexplode("v").alias("j", "m")).where("j >= i")
        return cells.select("i", "j", F.when(F.col("n") > 1, F.col("m") / (F.col("n") - 1)).alias("cov"))
    x = diffs.select(F.posexplode(col).alias("i", "xi"), F.col(col).alias("_v"))
    xy = x.select("i", "xi", F.posexplode("_v").alias("j", "xj")).filter(F.col("j") >= F.col("i"))
    return xy.groupBy("i", "j").agg(F.covar_samp("xi", "xj").alias("cov"))


def total_variance(diffs: DataFrame, col: str = "diff") -> DataFrame:
    """H7: sum over dimensions of the sample variance (= trace = sum of
    eigenvalues), from the same pass as H6."""
    return covariance(diffs, col).where("i = j").agg(F.sum("cov").alias("total_variance"))


def project(diffs: DataFrame, pca: PCAResult, col: str = "diff",
            keep: list[str] | None = None, method: str = "native") -> DataFrame:
    """H8: centred projection onto the components (MLlib's transform does
    not centre): ``(x - mean) . w``, centred before it is multiplied, so a
    common offset costs no precision.  ``method="arrow"`` runs the k dot
    products as one BLAS product per Arrow batch (for large k x d)."""
    keep = keep if keep is not None else ["pair_id"]
    x = F.col(col)
    if method == "arrow":
        from prefspark.operators.scoring import HeadMatrix, score_column
        hm = HeadMatrix(list(range(pca.components.shape[0])), pca.components)
        return diffs.select(*keep, score_column(x, hm, diffs.sparkSession, "arrow", shift=pca.mean).alias("proj"))
    mean = F.lit(pca.mean.tolist()).cast("array<double>")
    comps = F.transform(F.lit(pca.components.tolist()).cast("array<array<double>>"), lambda w: F.zip_with(
        w, mean, lambda a, m: F.struct(a.alias("w"), m.alias("m"))))
    return diffs.select(*keep, F.transform(comps, lambda c: F.aggregate(
        F.zip_with(x, c, lambda v, s: (v - s["m"]) * s["w"]), F.lit(0.0), lambda a, v: a + v)).alias("proj"))


def signed_heads(components: DataFrame, k: int) -> DataFrame:
    """H9: head i = +component i, head i+k = -component i."""
    s = components.select("component", "w", F.explode(F.array(F.lit(1), F.lit(-1))).alias("sign"))
    return s.select(
        F.when(F.col("sign") == 1, F.col("component")).otherwise(F.col("component") + F.lit(k))
        .cast("bigint").alias("head_id"),
        F.col("component").cast("int").alias("component"),
        F.col("sign").cast("int").alias("sign"),
        F.transform("w", lambda x: x.cast("double") * F.col("sign")).alias("w"))


def with_original(heads: DataFrame, original: DataFrame, original_id: int = -1) -> DataFrame:
    """Keep the base model's head as a head of its own (id ``original_id``)."""
    o = original.select(F.lit(original_id).cast("bigint").alias("head_id"),
                        F.lit(-1).cast("int").alias("component"),
                        F.lit(1).cast("int").alias("sign"),
                        F.col("w").cast("array<double>").alias("w"))
    return heads.select("head_id", "component", "sign", "w").unionByName(o)


def select_heads(heads: DataFrame, n: int) -> DataFrame:
    """First n/2 plus heads then first n/2 minus heads, renumbered 0..n-1.

    The plus half is the first half of the id order, the minus half the
    second.  The window spans the head table only (H rows, bounded).  Raises
    when there are fewer than ``n`` heads.
    """
    if n % 2:
        raise ValueError("the number of heads must be even")
    have = heads.count()
    if have < n:
        raise ValueError(f"{n} heads asked for, {have} given")
    w = Window.orderBy("head_id")
    r = (heads.withColumn("_r", F.row_number().over(w) - 1)
         .withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy())))
    half = F.floor(F.col("_n") / 2)
    plus = F.col("_r") < half
    pos = F.when(plus, F.col("_r")).otherwise(F.col("_r") - half)
    keep = pos < n // 2
    new_id = F.when(plus, pos).otherwise(pos + n // 2).cast("bigint")
    return r.filter(keep).select(new_id.alias("head_id"), "component", "sign", "w",
                                 F.col("head_id").alias("source_head_id"))


def random_heads(spark: SparkSession, n: int, d: int, kind: str = "uniform",
                 seed: int = 0) -> DataFrame:
    """Seeded random heads from md5-derived uniforms.

    ``uniform``: U(-1/sqrt(d), 1/sqrt(d)) (the default linear-layer bound);
    ``uniform_l2``: the same, rows L2-normalised; ``gaussian_l2``: Box-Muller
    normals, rows L2-normalised.
    """
    base = spark.range(n).select(F.col("id").alias("head_id"),
                                 F.sequence(F.lit(0), F.lit(d - 1)).alias("_j"))

    def u(tag: str, j):
        return (md5_uniform(F.lit(seed), F.lit(tag), F.col("head_id"), j).cast("double") + 0.5) / 4294967296.0

    bound = 1.0 / math.sqrt(d)
    if kind in ("uniform", "uniform_l2"):
        w = F.transform("_j", lambda j: (u("u", j) * 2 - 1) * bound)
    elif kind == "gaussian_l2":
        w = F.transform("_j", lambda j: F.sqrt(-2 * F.log(u("g1", j)))
                        * F.cos(2 * math.pi * u("g2", j)))
    else:
        raise ValueError(f"unknown kind {kind!r}")
    out = base.select("head_id", w.alias("w"))
    if kind.endswith("_l2"):
        out = out.select("head_id", l2_normalise("w").alias("w"))
    return out.select("head_id", F.lit(-1).cast("int").alias("component"),
                      F.lit(1).cast("int").alias("sign"), "w")


def unit_norm_check(heads: DataFrame, tol: float = 1e-6) -> DataFrame:
    """One row, true iff every head has L2 norm 1 within ``tol``."""
    return heads.agg(F.coalesce(F.bool_and(F.abs(l2_norm("w") - 1) <= tol), F.lit(True))
                     .alias("all_unit"))


def normalise_scores(scores: DataFrame, stats: DataFrame) -> DataFrame:
    """``(s - mean) / std`` with per-head statistics (broadcast join on head_id)."""
    from prefspark.operators.adapt import checked_broadcast
    st = checked_broadcast(stats.select("head_id", F.col("mean").alias("_m"), F.col("std").alias("_sd")))
    j = scores.join(st, "head_id", "left")
    return (j.withColumn("s_chosen", (F.col("s_chosen") - F.col("_m")) / F.col("_sd"))
            .withColumn("s_rejected", (F.col("s_rejected") - F.col("_m")) / F.col("_sd"))
            .drop("_m", "_sd"))
