"""Few-shot head reweighting.

Per seed and group: sample k pairs, standardise every head's scores with the
sample's mean and sample std (both sides together), weight heads by a softmax
of their summed pairwise loss, then re-score *every* pair of the group with
the weighted sum of standardised scores and evaluate.  Seeds and
configurations (head subset, k, temperature) are columns, so every run is
part of the same jobs.

Scale notes
-----------
* Scores are packed per pair (``sc``/``sr`` arrays in head order), so the
  pair table is never multiplied by the number of heads; every pair is
  scored once and the packed scores are written for the three readers.
* Sampling never ranks a whole group in one task.  A seeded md5 value ``u``
  orders the rows; every task keeps the k smallest of each (seed, group) in a
  bottom-k sketch, and the sketches merge to exactly the k smallest of all,
  in one read of the keys.
* Small tables (sketches, sample, statistics, weights) are written and
  broadcast only behind a bound derived from counted inputs; the final
  re-scoring is one Arrow pass with size-checked per-group coefficient
  tensors.  Tensors beyond the limit are not broadcast: salted blocks of a
  group's pairs meet blocks of its coefficients in a cogroup.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prefspark.functions.vectors import md5_uniform, softplus
from prefspark.operators import evaluate as ev
from prefspark.session import write_and_read

MAX_BROADCAST_BYTES = 256 * 1024 * 1024
U_RANGE = 4294967296  # md5_uniform is in [0, 2^32)
MODES = ("normalised", "raw", "delta")


def checked_broadcast(df: DataFrame, bound: int | None = None, row_bytes: int = 128,
                      max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Broadcast ``df`` only when rows times ``row_bytes`` (the width of a
    row, arrays included) is within ``max_bytes``: ``bound`` is an upper bound
    of the rows derived from counted inputs; without one they are counted.
    Otherwise the planner's shuffle join is kept."""
    n = df.count() if bound is None else bound
    return F.broadcast(df) if n * row_bytes <= max_bytes else df


def materialise_table(df: DataFrame) -> DataFrame:
    """Write a large intermediate that several stages read (the packed
    scores) as parquet under the shared checkpoint folder and read it back,
    so each reader prunes the columns it does not need."""
    return write_and_read(df, "packed")


def _seeds(seeds: int | Sequence[int]) -> list[int]:
    return list(range(seeds)) if isinstance(seeds, int) else [int(s) for s in seeds]


def seed_column(seeds: int | Sequence[int]) -> Column:
    return F.explode(F.array(*[F.lit(s).cast("int") for s in _seeds(seeds)]))


# ---------------------------------------------------------------- A4
def attach_category(pairs: DataFrame, section_map: Mapping, subset: str = "subset",
                    out: str = "grp") -> DataFrame:
    """A4: subset -> section via a broadcast lookup; unmapped subsets get null."""
    subset_type = dict(pairs.dtypes)[subset]
    lk = pairs.sparkSession.createDataFrame(
        [(k, v) for k, v in section_map.items()], f"_k {subset_type}, {out} string")
    # the section map is a constant of the call (one row per mapped subset)
    return pairs.join(F.broadcast(lk), pairs[subset] == lk["_k"], "left").drop("_k")


# ---------------------------------------------------------------- A5
SKETCH = "grp {grp}, seed int, n bigint, u bigint, pair_id bigint"


def _sketch_batches(k: int, seeds: list[int], schema_names: Sequence[str]):
    """Rows (pair_id, grp, u of every seed) to a task's bottom-k sketch: per
    group a row with its count (seed null) and, per seed, the k rows with the
    smallest (u, pair_id)."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        groups, names = {}, []  # group -> [count, u (seeds, <= k), ids (seeds, <= k)]
        kind = pa.null()
        for batch in batches:
            if not len(batch):
                continue
            kind = batch.column(1).type
            codes = batch.column(1).dictionary_encode()
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            u = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(len(ids), len(seeds))
            at = codes.indices.to_numpy(zero_copy_only=False)
            for code, name in enumerate(codes.dictionary.to_pylist()):
                own = np.flatnonzero(at == code)
                held = groups.get(name)
                if held is None:
                    held = groups[name] = [0, [np.empty(0, np.int64)] * len(seeds), [np.empty(0, np.int64)] * len(seeds)]
                held[0] += len(own)
                most = np.array([x[-1] if len(x) == k else U_RANGE for x in held[1]])
                mine = u[own]
                for s in np.flatnonzero((mine <= most).any(axis=0)):
                    pick = own[mine[:, s] <= most[s]]
                    us, rows = np.concatenate((held[1][s], u[pick, s])), np.concatenate((held[2][s], ids[pick]))
                    first = np.lexsort((rows, us))[:k]
                    held[1][s], held[2][s] = us[first], rows[first]
        for name, (count, us, rows) in groups.items():
            n = [len(x) for x in us]
            yield pa.RecordBatch.from_arrays([
                pa.array([name] * (1 + sum(n)), kind),
                pa.array([None, *np.repeat(np.array(seeds, np.int32), n).tolist()], pa.int32()),
                pa.array([count] + [None] * sum(n), pa.int64()),
                pa.array([None, *np.concatenate(us).tolist()], pa.int64()),
                pa.array([None, *np.concatenate(rows).tolist()], pa.int64())], list(schema_names))
    return run


def bottom_k(meta: DataFrame, k: int, seeds: int | Sequence[int], grp: str = "grp", key: str = "pair_id") -> DataFrame:
    """The written bottom-k sketches of all tasks, from one read of the keys:
    ``(grp, seed, n, u, pair_id)`` with k rows at most for each task, group
    and seed, and a row with the count ``n`` (seed null) for each task and
    group.  The hashes are made by the JVM, the heaps kept in numpy."""
    seed_list = _seeds(seeds)
    rows = meta.filter(F.col(grp).isNotNull()).select(F.col(key).cast("bigint").alias("pair_id"), F.col(grp).alias("grp"))
    u = F.array(*[md5_uniform(F.col("pair_id"), F.lit(s)) for s in seed_list])
    schema = SKETCH.format(grp=dict(rows.dtypes)["grp"])
    names = [f.split(" ")[0] for f in schema.split(", ")]
    return write_and_read(rows.select("pair_id", "grp", u.alias("u")).mapInArrow(_sketch_batches(k, seed_list, names), schema),
                          "sketch")


def sketch_sizes(sketch: DataFrame) -> DataFrame:
    """``(grp, _n)``: rows of every group."""
    return sketch.filter(F.col("seed").isNull()).groupBy("grp").agg(F.sum("n").alias("_n"))


def sample_per_group(meta: DataFrame, k: int, seeds: int | Sequence[int], grp: str = "grp",
                     key: str = "pair_id") -> DataFrame:
    """A5: exactly k rows per (seed, group) -> ``(seed, grp, slot, pair_id)``.

    Groups with n >= k: the k rows with the smallest ``md5(key|seed)``
    (ties by key), slot = rank.  Groups with n < k: k draws with
    replacement, slot j takes the row of rank ``md5(grp|seed|j) % n + 1``.
    Rows with a null group are never sampled; an empty table gives no rows.
    """
    return sample_per_group_multi(meta, [k], seeds, grp, key).drop("k")


def sample_per_group_multi(meta: DataFrame, ks: Sequence[int], seeds: int | Sequence[int],
                           grp: str = "grp", key: str = "pair_id", sketch: DataFrame | None = None) -> DataFrame:
    """A5 for several k at once -> ``(k, seed, grp, slot, pair_id)``.

    The sketches (``bottom_k``, made for the largest k) hold the k smallest
    for every smaller k.  Their merge ranks (tasks x k) rows of a (seed,
    group) at most, and keeps k of them in every task before it shuffles.
    """
    ks = sorted({int(k) for k in ks})
    k_max = ks[-1]
    sketch = bottom_k(meta, k_max, seeds, grp, key) if sketch is None else sketch
    order = Window.partitionBy("seed", "grp").orderBy("u", "pair_id")
    best = sketch.filter(F.col("seed").isNotNull()).withColumn("_rk", F.row_number().over(order)).filter(F.col("_rk") <= k_max)
    best = best.groupBy("seed", "grp").agg(F.sort_array(F.collect_list(F.struct("_rk", "pair_id"))).alias("_best"))
    best = best.join(sketch_sizes(sketch), "grp")
    best = best.select("seed", "grp", "_n", "_best", F.explode(F.array(*[F.lit(k).cast("int") for k in ks])).alias("k"))
    slots = best.select("k", "seed", "grp", "_n", "_best", F.explode(F.sequence(F.lit(1).cast("int"), F.col("k"))).alias("slot"))
    drawn = (md5_uniform(F.col("grp"), F.col("seed"), F.col("slot")) % F.col("_n") + 1).cast("int")
    rank = F.when(F.col("_n") < F.col("k"), drawn).otherwise(F.col("slot"))
    rows = slots.select("k", "seed", "grp", "slot", F.get(F.col("_best.pair_id"), rank - 1).alias("pair_id"))
    return write_and_read(rows, "sample")


# ---------------------------------------------------------------- A6-A8
def sampled_values(sample: DataFrame, packed: DataFrame, head_ids: list[int],
                   bound: int | None = None, cfg: Sequence[str] = ()) -> DataFrame:
    """Sampled rows joined to their packed scores, exploded per head:
    ``(cfg..., seed, grp, slot, pair_id, head_id, c, r)``.  ``bound`` =
    seeds x groups x k rows."""
    s = checked_broadcast(sample, bound)
    ids = F.lit([int(i) for i in head_ids]).cast("array<bigint>")
    j = packed.select("pair_id", "sc", "sr").join(s, "pair_id")
    z = F.arrays_zip(ids.alias("head_id"), F.col("sc").alias("c"), F.col("sr").alias("r"))
    return j.select(*cfg, "seed", "grp", "slot", "pair_id", F.inline(z))


def group_head_stats(sampled: DataFrame, cfg: Sequence[str] = ()) -> DataFrame:
    """Mean and sample std of the 2k values (chosen and rejected) per
    (seed, group, head); duplicates count; a std of 0 becomes 1."""
    keys = [*cfg, "seed", "grp", "head_id"]
    both = sampled.select(*keys, F.explode(F.array(F.col("c"), F.col("r"))).alias("v"))
    g = both.groupBy(*keys).agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("_sd"))
    sd = F.when(F.col("_sd") == 0, F.lit(1.0)).otherwise(F.col("_sd"))
    return g.select(*keys, "mean", sd.alias("std"))


def standardise(df: DataFrame, stats: DataFrame, cols: Sequence[str] = ("c", "r"),
                keys: Sequence[str] = ("seed", "grp", "head_id")) -> DataFrame:
    """``(s - mean) / std`` with the (seed, group, head) statistics."""
    j = df.join(stats, list(keys))
    for c in cols:
        j = j.withColumn(c, (F.col(c) - F.col("mean")) / F.col("std"))
    return j.drop("mean", "std")


def group_head_loss(sampled: DataFrame, stats: DataFrame, mode: str = "normalised",
                    cfg: Sequence[str] = ()) -> DataFrame:
    """Sum over the k sampled pairs of softplus(-(c - r)), on standardised
    scores (``normalised``), raw scores (``raw``) or raw deltas (``delta``)."""
    keys = [*cfg, "seed", "grp", "head_id"]
    if mode == "normalised":
        z = standardise(sampled, stats, keys=keys)
    elif mode in ("raw", "delta"):
        z = sampled
    else:
        raise ValueError(f"mode must be one of {MODES}")
    return z.groupBy(*keys).agg(F.sum(softplus(-(F.col("c") - F.col("r")))).alias("loss"))


# ---------------------------------------------------------------- A9-A10
def softmax_weights(loss: DataFrame, temperature: float | str = 1.0, cfg: Sequence[str] = ()) -> DataFrame:
    """Softmax over heads of -loss/T within (seed, group); ``temperature``
    is a number or the name of a column."""
    w = Window.partitionBy(*cfg, "seed", "grp")
    t = F.col(temperature) if isinstance(temperature, str) else F.lit(float(temperature))
    x = -F.col("loss") / t
    e = loss.withColumn("_x", x).withColumn("_e", F.exp(F.col("_x") - F.max("_x").over(w)))
    return e.select(*cfg, "seed", "grp", "head_id", (F.col("_e") / F.sum("_e").over(w)).alias("weight"))


def uniform_weights(loss: DataFrame, cfg: Sequence[str] = ()) -> DataFrame:
    """A10: 1/H per head."""
    w = Window.partitionBy(*cfg, "seed", "grp")
    return loss.select(*cfg, "seed", "grp", "head_id", (1.0 / F.count(F.lit(1)).over(w)).alias("weight"))


# ---------------------------------------------------------------- A11-A13
def coefficients(stats: DataFrame, weights: DataFrame, cfg: Sequence[str] = ()) -> DataFrame:
    """Per (seed, group): mean / std / weight arrays in head order (H entries)."""
    j = weights.join(stats, [*cfg, "seed", "grp", "head_id"])
    s = F.sort_array(F.collect_list(F.struct("head_id", "mean", "std", "weight")))
    return j.groupBy(*cfg, "seed", "grp").agg(s.alias("_h")).select(
        *cfg, "seed", "grp", F.col("_h.head_id").alias("_ids"), F.col("_h.mean").alias("_m"),
        F.col("_h.std").alias("_s"), F.col("_h.weight").alias("_w"))


def _weighted(vals: str, mode: str) -> Column:
    z = F.arrays_zip(F.col(vals).alias("v"), F.col("_m").alias("m"), F.col("_s").alias("s"),
                     F.col("_w").alias("w"))
    if mode == "normalised":
        term = lambda t: (t["v"] - t["m"]) / t["s"] * t["w"]
    else:
        term = lambda t: t["v"] * t["w"]
    return F.aggregate(z, F.lit(0.0).cast("double"), lambda acc, t: acc + term(t))


def apply_weights(packed: DataFrame, stats: DataFrame, weights: DataFrame,
                  seeds: int | Sequence[int], mode: str = "normalised",
                  keep: Sequence[str] = (), n_groups: int | None = None) -> DataFrame:
    """Re-score every pair under its group's weights, per seed.

    ``normalised``: sum_h (s - mean)/std * w; ``raw``: sum_h s * w;
    ``delta``: sum_h (c - r) * w (as ``agg_delta``).  Pairs without a group
    keep 0 and 0 and so count as wrong.  Output ``(seed, pair_id, keep...,
    agg_chosen, agg_rejected[, agg_delta])``.
    """
    bound = None if n_groups is None else n_groups * len(_seeds(seeds))
    wide = 128 + 32 * stats.select("head_id").distinct().count()  # four arrays of one entry per head
    coef = checked_broadcast(coefficients(stats, weights), bound, wide)
    p = packed.select("pair_id", "grp", *keep, "sc", "sr", seed_column(seeds).alias("seed"))
    j = p.join(coef, ["seed", "grp"], "left")
    zero = F.lit(0.0)
    if mode == "delta":
        j = j.withColumn("_d", F.zip_with("sc", "sr", lambda a, b: a - b))
        return j.select("seed", "pair_id", *keep,
                        F.coalesce(_weighted("_d", "raw"), zero).alias("agg_delta"))
    return j.select("seed", "pair_id", *keep,
                    F.coalesce(_weighted("sc", mode), zero).alias("agg_chosen"),
                    F.coalesce(_weighted("sr", mode), zero).alias("agg_rejected"))


MAX_COEF_BYTES = 512 * 1024 * 1024
#: Pairs of a salted group, on average.
PAIR_ROWS = 4096


def _folded(rows, configs: list[tuple], seeds: list[int], ids: list[int], cfg: Sequence[str], mode: str) -> dict:
    """Per group, the weights folded into one linear map: ``A`` (C*S, H) and
    ``b`` (C*S,) with ``agg = s @ A.T - b``.  For the normalised form
    ``A = w / std`` and ``b = sum_h mean * w / std``, which is
    ``sum_h (s - mean) / std * w`` rearranged; for raw scores and deltas
    ``A = w`` and ``b = 0``.  Heads outside a configuration's set get weight
    0."""
    import numpy as np
    hpos = {h: i for i, h in enumerate(ids)}
    cpos = {c: i for i, c in enumerate(configs)}
    spos = {sd: i for i, sd in enumerate(seeds)}
    n_cs = len(configs) * len(seeds)
    out: dict = {}
    for r in rows:
        a, b = out.setdefault(r["grp"], (np.zeros((n_cs, len(ids))), np.zeros(n_cs)))
        row = cpos[tuple(r[c] for c in cfg)] * len(seeds) + spos[r["seed"]]
        cols = [hpos[int(h)] for h in r["_ids"]]
        w = np.asarray(r["_w"], dtype=np.float64)
        if mode == "normalised":
            sd = np.asarray(r["_s"], dtype=np.float64)
            a[row, cols] = w / sd
            b[row] = float(np.sum(np.asarray(r["_m"], dtype=np.float64) * w / sd))
        else:
            a[row, cols] = w
    return out


def _coef_tensors(stats: DataFrame, weights: DataFrame, seeds: list[int], head_ids: list[int] | None,
                  cfg: Sequence[str], max_bytes: int, mode: str, rows_bound: int | None = None):
    """The folded maps of every group on the driver.  The size (rows x heads
    x 3 doubles) is checked *before* the rows are pulled."""
    coef = coefficients(stats, weights, cfg)
    n_rows = coef.count() if rows_bound is None else rows_bound
    n_heads = len(head_ids) if head_ids is not None else stats.select("head_id").distinct().count()
    if n_rows * max(n_heads, 1) * 3 * 8 > max_bytes:
        raise ValueError("coefficient tensors exceed the broadcast limit")
    rows = coef.collect()
    if not rows:
        return {}, []
    ids = head_ids if head_ids is not None else sorted({int(h) for r in rows for h in r["_ids"]})
    configs = sorted({tuple(r[c] for c in cfg) for r in rows})
    return _folded(rows, configs, seeds, ids, cfg, mode), configs


class _Given:
    """A value in the place of a broadcast variable."""

    def __init__(self, value):
        self.value = value


def _cogrouped(packed: DataFrame, stats: DataFrame, weights: DataFrame, seeds: list[int], head_ids: list[int] | None,
               cfg: list[str], keep: list[str], mode: str, block_bytes: int, pair_rows: int, run_of, schema: str) -> DataFrame:
    """A11-A13 without a broadcast: ``run_of(coefficients, configs, seeds)``
    over cogroups of salted pair groups with blocks of their weights.

    A group's pairs are dealt to salts of about ``pair_rows``, its
    coefficients to blocks of about ``block_bytes``; a task holds one of each.
    Pairs are sent once per block.  Groups without weights, and null ones,
    meet the list of (configuration, seed) alone and so keep 0.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType
    names = [*cfg, "seed"]
    ids = head_ids if head_ids is not None else sorted(
        r.head_id for r in stats.select("head_id").distinct().toLocalIterator())  # H numbers
    coef = coefficients(stats, weights, cfg)
    grid = weights.select(*names).distinct()
    n_grid = grid.count()
    blocks = max(1, -(-n_grid * max(len(ids), 1) * 24 // block_bytes))
    block = F.pmod(F.xxhash64(*names), F.lit(blocks)).cast("int")
    sizes = packed.groupBy("grp").agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.select(F.col("grp").alias("_g"), F.ceil(F.col("_n") / pair_rows).cast("int").alias("_salts"))
    same = F.col("grp").eqNullSafe(F.col("_g"))
    # every (group, configuration, seed), with weights where there are any
    every = sizes.select(F.col("_g").alias("grp"), "_salts").join(F.broadcast(grid))  # a few rows: configurations x seeds
    of = coef.select(F.col("grp").alias("_cg"), *[F.col(n).alias(f"_c_{n}") for n in names], "_ids", "_m", "_s", "_w")
    cond = F.col("grp").eqNullSafe(F.col("_cg"))
    for n in names:
        cond = cond & F.col(n).eqNullSafe(F.col(f"_c_{n}"))
    right = every.join(of, cond, "left").select("grp", "_salts", *names, "_ids", "_m", "_s", "_w")
    right = right.withColumn("_block", block).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).drop("_salts")
    left = packed.select("pair_id", "grp", *keep, "sc", "sr").join(sizes, same).withColumn(
        "_salt", F.pmod(F.xxhash64("pair_id", F.lit(7)), "_salts").cast("int")).drop("_g", "_salts")
    left = left.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    result = to_arrow_schema(StructType.fromDDL(schema))

    def run(pairs: pa.Table, rows: pa.Table) -> pa.Table:
        import pandas as pd
        rows = rows.to_pylist()
        done = []
        for config in sorted({tuple(r[c] for c in cfg) for r in rows}):
            own = [r for r in rows if tuple(r[c] for c in cfg) == config]
            some = sorted(r["seed"] for r in own)
            folded = _folded([r for r in own if r["_ids"] is not None], [config], some, ids, cfg, mode)
            done += run_of(_Given(folded), [config], some)(iter([pairs.to_pandas()]))
        return pa.Table.from_pandas(pd.concat(done), schema=result, preserve_index=False) if done else result.empty_table()
    return left.groupBy("grp", "_block", "_salt").cogroup(right.groupBy("grp", "_block", "_salt")).applyInArrow(run, schema)


def _score_matrices(pdf):
    """(sc, sr, whole): the packed scores as matrices; rows without scores on
    a side are zeros and not ``whole``."""
    import numpy as np
    sc, sr = pdf["sc"].to_numpy(), pdf["sr"].to_numpy()
    whole = np.array([x is not None and y is not None for x, y in zip(sc, sr)], bool)
    if whole.all():
        return np.stack(sc), np.stack(sr), whole
    width = max((len(x) for x in sc[whole]), default=0)
    out = np.zeros((2, len(pdf), width))
    if whole.any():
        out[0, whole], out[1, whole] = np.stack(sc[whole]), np.stack(sr[whole])
    return out[0], out[1], whole


def _apply_batches(bc, seeds: list[int], configs: list[tuple], cfg: list[str], keep: list[str], mode: str):
    import numpy as np
    import pandas as pd

    def run(batches):
        coef = bc.value
        n_c, n_s = max(len(configs), 1), len(seeds)
        for pdf in batches:
            n = len(pdf)
            if n == 0:
                continue
            sc_, sr_, whole = _score_matrices(pdf)
            agg_c = np.zeros((n, n_c * n_s))
            agg_r = np.zeros((n, n_c * n_s))
            grp = pdf["grp"].to_numpy()
            for g in pd.unique(grp):
                if g is None or (isinstance(g, float) and np.isnan(g)) or g not in coef:
                    continue
                idx = np.nonzero((grp == g) & whole)[0]
                a, b = coef[g]
                if mode == "delta":
                    agg_c[idx] = (sc_[idx] - sr_[idx]) @ a.T
                else:
                    agg_c[idx] = sc_[idx] @ a.T - b
                    agg_r[idx] = sr_[idx] @ a.T - b
            reps = n_c * n_s
            out = {}
            for j, c in enumerate(cfg):
                out[c] = np.tile(np.repeat(np.array([cf[j] for cf in configs]), n_s), n)
            out["seed"] = np.tile(np.array(seeds, dtype=np.int32), n * n_c)
            out["pair_id"] = np.repeat(pdf["pair_id"].to_numpy(), reps)
            for c in keep:
                out[c] = np.repeat(pdf[c].to_numpy(), reps)
            if mode == "delta":
                out["agg_delta"] = agg_c.reshape(-1)
            else:
                out["agg_chosen"] = agg_c.reshape(-1)
                out["agg_rejected"] = agg_r.reshape(-1)
            yield pd.DataFrame(out)
    return run


def apply_weights_arrow(packed: DataFrame, stats: DataFrame, weights: DataFrame,
                        seeds: int | Sequence[int], mode: str = "normalised",
                        keep: Sequence[str] = (), max_bytes: int = MAX_COEF_BYTES,
                        cfg: Sequence[str] = (), head_ids: list[int] | None = None,
                        rows_bound: int | None = None, pair_rows: int = PAIR_ROWS) -> DataFrame:
    """A11/A12/A13 on Arrow batches: per group the weights are folded into a
    (configurations x seeds, heads) matrix, broadcast once (size-checked),
    and every pair is re-scored for all configurations and seeds with one
    BLAS matrix product per group present in the batch (memory per batch:
    rows x configurations x seeds).  Same rule and output as
    ``apply_weights``, plus the configuration columns ``cfg``.  Coefficients
    above ``max_bytes`` are broadcast in blocks of seeds; where those of one
    seed alone are above it, pairs and coefficients meet in cogroups."""
    seed_list = _seeds(seeds)
    cfg = list(cfg)
    blocks = _seed_blocks(stats, weights, seed_list, head_ids, max_bytes, rows_bound)
    if blocks is None:
        fields = _agg_fields(packed, weights, cfg, keep, mode)
        return _cogrouped(packed, stats, weights, seed_list, head_ids, cfg, list(keep), mode, max_bytes, pair_rows,
                          lambda bc, configs, some: _apply_batches(bc, some, configs, cfg, list(keep), mode), fields)
    if len(blocks) > 1:
        return reduce(DataFrame.unionByName, [apply_weights_arrow(
            packed, stats.where(F.col("seed").isin(b)), weights.where(F.col("seed").isin(b)), b, mode, keep, max_bytes,
            cfg, head_ids, rows_bound and -(-rows_bound * len(b) // len(seed_list))) for b in blocks])
    coef, configs = _coef_tensors(stats, weights, seed_list, head_ids, cfg, max_bytes, mode, rows_bound)
    if not cfg:
        configs = [()]
    bc = packed.sparkSession.sparkContext.broadcast(coef)
    keep = list(keep)
    src = packed.select("pair_id", "grp", *keep, "sc", "sr")
    return src.mapInPandas(_apply_batches(bc, seed_list, configs, cfg, keep, mode), _agg_fields(packed, weights, cfg, keep, mode))


def _agg_fields(packed: DataFrame, weights: DataFrame, cfg: Sequence[str], keep: Sequence[str], mode: str) -> str:
    types = {**dict(packed.dtypes), **dict(weights.dtypes)}
    fields = [f"{c} {types[c]}" for c in cfg] + ["seed int", "pair_id bigint"] + [f"{c} {types[c]}" for c in keep]
    return ", ".join(fields + (["agg_delta double"] if mode == "delta" else ["agg_chosen double", "agg_rejected double"]))


def _seed_blocks(stats, weights, seeds: list[int], head_ids, max_bytes: int, rows_bound: int | None) -> list[list[int]] | None:
    """The seeds in blocks whose coefficient tensors stay within
    ``max_bytes``; each block is a pass of its own over the packed scores.
    None when one seed's coefficients are too large already."""
    rows = weights.select("seed", "grp", *[c for c in CONFIG if c in weights.columns]).distinct().count() \
        if rows_bound is None else rows_bound
    heads = len(head_ids) if head_ids is not None else stats.select("head_id").distinct().count()
    need = rows * max(heads, 1) * 24
    if -(-need // max(len(seeds), 1)) > max_bytes:
        return None
    n = min(len(seeds), -(-need // max_bytes)) or 1
    size = -(-len(seeds) // n)
    return [seeds[i:i + size] for i in range(0, len(seeds), size)]


def _count_batches(bc, seeds: list[int], configs: list[tuple], cfg: list[str], by: str, mode: str, margin: float):
    import numpy as np
    import pandas as pd

    def run(batches):
        coef, width = bc.value, max(len(configs), 1) * len(seeds)
        seen: dict = {}
        for pdf in batches:
            if not len(pdf):
                continue
            sc_, sr_, whole = _score_matrices(pdf)
            won = np.zeros((len(pdf), width), dtype=bool)
            codes, groups = pd.factorize(pdf["grp"])
            for i, g in enumerate(groups):
                if g in coef:
                    idx = np.flatnonzero((codes == i) & whole)
                    a, b = coef[g]
                    if mode == "delta":
                        ahead = (sc_[idx] - sr_[idx]) @ a.T
                    else:
                        ahead = (sc_[idx] @ a.T - b) - (sr_[idx] @ a.T - b)
                    won[idx] = (ahead > 0) & (ahead >= margin)
            codes, values = pd.factorize(pdf[by])
            for i, value in [*enumerate(values), (-1, None)]:
                idx = np.flatnonzero(codes == i)
                if len(idx):
                    wins, n = seen.get(value, (0, 0))
                    seen[value] = wins + won[idx].sum(axis=0), n + len(idx)
        reps = len(seeds)
        for value, (wins, n) in seen.items():
            out = {c: np.repeat([cf[j] for cf in configs], reps) for j, c in enumerate(cfg)}
            out["seed"] = np.tile(np.array(seeds, dtype=np.int32), max(len(configs), 1))
            yield pd.DataFrame({**out, by: [value] * width, "wins": np.asarray(wins, dtype=np.int64), "n": n})
    return run


def win_counts(packed: DataFrame, stats: DataFrame, weights: DataFrame, seeds: int | Sequence[int], by: str,
               mode: str = "normalised", max_bytes: int = MAX_COEF_BYTES, cfg: Sequence[str] = (),
               head_ids: list[int] | None = None, rows_bound: int | None = None, margin: float = ev.WIN_MARGIN,
               pair_rows: int = PAIR_ROWS) -> DataFrame:
    """Wins and pairs per (configuration, seed, ``by``): the metrics' form of
    A11-A13.  Pairs are re-scored and compared inside the Arrow batch; a task
    emits one row per configuration, seed and value of ``by``, whatever the
    number of its pairs."""
    seed_list, cfg = _seeds(seeds), list(cfg)
    types = {**dict(packed.dtypes), **dict(weights.dtypes)}
    fields = ", ".join([*[f"{c} {types[c]}" for c in cfg], "seed int", f"{by} {types[by]}", "wins bigint", "n bigint"])
    blocks = _seed_blocks(stats, weights, seed_list, head_ids, max_bytes, rows_bound)
    if blocks is None:
        part = _cogrouped(packed, stats, weights, seed_list, head_ids, cfg, [by] if by != "grp" else [], mode, max_bytes,
                          pair_rows, lambda bc, configs, some: _count_batches(bc, some, configs, cfg, by, mode, margin), fields)
    elif len(blocks) > 1:
        return reduce(DataFrame.unionByName, [win_counts(
            packed, stats.where(F.col("seed").isin(b)), weights.where(F.col("seed").isin(b)), b, by, mode, max_bytes,
            cfg, head_ids, rows_bound and -(-rows_bound * len(b) // len(seed_list)), margin) for b in blocks])
    else:
        coef, configs = _coef_tensors(stats, weights, seed_list, head_ids, cfg, max_bytes, mode, rows_bound)
        bc = packed.sparkSession.sparkContext.broadcast(coef)
        src = packed.select("grp", *([by] if by != "grp" else []), "sc", "sr")
        part = src.mapInPandas(_count_batches(bc, seed_list, configs if cfg else [()], cfg, by, mode, margin), fields)
    return part.groupBy(*cfg, "seed", by).agg(F.sum("wins").alias("wins"), F.sum("n").alias("n"))


def with_agg_win(agg: DataFrame, margin: float = ev.WIN_MARGIN) -> DataFrame:
    if "agg_delta" in agg.columns:
        return agg.withColumn("win", ev.win_delta("agg_delta", margin))
    return agg.withColumn("win", ev.win("agg_chosen", "agg_rejected", margin))


# ---------------------------------------------------------------- A14-A17
def exclude_sampled(agg: DataFrame, sample: DataFrame) -> DataFrame:
    """Drop, per seed, the pairs that were drawn for that seed's weights
    (left anti join with the broadcast sample)."""
    return agg.join(checked_broadcast(sample.select("seed", "pair_id").distinct()), ["seed", "pair_id"], "left_anti")


def tta_section_scores(agg: DataFrame, section_map: Mapping, counts: Mapping,
                       decimals: int | None = 3, sample: DataFrame | None = None,
                       keys: Sequence[str] = ("seed",)) -> DataFrame:
    """Subset accuracy -> section scores -> overall, per seed, rounded
    per seed.  ``agg`` is a row per pair and seed, or the counts of
    ``win_counts``.  All pairs count, the sampled ones included, as in the
    reference; pass ``sample`` (with rows per pair) to evaluate on the
    unsampled pairs only."""
    if "wins" in agg.columns:
        acc = agg.select(*keys, "subset", (F.col("wins") / F.col("n")).alias("accuracy"), "n")
        return ev.leaderboard(acc, section_map, counts, keys=list(keys), decimals=decimals)
    if sample is not None:
        agg = exclude_sampled(agg, sample)
    acc = ev.subset_accuracy(with_agg_win(agg), keys=list(keys))
    return ev.leaderboard(acc, section_map, counts, keys=list(keys), decimals=decimals)


def tta_task_scores(agg: DataFrame, n_tasks: int, task: str = "task_id",
                    decimals: int | None = 3, keys: Sequence[str] = ("seed",)) -> DataFrame:
    """Per-task accuracy (null for an empty task) and overall, per seed."""
    rows = agg if "wins" in agg.columns else with_agg_win(agg)
    return ev.task_accuracy(rows, n_tasks, keys=list(keys), task=task,
                            decimals=decimals)


def seed_statistics(metrics: DataFrame, keys: Sequence[str] = (), decimals: int | None = 3) -> DataFrame:
    """Per metric, mean over seeds (3 dp) and population std (4 dp).

    When the per-seed values are already rounded to ``decimals``, the mean is
    taken on the scaled integers, so a half-way mean rounds the same way in
    every engine.
    """
    v = F.col("value")
    if decimals is not None:
        scale = 10 ** decimals
        mean = F.round(F.sum(F.round(v * scale).cast("long")) / F.count(v), 0) / scale
    else:
        mean = ev.round_clean(F.avg(v), 3)
    return metrics.groupBy(*keys, "metric").agg(mean.alias("mean"),
                                                ev.round_clean(F.stddev_pop(v), 4).alias("std"))


# ---------------------------------------------------------------- A1-A3
def choose_heads(heads: DataFrame, n: int, with_original: bool = False,
                 original_id: int | None = None, form: str = "file") -> DataFrame:
    """A1/A2: choose ``n`` heads of a decomposed set and renumber them.

    The plus half is the first half of the id order, the minus half the
    second.  Without an original head: first n/2 of each half.  With one:
    ``file`` form puts it first and takes n/2 - 1 minus heads; ``map`` form
    keeps it first and drops the last minus head only when n is even.
    ``first`` form (head sets that are not +/- pairs, e.g. random heads):
    the first n heads in id order.
    Output ``(head_id, source_head_id)``; the original head gets ``0``.
    Raises when the set has fewer heads than asked for.
    """
    base = heads.filter(F.col("head_id") != F.lit(original_id)) if original_id is not None else heads
    have = base.count() + bool(with_original)
    if have < n:
        raise ValueError(f"{n} heads asked for, {have} given")
    if form == "first":
        if with_original:
            raise ValueError("the form 'first' has no place for an original head")
        w = Window.orderBy("source_head_id")  # the head table: H rows
        r = base.select(F.col("head_id").alias("source_head_id")).withColumn("_r", F.row_number().over(w) - 1)
        return r.filter(F.col("_r") < n).select(F.col("_r").cast("bigint").alias("head_id"), "source_head_id")
    w = Window.orderBy("head_id")
    r = (base.select("head_id").withColumn("_r", F.row_number().over(w) - 1)
         .withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy())))
    half = F.floor(F.col("_n") / 2)
    plus = F.col("_r") < half
    pos = F.when(plus, F.col("_r")).otherwise(F.col("_r") - half)
    n_minus = n // 2
    if with_original and (form == "file" or n % 2 == 0):
        n_minus = n // 2 - 1
    keep = F.when(plus, pos < n // 2).otherwise(pos < n_minus)
    order = F.when(plus, pos).otherwise(pos + n // 2)
    chosen = r.filter(keep).select(F.col("head_id").alias("source_head_id"), order.alias("_o"))
    shift = 1 if with_original else 0
    out = chosen.select((F.row_number().over(Window.orderBy("_o")) - 1 + shift).cast("bigint").alias("head_id"),
                        "source_head_id")
    if with_original:
        o = heads.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("head_id"),
                                               F.lit(original_id).cast("bigint").alias("source_head_id"))
        out = o.unionByName(out)
    return out


def merge_heads(scores: DataFrame, head_ids: Sequence[int]) -> DataFrame:
    """A3: one row per pair, columns ``sc_<h>``/``sr_<h>`` per head (wide view)."""
    ids = [int(h) for h in head_ids]
    p = scores.groupBy("pair_id").pivot("head_id", ids).agg(
        F.first("s_chosen").alias("sc"), F.first("s_rejected").alias("sr"))
    ren = []
    for h in ids:
        ren += [F.col(f"{h}_sc").alias(f"sc_{h}"), F.col(f"{h}_sr").alias(f"sr_{h}")]
    return p.select("pair_id", *ren)


# ---------------------------------------------------------------- composition
@dataclass
class Adaptation:
    sample: DataFrame
    sampled: DataFrame
    stats: DataFrame
    loss: DataFrame
    weights: DataFrame
    rescored: Callable[[], DataFrame]
    wins: Callable[[str], DataFrame]

    @cached_property
    def agg(self) -> DataFrame:
        """A row per pair, seed and configuration; planned when first asked for."""
        return self.rescored()


def adapt_from_vectors(pairs: DataFrame, heads, k: int, seeds: int | Sequence[int] = 20,
                       temperature: float = 1.0, mode: str = "normalised", keep: Sequence[str] = (),
                       uniform: bool = False) -> Adaptation:
    """The adaptation for one configuration straight from pair vectors
    (``pair_id, grp, chosen, rejected``)."""
    return _single(adapt_grid(pairs, heads, None, [k], [temperature], seeds, mode, keep, uniform))


CONFIG = ("num_heads", "k", "temperature")


def adapt_grid_packed(packed: DataFrame, head_ids: list[int], head_sets: Mapping[int, Sequence[int]] | None,
                      ks: Sequence[int], temperatures: Sequence[float], seeds: int | Sequence[int] = 20,
                      mode: str = "normalised", keep: Sequence[str] = (), uniform: bool = False,
                      max_bytes: int = MAX_COEF_BYTES) -> Adaptation:
    """A18 on packed scores: every configuration (head subset x k x
    temperature) and every seed in the same jobs, with the configuration as
    columns.

    ``packed`` has ``pair_id, grp, keep..., sc, sr`` with the scores in the
    order of ``head_ids`` (a written table: it is read by three stages).
    One sample per k (group sizes counted once), statistics / losses /
    weights grouped by configuration, and one Arrow pass that produces every
    (configuration, seed) weighted sum.  ``head_sets`` maps ``num_heads`` to
    the head ids it uses (default: all heads)."""
    head_sets = head_sets or {len(head_ids): list(head_ids)}
    seed_list = _seeds(seeds)
    spark = packed.sparkSession
    sketch = bottom_k(packed.select("pair_id", "grp"), max(ks), seed_list)
    n_groups = sketch.filter(F.col("seed").isNull()).select("grp").distinct().count()
    sample = sample_per_group_multi(packed, ks, seed_list, sketch=sketch)
    bound = n_groups * len(seed_list) * int(sum(ks))
    hmap = spark.createDataFrame([(int(n), int(h)) for n, hs in head_sets.items() for h in hs],
                                 "num_heads int, head_id bigint")
    # head-set map: configurations x heads rows, a constant of the call
    sampled = sampled_values(sample, packed, head_ids, bound, cfg=["k"]).join(F.broadcast(hmap), "head_id")
    sampled = write_and_read(sampled, "sampled")
    cfg = ["num_heads", "k"]
    stats = group_head_stats(sampled, cfg)
    temps = F.explode(F.array(*[F.lit(float(t)) for t in temperatures])).alias("temperature")
    loss = group_head_loss(sampled, stats, mode, cfg).select("*", temps)
    cfg_t = [*cfg, "temperature"]
    weights = uniform_weights(loss, cfg_t) if uniform else softmax_weights(loss, "temperature", cfg_t)
    # statistics and weights side by side in one small materialised table
    keys = [*cfg, "seed", "grp", "head_id"]
    both = write_and_read(weights.join(stats, keys), "weights")
    stats = both.filter(F.col("temperature") == F.lit(float(temperatures[0]))).select(*keys, "mean", "std")
    weights = both.select(*cfg_t, "seed", "grp", "head_id", "weight")
    n_configs = len(head_sets) * len(ks) * len(temperatures)
    rows_bound = n_groups * n_configs * len(seed_list)
    coef = both.select(*cfg_t, "seed", "grp", "head_id", "mean", "std")

    def rescored() -> DataFrame:
        return apply_weights_arrow(packed, coef, weights, seed_list, mode, keep, max_bytes, cfg=cfg_t, head_ids=list(head_ids),
                                   rows_bound=rows_bound)

    def wins(by: str) -> DataFrame:
        return win_counts(packed, coef, weights, seed_list, by, mode, max_bytes, cfg=cfg_t, head_ids=list(head_ids),
                          rows_bound=rows_bound)
    return Adaptation(sample, sampled, stats, loss, weights, rescored, wins)


def adapt_grid(pairs: DataFrame, heads, head_sets: Mapping[int, Sequence[int]] | None,
               ks: Sequence[int], temperatures: Sequence[float], seeds: int | Sequence[int] = 20,
               mode: str = "normalised", keep: Sequence[str] = (), uniform: bool = False) -> Adaptation:
    """A18 from pair vectors (``pair_id, grp, chosen, rejected``): every pair
    is scored once under the full head set in one Arrow pass and the packed
    scores (2H doubles a pair instead of 2d floats) are written, then
    ``adapt_grid_packed`` runs on them."""
    from prefspark.operators.scoring import HeadMatrix, collect_heads, score_heads_packed
    if isinstance(heads, DataFrame) and head_sets:
        # score only the heads some configuration uses (e.g. 100 of 4096)
        used = sorted({int(h) for hs in head_sets.values() for h in hs})
        heads = heads.filter(F.col("head_id").isin(used))
    hm = collect_heads(heads) if isinstance(heads, DataFrame) else heads
    if head_sets and not isinstance(heads, DataFrame):
        used = sorted({int(h) for hs in head_sets.values() for h in hs})
        pos = {h: i for i, h in enumerate(hm.ids)}
        hm = HeadMatrix(used, hm.w[[pos[h] for h in used]])
    packed, ids = score_heads_packed(pairs, hm)
    packed = materialise_table(packed.select("pair_id", "grp", *keep, "sc", "sr"))
    return adapt_grid_packed(packed, ids, head_sets, ks, temperatures, seeds, mode, keep, uniform)


def _single(g: Adaptation) -> Adaptation:
    drop = lambda df: df.drop(*[c for c in CONFIG if c in df.columns])
    return Adaptation(drop(g.sample), drop(g.sampled), drop(g.stats), drop(g.loss), drop(g.weights), lambda: drop(g.agg),
                      lambda by: drop(g.wins(by)))


def adapt(packed: DataFrame, head_ids: list[int], k: int, seeds: int | Sequence[int] = 20,
          temperature: float = 1.0, mode: str = "normalised", keep: Sequence[str] = (),
          uniform: bool = False) -> Adaptation:
    """The adaptation for one configuration on packed scores (e.g. scores
    read back from files): ``adapt_grid_packed`` with a single (all heads, k,
    T) configuration, configuration columns dropped."""
    return _single(adapt_grid_packed(packed, head_ids, None, [k], [temperature], seeds, mode, keep, uniform))
