"""Evaluation aggregates (V1-V6).

All of them are grouped aggregates with map-side partial aggregation; the
number of output rows is heads x subsets / sections / tasks, whatever the
number of pairs.  Section maps and example counts are lookup constants
(dicts), turned into tiny broadcast tables or literal arrays.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A difference below half a unit of the ninth decimal counts as a tie, so that
# a tie up to summation order is one in every engine; 0 compares exactly.
WIN_MARGIN = 5e-10


def round_clean(x: Column | str, decimals: int) -> Column:
    """Half-up rounding that first drops float noise below 1e-12, so that a
    value that is a tie up to summation order rounds the same way everywhere."""
    c = F.col(x) if isinstance(x, str) else x
    return F.round(F.round(c, 12), decimals)


def win(chosen: Column | str, rejected: Column | str, margin: float = WIN_MARGIN) -> Column:
    """V1: 1 iff chosen scores higher by at least ``margin`` (strictly higher
    for 0; ties count 0)."""
    c = F.col(chosen) if isinstance(chosen, str) else chosen
    r = F.col(rejected) if isinstance(rejected, str) else rejected
    return win_delta(c - r, margin)


def win_delta(delta: Column | str, margin: float = WIN_MARGIN) -> Column:
    """V1 (delta form): 1 iff delta is positive and at least ``margin``."""
    d = F.col(delta) if isinstance(delta, str) else delta
    return F.when((d > 0) & (d >= margin), 1).otherwise(0)


def with_win(scores: DataFrame, chosen: str = "s_chosen", rejected: str = "s_rejected",
             margin: float = WIN_MARGIN) -> DataFrame:
    return scores.withColumn("win", win(chosen, rejected, margin))


def subset_accuracy(scored: DataFrame, keys: list[str] | None = None,
                    subset: str = "subset") -> DataFrame:
    """V2: wins / rows per (head, subset) over the subsets present."""
    keys = keys if keys is not None else ["head_id"]
    return (scored.groupBy(*keys, subset)
            .agg(F.avg(F.col("win").cast("double")).alias("accuracy"),
                 F.count(F.lit(1)).alias("n")))


def _lookup_frame(spark, section_map: Mapping, counts: Mapping, subset_type: str):
    lacking = sorted((k for k in section_map if k not in counts), key=str)
    if lacking:
        raise ValueError(f"no example count for subsets {lacking}")
    rows = [(k, v, int(counts[k])) for k, v in section_map.items()]
    return F.broadcast(spark.createDataFrame(rows, f"_sub {subset_type}, section string, weight bigint"))


def section_scores(acc: DataFrame, section_map: Mapping, counts: Mapping,
                   keys: list[str] | None = None, subset: str = "subset") -> DataFrame:
    """V3: per section, sum(acc * n) / sum(n) over the present subsets, with n
    from the fixed count table (not the observed rows); a section with no
    present subset scores 0.  Output ``(keys..., section, score)``.

    One pass: each accuracy row is offered to every section and weighted
    only where its subset belongs, so every key gets every section without
    a second read of ``acc``.
    """
    keys = keys if keys is not None else ["head_id"]
    subset_type = dict(acc.dtypes)[subset]
    lk = _lookup_frame(acc.sparkSession, section_map, counts, subset_type)
    sections = sorted(set(section_map.values()))
    offered = acc.select(*keys, subset, "accuracy",
                         F.explode(F.array(*[F.lit(x) for x in sections])).alias("section"))
    j = offered.join(lk, (offered[subset] == lk["_sub"]) & (offered["section"] == lk["section"]), "left") \
        .drop(lk["section"]).drop("_sub")
    per = j.groupBy(*keys, "section").agg(
        F.sum(F.col("accuracy") * F.col("weight")).alias("_aw"), F.sum("weight").alias("_w"))
    score = F.when(F.col("_w") > 0, F.col("_aw") / F.col("_w")).otherwise(F.lit(0.0))
    return per.select(*keys, "section", score.alias("score"))


def overall_score(sections: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """V4: plain mean of the section scores."""
    keys = keys if keys is not None else ["head_id"]
    return sections.groupBy(*keys).agg(F.avg("score").alias("overall"))


def leaderboard(acc: DataFrame, section_map: Mapping, counts: Mapping,
                keys: list[str] | None = None, decimals: int | None = 3) -> DataFrame:
    """V3 + V4 as one long table ``(keys..., metric, value)``: every section
    and ``overall`` (mean of the unrounded section scores), then rounded.
    The section rows of a key are gathered once (bounded by the number of
    sections) so the overall needs no second pass."""
    keys = keys if keys is not None else ["head_id"]
    sec = section_scores(acc, section_map, counts, keys)
    g = sec.groupBy(*keys).agg(
        F.collect_list(F.struct(F.col("section").alias("metric"), F.col("score").alias("value"))).alias("_s"),
        F.avg("score").alias("_o"))
    rows = F.concat("_s", F.array(F.struct(F.lit("overall").alias("metric"), F.col("_o").alias("value"))))
    long = g.select(*keys, F.inline(rows))
    if decimals is not None:
        long = long.withColumn("value", round_clean("value", decimals))
    return long


def pref_set_accuracy(scored: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """V5: preference-set mode, subset accuracies only (no sections)."""
    return subset_accuracy(scored, keys)


def task_accuracy(scored: DataFrame, n_tasks: int, keys: list[str] | None = None,
                  task: str = "task_id", decimals: int | None = 3,
                  names: list[str] | None = None) -> DataFrame:
    """V6: accuracy for each task id in 0..n_tasks-1 (null when a task has no
    rows) and the overall accuracy over all rows (not the mean of tasks).
    Output ``(keys..., metric, value)`` with metric ``task_<t>`` (or
    ``names[t]``) / ``overall``.  One conditional aggregation per key."""
    keys = keys if keys is not None else ["head_id"]
    labels = list(names) if names is not None else [f"task_{t}" for t in range(n_tasks)]
    if len(labels) != n_tasks:
        raise ValueError("one name per task is needed")
    if "wins" in scored.columns:  # counts per task instead of rows per pair
        def rate(cond):
            return F.try_divide(F.sum(F.when(cond, F.col("wins"))), F.sum(F.when(cond, F.col("n"))))
        aggs = [rate(F.col(task) == t).alias(f"task_{t}") for t in range(n_tasks)]
        g = scored.groupBy(*keys).agg(*aggs, rate(F.lit(True)).alias("overall"))
    else:
        w = F.col("win").cast("double")
        aggs = [F.avg(F.when(F.col(task) == t, w)).alias(f"task_{t}") for t in range(n_tasks)]
        g = scored.groupBy(*keys).agg(*aggs, F.avg(w).alias("overall"))
    cols = [f"task_{t}" for t in range(n_tasks)] + ["overall"]
    labels = labels + ["overall"]
    rows = F.array(*[F.struct(F.lit(lab).alias("metric"), F.col(c).alias("value"))
                     for lab, c in zip(labels, cols)])
    long = g.select(*keys, F.inline(rows))
    if decimals is not None:
        long = long.withColumn("value", round_clean("value", decimals))
    return long
