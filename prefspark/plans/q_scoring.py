"""Registered queries: scoring (G1-G4) and losses."""

from __future__ import annotations

from pyspark.sql import functions as F

from prefspark.operators import losses
from prefspark.operators.scoring import score_delta, score_heads_packed, score_heads_tiled, single_head_score
from prefspark.plans import fixtures as fx
from prefspark.plans.registry import query

R6 = 6


def _rounded_scores(df):
    return df.select("pair_id", "subset", "task_id", "head_id",
                     F.round("s_chosen", R6).alias("s_chosen"),
                     F.round("s_rejected", R6).alias("s_rejected"))


SCORES_SQL = """
SELECT pair_id, subset, task_id, head_id, round(s_chosen, 6) + 0.0 AS s_chosen,
       round(s_rejected, 6) + 0.0 AS s_rejected
FROM fx_scores"""


@query("g1_score_heads", SCORES_SQL)
def g1_score_heads(spark, sf):
    return _rounded_scores(fx.scores(spark, sf, method="arrow"))


@query("g1_score_heads_native", SCORES_SQL)
def g1_score_heads_native(spark, sf):
    return _rounded_scores(fx.scores(spark, sf, method="native"))


@query("g1_score_heads_tiled", """
SELECT pair_id, head_id, round(s_chosen, 6) + 0.0 AS s_chosen, round(s_rejected, 6) + 0.0 AS s_rejected
FROM fx_scores""")
def g1_score_heads_tiled(spark, sf):
    """The block matrix product, in blocks small enough that there are several of both sides."""
    tiles = score_heads_tiled(fx.vec_pairs(spark, sf), fx.heads(spark, sf), head_rows=6, pair_rows=100)
    z = F.arrays_zip(F.col("head_ids").alias("head_id"), F.col("sc").alias("s_chosen"), F.col("sr").alias("s_rejected"))
    rows = tiles.select("pair_id", F.inline(z))
    return rows.select("pair_id", "head_id", F.round("s_chosen", R6).alias("s_chosen"),
                       F.round("s_rejected", R6).alias("s_rejected"))


@query("g2_score_heads_packed", """
SELECT pair_id, list(round(s_chosen, 6) + 0.0 ORDER BY head_id) AS sc,
       list(round(s_rejected, 6) + 0.0 ORDER BY head_id) AS sr
FROM fx_scores GROUP BY pair_id""")
def g2_score_heads_packed(spark, sf):
    packed, _ = score_heads_packed(fx.vec_pairs(spark, sf), fx.heads(spark, sf))
    r = lambda a: F.transform(a, lambda x: F.round(x, R6))
    return packed.select("pair_id", r("sc").alias("sc"), r("sr").alias("sr"))


@query("g3_single_head_score", """
SELECT pair_id, head_id, round(s_chosen, 6) + 0.0 AS s_chosen,
       round(s_rejected, 6) + 0.0 AS s_rejected
FROM fx_scores WHERE head_id = 11""")
def g3_single_head_score(spark, sf):
    s = single_head_score(fx.vec_pairs(spark, sf), fx.heads(spark, sf), 11, keep=["pair_id"])
    return s.select("pair_id", "head_id", F.round("s_chosen", R6).alias("s_chosen"),
                    F.round("s_rejected", R6).alias("s_rejected"))


@query("g4_score_delta", """
SELECT pair_id, head_id, round(s_chosen - s_rejected, 6) + 0.0 AS s_delta FROM fx_scores""")
def g4_score_delta(spark, sf):
    return score_delta(fx.scores(spark, sf)).select(
        "pair_id", "head_id", F.round("s_delta", R6).alias("s_delta"))


def _softplus_sql(x: str) -> str:
    return f"(greatest({x}, 0) + ln(1 + exp(-abs({x}))))"


@query("l1_loss_origin", f"""
SELECT head_id, round(avg({_softplus_sql('-(s_chosen - s_rejected)')}), 6) AS loss
FROM fx_scores GROUP BY head_id""")
def l1_loss_origin(spark, sf):
    return losses.pair_loss(fx.scores(spark, sf), "origin").select(
        "head_id", F.round("loss", R6).alias("loss"))


@query("l2_loss_margin", f"""
SELECT s.head_id, round(avg({_softplus_sql('-(s.s_chosen - s.s_rejected - p.margin)')}), 6) AS loss
FROM fx_scores s JOIN fx_vec_pairs p USING (pair_id) GROUP BY s.head_id""")
def l2_loss_margin(spark, sf):
    m = fx.vec_pairs(spark, sf).select("pair_id", "margin")
    s = fx.scores(spark, sf).join(m, "pair_id")
    return losses.pair_loss(s, "margin").select("head_id", F.round("loss", R6).alias("loss"))


@query("l3_loss_label_smooth", f"""
SELECT head_id, round(0.9 * avg({_softplus_sql('-(s_chosen - s_rejected)')})
                      + 0.1 * avg({_softplus_sql('s_chosen - s_rejected')}), 6) AS loss
FROM fx_scores GROUP BY head_id""")
def l3_loss_label_smooth(spark, sf):
    return losses.pair_loss(fx.scores(spark, sf), "labelsmooth").select(
        "head_id", F.round("loss", R6).alias("loss"))


@query("l4_argmax_accuracy", """
SELECT head_id, round(avg(CASE WHEN round(s_chosen - s_rejected, 9) >= 0 THEN 1.0 ELSE 0.0 END), 6)
       AS accuracy
FROM fx_scores GROUP BY head_id""")
def l4_argmax_accuracy(spark, sf):
    return losses.argmax_accuracy(fx.scores(spark, sf)).select(
        "head_id", F.round("accuracy", R6).alias("accuracy"))


@query("l5_win_flag", """
SELECT pair_id, head_id, CASE WHEN round(s_chosen - s_rejected, 9) > 0 THEN 1 ELSE 0 END AS win
FROM fx_scores""")
def l5_win_flag(spark, sf):
    return fx.scores(spark, sf).select("pair_id", "head_id", losses.win_flag().alias("win"))


@query("l6_pair_logits", """
SELECT pair_id, head_id, [round(s_chosen, 4) + 0.0, round(s_rejected, 4) + 0.0] AS logits
FROM fx_scores""")
def l6_pair_logits(spark, sf):
    return fx.scores(spark, sf).select("pair_id", "head_id", losses.pair_logits().alias("logits"))
