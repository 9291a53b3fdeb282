"""Pairwise reward losses and training-free metrics.

``c``/``r`` are the chosen / rejected scores.  Every loss is a grouped mean
of a built-in column expression; softplus is the overflow-safe form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefspark.functions.vectors import softplus
from prefspark.operators.evaluate import WIN_MARGIN

LOSS_TYPES = ("origin", "margin", "labelsmooth")


def _d(c: str, r: str) -> Column:
    return F.col(c) - F.col(r)


def loss_expr(loss_type: str, c: str = "s_chosen", r: str = "s_rejected",
              margin: str = "margin", eps: float = 0.1) -> Column:
    """Aggregate expression of one loss type (L1-L3)."""
    d = _d(c, r)
    if loss_type == "origin":
        return F.avg(softplus(-d))
    if loss_type == "margin":
        return F.avg(softplus(-(d - F.col(margin))))
    if loss_type == "labelsmooth":
        return (1 - eps) * F.avg(softplus(-d)) + eps * F.avg(softplus(d))
    raise ValueError(f"unknown loss type {loss_type!r}; expected one of {LOSS_TYPES}")


def pair_loss(scores: DataFrame, loss_type: str = "origin", keys: list[str] | None = None,
              **kw) -> DataFrame:
    """L1/L2/L3: mean loss per group of ``keys`` (default: per head)."""
    keys = keys if keys is not None else ["head_id"]
    return scores.groupBy(*keys).agg(loss_expr(loss_type, **kw).alias("loss"))


def argmax_accuracy(scores: DataFrame, keys: list[str] | None = None,
                    c: str = "s_chosen", r: str = "s_rejected", margin: float = WIN_MARGIN) -> DataFrame:
    """L4: share of pairs with c >= r (a tie, a difference below ``margin``,
    counts as correct)."""
    keys = keys if keys is not None else ["head_id"]
    d = _d(c, r)
    ok = F.when((d >= 0) | (d > -margin), 1.0).otherwise(0.0)
    return scores.groupBy(*keys).agg(F.avg(ok).alias("accuracy"))


def win_flag(c: str = "s_chosen", r: str = "s_rejected", margin: float = WIN_MARGIN) -> Column:
    """1 iff c > r strictly (a tie, a difference below ``margin``, is 0)."""
    d = _d(c, r)
    return F.when((d > 0) & (d >= margin), 1).otherwise(0)


def pair_logits(c: str = "s_chosen", r: str = "s_rejected", decimals: int = 4) -> Column:
    """``[c, r]`` rounded."""
    return F.array(F.round(F.col(c), decimals), F.round(F.col(r), decimals))
