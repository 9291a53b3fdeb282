"""Registered queries: token-array operators."""

from __future__ import annotations

from prefspark.functions import tokens as tok
from prefspark.plans import fixtures as fx
from prefspark.plans.registry import query

N_TRUNC = 8


@query("t1_truncate", f"""
SELECT doc_id, ids[1:{N_TRUNC}] AS right_ids,
       ids[greatest(len(ids) - {N_TRUNC}, 0) + 1:greatest(len(ids) - {N_TRUNC}, 0) + {N_TRUNC}] AS left_ids
FROM fx_tokens""")
def t1_truncate(spark, sf):
    t = fx.tokens(spark, sf)
    return t.select("doc_id", tok.truncate("ids", N_TRUNC, "right").alias("right_ids"),
                    tok.truncate("ids", N_TRUNC, "left").alias("left_ids"))


PAD_SQL = (f"list_concat(ids, list_transform(range(greatest({fx.TOKEN_TARGET} - len(ids), 0)), "
           f"lambda x: {fx.PAD_ID}))")


@query("t2_pad", f"""
SELECT doc_id, {PAD_SQL} AS padded,
       list_concat(list_transform(range(len(ids)), lambda x: 1),
                   list_transform(range(greatest({fx.TOKEN_TARGET} - len(ids), 0)), lambda x: 0)) AS mask
FROM fx_tokens""")
def t2_pad(spark, sf):
    t = fx.tokens(spark, sf)
    return t.select("doc_id", tok.pad("ids", fx.TOKEN_TARGET, fx.PAD_ID).alias("padded"),
                    tok.pad_mask("ids", fx.TOKEN_TARGET).alias("mask"))


def _last_sql(a: str) -> str:
    x = f"(greatest(coalesce(list_position({a}, {fx.PAD_ID}), 0), 1) - 2)"
    return f"CAST(((({x}) % len({a})) + len({a})) % len({a}) AS INTEGER)"


@query("t3_last_token_index", f"""
SELECT doc_id, {_last_sql('ids')} AS last_raw, {_last_sql('padded')} AS last_padded
FROM (SELECT doc_id, ids, {PAD_SQL} AS padded FROM fx_tokens) t""")
def t3_last_token_index(spark, sf):
    t = fx.tokens(spark, sf).withColumn("padded", tok.pad("ids", fx.TOKEN_TARGET, fx.PAD_ID))
    return t.select("doc_id", tok.last_token_index("ids", fx.PAD_ID).alias("last_raw"),
                    tok.last_token_index("padded", fx.PAD_ID).alias("last_padded"))


@query("t4_find_last", """
SELECT doc_id, CAST(list_max(list_filter(range(0, len(ids) - 1), lambda j: ids[j + 1:j + 2] = [3, 2])) AS INTEGER)
       AS start FROM fx_tokens""")
def t4_find_last(spark, sf):
    return fx.tokens(spark, sf).select("doc_id", tok.find_last("ids", fx.TOKEN_PATTERN).alias("start"))


@query("t5_mask_double_bos", f"""
WITH s AS (SELECT doc_id, ids, mask, greatest(coalesce(list_position(mask, 1), 0) - 1, 0) AS st FROM fx_tokens),
d AS (SELECT doc_id, ids, mask, st,
             len(ids) > 0 AND ids[st + 1] = {fx.BOS_ID}
             AND ids[greatest(least(st + 1, len(ids) - 1), 0) + 1] = {fx.BOS_ID} AS dbl FROM s)
SELECT doc_id, list_transform(mask, lambda x, i: CASE WHEN dbl AND i - 1 = st THEN 0 ELSE x END) AS mask
FROM d""")
def t5_mask_double_bos(spark, sf):
    t = fx.tokens(spark, sf)
    return t.select("doc_id", tok.mask_double_bos("ids", "mask", fx.BOS_ID).alias("mask"))



@query("t2_pad_to_batch", f"""
WITH b AS (SELECT doc_id // 8 AS batch, CAST(ceil(max(len(ids)) / 16) * 16 AS INTEGER) AS target
           FROM fx_tokens GROUP BY doc_id // 8)
SELECT t.doc_id, list_concat(t.ids, list_transform(range(greatest(b.target - len(t.ids), 0)),
                                                   lambda x: {fx.PAD_ID})) AS padded
FROM fx_tokens t JOIN b ON b.batch = t.doc_id // 8""")
def t2_pad_to_batch(spark, sf):
    from pyspark.sql import functions as F

    from prefspark.operators.pairs import pad_to_batch
    t = fx.tokens(spark, sf).withColumn("batch", (F.col("doc_id") / 8).cast("bigint"))
    return pad_to_batch(t, "ids", "batch", fx.PAD_ID, multiple=16).select("doc_id", "padded")
