"""Registered queries: encoding and pooling.

Hidden states come from ``embeddings``: row = vec_id div 8, pos = vec_id
mod 8.  The last-token index of a row is T2 -> T3 on all token ids of the
document with the same id, taken modulo the row's own number of positions.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from prefspark.functions import messages as msg
from prefspark.functions import tokens as tok
from prefspark.operators import encode as en
from prefspark.plans import fixtures as fx
from prefspark.plans.registry import query

POS = 8


def hidden(spark, sf):
    e = fx.table(spark, sf, "embeddings")
    return e.select((F.col("vec_id") / POS).cast("bigint").alias("row"),
                    (F.col("vec_id") % POS).cast("int").alias("pos"), F.col("embedding").alias("vec"))


def last_index(spark, sf):
    t = fx.tokens(spark, sf)
    idx = t.select(F.col("doc_id").alias("row"), tok.last_token_index(tok.pad("ids", POS, fx.PAD_ID), fx.PAD_ID).alias("i"))
    n = hidden(spark, sf).groupBy("row").agg(F.count(F.lit(1)).alias("n"))
    return idx.join(n, "row").select("row", F.pmod("i", "n").cast("int").alias("idx"))


HIDDEN_SQL = "SELECT vec_id // 8 AS row, CAST(vec_id % 8 AS INTEGER) AS pos, embedding AS vec FROM embeddings"
IDX_SQL = """
SELECT doc_id AS row,
       CAST(((((greatest(coalesce(list_position(p, 2), 0), 1) - 2) % len(p)) + len(p)) % len(p)) % n.n AS INTEGER) AS idx
FROM (SELECT doc_id, list_concat(ids, list_transform(range(greatest(8 - len(ids), 0)), lambda x: 2)) AS p
      FROM fx_tokens) t JOIN (SELECT vec_id // 8 AS row, count(*) AS n FROM embeddings GROUP BY 1) n ON n.row = doc_id"""


def _encoder_sql() -> str:
    from prefspark.plans.q_pairs import _render_sql
    return f"""
WITH texts AS (
  SELECT pair_id, 0 AS side, {_render_sql('chosen', 'gemma2', False)} AS text FROM fx_msg_pairs
  UNION ALL
  SELECT pair_id, 1 AS side, {_render_sql('rejected', 'gemma2', False)} AS text FROM fx_msg_pairs),
tok AS (SELECT pair_id, side, unnest(string_split(text, ' ')) AS t FROM texts),
h AS (SELECT pair_id, side, CAST('0x' || substring(md5(t), 1, 8) AS BIGINT) AS h FROM tok),
b AS (SELECT pair_id, side, h % {DIM} AS bucket,
             sum(CASE WHEN (h >> 16) & 1 = 1 THEN 1.0 ELSE -1.0 END) AS v
      FROM h GROUP BY pair_id, side, h % {DIM}),
grid AS (SELECT t.pair_id, t.side, r.bucket FROM texts t, range({DIM}) r(bucket)),
vec AS (SELECT g.pair_id, g.side, list(CAST(coalesce(b.v, 0.0) AS FLOAT) ORDER BY g.bucket) AS v
        FROM grid g LEFT JOIN b ON b.pair_id = g.pair_id AND b.side = g.side AND b.bucket = g.bucket
        GROUP BY g.pair_id, g.side)
SELECT c.pair_id, c.v AS chosen, r.v AS rejected
FROM vec c JOIN vec r ON r.pair_id = c.pair_id AND r.side = 1 WHERE c.side = 0"""


DIM = 64


@query("e1_embed_pairs", _encoder_sql())
def e1_embed_pairs(spark, sf):
    p = fx.msg_pairs(spark, sf)
    texts = p.select("pair_id", msg.render_chat("chosen").alias("chosen_text"),
                     msg.render_chat("rejected").alias("rejected_text"))
    return en.embed_pairs(texts, en.hashing_encoder(64)).select("pair_id", "chosen", "rejected")


@query("e2_pool_last", f"""
WITH h AS ({HIDDEN_SQL}), t AS ({IDX_SQL})
SELECT r.row, h.vec FROM (SELECT DISTINCT row FROM h) r LEFT JOIN t ON t.row = r.row
LEFT JOIN h ON h.row = t.row AND t.idx = h.pos""")
def e2_pool_last(spark, sf):
    return en.pool_last(hidden(spark, sf), last_index(spark, sf))


@query("e3_pool_prompt_boundary", f"""
WITH h AS ({HIDDEN_SQL})
SELECT row, CAST(pos - row % 8 + 1 AS INTEGER) AS slot, vec FROM h
WHERE row % 8 >= 1 AND pos BETWEEN row % 8 - 1 AND row % 8""")
def e3_pool_prompt_boundary(spark, sf):
    h = hidden(spark, sf)
    p = h.select("row").distinct().withColumn("p", (F.col("row") % POS).cast("int"))
    return en.pool_prompt_boundary(h, p)


@query("e4_assemble_pair_vectors", f"""
WITH h AS ({HIDDEN_SQL}), t AS ({IDX_SQL}),
pooled AS (SELECT h.row, h.vec FROM h JOIN t ON t.row = h.row AND t.idx = h.pos),
b AS (SELECT row // 2 AS pair_id, pos - row % 8 + 1 AS slot, vec FROM h
      WHERE row % 2 = 0 AND row % 8 >= 1 AND pos BETWEEN row % 8 - 1 AND row % 8)
SELECT coalesce(c.row, r.row) // 2 AS pair_id, c.vec AS chosen, r.vec AS rejected,
       (SELECT vec FROM b WHERE b.pair_id = c.row // 2 AND slot = 0) AS prompt_prev,
       (SELECT vec FROM b WHERE b.pair_id = c.row // 2 AND slot = 1) AS prompt_last
FROM (SELECT * FROM pooled WHERE row % 2 = 0) c FULL JOIN (SELECT * FROM pooled WHERE row % 2 = 1) r ON r.row = c.row + 1""")
def e4_assemble_pair_vectors(spark, sf):
    h = hidden(spark, sf)
    pooled = en.pool_last(h, last_index(spark, sf)).withColumn("pair_id", (F.col("row") / 2).cast("bigint"))
    chosen = pooled.filter(F.col("row") % 2 == 0)
    rejected = pooled.filter(F.col("row") % 2 == 1)
    ev_rows = h.filter(F.col("row") % 2 == 0)
    p = ev_rows.select("row").distinct().withColumn("p", (F.col("row") % POS).cast("int"))
    b = en.pool_prompt_boundary(ev_rows, p).withColumn("pair_id", (F.col("row") / 2).cast("bigint"))
    return en.assemble_pair_vectors(chosen, rejected, b).select(
        "pair_id", "chosen", "rejected", "prompt_prev", "prompt_last")


@query("e5_dump_hidden", f"""
WITH h AS ({HIDDEN_SQL}),
n AS (SELECT row, count(*) AS n FROM h GROUP BY row)
SELECT h.row, h.pos, h.vec, CASE WHEN h.pos < n.n THEN t.ids[h.pos + 1] END AS id
FROM h JOIN n ON n.row = h.row LEFT JOIN fx_tokens t ON t.doc_id = h.row""")
def e5_dump_hidden(spark, sf):
    packed = en.pack_hidden(hidden(spark, sf))
    ids = fx.tokens(spark, sf).select(F.col("doc_id").alias("row"), "ids")
    j = packed.join(ids, "row", "left")
    return en.dump_hidden(j)

