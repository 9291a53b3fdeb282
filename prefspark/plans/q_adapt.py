"""Registered queries: few-shot head reweighting.

The Spark side runs the library's ``adapt`` plan; the oracle states the same
rules in plain SQL (full ``row_number`` ranking, long score table).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from prefspark.operators import adapt as ad
from prefspark.plans import fixtures as fx
from prefspark.plans.registry import query, rnd

SEEDS = 20
K_SECTION = 15
K_TASK = 5
K_SMALL = 8
SMALL_GROUPS = 40


# ------------------------------------------------------------------ Spark side
def grouped_pairs(spark, sf, grouping: str):
    pairs = fx.vec_pairs(spark, sf)
    if grouping == "section":
        return ad.attach_category(pairs, fx.SECTION_MAP)
    if grouping == "task":
        return pairs.withColumn("grp", F.col("task_id"))
    if grouping == "subset":
        return pairs.withColumn("grp", F.col("subset"))
    if grouping == "small":
        return pairs.withColumn("grp", F.col("pair_id") % SMALL_GROUPS)
    raise ValueError(grouping)


def run(spark, sf, grouping="section", k=K_SECTION, mode="normalised", temperature=1.0,
        uniform=False, head_ids=None):
    heads = fx.heads(spark, sf)
    if head_ids is not None:
        heads = heads.filter(F.col("head_id").isin(head_ids))
    keep = ("task_id",) if grouping == "task" else ("subset",)   # the column its report needs
    return ad.adapt_from_vectors(grouped_pairs(spark, sf, grouping), heads, k, SEEDS, temperature, mode,
                                 keep=keep, uniform=uniform)


# ------------------------------------------------------------------ SQL side
META = {
    "section": "SELECT p.pair_id, p.subset, p.task_id, m.section AS grp "
               "FROM fx_vec_pairs p LEFT JOIN fx_section_map m ON m.subset = p.subset",
    "task": "SELECT pair_id, subset, task_id, task_id AS grp FROM fx_vec_pairs",
    "subset": "SELECT pair_id, subset, task_id, subset AS grp FROM fx_vec_pairs",
    "small": f"SELECT pair_id, subset, task_id, pair_id % {SMALL_GROUPS} AS grp FROM fx_vec_pairs",
}


def _u(key: str) -> str:
    return f"CAST('0x' || substring(md5({key}), 1, 8) AS BIGINT)"


def _sp(x: str) -> str:
    return f"(greatest({x}, 0) + ln(1 + exp(-abs({x}))))"


def adapt_sql(grouping: str = "section", k: int = K_SECTION, mode: str = "normalised",
              temperature: float = 1.0, uniform: bool = False, heads: str = "fx_scores") -> str:
    """CTEs meta, sizes, ranked, sample, samp, stats, loss, weights, agg."""
    pk = "CAST(m.pair_id AS VARCHAR) || '|' || CAST(s.seed AS VARCHAR)"
    gk = "CAST(z.grp AS VARCHAR) || '|' || CAST(s.seed AS VARCHAR) || '|' || CAST(j.slot AS VARCHAR)"
    if mode == "normalised":
        zc, zr = "(x.c - t.mean) / t.std", "(x.r - t.mean) / t.std"
    else:
        zc, zr = "x.c", "x.r"
    if uniform:
        weights = ("weights AS (SELECT seed, grp, head_id, "
                   "1.0 / count(*) OVER (PARTITION BY seed, grp) AS weight FROM loss)")
    else:
        weights = f"""lx AS (SELECT seed, grp, head_id, -loss / {float(temperature)} AS x FROM loss),
le AS (SELECT seed, grp, head_id, exp(x - max(x) OVER (PARTITION BY seed, grp)) AS e FROM lx),
weights AS (SELECT seed, grp, head_id, e / sum(e) OVER (PARTITION BY seed, grp) AS weight FROM le)"""
    if mode == "normalised":
        contrib_cols = ("sum((x.s_chosen - t.mean) / t.std * w.weight) AS agg_c, "
                        "sum((x.s_rejected - t.mean) / t.std * w.weight) AS agg_r")
    elif mode == "raw":
        contrib_cols = "sum(x.s_chosen * w.weight) AS agg_c, sum(x.s_rejected * w.weight) AS agg_r"
    else:
        contrib_cols = "sum((x.s_chosen - x.s_rejected) * w.weight) AS agg_d"
    if mode == "delta":
        agg_cols = "coalesce(c.agg_d, 0.0) AS agg_delta"
    else:
        agg_cols = "coalesce(c.agg_c, 0.0) AS agg_chosen, coalesce(c.agg_r, 0.0) AS agg_rejected"
    return f"""
meta AS ({META[grouping]}),
sizes AS (SELECT grp, count(*) AS n FROM meta WHERE grp IS NOT NULL GROUP BY grp),
ranked AS (SELECT s.seed, m.grp, m.pair_id,
                  row_number() OVER (PARTITION BY s.seed, m.grp ORDER BY {_u(pk)}, m.pair_id) AS rk
           FROM meta m, fx_seeds s WHERE m.grp IS NOT NULL),
draws AS (SELECT s.seed, z.grp, CAST(j.slot AS INTEGER) AS slot, {_u(gk)} % z.n + 1 AS pick
          FROM sizes z, fx_seeds s, range(1, {k + 1}) j(slot) WHERE z.n < {k}),
sample AS (SELECT r.seed, r.grp, CAST(r.rk AS INTEGER) AS slot, r.pair_id
           FROM ranked r JOIN sizes z ON z.grp = r.grp WHERE z.n >= {k} AND r.rk <= {k}
           UNION ALL
           SELECT d.seed, d.grp, d.slot, r.pair_id
           FROM draws d JOIN ranked r ON r.seed = d.seed AND r.grp = d.grp AND r.rk = d.pick),
samp AS (SELECT a.seed, a.grp, a.slot, a.pair_id, x.head_id, x.s_chosen AS c, x.s_rejected AS r
         FROM sample a JOIN {heads} x ON x.pair_id = a.pair_id),
stats AS (SELECT seed, grp, head_id, avg(v) AS mean,
                 CASE WHEN stddev_samp(v) = 0 THEN 1.0 ELSE stddev_samp(v) END AS std
          FROM (SELECT seed, grp, head_id, c AS v FROM samp
                UNION ALL SELECT seed, grp, head_id, r AS v FROM samp) b
          GROUP BY seed, grp, head_id),
loss AS (SELECT x.seed, x.grp, x.head_id, sum({_sp(f'-(({zc}) - ({zr}))')}) AS loss
         FROM samp x JOIN stats t ON t.seed = x.seed AND t.grp = x.grp AND t.head_id = x.head_id
         GROUP BY x.seed, x.grp, x.head_id),
{weights},
contrib AS (SELECT t.seed, m.pair_id, {contrib_cols}
            FROM meta m JOIN {heads} x ON x.pair_id = m.pair_id
            JOIN stats t ON t.grp = m.grp AND t.head_id = x.head_id
            JOIN weights w ON w.seed = t.seed AND w.grp = t.grp AND w.head_id = t.head_id
            GROUP BY t.seed, m.pair_id),
agg AS (SELECT s.seed, m.pair_id, m.subset, m.task_id, {agg_cols}
        FROM meta m CROSS JOIN fx_seeds s
        LEFT JOIN contrib c ON c.seed = s.seed AND c.pair_id = m.pair_id)"""


def board_sql(delta: bool = False) -> str:
    win = ("CASE WHEN round(agg_delta, 9) > 0 THEN 1 ELSE 0 END" if delta else
           "CASE WHEN round(agg_chosen - agg_rejected, 9) > 0 THEN 1 ELSE 0 END")
    return f""",
wins AS (SELECT seed, pair_id, subset, task_id, {win} AS win FROM agg),
acc AS (SELECT seed, subset, avg(CAST(win AS DOUBLE)) AS accuracy FROM wins GROUP BY seed, subset),
per AS (SELECT a.seed, m.section, sum(a.accuracy * c.n) / sum(c.n) AS s
        FROM acc a JOIN fx_section_map m ON m.subset = a.subset JOIN fx_counts c ON c.subset = a.subset
        GROUP BY a.seed, m.section),
grid AS (SELECT DISTINCT a.seed, m.section FROM acc a, fx_section_map m),
sec AS (SELECT g.seed, g.section, coalesce(p.s, 0.0) AS score
        FROM grid g LEFT JOIN per p ON p.seed = g.seed AND p.section = g.section),
board AS (SELECT seed, section AS metric, {rnd('score', 3)} AS value FROM sec
          UNION ALL SELECT seed, 'overall' AS metric, {rnd('avg(score)', 3)} AS value FROM sec GROUP BY seed)"""


def task_board_sql(delta: bool = False) -> str:
    win = ("CASE WHEN round(agg_delta, 9) > 0 THEN 1 ELSE 0 END" if delta else
           "CASE WHEN round(agg_chosen - agg_rejected, 9) > 0 THEN 1 ELSE 0 END")
    return f""",
wins AS (SELECT seed, pair_id, task_id, {win} AS win FROM agg),
per AS (SELECT seed, task_id, avg(CAST(win AS DOUBLE)) AS a FROM wins GROUP BY seed, task_id),
ov AS (SELECT seed, avg(CAST(win AS DOUBLE)) AS a FROM wins GROUP BY seed),
board AS (SELECT o.seed, 'task_' || CAST(t.task_id AS VARCHAR) AS metric, {rnd('p.a', 3)} AS value
          FROM ov o CROSS JOIN fx_tasks t LEFT JOIN per p ON p.seed = o.seed AND p.task_id = t.task_id
          UNION ALL SELECT seed, 'overall' AS metric, {rnd('a', 3)} AS value FROM ov)"""


STATS_SELECT = f"""
SELECT metric, CAST(round(sum(CAST(round(value * 1000) AS BIGINT)) / count(value)) AS DOUBLE) / 1000 AS mean,
       {rnd('stddev_pop(value)', 4)} AS std
FROM board GROUP BY metric"""


def W(*ctes: str) -> str:
    return "WITH " + "".join(ctes)


def r6(c: str):
    return F.round(c, 6).alias(c)


# ------------------------------------------------------------------ A4, A5
@query("a4_attach_category", """
SELECT p.pair_id, p.subset, m.section FROM fx_vec_pairs p LEFT JOIN fx_section_map m ON m.subset = p.subset""")
def a4_attach_category(spark, sf):
    p = ad.attach_category(fx.vec_pairs(spark, sf), fx.SECTION_MAP, out="section")
    return p.select("pair_id", "subset", "section")


@query("a5_sample_sections", W(adapt_sql("section", K_SECTION)) + "\nSELECT seed, grp, slot, pair_id FROM sample")
def a5_sample_sections(spark, sf):
    p = ad.attach_category(fx.vec_pairs(spark, sf), fx.SECTION_MAP)
    return ad.sample_per_group(p.select("pair_id", "grp"), K_SECTION, SEEDS)


@query("a5_sample_with_replacement",
       W(adapt_sql("small", K_SMALL)) + "\nSELECT seed, grp, slot, pair_id FROM sample")
def a5_sample_with_replacement(spark, sf):
    p = fx.vec_pairs(spark, sf).withColumn("grp", F.col("pair_id") % SMALL_GROUPS)
    return ad.sample_per_group(p.select("pair_id", "grp"), K_SMALL, SEEDS)


@query("a5_sample_tasks", W(adapt_sql("task", K_TASK)) + "\nSELECT seed, grp, slot, pair_id FROM sample")
def a5_sample_tasks(spark, sf):
    p = fx.vec_pairs(spark, sf).withColumn("grp", F.col("task_id"))
    return ad.sample_per_group(p.select("pair_id", "grp"), K_TASK, SEEDS)


# ------------------------------------------------------------------ A6-A10
@query("a6_group_head_stats", W(adapt_sql()) + """
SELECT seed, grp, head_id, round(mean, 6) + 0.0 AS mean, round(std, 6) AS std FROM stats""")
def a6_group_head_stats(spark, sf):
    return run(spark, sf).stats.select("seed", "grp", "head_id", r6("mean"), r6("std"))


@query("a7_standardise", W(adapt_sql()) + """
SELECT x.seed, x.grp, x.slot, x.pair_id, x.head_id,
       round((x.c - t.mean) / t.std, 6) + 0.0 AS c, round((x.r - t.mean) / t.std, 6) + 0.0 AS r
FROM samp x JOIN stats t ON t.seed = x.seed AND t.grp = x.grp AND t.head_id = x.head_id""")
def a7_standardise(spark, sf):
    a = run(spark, sf)
    z = ad.standardise(a.sampled, a.stats)
    return z.select("seed", "grp", "slot", "pair_id", "head_id", r6("c"), r6("r"))


@query("a8_group_head_loss", W(adapt_sql()) + """
SELECT seed, grp, head_id, round(loss, 6) AS loss FROM loss""")
def a8_group_head_loss(spark, sf):
    return run(spark, sf).loss.select("seed", "grp", "head_id", r6("loss"))


@query("a9_softmax_weights", W(adapt_sql()) + """
SELECT seed, grp, head_id, round(weight, 6) AS weight FROM weights""")
def a9_softmax_weights(spark, sf):
    return run(spark, sf).weights.select("seed", "grp", "head_id", r6("weight"))


@query("a9_softmax_weights_t05", W(adapt_sql(temperature=0.5)) + """
SELECT seed, grp, head_id, round(weight, 6) AS weight FROM weights""")
def a9_softmax_weights_t05(spark, sf):
    return run(spark, sf, temperature=0.5).weights.select("seed", "grp", "head_id", r6("weight"))


@query("a10_uniform_weights", W(adapt_sql(uniform=True)) + """
SELECT seed, grp, head_id, round(weight, 6) AS weight FROM weights""")
def a10_uniform_weights(spark, sf):
    return run(spark, sf, uniform=True).weights.select("seed", "grp", "head_id", r6("weight"))


# ------------------------------------------------------------------ A11-A13
@query("a11_apply_weights", W(adapt_sql()) + """
SELECT seed, pair_id, round(agg_chosen, 6) + 0.0 AS agg_chosen, round(agg_rejected, 6) + 0.0 AS agg_rejected
FROM agg""")
def a11_apply_weights(spark, sf):
    return run(spark, sf).agg.select("seed", "pair_id", r6("agg_chosen"), r6("agg_rejected"))


@query("a12_apply_weights_raw", W(adapt_sql(mode="raw")) + """
SELECT seed, pair_id, round(agg_chosen, 6) + 0.0 AS agg_chosen, round(agg_rejected, 6) + 0.0 AS agg_rejected
FROM agg""")
def a12_apply_weights_raw(spark, sf):
    return run(spark, sf, mode="raw").agg.select("seed", "pair_id", r6("agg_chosen"), r6("agg_rejected"))


@query("a13_apply_weights_delta", W(adapt_sql("task", K_TASK, mode="delta")) + """
SELECT seed, pair_id, round(agg_delta, 6) + 0.0 AS agg_delta FROM agg""")
def a13_apply_weights_delta(spark, sf):
    return run(spark, sf, "task", K_TASK, mode="delta").agg.select("seed", "pair_id", r6("agg_delta"))


# ------------------------------------------------------------------ A14-A17
@query("a14_tta_section_scores", W(adapt_sql(), board_sql()) + "\nSELECT seed, metric, value FROM board")
def a14_tta_section_scores(spark, sf):
    return ad.tta_section_scores(run(spark, sf).wins("subset"), fx.SECTION_MAP, fx.EXAMPLE_COUNTS)


@query("a14_tta_section_scores_exclude_sample",
       W(adapt_sql(), board_sql().replace("FROM agg)", "FROM agg a WHERE NOT EXISTS (SELECT 1 FROM sample x "
                                          "WHERE x.seed = a.seed AND x.pair_id = a.pair_id))"))
       + "\nSELECT seed, metric, value FROM board")
def a14_tta_section_scores_exclude_sample(spark, sf):
    a = run(spark, sf)
    return ad.tta_section_scores(a.agg, fx.SECTION_MAP, fx.EXAMPLE_COUNTS, sample=a.sample)


@query("a14_subset_groups", W(adapt_sql("subset"), board_sql()) + "\nSELECT seed, metric, value FROM board")
def a14_subset_groups(spark, sf):
    """Sampled and weighted per subset, reported per section."""
    return ad.tta_section_scores(run(spark, sf, "subset").wins("subset"), fx.SECTION_MAP, fx.EXAMPLE_COUNTS)


K_LARGE = 40


@query("a14_subset_groups_with_replacement", W(adapt_sql("subset", K_LARGE), board_sql())
       + "\nSELECT seed, metric, value FROM board")
def a14_subset_groups_with_replacement(spark, sf):
    return ad.tta_section_scores(run(spark, sf, "subset", K_LARGE).wins("subset"), fx.SECTION_MAP, fx.EXAMPLE_COUNTS)


@query("a15_tta_task_scores", W(adapt_sql("task", K_TASK), task_board_sql())
       + "\nSELECT seed, metric, value FROM board")
def a15_tta_task_scores(spark, sf):
    return ad.tta_task_scores(run(spark, sf, "task", K_TASK).wins("task_id"), fx.N_TASKS)


@query("a15_tta_task_scores_delta", W(adapt_sql("task", K_TASK, mode="delta"), task_board_sql(True))
       + "\nSELECT seed, metric, value FROM board")
def a15_tta_task_scores_delta(spark, sf):
    return ad.tta_task_scores(run(spark, sf, "task", K_TASK, mode="delta").wins("task_id"), fx.N_TASKS)


@query("a16_seed_sweep_overall", W(adapt_sql(), board_sql())
       + "\nSELECT seed, value AS overall FROM board WHERE metric = 'overall'")
def a16_seed_sweep_overall(spark, sf):
    b = ad.tta_section_scores(run(spark, sf).wins("subset"), fx.SECTION_MAP, fx.EXAMPLE_COUNTS)
    return b.filter(F.col("metric") == "overall").select("seed", F.col("value").alias("overall"))


@query("a17_seed_statistics_sections", W(adapt_sql(), board_sql()) + STATS_SELECT)
def a17_seed_statistics_sections(spark, sf):
    b = ad.tta_section_scores(run(spark, sf).wins("subset"), fx.SECTION_MAP, fx.EXAMPLE_COUNTS)
    return ad.seed_statistics(b)


@query("a17_seed_statistics_tasks", W(adapt_sql("task", K_TASK), task_board_sql()) + STATS_SELECT)
def a17_seed_statistics_tasks(spark, sf):
    return ad.seed_statistics(ad.tta_task_scores(run(spark, sf, "task", K_TASK).wins("task_id"), fx.N_TASKS))


@query("a17_from_written_scores", W(adapt_sql(), board_sql()) + STATS_SELECT)
def a17_from_written_scores(spark, sf):
    """Evaluate writes the scores; the adaptation reads them back."""
    from prefspark.plans import stages
    from prefspark.session import scratch_path
    path = scratch_path(spark, "evaluated")
    stages.evaluate(fx.vec_pairs(spark, sf), fx.heads(spark, sf), out_path=path)
    r = stages.adapt_from_scores(spark, path, None, [K_SECTION], seeds=SEEDS, section_map=fx.SECTION_MAP,
                                 counts=fx.EXAMPLE_COUNTS)
    return r["statistics"].select("metric", "mean", "std")


# ------------------------------------------------------------------ A18, A19
GRID_HEADS = (8, 16)
GRID_KS = (5, 15)


def _grid_heads(n: int) -> list[int]:
    half = fx.N_COMPONENTS
    return list(range(n // 2)) + [half + i for i in range(n // 2)]


def _grid_sql(select: str, extra: str = "") -> str:
    parts = []
    for n in GRID_HEADS:
        ids = ", ".join(str(i) for i in _grid_heads(n))
        sub = f"(SELECT * FROM fx_scores WHERE head_id IN ({ids}))"
        for k in GRID_KS:
            body = W(adapt_sql("section", k, heads=sub), board_sql() if extra else "")
            parts.append(f"SELECT {n} AS num_heads, {k} AS k, CAST(1.0 AS DOUBLE) AS temperature, q.* FROM ({body}\n{select}) q")
    return "\nUNION ALL\n".join(parts)


def _grid(spark, sf):
    heads = {n: _grid_heads(n) for n in GRID_HEADS}
    return ad.adapt_grid(grouped_pairs(spark, sf, "section"), fx.heads(spark, sf), heads, GRID_KS, [1.0], SEEDS,
                         keep=("subset",))


@query("a18_config_grid", _grid_sql(STATS_SELECT, extra="board"))
def a18_config_grid(spark, sf):
    a = _grid(spark, sf)
    keys = list(ad.CONFIG)
    board = ad.tta_section_scores(a.wins("subset"), fx.SECTION_MAP, fx.EXAMPLE_COUNTS, keys=[*keys, "seed"])
    return ad.seed_statistics(board, keys=keys)


N_WITH_ORIGINAL = 6
WITH_ORIGINAL_SQL = """(SELECT pair_id, head_id, s_chosen, s_rejected FROM fx_scores WHERE head_id IN (0, 1, 2, 10, 11)
  UNION ALL SELECT p.pair_id, -1 AS head_id, list_dot_product(list_transform(p.chosen, lambda x: CAST(x AS DOUBLE)), o.w),
         list_dot_product(list_transform(p.rejected, lambda x: CAST(x AS DOUBLE)), o.w)
  FROM fx_vec_pairs p, fx_original o)"""


@query("a18_with_original", "\nUNION ALL\n".join(
    f"SELECT {N_WITH_ORIGINAL} AS num_heads, {k} AS k, CAST(1.0 AS DOUBLE) AS temperature, q.* FROM ("
    + W(adapt_sql("subset", k, heads=WITH_ORIGINAL_SQL), board_sql()) + STATS_SELECT + ") q" for k in (5, K_LARGE)))
def a18_with_original(spark, sf):
    """Choose heads (the original first, then plus and minus heads), score
    under them, adapt per subset, with (k = 40) and without replacement."""
    from prefspark.operators.heads import with_original
    heads = with_original(fx.heads(spark, sf), fx.original_head(spark, sf))
    chosen = ad.choose_heads(heads, N_WITH_ORIGINAL, with_original=True, original_id=-1)
    ids = [int(r.source_head_id) for r in chosen.orderBy("head_id").collect()]  # N_WITH_ORIGINAL rows
    a = ad.adapt_grid(grouped_pairs(spark, sf, "subset"), heads, {N_WITH_ORIGINAL: ids}, [5, K_LARGE], [1.0], SEEDS,
                      keep=("subset",))
    keys = list(ad.CONFIG)
    board = ad.tta_section_scores(a.wins("subset"), fx.SECTION_MAP, fx.EXAMPLE_COUNTS, keys=[*keys, "seed"])
    return ad.seed_statistics(board, keys=keys)


@query("a19_weight_table", _grid_sql(
    "SELECT seed, grp, head_id, round(weight, 6) AS weight FROM weights"))
def a19_weight_table(spark, sf):
    w = _grid(spark, sf).weights
    return w.select(*ad.CONFIG, "seed", "grp", "head_id", r6("weight"))


# ------------------------------------------------------------------ A1-A3
def _choose_sql(n: int, with_original: bool, form: str) -> str:
    n_minus = n // 2 - 1 if with_original and (form == "file" or n % 2 == 0) else n // 2
    shift = 1 if with_original else 0
    sql = f"""
WITH h AS (SELECT head_id, row_number() OVER (ORDER BY head_id) - 1 AS r, count(*) OVER () AS n FROM fx_heads),
c AS (SELECT head_id AS source_head_id, CASE WHEN r < n // 2 THEN r ELSE r - n // 2 + {n // 2} END AS o
      FROM h WHERE (r < n // 2 AND r < {n // 2}) OR (r >= n // 2 AND r - n // 2 < {n_minus}))
SELECT CAST(row_number() OVER (ORDER BY o) - 1 + {shift} AS BIGINT) AS head_id, source_head_id FROM c"""
    if with_original:
        sql += "\nUNION ALL SELECT CAST(0 AS BIGINT) AS head_id, CAST(-1 AS BIGINT) AS source_head_id"
    return sql


@query("a1_choose_heads_file", _choose_sql(6, True, "file"))
def a1_choose_heads_file(spark, sf):
    return ad.choose_heads(fx.heads(spark, sf), 6, with_original=True, original_id=-1, form="file")


@query("a1_choose_heads_no_original", _choose_sql(10, False, "file"))
def a1_choose_heads_no_original(spark, sf):
    return ad.choose_heads(fx.heads(spark, sf), 10)


@query("a1_choose_heads_first", """
SELECT CAST(row_number() OVER (ORDER BY head_id) - 1 AS BIGINT) AS head_id, head_id AS source_head_id
FROM fx_heads QUALIFY row_number() OVER (ORDER BY head_id) <= 5""")
def a1_choose_heads_first(spark, sf):
    return ad.choose_heads(fx.heads(spark, sf), 5, form="first")


@query("a2_choose_heads_map", _choose_sql(7, True, "map"))
def a2_choose_heads_map(spark, sf):
    return ad.choose_heads(fx.heads(spark, sf), 7, with_original=True, original_id=-1, form="map")


def _merge_sql() -> str:
    cols = []
    for h in range(2 * fx.N_COMPONENTS):
        cols.append(f"max(CASE WHEN head_id = {h} THEN round(s_chosen, 6) + 0.0 END) AS sc_{h}")
        cols.append(f"max(CASE WHEN head_id = {h} THEN round(s_rejected, 6) + 0.0 END) AS sr_{h}")
    return "SELECT pair_id, " + ", ".join(cols) + " FROM fx_scores GROUP BY pair_id"


@query("a3_merge_heads", _merge_sql())
def a3_merge_heads(spark, sf):
    s = fx.scores(spark, sf).select("pair_id", "head_id", r6("s_chosen"), r6("s_rejected"))
    return ad.merge_heads(s, list(range(2 * fx.N_COMPONENTS)))
