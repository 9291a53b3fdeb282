"""Registered queries: difference vectors, PCA and head construction."""

from __future__ import annotations

from pyspark.sql import functions as F

from prefspark.functions.vectors import l2_normalise
from prefspark.operators import heads as hd
from prefspark.operators.scoring import score_heads
from prefspark.plans import fixtures as fx
from prefspark.plans.registry import query

N_PCA = 8
N_RANDOM = 4


def _diffs(spark, sf):
    return hd.pair_diff(fx.vec_pairs(spark, sf))


def _r(arr: str, d: int):
    return F.transform(arr, lambda x: F.round(x, d))


DIFF_SQL = """
SELECT pair_id, list_transform(range(1, len(chosen) + 1),
       lambda i: CAST(chosen[i] AS DOUBLE) - CAST(rejected[i] AS DOUBLE)) AS diff
FROM fx_vec_pairs"""


@query("h1_pair_diff", f"""
SELECT pair_id, list_transform(diff, lambda x: round(x, 9) + 0.0) AS diff FROM ({DIFF_SQL}) d""")
def h1_pair_diff(spark, sf):
    return _diffs(spark, sf).select("pair_id", _r("diff", 9).alias("diff"))


ELEMS_SQL = f"""
e AS (SELECT d.pair_id, CAST(generate_subscripts(d.diff, 1) - 1 AS INTEGER) AS i, unnest(d.diff) AS x
      FROM ({DIFF_SQL}) d)"""


SQUARINGS = 14


def _pca_sql(select: str) -> str:
    """The first N_PCA directions by repeated squaring: the covariance scaled
    to trace 1 and squared 14 times is dominated by its first direction;
    the column of its largest diagonal, normalised and with its largest
    loading positive, is that direction; it is deflated and the next follows."""
    parts = [f"""WITH {ELEMS_SQL},
c0 AS MATERIALIZED (SELECT a.i, b.i AS j, covar_samp(a.x, b.x) AS v FROM e a JOIN e b ON a.pair_id = b.pair_id
                    GROUP BY a.i, b.i),
tv AS MATERIALIZED (SELECT sum(v) AS t FROM c0 WHERE i = j)"""]
    for t in range(N_PCA):
        parts.append(f"m{t}_0 AS MATERIALIZED (SELECT i, j, v / (SELECT sum(v) FROM c{t} WHERE i = j) AS v FROM c{t})")
        for k in range(SQUARINGS):
            parts.append(f"""s{t}_{k} AS MATERIALIZED (SELECT a.i, b.j, sum(a.v * b.v) AS v
                         FROM m{t}_{k} a JOIN m{t}_{k} b ON a.j = b.i GROUP BY a.i, b.j)""")
            parts.append(f"m{t}_{k + 1} AS MATERIALIZED (SELECT i, j, v / (SELECT sum(v) FROM s{t}_{k} WHERE i = j) AS v "
                         f"FROM s{t}_{k})")
        m = f"m{t}_{SQUARINGS}"
        parts.append(f"r{t} AS MATERIALIZED (SELECT i, v FROM {m} "
                     f"WHERE j = (SELECT i FROM {m} WHERE i = j ORDER BY v DESC, i LIMIT 1))")
        parts.append(f"""u{t} AS MATERIALIZED (SELECT i, v / (SELECT sqrt(sum(v * v)) FROM r{t})
                         * (SELECT sign(v) FROM r{t} ORDER BY abs(v) DESC, i LIMIT 1) AS v FROM r{t})""")
        parts.append(f"""l{t} AS MATERIALIZED (SELECT sum(a.v * c.v * b.v) AS l FROM u{t} a JOIN c{t} c ON c.i = a.i
                         JOIN u{t} b ON b.i = c.j)""")
        parts.append(f"""c{t + 1} AS MATERIALIZED (SELECT c.i, c.j, c.v - l * a.v * b.v AS v FROM c{t} c
                         JOIN u{t} a ON a.i = c.i JOIN u{t} b ON b.i = c.j, l{t})""")
    pca = " UNION ALL ".join(f"SELECT CAST({t} AS INTEGER) AS component, i, v, l FROM u{t}, l{t}" for t in range(N_PCA))
    return ",\n".join([*parts, f"pca AS MATERIALIZED ({pca})"]) + "\n" + select


def _pca_frame(spark, sf):
    comp = hd.fit_pca(_diffs(spark, sf), N_PCA).components_frame(spark)
    return comp.select("component", _r("w", 6).alias("w"),
                       F.round("explained_variance_ratio", 9).alias("explained_variance_ratio"),
                       F.round("explained_variance", 9).alias("explained_variance"))


W_SQL = "list(round(v, 6) + 0.0 ORDER BY i) AS w"
RATIO_SQL = "round(any_value(l) / (SELECT t FROM tv), 9) AS explained_variance_ratio"
VARIANCE_SQL = "round(any_value(l), 9) AS explained_variance"


@query("h2_pca_components", _pca_sql(
    f"SELECT component, {W_SQL}, {RATIO_SQL}, {VARIANCE_SQL} FROM pca GROUP BY component"))
def h2_pca_components(spark, sf):
    return _pca_frame(spark, sf)


@query("h2_pca_krylov", _pca_sql(
    f"SELECT component, {W_SQL}, {RATIO_SQL}, {VARIANCE_SQL} FROM pca GROUP BY component"))
def h2_pca_krylov(spark, sf):
    """The same directions without a d x d matrix: block Krylov and a QR tree."""
    comp = hd.fit_pca(_diffs(spark, sf), N_PCA, method="krylov").components_frame(spark)
    return comp.select("component", _r("w", 6).alias("w"),
                       F.round("explained_variance_ratio", 9).alias("explained_variance_ratio"),
                       F.round("explained_variance", 9).alias("explained_variance"))


@query("h3_pca_full", f"""
WITH {ELEMS_SQL}
SELECT a.i, b.i AS j, round(covar_samp(a.x, b.x), 9) + 0.0 AS rebuilt
FROM e a JOIN e b ON a.pair_id = b.pair_id AND b.i >= a.i GROUP BY a.i, b.i""")
def h3_pca_full(spark, sf):
    """All directions, in the form that does not depend on their signs: the
    sum over k of variance_k * w_ki * w_kj."""
    comp = hd.fit_pca(_diffs(spark, sf)).components_frame(spark)
    left = comp.select("explained_variance", "w", F.posexplode("w").alias("i", "wi"))
    cells = left.select("explained_variance", "i", "wi", F.posexplode("w").alias("j", "wj")).where("j >= i")
    return cells.groupBy("i", "j").agg(
        F.round(F.sum(F.col("explained_variance") * F.col("wi") * F.col("wj")), 9).alias("rebuilt"))


@query("h4_explained_variance_ratio", _pca_sql(f"SELECT component, {RATIO_SQL} FROM pca GROUP BY component"))
def h4_explained_variance_ratio(spark, sf):
    return _pca_frame(spark, sf).select("component", "explained_variance_ratio")


@query("h5_explained_variance", _pca_sql(f"SELECT component, {VARIANCE_SQL} FROM pca GROUP BY component"))
def h5_explained_variance(spark, sf):
    return _pca_frame(spark, sf).select("component", "explained_variance")


@query("h6_covariance", f"""
WITH {ELEMS_SQL}
SELECT a.i, b.i AS j, round(covar_samp(a.x, b.x), 9) + 0.0 AS cov
FROM e a JOIN e b ON a.pair_id = b.pair_id AND b.i >= a.i GROUP BY a.i, b.i""")
def h6_covariance(spark, sf):
    c = hd.covariance(_diffs(spark, sf))
    return c.select("i", "j", F.round("cov", 9).alias("cov"))


OFFSET = 1e6


@query("h6_covariance_offset", f"""
WITH {ELEMS_SQL}
SELECT a.i, b.i AS j, round(covar_samp(a.x + {OFFSET}, b.x + {OFFSET}), 7) + 0.0 AS cov
FROM e a JOIN e b ON a.pair_id = b.pair_id AND b.i >= a.i GROUP BY a.i, b.i""")
def h6_covariance_offset(spark, sf):
    """Covariance of vectors whose mean is far larger than their spread."""
    far = _diffs(spark, sf).select("pair_id", F.transform("diff", lambda x: x + F.lit(OFFSET)).alias("diff"))
    return hd.covariance(far).select("i", "j", F.round("cov", 7).alias("cov"))


@query("h7_total_variance", f"""
WITH {ELEMS_SQL}
SELECT round(sum(v), 9) AS total_variance FROM (SELECT i, var_samp(x) AS v FROM e GROUP BY i) t""")
def h7_total_variance(spark, sf):
    return hd.total_variance(_diffs(spark, sf)).select(F.round("total_variance", 9).alias("total_variance"))


@query("h8_project", _pca_sql("""
SELECT pair_id, list(round(p, 6) + 0.0 ORDER BY component) AS proj
FROM (SELECT e.pair_id, pca.component, sum((e.x - mu.m) * pca.v) AS p
      FROM e JOIN (SELECT i, avg(x) AS m FROM e GROUP BY i) mu ON mu.i = e.i JOIN pca ON pca.i = e.i
      GROUP BY e.pair_id, pca.component) t GROUP BY pair_id"""))
def h8_project(spark, sf):
    diffs = _diffs(spark, sf)
    res = hd.fit_pca(diffs, N_PCA)
    return hd.project(diffs, res).select("pair_id", _r("proj", 6).alias("proj"))


@query("h8_full_projection_length", f"""
WITH {ELEMS_SQL}
SELECT e.pair_id, round(sum((e.x - mu.m) * (e.x - mu.m)), 6) AS length2
FROM e JOIN (SELECT i, avg(x) AS m FROM e GROUP BY i) mu ON mu.i = e.i GROUP BY e.pair_id""")
def h8_full_projection_length(spark, sf):
    """Squared length of the projection onto all directions, which is that of
    the centred difference."""
    diffs = _diffs(spark, sf)
    proj = hd.project(diffs, hd.fit_pca(diffs))
    return proj.select("pair_id", F.round(F.aggregate("proj", F.lit(0.0), lambda a, x: a + x * x), 6).alias("length2"))


HEADS_SQL = "SELECT head_id, component, sign, w FROM fx_heads"


@query("h9_signed_heads", HEADS_SQL)
def h9_signed_heads(spark, sf):
    return fx.heads(spark, sf)


@query("h10_original_head", HEADS_SQL + """
UNION ALL SELECT CAST(-1 AS BIGINT) AS head_id, CAST(-1 AS INTEGER) AS component, CAST(1 AS INTEGER) AS sign, w
FROM fx_original""")
def h10_original_head(spark, sf):
    return hd.with_original(fx.heads(spark, sf), fx.original_head(spark, sf))


@query("h11_select_heads", """
WITH h AS (SELECT head_id, component, sign, row_number() OVER (ORDER BY head_id) - 1 AS r,
                  count(*) OVER () AS n FROM fx_heads)
SELECT CAST(CASE WHEN r < n // 2 THEN r ELSE r - n // 2 + 3 END AS BIGINT) AS head_id, component, sign,
       head_id AS source_head_id
FROM h WHERE n >= 6 AND ((r < n // 2 AND r < 3) OR (r >= n // 2 AND r - n // 2 < 3))""")
def h11_select_heads(spark, sf):
    return hd.select_heads(fx.heads(spark, sf), 6).drop("w")


def _rand_sql(d_expr: str) -> str:
    u = ("((CAST('0x' || substring(md5('0|u|' || CAST(h.head_id AS VARCHAR) || '|' || CAST(j AS VARCHAR)), 1, 8)"
         " AS BIGINT) + 0.5) / 4294967296.0)")
    return f"""
rh AS (SELECT h.head_id, list_transform(range(0, {d_expr}), lambda j: ({u} * 2 - 1) * (1.0 / sqrt({d_expr}))) AS w
       FROM range({N_RANDOM}) h(head_id), dim)"""


@query("h12_random_head_scores", f"""
WITH dim AS (SELECT max(len(embedding)) AS d FROM embeddings),
{_rand_sql('dim.d')}
SELECT p.pair_id, CAST(h.head_id AS BIGINT) AS head_id,
       round(list_dot_product(list_transform(p.chosen, lambda x: CAST(x AS DOUBLE)), h.w), 6) + 0.0 AS s_chosen,
       round(list_dot_product(list_transform(p.rejected, lambda x: CAST(x AS DOUBLE)), h.w), 6) + 0.0 AS s_rejected
FROM fx_vec_pairs p, rh h""")
def h12_random_head_scores(spark, sf):
    pairs = fx.vec_pairs(spark, sf)
    d = pairs.agg(F.max(F.size("chosen"))).first()[0]
    heads = hd.random_heads(spark, N_RANDOM, d, "uniform", seed=0)
    s = score_heads(pairs, heads, keep=["pair_id"])
    return s.select("pair_id", "head_id", F.round("s_chosen", 6).alias("s_chosen"),
                    F.round("s_rejected", 6).alias("s_rejected"))


def _gauss_sql() -> str:
    def u(tag):
        return (f"((CAST('0x' || substring(md5('0|{tag}|' || CAST(h.head_id AS VARCHAR) || '|' || CAST(j AS VARCHAR)),"
                f" 1, 8) AS BIGINT) + 0.5) / 4294967296.0)")
    return f"""
WITH dim AS (SELECT max(len(embedding)) AS d FROM embeddings),
g AS (SELECT h.head_id, list_transform(range(0, dim.d),
                 lambda j: sqrt(-2 * ln({u('g1')})) * cos(2 * pi() * {u('g2')})) AS w
      FROM range({N_RANDOM}) h(head_id), dim),
rh AS (SELECT head_id, list_transform(w, lambda x: x / sqrt(list_sum(list_transform(w, lambda y: y * y)))) AS w
       FROM g)
SELECT p.pair_id, CAST(h.head_id AS BIGINT) AS head_id,
       round(list_dot_product(list_transform(p.chosen, lambda x: CAST(x AS DOUBLE)), h.w), 6) + 0.0 AS s_chosen
FROM fx_vec_pairs p, rh h"""


@query("h12_random_heads_uniform_l2", f"""
WITH dim AS (SELECT max(len(embedding)) AS d FROM embeddings),
{_rand_sql('dim.d')},
nh AS (SELECT head_id, list_transform(w, lambda x: x / sqrt(list_sum(list_transform(w, lambda y: y * y)))) AS w FROM rh)
SELECT p.pair_id, CAST(h.head_id AS BIGINT) AS head_id,
       round(list_dot_product(list_transform(p.chosen, lambda x: CAST(x AS DOUBLE)), h.w), 6) + 0.0 AS s_chosen
FROM fx_vec_pairs p, nh h""")
def h12_random_heads_uniform_l2(spark, sf):
    pairs = fx.vec_pairs(spark, sf)
    d = pairs.agg(F.max(F.size("chosen"))).first()[0]
    heads = hd.random_heads(spark, N_RANDOM, d, "uniform_l2", seed=0)
    s = score_heads(pairs, heads, keep=["pair_id"])
    return s.select("pair_id", "head_id", F.round("s_chosen", 6).alias("s_chosen"))


@query("h12_random_heads_gaussian_l2", _gauss_sql())
def h12_random_heads_gaussian_l2(spark, sf):
    pairs = fx.vec_pairs(spark, sf)
    d = pairs.agg(F.max(F.size("chosen"))).first()[0]
    heads = hd.random_heads(spark, N_RANDOM, d, "gaussian_l2", seed=0)
    s = score_heads(pairs, heads, keep=["pair_id"])
    return s.select("pair_id", "head_id", F.round("s_chosen", 6).alias("s_chosen"))


@query("h13_l2_normalise", f"""
WITH d AS ({DIFF_SQL}),
n AS (SELECT pair_id, diff, sqrt(list_sum(list_transform(diff, lambda x: x * x))) AS nrm FROM d)
SELECT pair_id, list_transform(diff, lambda x: round(CASE WHEN nrm > 0 THEN x / nrm ELSE x END, 9) + 0.0) AS diff
FROM n""")
def h13_l2_normalise(spark, sf):
    return _diffs(spark, sf).select("pair_id", _r(l2_normalise("diff"), 9).alias("diff"))


@query("h13_unit_norm_check", """
SELECT coalesce(bool_and(abs(sqrt(list_sum(list_transform(w, lambda x: x * x))) - 1) <= 1e-6), true) AS all_unit
FROM fx_heads""")
def h13_unit_norm_check(spark, sf):
    return hd.unit_norm_check(fx.heads(spark, sf))


@query("h14_normalise_scores", """
WITH st AS (SELECT head_id, avg(s_chosen) AS mean, stddev_samp(s_chosen) AS std FROM fx_scores GROUP BY head_id)
SELECT x.pair_id, x.head_id, round((x.s_chosen - st.mean) / st.std, 6) + 0.0 AS s_chosen,
       round((x.s_rejected - st.mean) / st.std, 6) + 0.0 AS s_rejected
FROM fx_scores x JOIN st USING (head_id)""")
def h14_normalise_scores(spark, sf):
    s = fx.scores(spark, sf)
    st = s.groupBy("head_id").agg(F.avg("s_chosen").alias("mean"), F.stddev_samp("s_chosen").alias("std"))
    n = hd.normalise_scores(s, st)
    return n.select("pair_id", "head_id", F.round("s_chosen", 6).alias("s_chosen"),
                    F.round("s_rejected", 6).alias("s_rejected"))


@query("h9_pca_heads_subset_accuracy", _pca_sql(f"""
SELECT head_id, subset, round(avg(CASE WHEN sign * delta > 5e-10 THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) AS n
FROM (SELECT CAST(pca.component + CASE WHEN s.sign = 1 THEN 0 ELSE {N_PCA} END AS BIGINT) AS head_id, s.sign,
             e.pair_id, any_value(p.subset) AS subset, sum(e.x * pca.v) AS delta
      FROM e JOIN pca ON pca.i = e.i JOIN fx_vec_pairs p ON p.pair_id = e.pair_id, (VALUES (1), (-1)) s(sign)
      GROUP BY pca.component, s.sign, e.pair_id) t GROUP BY head_id, subset"""))
def h9_pca_heads_subset_accuracy(spark, sf):
    """PCA of the pair differences -> signed heads -> accuracy per (head, subset)."""
    from prefspark.operators import evaluate as ev
    pairs = fx.vec_pairs(spark, sf)
    res = hd.fit_pca(hd.pair_diff(pairs), N_PCA)
    heads = hd.signed_heads(res.components_frame(spark).select("component", "w"), N_PCA)
    scored = ev.with_win(score_heads(pairs, heads, keep=["pair_id", "subset"]))
    acc = ev.subset_accuracy(scored)
    return acc.select("head_id", "subset", F.round("accuracy", 6).alias("accuracy"), "n")
