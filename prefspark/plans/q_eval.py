"""Registered queries: evaluation aggregates (V1-V6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from prefspark.operators import evaluate as ev
from prefspark.plans import fixtures as fx
from prefspark.plans.registry import query, rnd

WIN_SQL = "CASE WHEN round(s_chosen - s_rejected, 9) > 0 THEN 1 ELSE 0 END"


def _scored(spark, sf):
    return ev.with_win(fx.scores(spark, sf))


@query("v1_win", f"""
SELECT pair_id, head_id, {WIN_SQL} AS win FROM fx_scores""")
def v1_win(spark, sf):
    return _scored(spark, sf).select("pair_id", "head_id", "win")


ACC_SQL = f"""
acc AS (SELECT head_id, subset, avg(CAST({WIN_SQL} AS DOUBLE)) AS accuracy, count(*) AS n
        FROM fx_scores GROUP BY head_id, subset)"""


@query("v2_subset_accuracy", f"""
WITH {ACC_SQL}
SELECT head_id, subset, round(accuracy, 6) AS accuracy, n FROM acc""")
def v2_subset_accuracy(spark, sf):
    acc = ev.subset_accuracy(_scored(spark, sf))
    return acc.select("head_id", "subset", F.round("accuracy", 6).alias("accuracy"), "n")


SECTION_SQL = f"""
WITH {ACC_SQL},
per AS (SELECT a.head_id, m.section, sum(a.accuracy * c.n) / sum(c.n) AS s
        FROM acc a JOIN fx_section_map m USING (subset) JOIN fx_counts c USING (subset)
        GROUP BY a.head_id, m.section),
grid AS (SELECT DISTINCT a.head_id, m.section FROM acc a, fx_section_map m),
sec AS (SELECT g.head_id, g.section, coalesce(p.s, 0.0) AS score
        FROM grid g LEFT JOIN per p USING (head_id, section))"""


@query("v3_section_scores", SECTION_SQL + """
SELECT head_id, section, round(score, 6) AS score FROM sec""")
def v3_section_scores(spark, sf):
    acc = ev.subset_accuracy(_scored(spark, sf))
    sec = ev.section_scores(acc, fx.SECTION_MAP, fx.EXAMPLE_COUNTS)
    return sec.select("head_id", "section", F.round("score", 6).alias("score"))


@query("v4_overall_score", SECTION_SQL + """
SELECT head_id, round(avg(score), 6) AS overall FROM sec GROUP BY head_id""")
def v4_overall_score(spark, sf):
    acc = ev.subset_accuracy(_scored(spark, sf))
    ov = ev.overall_score(ev.section_scores(acc, fx.SECTION_MAP, fx.EXAMPLE_COUNTS))
    return ov.select("head_id", F.round("overall", 6).alias("overall"))


@query("v3_v4_leaderboard", SECTION_SQL + """
SELECT head_id, section AS metric, {r_score} AS value FROM sec
UNION ALL
SELECT head_id, 'overall' AS metric, {r_avg} AS value FROM sec GROUP BY head_id""".format(
    r_score=rnd("score", 3), r_avg=rnd("avg(score)", 3)))
def v3_v4_leaderboard(spark, sf):
    acc = ev.subset_accuracy(_scored(spark, sf))
    return ev.leaderboard(acc, fx.SECTION_MAP, fx.EXAMPLE_COUNTS)


@query("v5_pref_set_accuracy", f"""
SELECT head_id, task_id AS subset, round(avg(CAST({WIN_SQL} AS DOUBLE)), 6) AS accuracy, count(*) AS n
FROM fx_scores GROUP BY head_id, task_id""")
def v5_pref_set_accuracy(spark, sf):
    s = _scored(spark, sf).drop("subset").withColumnRenamed("task_id", "subset")
    acc = ev.pref_set_accuracy(s)
    return acc.select("head_id", "subset", F.round("accuracy", 6).alias("accuracy"), "n")


@query("v6_task_accuracy", f"""
WITH per AS (SELECT head_id, task_id, avg(CAST({WIN_SQL} AS DOUBLE)) AS a
             FROM fx_scores GROUP BY head_id, task_id),
heads AS (SELECT head_id, avg(CAST({WIN_SQL} AS DOUBLE)) AS a FROM fx_scores GROUP BY head_id)
SELECT h.head_id, 'task_' || CAST(t.task_id AS VARCHAR) AS metric, {rnd('p.a', 3)} AS value
FROM heads h CROSS JOIN fx_tasks t LEFT JOIN per p ON p.head_id = h.head_id AND p.task_id = t.task_id
UNION ALL
SELECT head_id, 'overall' AS metric, {rnd('a', 3)} AS value FROM heads""")
def v6_task_accuracy(spark, sf):
    return ev.task_accuracy(_scored(spark, sf), fx.N_TASKS)
