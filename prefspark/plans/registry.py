"""Registry of named queries and their oracle SQL.

Each query is a callable ``(spark, sf_dir) -> DataFrame`` built from the
library's operators.  Its oracle is an independent DuckDB SQL statement over
the base tables; the fixture views it names (``fx_*``) are prepended as CTEs
from ``FIXTURE_SQL``.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}

# DuckDB statements of the fixture views (see FIXTURES.md).
FIXTURE_SQL: dict[str, str] = {
    "fx_vec_pairs": """
        SELECT CAST(a.vec_id / 2 AS BIGINT) AS pair_id, a.label AS subset,
               a.label % 4 AS task_id, abs(a.label - b.label) / 10 AS margin,
               a.embedding AS chosen, b.embedding AS rejected
        FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1
        WHERE a.vec_id % 2 = 0""",
    "fx_components": """
        SELECT label AS component, list(m ORDER BY i) AS w
        FROM (SELECT CAST(label AS INTEGER) AS label, i, CAST(round(CAST(avg(x) AS DECIMAL(38, 12)), 6) AS DOUBLE) AS m
              FROM fx_elements GROUP BY label, i) t GROUP BY label""",
    "fx_elements": """
        SELECT label, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings""",
    "fx_heads": """
        SELECT CAST(CASE WHEN s.sign = 1 THEN c.component ELSE c.component + 10 END AS BIGINT) AS head_id,
               c.component, s.sign, list_transform(c.w, lambda x: x * s.sign) AS w
        FROM fx_components c, (VALUES (1), (-1)) s(sign)""",
    "fx_original": """
        SELECT list(m ORDER BY i) AS w
        FROM (SELECT i, CAST(round(CAST(avg(x) AS DECIMAL(38, 12)), 6) AS DOUBLE) AS m
              FROM fx_elements GROUP BY i) t""",
    "fx_scores": """
        SELECT p.pair_id, p.subset, p.task_id, h.head_id,
               list_dot_product(list_transform(p.chosen, lambda x: CAST(x AS DOUBLE)), h.w) AS s_chosen,
               list_dot_product(list_transform(p.rejected, lambda x: CAST(x AS DOUBLE)), h.w) AS s_rejected
        FROM fx_vec_pairs p, fx_heads h""",
    "fx_section_map": """
        SELECT * FROM (VALUES (0, 's_a'), (1, 's_a'), (2, 's_a'), (3, 's_b'), (4, 's_b'),
                              (5, 's_b'), (6, 's_c'), (7, 's_c'), (8, 's_d')) t(subset, section)""",
    "fx_counts": """
        SELECT CAST(s AS INTEGER) AS subset, CAST(10 * (s + 1) AS BIGINT) AS n FROM range(10) t(s)""",
    "fx_tasks": """
        SELECT CAST(t AS INTEGER) AS task_id FROM range(5) r(t)""",
    "fx_seeds": """
        SELECT CAST(s AS INTEGER) AS seed FROM range(20) r(s)""",
    "fx_dialogues": """
        SELECT conv_id, list({'role': role, 'content': text} ORDER BY turn) AS m
        FROM conversations GROUP BY conv_id""",
    "fx_msg_pairs": """
        SELECT n.conv_id AS pair_id, n.m AS chosen,
               list_transform(list_concat(n.m[1:len(n.m) - 1],
                                          [{'role': n.m[len(n.m)].role, 'content': x.m[len(x.m)].content}]),
                              lambda t, i: CASE WHEN i = 1 AND n.conv_id % 5 = 4
                                                THEN {'role': t.role, 'content': t.content || 'x'} ELSE t END)
                   AS rejected
        FROM (SELECT conv_id, m, coalesce(lead(conv_id) OVER (ORDER BY conv_id), min(conv_id) OVER ()) AS nk
              FROM fx_dialogues) n
        JOIN fx_dialogues x ON x.conv_id = n.nk""",
    "fx_winner": """
        SELECT pair_id, CASE pair_id % 3 WHEN 0 THEN 'model_a' WHEN 1 THEN 'model_b' ELSE 'tie' END AS winner,
               chosen AS conversation_a, rejected AS conversation_b
        FROM fx_msg_pairs""",
    "fx_choice": """
        SELECT k // 2 AS pair_id,
               'Which text is better? (' || arg_min(lang, doc_id) || ')' AS input,
               {'choices': list(text ORDER BY doc_id), 'labels': list(quality ORDER BY doc_id)} AS targets
        FROM (SELECT d.doc_id, d.lang, d.text, l.quality, row_number() OVER (ORDER BY d.doc_id) - 1 AS k
              FROM documents d JOIN labels l ON l.doc_id = d.doc_id) t
        GROUP BY k // 2 HAVING count(*) = 2""",
    "fx_indexed": """
        SELECT pair_id, input AS prompt, targets.choices[1] AS response_0, targets.choices[2] AS response_1,
               CAST(pair_id % 2 AS INTEGER) AS better_response_id
        FROM fx_choice""",
    "fx_transcript": """
        SELECT conv_id AS pair_id,
               array_to_string(list_transform(m, lambda t, i: CASE WHEN i = 1 AND conv_id % 3 != 2 THEN ''
                    WHEN t.role = 'assistant' THEN chr(10) || chr(10) || 'Assistant: '
                    ELSE chr(10) || chr(10) || 'Human: ' END || t.content), '') AS input,
               {'choices': ['answer A ' || CAST(conv_id AS VARCHAR), 'answer B ' || CAST(conv_id AS VARCHAR)],
                'labels': [CAST(conv_id % 2 AS INTEGER), CAST(1 - conv_id % 2 AS INTEGER)]} AS targets
        FROM fx_dialogues""",
    "fx_tokens": """
        SELECT doc_id, ids, list_transform(ids, lambda x, i: CASE WHEN i - 1 < doc_id % 3 THEN 0 ELSE 1 END) AS mask
        FROM (SELECT doc_id, list_transform(string_split(text, ' '), lambda w: CAST(length(w) AS INTEGER)) AS ids
              FROM documents) t""",
}


def rnd(expr: str, decimals: int) -> str:
    """DuckDB rounding matching ``round_clean``: noise below 1e-12 dropped,
    then half away from zero on the decimal value."""
    return f"CAST(round(CAST(({expr}) AS DECIMAL(38, 12)), {decimals}) AS DOUBLE)"


def _needed(sql: str) -> list[str]:
    """Fixture CTEs referenced by ``sql``, dependencies first."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for dep in re.findall(r"\bfx_\w+", FIXTURE_SQL[name]):
            if dep != name and dep in FIXTURE_SQL:
                visit(dep)
        order.append(name)

    for name in re.findall(r"\bfx_\w+", sql):
        if name in FIXTURE_SQL:
            visit(name)
    return order


def with_fixtures(sql: str) -> str:
    names = _needed(sql)
    if not names:
        return sql.strip()
    ctes = ",\n".join(f"{n} AS ({FIXTURE_SQL[n].strip()})" for n in names)
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


def query(name: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    """Register a query; ``sql=None`` means rows-only checking."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = with_fixtures(sql)
        return fn
    return deco


def load_all() -> None:
    """Import every query module so that it registers itself."""
    from prefspark.plans import (q_adapt, q_encode, q_eval, q_heads, q_io,  # noqa: F401
                                 q_pairs, q_scoring, q_tokens)
