"""Extraction on token ids: length rules, truncation sides, prompt boundary."""

import pytest
from pyspark.sql import functions as F

from prefspark.functions import tokens as tok
from prefspark.plans import stages
from prefspark.session import scratch_path

MARK = tok.PROMPT_END_PATTERNS["gemma2"]
SCHEMA = "pair_id long, chosen array<struct<role:string,content:string>>, rejected array<struct<role:string,content:string>>"


def user_functions():
    """Local functions, so that they travel to the workers by value."""
    def make_tokenizer():
        import re

        def ids(texts):  # the numbers of a text: a message spells its own ids
            return [[int(n) for n in re.findall(r"\b\d+\b", t)] for t in texts]
        return ids

    def make_encoder():
        def states(ids, at):
            return [[[float(s[i]), float(i), float(len(s))] for i in p] for s, p in zip(ids, at)]
        return states
    return make_tokenizer, make_encoder


def messages(ids, answer):
    return [("user", " ".join(map(str, ids))), ("assistant", " ".join(map(str, answer)))]


def run(spark, rows, name, **kw):
    pairs = spark.createDataFrame([(i, messages(q, a), messages(q, b)) for i, q, a, b in rows], SCHEMA)
    out = scratch_path(spark, name)
    got = stages.extract_tokens(spark, pairs, *user_functions(), out, n_buckets=2, **kw)
    again = stages.extract_tokens(spark, pairs, *user_functions(), out, n_buckets=2, **kw)
    assert again.count() == got.count()     # a rerun adds nothing
    return {r.pair_id: r.asDict() for r in got.collect()}


def test_length_rules_and_sides(spark):
    rows = [(1, [1, 2, 3], [4, 5], [6]), (2, list(range(20)), [7, 8], [9])]
    whole = run(spark, rows, "tokens-dropped", max_tokens=10)
    assert set(whole) == {1} and whole[1]["chosen"] == [5.0, 4.0, 5.0] and whole[1]["rejected"] == [6.0, 3.0, 4.0]
    right = run(spark, rows, "tokens-right", max_tokens=10, truncation="right")
    assert right[2]["chosen"] == right[2]["rejected"] == [9.0, 9.0, 10.0]
    left = run(spark, rows, "tokens-left", max_tokens=10, truncation="left")
    assert left[2]["chosen"] == [8.0, 9.0, 10.0] and left[2]["rejected"] == [9.0, 9.0, 10.0]
    assert left[1]["chosen"] == whole[1]["chosen"]
    with pytest.raises(ValueError):
        run(spark, rows, "tokens-side", max_tokens=10, truncation="middle")


def test_prompt_boundary(spark):
    rows = [(1, [1, 2], [*MARK, 4], [6]), (2, [1, 2], [4], [6]), (3, list(range(30)), [*MARK, 4], [6])]
    got = run(spark, rows, "tokens-boundary", max_tokens=20, truncation="right", boundary=True)
    assert set(got) == {1}      # no marker, and a marker cut away
    ids = [1, 2, *MARK, 4]
    assert got[1]["chosen"] == [4.0, len(ids) - 1.0, float(len(ids))]
    before, at = got[1]["prompt_prev"], got[1]["prompt_last"]
    assert at[1] == before[1] + 1 and before[0] == ids[int(before[1])] and at[0] == ids[int(at[1])]
    kept = run(spark, rows, "tokens-boundary-left", max_tokens=20, truncation="left", boundary=True)
    assert set(kept) == {1, 3}


def test_empty(spark):
    assert run(spark, [], "tokens-none", max_tokens=5, boundary=True) == {}
    got = run(spark, [(1, [], [], [2])], "tokens-empty", max_tokens=5)
    assert got[1]["chosen"] is None and got[1]["rejected"] == [2.0, 0.0, 1.0]
