"""Indented score objects read and written as lines, against the json module."""

import json
import random
from pathlib import Path

import pytest

from prefspark.sources import objects as ob
from prefspark.sources import readers as rd


@pytest.fixture()
def small_splits(spark):
    """Input splits of a few hundred bytes, so that arrays and elements are cut."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def rows_of(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


ODD = ["],", '"id": [', "        x", "a\nb", "{", "é 中", '\\"', "", "[", "7", "null"]


def test_head_objects_equal_whole_reads(spark, tmp_path, small_splits):
    rng = random.Random(4)
    for h, n in ((0, 0), (2, 1), (10, 90)):
        whole = {"id": [rng.choice(ODD) + str(i) for i in range(n)], "subset": [rng.choice(ODD) for _ in range(n)],
                 "scores_chosen": [[rng.uniform(-9, 9)] if i % 7 else [] for i in range(n)],
                 "scores_rejected": [[rng.random() * 1e-9, 5.0] if i % 5 else [None] for i in range(max(n - 2, 0))],
                 "results_leaderboard": {"id": 1, "subset": [[3]]}, "extra": "scores"}
        (tmp_path / f"case_x_{h}.json").write_text(json.dumps(whole, indent=4, sort_keys=True))
    got = rows_of(ob.read_head_score_objects(spark, str(tmp_path)), "head_id", "pair_index")
    want = rows_of(rd.read_head_scores_files(spark, str(tmp_path)), "head_id", "pair_index")
    assert got == want and len(got) == 91


def test_combined_object_equals_whole_read(spark, tmp_path, small_splits):
    rng = random.Random(5)
    whole = {f"head_{h}": {"scores_chosen": [rng.gauss(0, 1) for _ in range(n)], "scores_rejected": [rng.gauss(0, 1) for _ in range(n)],
                           "overall_accuracy": 0.5, "per_task_accuracy": {"0": 1.0, "1": 0.25},
                           "task_ids": [i % 3 for i in range(n)]} for h, n in ((0, 40), (1, 0), (2, 3), (11, 70))}
    path = tmp_path / "combined.json"
    path.write_text(json.dumps(whole, indent=4, sort_keys=True))
    got = rows_of(ob.read_combined_score_pieces(spark, str(path)), "head_id", "pair_index")
    assert got == rows_of(rd.read_combined_scores_object(spark, str(path)), "head_id", "pair_index") and len(got) == 113
    assert spark.read.text(str(path)).rdd.getNumPartitions() > 20


def joined(folder):
    return "".join(p.read_text() for p in sorted(Path(folder).glob("part-*")))


def test_written_objects_are_json(spark, tmp_path, small_splits):
    rows = [(h, p, ODD[p % len(ODD)], p % 4, None if p == 3 else p / 7 - h, float(-p)) for h in (1, 2, 12) for p in range(0, 60 * h, 3)]
    df = spark.createDataFrame(rows, "head_id long, pair_id long, subset string, task_id int, s_chosen double, s_rejected double")
    df = df.repartition(7)
    ob.write_head_score_objects(df, str(tmp_path / "heads"))
    for h in (1, 2, 12):
        own = [r for r in rows if r[0] == h]
        text = joined(tmp_path / "heads" / f"head_id={h}")
        whole = {"id": [str(r[1]) for r in own], "subset": [r[2] for r in own],
                 "scores_chosen": [[r[4]] for r in own], "scores_rejected": [[r[5]] for r in own]}
        assert json.loads(text) == whole
        assert [x.strip() for x in text.splitlines()][:3] == ["{", '"id": [', f'"{own[0][1]}",']
    back = rows_of(ob.read_head_score_objects(spark, str(tmp_path / "heads")), "head_id", "pair_index")
    assert [(r[0], r[2], r[3], r[4], r[5]) for r in back] == [(r[0], str(r[1]), r[2], r[4], r[5]) for r in rows]
    acc = spark.createDataFrame([(h, m, 0.5) for h in (1, 2) for m in ("overall", "task_0", "task_1")], "head_id long, metric string, value double")
    ob.write_combined_score_object(df, acc, str(tmp_path / "all"))
    whole = json.loads(joined(tmp_path / "all"))
    assert list(whole) == ["head_1", "head_2", "head_12"] and whole["head_12"]["per_task_accuracy"] == {}
    assert whole["head_1"]["per_task_accuracy"] == {"0": 0.5, "1": 0.5} and whole["head_12"]["overall_accuracy"] is None
    assert whole["head_2"]["task_ids"] == [r[3] for r in rows if r[0] == 2]
    back = rows_of(ob.read_combined_score_pieces(spark, str(tmp_path / "all")), "head_id", "pair_index")
    assert [(r[0], *r[2:]) for r in back] == [(r[0], *r[3:]) for r in rows]


def test_no_scores(spark, tmp_path):
    none = spark.createDataFrame([], "head_id long, pair_id long, subset string, s_chosen double, s_rejected double")
    ob.write_head_score_objects(none, str(tmp_path / "none"))
    assert ob.read_head_score_objects(spark, str(tmp_path / "none")).count() == 0
