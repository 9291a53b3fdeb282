"""Hand-made edge rows and properties for the operators."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_MID, SF_SMALL
from prefspark.functions import messages as msg
from prefspark.functions import tokens as tok
from prefspark.functions.vectors import softplus
from prefspark.operators import adapt as ad
from prefspark.operators import heads as hd
from prefspark.operators import pairs as pr
from prefspark.operators import scoring as sc
from prefspark.plans import fixtures as fx

MSG = "array<struct<role:string,content:string>>"


def _m(*turns):
    return [{"role": r, "content": c} for r, c in turns]


# ------------------------------------------------------------------ P3-P5
def test_consistency_rules(spark):
    rows = [
        (0, [], []),                                                           # empty: not consistent
        (1, _m(("assistant", "a")), _m(("assistant", "b"))),                   # one turn, both assistant
        (2, _m(("user", "q"), ("user", "a")), _m(("user", "q"), ("user", "a"))),  # equal, last not assistant
        (3, _m(("user", "q"), ("assistant", "a")), _m(("user", "q"), ("assistant", "b"))),
        (4, _m(("user", "q"), ("assistant", "a")), _m(("user", "Q"), ("assistant", "b"))),
        (5, _m(("user", "q"), ("assistant", "a")), _m(("assistant", "b"),)),
    ]
    df = spark.createDataFrame(rows, f"pair_id int, chosen {MSG}, rejected {MSG}")
    got = {r.pair_id: r.ok for r in df.select("pair_id", msg.is_consistent_pair("chosen", "rejected")
                                                .alias("ok")).collect()}
    assert got == {0: False, 1: True, 2: False, 3: True, 4: False, 5: False}
    sp = {r.pair_id: r for r in pr.split_pair(df).collect()}
    assert (sp[3].prompt, sp[3].chosen, sp[3].rejected) == ("user: q\n", "a", "b")
    assert (sp[0].prompt, sp[0].chosen, sp[0].rejected) == ("", "", "")
    assert sp[1].prompt == ""


def test_pick_rules(spark):
    df = spark.createDataFrame(
        [(["a", "b", "c"], [1, 3, 3], "model_a"), (["x", "y"], [2, 2], None), (["p", "q"], [0, 1], "tie")],
        "choices array<string>, labels array<int>, winner string")
    got = df.select(msg.pick_by_label("choices", "labels", True).alias("best"),
                    msg.pick_by_label("choices", "labels", False).alias("worst"),
                    msg.pick_by_winner("winner", F.lit("A"), F.lit("B")).alias("w")).collect()
    assert [(r.best, r.worst, r.w) for r in got] == [("b", "a", "A"), ("x", "x", "B"), ("q", "p", "B")]


def test_transcript_rules(spark):
    text = "Hi there\n\nAssistant: hello\n\nHuman:  more?\n\nAssistant: yes\n\nAssistant: lost\n\nHuman: last "
    df = spark.createDataFrame([(text,), ("\n\nHuman: lead",)], "t string")
    got = df.select(msg.transcript_messages("t", F.lit("CAND")).alias("m"),
                    msg.transcript_messages("t", F.lit("CAND"), skip_empty_leading=False).alias("legacy")).collect()
    m = [(x.role, x.content) for x in got[0].m]
    assert m == [("user", "Hi there"), ("assistant", "hello"), ("user", "more?"), ("assistant", "yes"),
                 ("user", "last"), ("assistant", "CAND")]
    assert [(x.role, x.content) for x in got[1].m] == [("user", "lead"), ("assistant", "CAND")]
    assert [(x.role, x.content) for x in got[1].legacy] == [("user", ""), ("assistant", "CAND"),
                                                            ("user", "lead"), ("assistant", "CAND")]


def test_strip_pad(spark):
    df = spark.createDataFrame([("A MAD[PAD][PAD]",), ("ok[PAD]",)], "s string")
    got = df.select(msg.strip_pad_chars("s").alias("c"), msg.strip_pad_suffix("s").alias("x")).collect()
    assert [(r.c, r.x) for r in got] == [("A M", "A MAD"), ("ok", "ok")]


def test_template_for_case_insensitive(spark):
    df = spark.createDataFrame([("Meta-Llama-3",), ("llama",), ("gemma-2b",)], "n string")
    assert [r.f for r in df.select(msg.template_for("n").alias("f")).collect()] == ["llama3", "llama3", "gemma2"]


# ------------------------------------------------------------------ T1-T5
def test_token_rules(spark):
    rows = [([5, 6, 7], [1, 1, 1]), ([5, 2, 2], [1, 1, 0]), ([2, 5, 6], [1, 1, 1]), ([3, 3, 4], [0, 1, 1]),
            ([3], [1]), ([3, 2, 9, 3, 2], [1, 1, 1, 1, 1]), ([3], [0])]
    df = spark.createDataFrame(rows, "ids array<int>, mask array<int>")
    got = df.select(tok.last_token_index("ids", 2).alias("last"),
                    tok.find_last("ids", [3, 2]).alias("fl"),
                    tok.mask_double_bos("ids", "mask", 3).alias("m"),
                    tok.truncate("ids", 2, "left").alias("left"),
                    tok.pad("ids", 4, 2).alias("pad"), tok.pad_mask("ids", 4).alias("pm")).collect()
    assert [r["last"] for r in got] == [2, 0, 2, 2, 0, 0, 0]
    assert [r.fl for r in got] == [None, None, None, None, None, 3, None]
    assert got[3].m == [0, 1, 1]         # first unmasked is ids[1]=3, ids[2]=4: no double
    assert got[4].m == [0]               # L=1: the token is compared with itself
    assert got[6].m == [0]               # all masked: start 0, ids[0]=3 twice -> 0
    assert got[0].left == [6, 7] and got[0].pad == [5, 6, 7, 2] and got[0].pm == [1, 1, 1, 0]


# ------------------------------------------------------------------ scoring
def test_score_paths_agree_with_numpy(spark):
    pairs = fx.vec_pairs(spark, SF_MID)
    heads = fx.heads(spark, SF_MID)
    hm = sc.collect_heads(heads)
    a, ids = sc.score_heads_packed(pairs, hm, method="arrow", drop_vectors=False)
    b, _ = sc.score_heads_packed(pairs, hm, method="native")
    c, _ = sc.score_heads_packed(pairs, hm, method="arrow", max_broadcast_bytes=64 * 8 * 3)  # 3 heads per block
    ra = {r.pair_id: (np.array(r.sc), np.array(r.sr), np.array(r.chosen, dtype=np.float64)) for r in a.collect()}
    rb = {r.pair_id: (np.array(r.sc), np.array(r.sr)) for r in b.collect()}
    rc = {r.pair_id: (np.array(r.sc), np.array(r.sr)) for r in c.collect()}
    assert ids == list(range(2 * fx.N_COMPONENTS))
    with pytest.raises(ValueError):
        sc.score_heads_packed(pairs, sc.HeadMatrix([0], np.zeros((1, 1 << 20))), method="native")
    for k, (sca, sra, x) in ra.items():
        np.testing.assert_allclose(sca, hm.w @ x, atol=1e-12)
        np.testing.assert_allclose(sca, rb[k][0], atol=1e-12)
        np.testing.assert_allclose(sra, rc[k][1], atol=1e-12)
        np.testing.assert_allclose(sca[:10], -sca[10:], atol=1e-12)   # +/- heads are negatives


def test_head_size_check(spark):
    heads = fx.heads(spark, SF_SMALL)
    with pytest.raises(ValueError):
        sc.collect_heads(heads, max_bytes=100)


def test_softplus_is_stable(spark):
    df = spark.createDataFrame([(800.0,), (-800.0,), (0.0,)], "x double")
    got = [r.s for r in df.select(softplus("x").alias("s")).collect()]
    assert got[0] == 800.0 and got[1] == pytest.approx(0.0, abs=1e-300) and got[2] == pytest.approx(math.log(2))


# ------------------------------------------------------------------ heads / PCA
def test_pca_matches_numpy(spark):
    diffs = hd.pair_diff(fx.vec_pairs(spark, SF_MID))
    x = np.array([r.diff for r in diffs.orderBy("pair_id").collect()])
    res = hd.fit_pca(diffs, 8)
    xc = x - x.mean(0)
    cov = xc.T @ xc / (len(x) - 1)
    lam, vec = np.linalg.eigh(cov)
    order = np.argsort(lam)[::-1]
    lam, vec = lam[order], vec[:, order]
    assert res.total_variance == pytest.approx(np.trace(cov), rel=1e-9)
    np.testing.assert_allclose(res.explained_variance_ratio, lam[:8] / lam.sum(), atol=1e-9)
    np.testing.assert_allclose(res.explained_variance, lam[:8], rtol=1e-7)
    for i in range(8):
        v = res.components[i]
        assert abs(abs(v @ vec[:, i]) - 1) < 1e-6
        np.testing.assert_allclose(cov @ v, lam[i] * v, atol=1e-9)
        j = int(np.argmax(np.abs(v)))
        assert v[j] > 0
    np.testing.assert_allclose(res.components @ res.components.T, np.eye(8), atol=1e-9)
    proj = hd.project(diffs, res).orderBy("pair_id").collect()
    np.testing.assert_allclose(np.array([r.proj for r in proj]), xc @ res.components.T, atol=1e-9)
    proj_a = hd.project(diffs, res, method="arrow").orderBy("pair_id").collect()
    np.testing.assert_allclose(np.array([r.proj for r in proj_a]), xc @ res.components.T, atol=1e-9)
    full = hd.fit_pca(diffs, None)
    assert full.explained_variance_ratio.sum() == pytest.approx(1.0, abs=1e-9)
    ml = hd.fit_pca(diffs, 8, method="ml")
    np.testing.assert_allclose(ml.explained_variance_ratio, res.explained_variance_ratio, atol=1e-9)
    np.testing.assert_allclose(np.abs(ml.components @ res.components.T), np.eye(8), atol=1e-6)


def test_covariance_methods_agree(spark):
    diffs = hd.pair_diff(fx.vec_pairs(spark, SF_MID))
    a = {(r.i, r.j): r.cov for r in hd.covariance(diffs).collect()}
    b = {(r.i, r.j): r.cov for r in hd.covariance(diffs, method="gram").collect()}
    assert a.keys() == b.keys() and len(a) == 64 * 65 // 2
    np.testing.assert_allclose([a[k] for k in sorted(a)], [b[k] for k in sorted(a)], atol=1e-12)


def test_select_heads_rules(spark):
    h = fx.heads(spark, SF_SMALL)
    got = [(r.head_id, r.source_head_id) for r in hd.select_heads(h, 4).orderBy("head_id").collect()]
    assert got == [(0, 0), (1, 1), (2, 10), (3, 11)]
    with pytest.raises(ValueError):
        hd.select_heads(h, 3)
    for ask in (lambda: hd.select_heads(h, 40), lambda: ad.choose_heads(h, 40),
                lambda: ad.choose_heads(h, 3, with_original=True, original_id=-1, form="first")):
        with pytest.raises(ValueError):
            ask()
    ch = ad.choose_heads(h, 5, with_original=True, original_id=-1, form="map")
    assert [(r.head_id, r.source_head_id) for r in ch.orderBy("head_id").collect()] == [
        (0, -1), (1, 0), (2, 1), (3, 10), (4, 11)]


def test_random_heads_unit_norm(spark):
    for kind in ("uniform_l2", "gaussian_l2"):
        h = hd.random_heads(spark, 5, 32, kind, seed=3)
        assert hd.unit_norm_check(h).first().all_unit
    u = hd.random_heads(spark, 5, 32, "uniform", seed=3).collect()
    assert all(abs(x) <= 1 / math.sqrt(32) for r in u for x in r.w)


# ------------------------------------------------------------------ adaptation
def _meta(spark, n_per_group, grp_of=None):
    rows = []
    pid = 0
    for g, n in n_per_group.items():
        for _ in range(n):
            rows.append((pid, g))
            pid += 1
    return spark.createDataFrame(rows, "pair_id bigint, grp string")


def _brute_sample(meta_rows, k, seeds):
    import hashlib
    out = set()
    groups = {}
    for pid, g in meta_rows:
        groups.setdefault(g, []).append(pid)
    for s in seeds:
        for g, ids in groups.items():
            u = sorted(ids, key=lambda p: (int(hashlib.md5(f"{p}|{s}".encode()).hexdigest()[:8], 16), p))
            if len(u) >= k:
                out |= {(s, g, i + 1, p) for i, p in enumerate(u[:k])}
            else:
                for j in range(1, k + 1):
                    r = int(hashlib.md5(f"{g}|{s}|{j}".encode()).hexdigest()[:8], 16) % len(u)
                    out.add((s, g, j, u[r]))
    return out


@pytest.mark.parametrize("parts", [1, 4, 23])
def test_sampling_is_exact_topk_however_the_keys_are_dealt(spark, parts):
    meta = _meta(spark, {"hot": 3000, "mid": 40, "small": 3, "one": 1}).repartition(parts)
    rows = [(r.pair_id, r.grp) for r in meta.collect()]
    got = {(r.seed, r.grp, r.slot, r.pair_id) for r in ad.sample_per_group(meta, 5, [0, 1, 2]).collect()}
    assert got == _brute_sample(rows, 5, [0, 1, 2])
    sketch = ad.bottom_k(meta, 5, [0, 1, 2])
    assert sketch.where("seed is not null").count() <= parts * 3 * 4 * 5  # no task keeps more
    assert {r.grp: r._n for r in ad.sketch_sizes(sketch).collect()} == {"hot": 3000, "mid": 40, "small": 3, "one": 1}
    assert ad.sample_per_group(meta.limit(0), 5, 2).count() == 0


def test_sample_groups_may_have_any_type(spark):
    rows = [(i, i % 3) for i in range(60)]
    for kind in ("int", "bigint", "string", "date"):
        meta = spark.createDataFrame(rows, "pair_id bigint, g int").withColumn(
            "grp", F.col("g").cast(kind) if kind != "date" else F.date_add(F.lit("2020-01-01").cast("date"), F.col("g")))
        s = ad.sample_per_group(meta, 4, 2)
        assert dict(s.dtypes)["grp"] == kind and s.count() == 24


@pytest.mark.parametrize("mode", ["normalised", "raw", "delta"])
def test_cogrouped_weights_equal_broadcast_weights(spark, mode):
    """Coefficients above the limit for one seed alone: pairs of a salted hot
    group, of a null group and without scores meet the weights in cogroups."""
    pairs, heads = fx.vec_pairs(spark, SF_SMALL), fx.heads(spark, SF_SMALL)
    grouped = ad.attach_category(pairs, fx.SECTION_MAP).withColumn(
        "grp", F.when(F.col("pair_id") % 11 == 0, None).otherwise(F.col("grp")))
    packed, ids = sc.score_heads_packed(grouped, heads)
    packed = packed.withColumn("sc", F.when(F.col("pair_id") % 13 != 0, F.col("sc")))
    packed = ad.materialise_table(packed.select("pair_id", "grp", "subset", "sc", "sr"))
    sets = {4: ids[:4], len(ids): ids}
    args = (packed, ids, sets, [3, 5], [0.5, 1.0], 3, mode, ["subset"])
    plain, tight = ad.adapt_grid_packed(*args), ad.adapt_grid_packed(*args, max_bytes=4000)
    columns = plain.agg.columns
    rows = [{tuple(r[c] for c in (*ad.CONFIG, "seed", "pair_id", "subset")): tuple(
        round(r[c], 9) for c in columns if c.startswith("agg")) for r in a.agg.select(*columns).collect()} for a in (plain, tight)]
    assert rows[0] == rows[1] and len(rows[0]) == packed.count() * 8 * 3
    assert any(None is not v and v[0] == 0 for v in rows[0].values())
    assert "CoGroup" in tight.agg._jdf.queryExecution().executedPlan().toString()
    wins = [sorted(map(tuple, a.wins("subset").select(*ad.CONFIG, "seed", "subset", "wins", "n").collect())) for a in (plain, tight)]
    assert wins[0] == wins[1]


def test_sample_has_exactly_k_per_group_and_drops_null_groups(spark):
    rows = [(i, None if i % 7 == 0 else f"g{i % 3}") for i in range(60)]
    meta = spark.createDataFrame(rows, "pair_id bigint, grp string")
    s = ad.sample_per_group(meta, 25, 4)
    counts = {(r.seed, r.grp): r["count"] for r in s.groupBy("seed", "grp").count().collect()}
    assert len(counts) == 12 and set(counts.values()) == {25}


def _reference_adaptation(sc_c, sc_r, grp, sample_idx, k, temperature=1.0):
    """Independent numpy statement of the adaptation for one seed:
    standardise with mean / unbiased std of the 2k sampled values, loss =
    sum of -log sigmoid(zc - zr), softmax of -loss/T, weighted sum."""
    agg_c = np.zeros(len(grp))
    agg_r = np.zeros(len(grp))
    for g, idx in sample_idx.items():
        vals = np.concatenate([sc_c[idx], sc_r[idx]], 0)
        mean = vals.mean(0)
        std = vals.std(0, ddof=1)
        std[std == 0] = 1
        zc, zr = (sc_c[idx] - mean) / std, (sc_r[idx] - mean) / std
        loss = np.log1p(np.exp(-(zc - zr))).sum(0)
        x = -loss / temperature
        w = np.exp(x - x.max())
        w /= w.sum()
        mask = grp == g
        agg_c[mask] = ((sc_c[mask] - mean) / std * w).sum(1)
        agg_r[mask] = ((sc_r[mask] - mean) / std * w).sum(1)
    return agg_c, agg_r


def test_adaptation_matches_tensor_formula(spark):
    pairs = ad.attach_category(fx.vec_pairs(spark, SF_MID), fx.SECTION_MAP)
    packed, ids = sc.score_heads_packed(pairs, fx.heads(spark, SF_MID))
    a = ad.adapt(packed, ids, 15, [0, 1])
    p = sorted(packed.select("pair_id", "grp", "sc", "sr").collect(), key=lambda r: r.pair_id)
    pos = {r.pair_id: i for i, r in enumerate(p)}
    sc_c, sc_r = np.array([r.sc for r in p]), np.array([r.sr for r in p])
    grp = np.array([r.grp for r in p], dtype=object)
    sample = a.sample.collect()
    agg = {(r.seed, r.pair_id): (r.agg_chosen, r.agg_rejected) for r in a.agg.collect()}
    for seed in (0, 1):
        idx = {}
        for r in sorted(sample, key=lambda r: r.slot):
            if r.seed == seed:
                idx.setdefault(r.grp, []).append(pos[r.pair_id])
        want_c, want_r = _reference_adaptation(sc_c, sc_r, grp, {g: np.array(v) for g, v in idx.items()}, 15)
        got_c = np.array([agg[(seed, r.pair_id)][0] for r in p])
        got_r = np.array([agg[(seed, r.pair_id)][1] for r in p])
        np.testing.assert_allclose(got_c, want_c, atol=1e-9)
        np.testing.assert_allclose(got_r, want_r, atol=1e-9)
    w = a.weights.groupBy("seed", "grp").agg(F.sum("weight").alias("s")).collect()
    assert all(abs(r.s - 1) < 1e-12 for r in w)


def test_std_zero_becomes_one(spark):
    sampled = spark.createDataFrame([(0, "g", 1, 1, 5, 2.0, 2.0)],
                                    "seed int, grp string, slot int, pair_id bigint, head_id bigint, c double, r double")
    st = ad.group_head_stats(sampled).first()
    assert st["std"] == 1.0 and st["mean"] == 2.0


def test_seed_statistics_population_std(spark):
    df = spark.createDataFrame([(s, "overall", v) for s, v in enumerate([0.5, 0.7, 0.6, 0.6])],
                               "seed int, metric string, value double")
    r = ad.seed_statistics(df).first()
    assert r["mean"] == 0.6 and r["std"] == round(float(np.std([0.5, 0.7, 0.6, 0.6])), 4)


# ------------------------------------------------------------------ sources
def test_npy_and_compat_readers(spark, tmp_path):
    from prefspark.sources import readers as rd
    d = tmp_path / "npy"
    d.mkdir()
    for i in range(3):
        np.save(d / f"emb_{i}.npy", np.full((1, 4, 5), i, dtype=np.float32) + np.arange(4)[None, :, None])
    np.save(d / "emb_7.npy", np.ones((2, 5), dtype=np.float32))
    got = {r.pair_id: r for r in rd.read_npy_embeddings(spark, str(d)).collect()}
    assert sorted(got) == [0, 1, 2, 7]
    assert got[2].rejected[0] == 3.0 and got[2].prompt_last[0] == 5.0 and got[7].prompt_prev is None

    s = tmp_path / "scores"
    s.mkdir()
    for h in (0, 1, 10):
        (s / f"case_{h}.json").write_text(json.dumps({
            "id": ["a", "b"], "subset": ["x", "y"], "scores_chosen": [[h + 0.5], [h + 1.5]],
            "scores_rejected": [[0.0], [1.0]], "results_leaderboard": {"x": 1}}))
    rows = rd.read_head_scores_files(spark, str(s)).orderBy("head_id", "pair_index").collect()
    assert [(r.head_id, r.pair_index, r.s_chosen) for r in rows][:3] == [(0, 0, 0.5), (0, 1, 1.5), (1, 0, 1.5)]
    assert rows[-1].head_id == 10

    c = tmp_path / "combined.json"
    c.write_text(json.dumps({"head_0": {"scores_chosen": [1.0, 2.0], "scores_rejected": [0.0, 3.0],
                                        "overall_accuracy": 0.5, "per_task_accuracy": {"0": 1.0},
                                        "task_ids": [0, 1]}}))
    cr = rd.read_combined_scores_object(spark, str(c)).orderBy("pair_index").collect()
    assert [(r.head_id, r.subset, r.s_chosen) for r in cr] == [(0, 0, 1.0), (0, 1, 2.0)]


def test_positions_of_written_scores(spark, monkeypatch):
    """Positions per head, heads of unlike sizes and gaps in the ids, from any
    partitioning; the registered query needs no single-object file."""
    from prefspark.plans.q_io import s7_combined_score_positions
    from prefspark.sources import readers as rd
    pairs = {3: [5, 9, 7], 1: [8], 20: list(range(400, 0, -3))}
    df = spark.createDataFrame([(h, p) for h, ps in pairs.items() for p in ps], "head_id long, pair_id long").repartition(5)
    got = {(r.head_id, r.pair_id): r.pair_index for r in rd.with_pair_index(df).collect()}
    assert got == {(h, p): i for h, ps in pairs.items() for i, p in enumerate(sorted(ps))}

    monkeypatch.delattr(rd, "read_combined_scores_object")
    rows = s7_combined_score_positions(spark, SF_SMALL)
    per = {r.head_id: (r.n, r.last) for r in rows.groupBy("head_id").agg(
        F.countDistinct("pair_index").alias("n"), F.max("pair_index").alias("last")).collect()}
    n = fx.scores(spark, SF_SMALL).groupBy("head_id").count().collect()
    assert per == {r.head_id: (r["count"], r["count"] - 1) for r in n}


def test_embed_pairs_matches_direct_encoder(spark):
    from prefspark.operators import encode as en
    texts = ["hello world hello", "x" * 5000, "bye", ""]
    df = spark.createDataFrame([(0, texts[0], texts[2]), (1, texts[1], texts[3])],
                               "pair_id int, chosen_text string, rejected_text string")
    got = en.embed_pairs(df, en.hashing_encoder(16), batch_size=1).orderBy("pair_id").collect()
    want = en.hashing_encoder(16)()(np.array(texts))
    np.testing.assert_array_equal(np.array([r.chosen for r in got]), want[[0, 1]])
    np.testing.assert_array_equal(np.array([r.rejected for r in got]), want[[2, 3]])
    assert np.abs(want[0]).sum() == 3            # three tokens, one count each


def test_with_pair_id_is_dense_across_partitions(spark):
    df = spark.range(0, 5000, 1, 7).select((F.col("id") * 7919 % 5003).alias("k"))
    out = pr.with_pair_id(df, ["k"]).collect()
    got = sorted((r.k, r.pair_id) for r in out)
    assert [p for _, p in got] == list(range(5000))


def test_apply_weights_native_equals_arrow(spark):
    pairs = ad.attach_category(fx.vec_pairs(spark, SF_MID), fx.SECTION_MAP)
    for mode in ("normalised", "raw", "delta"):
        a = ad.adapt_from_vectors(pairs, fx.heads(spark, SF_MID), 15, [0, 3], mode=mode, keep=("subset",))
        b = ad.apply_weights(sc.score_heads_packed(pairs, fx.heads(spark, SF_MID))[0], a.stats, a.weights,
                             [0, 3], mode, ("subset",))
        cols = ["agg_delta"] if mode == "delta" else ["agg_chosen", "agg_rejected"]
        ga = {(r.seed, r.pair_id): tuple(r[c] for c in cols) + (r.subset,) for r in a.agg.collect()}
        gb = {(r.seed, r.pair_id): tuple(r[c] for c in cols) + (r.subset,) for r in b.collect()}
        assert ga.keys() == gb.keys() and len(ga) == 500
        for key, va in ga.items():
            assert va[-1] == gb[key][-1]
            np.testing.assert_allclose(va[:-1], gb[key][:-1], atol=1e-12)


def test_bundle_from_aligned(spark):
    from prefspark.sources import readers as rd
    df = spark.createDataFrame([(["a", "b"], ["s1", "s2"], [[[1.0, 2.0], [3.0, 4.0]], [[5.0, 6.0], [7.0, 8.0]]])],
                               "ids array<string>, subsets array<string>, embs array<array<array<float>>>")
    got = [(r.id, r.subset, r.chosen, r.rejected) for r in rd.bundle_from_aligned(df).collect()]
    assert got == [("a", "s1", [1.0, 2.0], [3.0, 4.0]), ("b", "s2", [5.0, 6.0], [7.0, 8.0])]


def test_exclude_sampled_drops_exactly_the_sample(spark):
    pairs = ad.attach_category(fx.vec_pairs(spark, SF_MID), fx.SECTION_MAP)
    a = ad.adapt_from_vectors(pairs, fx.heads(spark, SF_MID), 15, [0, 1])
    kept = ad.exclude_sampled(a.agg, a.sample)
    n_sampled = a.sample.select("seed", "pair_id").distinct().count()
    assert kept.count() == a.agg.count() - n_sampled


def test_adapt_on_packed_scores_equals_from_vectors(spark):
    pairs = ad.attach_category(fx.vec_pairs(spark, SF_MID), fx.SECTION_MAP)
    heads = fx.heads(spark, SF_MID)
    direct = ad.adapt_from_vectors(pairs, heads, 15, [0, 1])
    long = sc.score_heads(pairs, heads, keep=["pair_id"])
    packed = sc.pack_scores(long).join(pairs.select("pair_id", "grp"), "pair_id")
    ids = packed.first().head_ids
    via = ad.adapt(packed, ids, 15, [0, 1])
    a = {(r.seed, r.pair_id): (r.agg_chosen, r.agg_rejected) for r in direct.agg.collect()}
    b = {(r.seed, r.pair_id): (r.agg_chosen, r.agg_rejected) for r in via.agg.collect()}
    assert a.keys() == b.keys()
    for key in a:
        np.testing.assert_allclose(a[key], b[key], atol=1e-12)


def test_task_accuracy_names_and_null_task(spark):
    from prefspark.operators import evaluate as ev
    df = spark.createDataFrame([(0, 0, 1), (0, 0, 0), (0, 2, 1)], "head_id bigint, task_id int, win int")
    got = {r.metric: r.value for r in ev.task_accuracy(df, 3, names=["A", "B", "C"]).collect()}
    assert got == {"A": 0.5, "B": None, "C": 1.0, "overall": round(2 / 3, 3)}


def test_results_do_not_depend_on_partitioning(spark):
    base = ad.attach_category(fx.vec_pairs(spark, SF_MID), fx.SECTION_MAP)
    heads = fx.heads(spark, SF_MID)
    outs = []
    for n in (1, 7):
        a = ad.adapt_from_vectors(base.repartition(n), heads, 15, [0, 2], keep=("subset",))
        board = ad.tta_section_scores(a.agg, fx.SECTION_MAP, fx.EXAMPLE_COUNTS)
        outs.append(({(r.seed, r.grp, r.slot, r.pair_id) for r in a.sample.collect()},
                     sorted((r.seed, r.metric, r.value) for r in board.collect())))
    assert outs[0] == outs[1]


def test_equal_heads_get_uniform_weights(spark):
    pairs = ad.attach_category(fx.vec_pairs(spark, SF_MID), fx.SECTION_MAP)
    w0 = fx.heads(spark, SF_MID).filter(F.col("head_id") == 0).first().w
    heads = fx.heads(spark, SF_MID).filter(F.col("head_id") < 4).select(
        "head_id", F.lit(w0).cast("array<double>").alias("w"))
    a = ad.adapt_from_vectors(pairs, heads, 15, [0])
    ws = [r.weight for r in a.weights.collect()]
    assert ws and all(abs(w - 0.25) < 1e-12 for w in ws)


def test_adaptation_with_a_hot_group_matches_tensor_formula(spark):
    # a third of the pairs in one group, the rest in 40 small groups
    grp = F.when(F.col("pair_id") % 3 == 0, F.lit("hot")).otherwise(
        F.concat(F.lit("g"), (F.col("pair_id") % 40).cast("string")))
    pairs = fx.vec_pairs(spark, SF_MID).withColumn("grp", grp)
    a = ad.adapt_from_vectors(pairs, fx.heads(spark, SF_MID), 5, [0, 1])
    packed, _ = sc.score_heads_packed(pairs, fx.heads(spark, SF_MID))
    p = sorted(packed.select("pair_id", "grp", "sc", "sr").collect(), key=lambda r: r.pair_id)
    pos = {r.pair_id: i for i, r in enumerate(p)}
    sc_c, sc_r = np.array([r.sc for r in p]), np.array([r.sr for r in p])
    g = np.array([r.grp for r in p], dtype=object)
    sample = a.sample.collect()
    agg = {(r.seed, r.pair_id): (r.agg_chosen, r.agg_rejected) for r in a.agg.collect()}
    for seed in (0, 1):
        idx = {}
        for r in sorted(sample, key=lambda r: r.slot):
            if r.seed == seed:
                idx.setdefault(r.grp, []).append(pos[r.pair_id])
        assert all(len(v) == 5 for v in idx.values()) and len(idx) == len(set(g))
        want_c, want_r = _reference_adaptation(sc_c, sc_r, g, {k: np.array(v) for k, v in idx.items()}, 5)
        np.testing.assert_allclose([agg[(seed, r.pair_id)][0] for r in p], want_c, atol=1e-9)
        np.testing.assert_allclose([agg[(seed, r.pair_id)][1] for r in p], want_r, atol=1e-9)


def test_pca_heads_plus_minus_accuracies_complement(spark):
    from __spark_entry__ import queries
    rows = queries()["h9_pca_heads_subset_accuracy"](spark, SF_MID).collect()
    acc = {(r.head_id, r.subset): (r.accuracy, r.n) for r in rows}
    # head i+k is -head i: a pair won by one is lost by the other unless tied
    for (h, sub), (a, n) in acc.items():
        if h < 8:
            b, n2 = acc[(h + 8, sub)]
            assert n == n2 and a + b <= 1.0 + 1e-9


def test_resolve_paths_prefers_primary_then_rewritten(spark):
    from prefspark.sources import readers as rd
    paths = ["/old/a", "/new/b", "/old/c", "/old/x", None, None, "/old/a", "/older/a"]
    man = spark.createDataFrame(list(enumerate(paths)), "i int, cls_emb string")
    vec = spark.createDataFrame([("/old/a", 1), ("/new/a", 2), ("/new/b", 3), ("/new/c", 4), (None, 5)],
                                "path string, v int")
    got = {r.i: r.v for r in rd.resolve_paths(man, vec, "/old/", "/new/").collect()}
    assert got == dict(enumerate([1, 3, 4, None, None, None, 1, None]))   # every row stays


def test_grid_equals_separate_runs(spark):
    pairs = ad.attach_category(fx.vec_pairs(spark, SF_MID), fx.SECTION_MAP)
    heads = fx.heads(spark, SF_MID)
    grid = ad.adapt_grid(pairs, heads, None, [5, 15], [0.5, 1.0], [0, 1])
    g = {(r.k, r.temperature, r.seed, r.pair_id): (r.agg_chosen, r.agg_rejected) for r in grid.agg.collect()}
    for k in (5, 15):
        for t in (0.5, 1.0):
            one = ad.adapt_from_vectors(pairs, heads, k, [0, 1], temperature=t)
            for r in one.agg.collect():
                np.testing.assert_allclose(g[(k, t, r.seed, r.pair_id)], (r.agg_chosen, r.agg_rejected), atol=1e-12)


def test_multi_k_sampling_matches_brute_force(spark):
    meta = _meta(spark, {"hot": 2000, "mid": 40, "small": 3, "one": 1})
    rows = [(r.pair_id, r.grp) for r in meta.collect()]
    got = ad.sample_per_group_multi(meta, [3, 5, 50], [0, 1]).collect()
    for k in (3, 5, 50):
        want = _brute_sample(rows, k, [0, 1])
        assert {(r.seed, r.grp, r.slot, r.pair_id) for r in got if r.k == k} == want


def test_prompt_len_dropped_count_by_observation(spark):
    from prefspark.functions import tokens as tk
    t = fx.tokens(spark, SF_SMALL).select(
        "doc_id", F.coalesce(tk.find_last("ids", fx.TOKEN_PATTERN), F.lit(tk.NOT_FOUND)).alias("pl"))
    kept, obs = pr.filter_prompt_len_observed(t, "pl", 8)
    n_kept = kept.count()
    _, dropped = pr.filter_prompt_len(t, "pl", 8)
    assert obs.get["dropped"] == dropped.first().dropped
    assert n_kept + obs.get["dropped"] == t.count()


def test_manifest_round_trip_with_awkward_text(spark):
    from prefspark.session import scratch_path
    from prefspark.sources import readers as rd
    from prefspark.sources import writers as wr
    rows = [(0, 'say "hi", then\nleave', "a,b", 'c "d"', "/v/e0.npy", 1),
            (1, "plain", "", "x\n\ny", "/v/e1.npy", 0), (2, "user: hi\n", "  lead", "trail \t", None, 1),
            (3, None, "a\r\nb", " ", "/v/e3.npy", None)]
    df = spark.createDataFrame(rows, "pair_id bigint, prompts string, chosen_responses string, "
                                     "rejected_responses string, cls_emb string, task_ids int")
    path = scratch_path(spark, "manifest-awkward")
    wr.write_manifest(df, path)
    back = sorted((int(r[0]), *r[1:5], r[5] and int(r[5])) for r in rd.read_manifest(spark, path).collect())
    assert back == rows


def test_writers_bound_the_number_of_files(spark):
    import glob

    from prefspark.session import scratch_path
    from prefspark.sources import writers as wr
    df = spark.range(4000).select(F.col("id").alias("pair_id"), (F.col("id") % 3).cast("int").alias("subset"),
                                  F.array(F.lit(1.0)).alias("chosen"), F.array(F.lit(2.0)).alias("rejected")).repartition(16)
    path = scratch_path(spark, "files")
    wr.write_embeddings(df, path, n_buckets=4, files_per_bucket=2)
    folder = path.removeprefix("file:")
    assert 4 <= len(glob.glob(f"{folder}/bucket=*/part-*")) <= 8 and spark.read.parquet(path).count() == 4000
    scores = df.select("pair_id", "subset", F.lit(1.0).alias("s_chosen"), F.lit(2.0).alias("s_rejected"),
                       F.explode(F.sequence(F.lit(0), F.lit(4))).alias("head_id"))
    path = scratch_path(spark, "score-files")
    wr.write_head_scores(scores, path, n_heads=5, files_per_head=2)
    assert 5 <= len(glob.glob(f"{path.removeprefix('file:')}/head_id=*/part-*")) <= 10


def test_materialise_once_wants_the_success_mark(spark):
    import os

    from prefspark.session import scratch_path
    from prefspark.sources import writers as wr
    path = scratch_path(spark, "half")
    spark.range(10).write.parquet(path)
    os.remove(path.removeprefix("file:") + "/_SUCCESS")
    assert wr.materialise_once(spark, path, lambda: spark.range(20)).count() == 20
    assert wr.materialise_once(spark, path, lambda: spark.range(30)).count() == 20


def test_null_turns_null_lengths_and_missing_counts(spark):
    from prefspark.functions import messages as msg
    from prefspark.operators import evaluate as ev
    m = spark.createDataFrame([([("user", None), (None, "x"), ("assistant", "y")],)],
                              "m array<struct<role:string,content:string>>")
    assert m.select(msg.prompt_text("m")).first()[0] == "user: \n: x\n"
    assert m.select(msg.render_chat("m")).first()[0].count("<start_of_turn>") == 3
    kept, dropped = pr.filter_prompt_len(spark.createDataFrame([(1,), (None,), (99,)], "n int"), "n", 10)
    assert kept.count() == 1 and dropped.first().dropped == 2
    acc = spark.createDataFrame([(0, 1, 0.5, 4)], "head_id int, subset int, accuracy double, n bigint")
    with pytest.raises(ValueError):
        ev.section_scores(acc, {1: "s"}, {})


def test_moments_read_the_vectors_once(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 12)) + 1
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "pair_id long, diff array<double>").repartition(5)
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b
    res = hd.fit_pca(df.mapInPandas(count, "pair_id long, diff array<double>"), 3)
    assert seen.value == 500
    lam = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    np.testing.assert_allclose(res.explained_variance, lam[:3], rtol=1e-10)
    np.testing.assert_allclose(res.total_variance, lam.sum(), rtol=1e-10)
