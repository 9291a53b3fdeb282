"""Centred moments, wide PCA, tiled scoring and unusable vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from prefspark.operators import heads as hd
from prefspark.operators import scoring as sc


def frame(spark, x, parts=5):
    rows = [(i, r.tolist()) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "pair_id long, diff array<double>").repartition(parts)


@pytest.mark.parametrize("offset", [0.0, 1e5, 1e6])
def test_moments_with_a_common_offset(spark, offset):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(700, 9)) * 0.01 + offset
    want = np.cov((x - x.mean(axis=0)).T)
    df = frame(spark, x)
    got = {(r.i, r.j): r.cov for r in hd.covariance(df).collect()}
    scale = want.diagonal().max()
    for (i, j), c in got.items():
        assert abs(c - want[i, j]) <= 1e-9 * scale
    assert hd.total_variance(df).first()[0] == pytest.approx(np.trace(want), rel=1e-9)
    res = hd.fit_pca(df, 4)
    lam = np.sort(np.linalg.eigvalsh(want))[::-1]
    np.testing.assert_allclose(res.explained_variance, lam[:4], rtol=1e-8)
    np.testing.assert_allclose(res.mean, x.mean(axis=0), rtol=1e-14)
    proj = np.array([r.proj for r in hd.project(df, res).orderBy("pair_id").collect()])
    np.testing.assert_allclose(proj, (x - res.mean) @ res.components.T, atol=1e-12)
    again = np.array([r.proj for r in hd.project(df, res, method="arrow").orderBy("pair_id").collect()])
    np.testing.assert_allclose(again, proj, atol=1e-12)


def test_moments_do_not_depend_on_the_partitions(spark):
    x = np.random.default_rng(2).normal(size=(300, 5)) + 1e4
    covs = [np.array([r.cov for r in hd.covariance(frame(spark, x, n)).orderBy("i", "j").collect()]) for n in (1, 7)]
    np.testing.assert_allclose(covs[0], covs[1], rtol=1e-9, atol=1e-12)


@pytest.mark.parametrize("kind", ["decaying", "flat", "thin", "offset"])
def test_krylov_pca_equals_eigh(spark, kind):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 150))
    if kind != "flat":
        x = x * (1.05 ** -np.arange(150))
    if kind == "thin":
        x = x[:20]
    if kind == "offset":
        x = x * 0.01 + 1e5
    k = 8
    res = hd.fit_pca(frame(spark, x), k, method="krylov")
    xc = x - x.mean(axis=0)
    lam, vec = np.linalg.eigh(xc.T @ xc / (len(x) - 1))
    lam, vec = lam[::-1][:k], vec[:, ::-1][:, :k].T
    np.testing.assert_allclose(res.explained_variance, lam, rtol=1e-7)
    np.testing.assert_allclose(res.components, hd.fix_signs(vec), atol=1e-6)
    assert res.total_variance == pytest.approx(np.trace(xc.T @ xc) / (len(x) - 1), rel=1e-8)


def test_krylov_pca_of_few_and_equal_vectors(spark):
    res = hd.fit_pca(frame(spark, np.ones((4, 6)), 2), 3, method="krylov")
    assert res.total_variance == 0 and (res.explained_variance == 0).all() and res.components.shape == (3, 6)
    np.testing.assert_allclose(res.components @ res.components.T, np.eye(3), atol=1e-9)
    with pytest.raises(ValueError):
        hd.fit_pca(frame(spark, np.ones((4, 6))), 7, method="krylov")
    with pytest.raises(ValueError):
        hd.fit_pca(frame(spark, np.ones((4, 6))).limit(0), 2, method="krylov")


def test_qr_tree_of_many_parts(spark):
    x = np.random.default_rng(5).normal(size=(400, 12))
    basis = np.linalg.qr(np.random.default_rng(6).normal(size=(12, 5)))[0]
    r, total = hd.tall_qr(frame(spark, x, 40), "diff", x.mean(axis=0), basis, fan=3)
    y = (x - x.mean(axis=0)) @ basis
    np.testing.assert_allclose(r.T @ r, y.T @ y, rtol=1e-10, atol=1e-10)
    assert total == pytest.approx(((x - x.mean(axis=0))**2).sum())


PAIRS = "pair_id long, chosen array<double>, rejected array<double>"
UNUSABLE = [(1, [1.0, 2.0, 3.0, 4.0], [0.0, 1.0, 0.0, 1.0]), (2, [1.0, 2.0, 3.0], [4.0, 5.0, 6.0, 7.0, 8.0]),
            (3, None, [1.0, 1.0, 1.0, 1.0]), (4, [1.0, None, 3.0, 4.0], [2.0, 2.0, 2.0, 2.0]), (5, [], [1.0, 0.0, 0.0, 0.0])]
HEADS = "head_id long, w array<double>"


def test_ragged_and_null_vectors_score_null(spark):
    """Lengths 3 and 5 add up to two vectors of 4; none of them may be scored."""
    pairs = spark.createDataFrame(UNUSABLE, PAIRS).coalesce(1)
    heads = spark.createDataFrame([(0, [1.0, 0.0, 0.0, 0.0]), (1, [0.0, 0.0, 0.0, 2.0])], HEADS)
    want = {1: ([1.0, 8.0], [0.0, 2.0]), 2: (None, None), 3: (None, [1.0, 2.0]), 4: (None, [2.0, 4.0]), 5: (None, [1.0, 0.0])}
    packed, ids = sc.score_heads_packed(pairs, heads)
    assert {r.pair_id: (r.sc, r.sr) for r in packed.collect()} == want
    long = {(r.pair_id, r.head_id): (r.s_chosen, r.s_rejected) for r in sc.score_heads(pairs, heads, keep=["pair_id"]).collect()}
    assert long == {(p, h): tuple(s and s[h] for s in sides) for p, sides in want.items() for h in (0, 1)}
    tiled = sc.score_heads_tiled(pairs, heads, head_rows=1, pair_rows=2).collect()
    assert {(r.pair_id, r.head_ids[0]): (r.sc and r.sc[0], r.sr and r.sr[0]) for r in tiled} == long
    with pytest.raises(Exception, match="of one length|numbers"):
        hd.covariance(pairs.select("pair_id", F.col("rejected").alias("diff"))).collect()
    whole = pairs.where("pair_id <> 2").select("pair_id", F.col("rejected").alias("diff"))
    nulls = whole.unionByName(pairs.where("pair_id in (3, 4)").select("pair_id", F.col("chosen").alias("diff")))
    assert sorted(hd.covariance(nulls).collect()) == sorted(hd.covariance(whole).collect())


def test_tiled_scores_equal_packed_scores(spark, monkeypatch):
    rng = np.random.default_rng(7)
    pairs = spark.createDataFrame([(i % 50, rng.normal(size=6).tolist(), rng.normal(size=6).tolist()) for i in range(60)], PAIRS)
    heads = spark.createDataFrame([(int(h), rng.normal(size=6).tolist()) for h in rng.permutation(1000)[:37]], HEADS)
    packed, ids = sc.score_heads_packed(pairs, heads)
    want = sorted((r.pair_id, h, round(a, 9), round(b, 9)) for r in packed.collect() for h, a, b in zip(ids, r.sc, r.sr))
    monkeypatch.setattr(sc, "collect_heads", None)  # never called
    got = sc.score_heads_tiled(pairs, heads, head_rows=5, pair_rows=9).collect()
    assert len({r.block for r in got}) == 8 and all(r.head_ids == sorted(r.head_ids) for r in got)
    assert sorted((r.pair_id, h, round(a, 9), round(b, 9)) for r in got for h, a, b in zip(r.head_ids, r.sc, r.sr)) == want
    assert sc.score_heads_tiled(pairs.limit(0), heads).count() == 0
    assert sc.score_heads_tiled(pairs, heads.limit(0)).count() == 0
