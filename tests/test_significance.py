"""Significance tests and evidence tiers."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Row

from massweave import StatTestParams
from massweave.operators import results, significance as S


def plain_corr(x, y, method):
    if method == "spearman":
        x, y = pd.Series(x).rank().to_numpy(), pd.Series(y).rank().to_numpy()
    if np.ptp(x) == 0 or np.ptp(y) == 0:
        return np.nan
    return float(np.clip(np.corrcoef(x, y)[0, 1], -1, 1))


@pytest.mark.parametrize("method", ["pearson", "spearman"])
def test_resampling_equals_plain_loops(method):
    r = np.random.default_rng(4)
    a = r.lognormal(3, 1, (40, 7)).round(1)
    b = a * r.uniform(0.5, 1.5, a.shape)
    b[3], a[5] = 2.0, 1.0
    valid = np.ones(40, bool)
    valid[7] = False
    shuffles, resamples = S.index_matrices(7, StatTestParams(n_permutations=120, n_bootstrap=60))
    p = S.permutation_pvalues(a, b, valid, shuffles, method, 1e-12)
    low, high = S.bootstrap_interval(a, b, valid, resamples, method)
    for k in range(40):
        if not valid[k]:
            assert np.isnan([p[k], low[k], high[k]]).all()
            continue
        seen = plain_corr(a[k], b[k], method)
        null = np.array([plain_corr(a[k], b[k][s], method) for s in shuffles])
        assert p[k] == pytest.approx(max((null >= seen - 1e-9).sum(), 1) / len(shuffles), abs=2 / len(shuffles))
        boot = np.array([plain_corr(a[k][s], b[k][s], method) for s in resamples])
        if np.isfinite(boot).any():
            assert [low[k], high[k]] == pytest.approx(np.nanpercentile(boot, [2.5, 97.5]), abs=1e-9)
        else:
            assert np.isnan(low[k])
    # A constant row gets the smallest p-value.
    assert p[3] == p[5] == 1 / len(shuffles)


def test_indices_follow_one_generator():
    rng = np.random.default_rng(42)
    shuffles, resamples = S.index_matrices(5, StatTestParams(n_permutations=100, n_bootstrap=3))
    assert (shuffles == [rng.permutation(5) for _ in range(100)]).all()
    assert (resamples == [rng.integers(0, 5, size=5) for _ in range(3)]).all()


def test_q_values_equal_the_definition(spark):
    r = np.random.default_rng(1)
    p = [float(x) if r.random() > 0.1 else None for x in r.integers(1, 40, 200) / 40] + [float("nan"), None]
    got = {x.k: x.q for x in S.bh_qvalues(spark.createDataFrame(list(enumerate(p)), "k int, p double"), "p", "q").collect()}
    known = sorted((v, k) for k, v in enumerate(p) if v is not None and not np.isnan(v))
    q, least = {}, 1.0
    for rank in range(len(known), 0, -1):
        v, k = known[rank - 1]
        least = min(least, v * len(known) / rank)
        q[k] = least
    assert len(got) == len(p)
    for k in range(len(p)):
        assert got[k] is None if k not in q else got[k] == pytest.approx(q[k])


def test_specificity_looks_at_other_candidates_of_both_rows(spark):
    edges = {(1, 1): 0.9, (1, 2): 0.7, (2, 1): 0.8, (3, 3): 0.6, (4, 4): 0.5, (4, 5): 0.9, (6, 6): 0.4, (6, 7): 0.4}
    df = spark.createDataFrame([(*k, v) for k, v in edges.items()], "idx_a bigint, idx_b bigint, confidence double")
    chosen = df.where("idx_a = idx_b")
    got = {x.idx_a: x._specificity for x in S.specificity(chosen, df).collect()}
    assert got == {1: pytest.approx(0.1), 3: pytest.approx(0.6), 4: 0.0, 6: 0.0}


@pytest.mark.parametrize("hi,raw", [(1e4, True), (9999.0, False)])
def test_raw_data_are_told_by_their_range(spark, hi, raw):
    df = spark.createDataFrame([([1.0, None], [hi])], "x_a array<double>, x_b array<double>")
    assert S.is_raw(df) is raw
    assert S.is_raw(df.limit(0)) is False


def test_matrices_are_completed_after_the_logarithm(spark):
    rows = [([1.0, None, 3.0, 7.0], [1.0, 2.0, None, 4.0]), ([None] * 4, [1.0] * 4)]
    got = S.matrices(spark.createDataFrame(rows, "x_a array<double>, x_b array<double>"), True).collect()
    la = np.log1p([1, 3, 7])
    assert got[0].x_a == pytest.approx([la[0], la.mean(), la[1], la[2]]) and got[0].valid is False
    assert got[1].x_a == [0.0] * 4 and got[1].valid is False


def evidence(**kw):
    base = dict(_perm_qvalue=0.01, _fdr_significant=True, _specificity=0.8, _corr_ci_low=0.5, _corr_ci_high=0.8, _ci_width=0.3, _intensity_corr=0.9, _confidence=0.9, _delta_mz_ppm=1.0, _delta_rt=-2.0, _stat_notes="")
    return base | kw


def test_tiers(spark):
    cases = [
        (evidence(), 1), (evidence(_specificity=0.5), 1), (evidence(_specificity=0.49), 3), (evidence(_ci_width=0.4), 2), (evidence(_ci_width=0.4, _specificity=0.0), 2),
        (evidence(_ci_width=0.9, _corr_ci_low=-0.1), 3), (evidence(_ci_width=2.0), 2), (evidence(_ci_width=2.0, _specificity=0.1), 3), (evidence(_ci_width=None, _corr_ci_low=None), 3),
        (evidence(_fdr_significant=False), 4), (evidence(_fdr_significant=False, _perm_qvalue=None), 4),
    ]
    schema = "_perm_qvalue double, _fdr_significant boolean, _specificity double, _corr_ci_low double, _corr_ci_high double, _ci_width double, _intensity_corr double, _confidence double, _delta_mz_ppm double, _delta_rt double, _stat_notes string"
    df = spark.createDataFrame([Row(**c) for c, _ in cases], schema)
    got = [x.tier for x in df.withColumn("tier", results.tier_of()).collect()]
    assert got == [t for _, t in cases]
    rows = results.tier_summary(df).collect()
    assert [r.n for r in rows] == [got.count(k) for k in (1, 2, 3, 4)] and rows[0].pct == round(100 * 2 / 11, 1)
    empty = results.tier_summary(df.limit(0)).collect()
    assert [(r.n, r.pct, r.median_r) for r in empty] == [(0, 0.0, None)] * 4
    with pytest.raises(ValueError, match="not found"):
        results.MatchResult(df.drop("_ci_width"), df, df).triage()


def test_many_pvalues_are_ranked_in_ranges(spark):
    r = np.random.default_rng(11)
    p = [None if r.random() < 0.1 else float(v) for v in np.round(r.beta(0.3, 2, 3000), 4)]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(p)], "k int, p double")
    few, many = (sorted((x.k, x.q) for x in S.bh_qvalues(df, "p", "q", most).collect()) for most in (100_000, 50))
    assert [k for k, _ in few] == [k for k, _ in many]
    assert all((a is None and b is None) or a == pytest.approx(b, abs=1e-15) for (_, a), (_, b) in zip(few, many))
    known = np.sort([v for v in p if v is not None])
    rank = {v: k + 1 for k, v in enumerate(known)}
    want = {v: min(1.0, min(w * len(known) / rank[w] for w in rank if w >= v)) for v in list(rank)[::97]}
    got = {p[k]: q for k, q in many if q is not None}
    assert all(got[v] == pytest.approx(q, abs=1e-12) for v, q in want.items())
