"""Roles, band join, scoring, drift, assignment and the whole linkage."""

import itertools
import random
import re
import warnings
import zipfile
from xml.etree import ElementTree

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from massweave import ColumnMap, StatTestParams, Tolerances, align, infer_column_map
from massweave.functions.arrays import with_correlation
from massweave.operators import assignment, band_join, drift, ingest, scoring
from massweave.operators.roles import has_role, shared_samples
from massweave.plans import linkage

QUICK = StatTestParams(n_permutations=100, n_bootstrap=50)


def feature_table(n=50, mz=(100, 1000), samples=6, seed=42):
    r = np.random.default_rng(seed)
    m, t, w, h = r.uniform(*mz, n), r.uniform(60, 1800, n), r.uniform(0.001, 0.005, n), r.uniform(2, 20, n)
    base = {"mz": m, "mzmin": m - w, "mzmax": m + w, "rt": t, "rtmin": t - h, "rtmax": t + h, "pcgroup": r.integers(1, 20, n)}
    return pd.DataFrame(base | {f"Sample_{k + 1}": r.lognormal(10, 1.5, n) for k in range(samples)})


def perturbed(df, rt_noise=2.0, seed=99):
    r = np.random.default_rng(seed)
    out = df.copy()
    out["mz"] += r.normal(0, 1e-5, len(df))
    out["rt"] += r.normal(0, rt_noise, len(df))
    for c in df.columns:
        if c.startswith("Sample_"):
            out[c] *= r.uniform(0.9, 1.1, len(df))
    return out


@pytest.mark.parametrize(
    "name,role",
    [(" MZ ", "mz"), ("m/z", "mz"), ("Precursor Mz", "mz"), ("exact.mass", "mz"), ("MW", "mz"), ("mz.min", "mz_min"), ("Max MZ", "mz_max"), ("Best Retention Time", "rt"),
     ("RT", "rt"), ("apexrt", "rt"), ("start_rt", "rt_min"), ("End RT", "rt_max"), ("Feature ID", "annotation"), ("msms", "annotation")],
)
def test_names_have_roles(name, role):
    assert has_role(name, role)


def test_names_without_roles():
    assert not any(has_role("retention_time_xyz", r) for r in ("mz", "rt", "annotation"))


def test_roles_are_inferred(spark):
    m = infer_column_map(spark.createDataFrame(feature_table(10)))
    assert (m.mz, m.rt, m.mz_min, m.rt_max) == ("mz", "rt", "mzmin", "rtmax")
    assert m.intensity_cols == [f"Sample_{k}" for k in range(1, 7)] and m.annotation_cols == ["pcgroup"]
    assert len(m.summary().splitlines()) == 8


def test_roles_of_another_export_with_prefix_and_zero_columns(spark):
    rows = [(500.1, 100.0, 1.0, 2.0, 0.0, 7.0, None), (600.1, 200.0, 3.0, 4.0, 0.0, 7.0, None)]
    df = spark.createDataFrame(rows, "`Precursor Mz` double, `Best Retention Time` double, Area_S1 double, Area_S2 double, zero double, other double, empty double")
    assert infer_column_map(df).intensity_cols == ["Area_S1", "Area_S2"]
    plain = infer_column_map(df.drop("Area_S1", "Area_S2"))
    assert plain.intensity_cols == ["other"]
    single = infer_column_map(df.drop("Area_S1", "Area_S2", "other").limit(1))
    assert single.intensity_cols == ["zero"]


def test_roles_that_fail(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "retention_time_xyz double, Sample_1 double")
    with pytest.raises(ValueError, match="m/z column"):
        infer_column_map(df)
    with pytest.raises(ValueError, match="RT column"):
        infer_column_map(df, mz_col="Sample_1")
    with pytest.raises(ValueError, match="not in the DataFrame"):
        infer_column_map(df, mz_col="nothing")
    with pytest.raises(ValueError, match="not found in DataFrame"):
        ColumnMap("mz", "rt", ["a"]).validate_against(df)
    with pytest.warns(UserWarning, match="all fit"):
        two = spark.createDataFrame([(1.0, 2.0, 3.0, 4.0)], "mz double, mass double, rt double, s double")
        assert infer_column_map(two).mz == "mz"


def test_settings_are_checked():
    with pytest.raises(ValueError):
        Tolerances(confidence_weights={"mz": 0.5, "rt": 0.5, "intensity": 0.5})
    with pytest.raises(ValueError):
        Tolerances(corr_method="kendall")
    with pytest.raises(ValueError):
        StatTestParams(fdr_alpha=1.0)
    with pytest.warns(UserWarning):
        StatTestParams(n_permutations=10)


def test_shared_samples_keep_the_first_order():
    assert shared_samples(ColumnMap("m", "r", ["c", "a", "b"]), ColumnMap("m", "r", ["a", "c", "B"])) == ["c", "a"]


@pytest.mark.parametrize("tol", [Tolerances(), Tolerances(mz_ppm=2000, rt_seconds=40), Tolerances(mz_ppm=5, mz_da=0.4, rt_seconds=15), Tolerances(mz_ppm=0, rt_seconds=0), Tolerances(mz_ppm=-1)])
def test_band_join_equals_the_plain_condition(spark, tol):
    r = random.Random(5)
    row = lambda k: (k, r.choice([None, float("nan"), 0.0, -5.0]) if r.random() < 0.1 else round(r.uniform(100, 130), 1), None if r.random() < 0.1 else float(r.randint(0, 300)))
    a, b = [row(k) for k in range(150)], [row(k) for k in range(150)]
    kind = "idx bigint, mz double, rt double"
    frames = [spark.createDataFrame(x, kind).withColumn("mz", ingest.finite(F.col("mz"))) for x in (a, b)]
    got = sorted((x.idx_a, x.idx_b) for x in band_join.candidate_pairs(*frames, tol).collect())
    wide = lambda m: m * tol.mz_ppm / 1e6 if tol.mz_da is None else max(m * tol.mz_ppm / 1e6, tol.mz_da)
    ok = lambda x: x[1] is not None and x[1] > 0 and x[2] is not None
    want = sorted((x[0], y[0]) for x in a for y in b if ok(x) and ok(y) and abs(y[1] - x[1]) <= wide(x[1]) and abs(y[2] - x[2]) <= tol.rt_seconds)
    assert got == want


def test_scores(spark):
    e = spark.range(1)
    one = lambda c: e.select(c.alias("v")).first()["v"]
    assert one(scoring.delta_mz_ppm(F.lit(500.0), F.lit(500.0))) == 0
    assert one(scoring.delta_mz_ppm(F.lit(500.0), F.lit(500.005))) == pytest.approx(10, abs=0.01)
    assert one(scoring.delta_mz_ppm(F.lit(0.0), F.lit(0.0))) is None
    assert one(scoring.gaussian_similarity(F.lit(0.0), 5)) == 1
    assert one(scoring.gaussian_similarity(F.lit(5.0), 5)) == pytest.approx(np.exp(-0.5))
    score = lambda *v: one(scoring.confidence(*[F.lit(x).cast("double") for x in v], Tolerances()))
    assert score(0.0, 0.0, 1.0) == pytest.approx(1)
    assert score(50.0, 120.0, -0.5) < 0.3
    assert 0 <= score(0.5, 1.0, None) <= 1
    assert score(None, 1.0, 0.5) is None


def test_correlation_of_arrays(spark):
    r = random.Random(1)
    rows = []
    for k in range(60):
        rows.append((k, *[[None if r.random() < 0.2 else float(r.choice([1, 2, 2, 3, 5, 8])) for _ in range(7)] for _ in range(2)]))
    rows += [(60, [1.0, 1.0, 1.0], [1.0, 2.0, 3.0]), (61, [], []), (62, [0.1, 0.1, 0.1], [0.3, 0.1, 0.2]), (63, [1.0, 2.0, None], [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "k int, x array<double>, y array<double>")
    for method in ("pearson", "spearman"):
        got = {x.k: x.r for x in with_correlation(df, "x", "y", "r", method).collect()}
        for k, x, y in rows:
            p = pd.DataFrame({"x": x, "y": y}, dtype=float).dropna()
            constant = len(p) < 3 or p.x.nunique() == 1 or p.y.nunique() == 1
            if method == "spearman":
                p = p.rank()
            want = None if constant else p.x.corr(p.y)
            assert got[k] is None if want is None else got[k] == pytest.approx(want, abs=1e-9)


def test_drift_is_the_ridge_solution(spark):
    r = np.random.default_rng(3)
    x = r.uniform(50, 1500, 50)
    y = 3 - 0.004 * x + 2e-6 * x**2 + r.normal(0, 0.5, 50)
    df = spark.createDataFrame(pd.DataFrame({"rt_a": x, "rt_b": x + y}))
    fit = drift.fit_drift(df)
    design = np.c_[x, x**2]
    centred, target = design - design.mean(0), y - y.mean()
    w = np.linalg.solve(centred.T @ centred + np.eye(2), centred.T @ target)
    assert (fit.slope, fit.curve) == (pytest.approx(w[0], rel=1e-6), pytest.approx(w[1], rel=1e-6))
    assert fit.intercept == pytest.approx(y.mean() - design.mean(0) @ w, rel=1e-6)
    line = drift.fit_drift(df, "linear")
    assert [line.slope, line.intercept] == pytest.approx(np.polyfit(x, y, 1), rel=1e-6)
    for n, enough in ((19, False), (20, True)):
        with warnings.catch_warnings(record=True) as seen:
            warnings.simplefilter("always")
            assert (drift.fit_drift(df.limit(n)) is not None) is enough
            assert any("anchors" in str(w.message) for w in seen) is not enough


def heaviest(edges):
    rows = sorted({i for i, _ in edges})

    def best(k, used):
        if k == len(rows):
            return 0.0
        out = best(k + 1, used)
        for (i, j), g in edges.items():
            if i == rows[k] and j not in used:
                out = max(out, g + best(k + 1, used | {j}))
        return out

    return best(0, frozenset())


@pytest.mark.parametrize("seed", range(150))
def test_component_solver_is_optimal(seed):
    r = random.Random(seed)
    edges = {(i, j): r.choice([0, 0.1, 0.45, 0.5, 0.95]) if seed % 2 else r.random() for i in range(r.randint(1, 6)) for j in range(r.randint(1, 6)) if r.random() < 0.6}
    if not edges:
        return
    got = assignment.solve_component([i for i, _ in edges], [j for _, j in edges], list(edges.values()))
    assert len({i for i, _ in got}) == len(got) == len({j for _, j in got})
    assert sum(edges[p] for p in got) == pytest.approx(heaviest(edges))


def test_assignment_over_components(spark):
    r = random.Random(8)
    edges = {}
    for block in range(40):
        for i, j in itertools.product(range(4), range(4)):
            if r.random() < 0.35:
                edges[(block * 10 + i, block * 10 + j)] = round(r.random(), 3)
    # A long path, a star around each side, and the path whose middle is worth more than both ends.
    for k in range(30):
        edges[(1000 + k, 1000 + k)] = 0.5 + k / 100
        edges[(1000 + k, 1001 + k)] = 0.6 - k / 100
    edges |= {(2000, 2000 + k): 0.1 * k for k in range(1, 6)} | {(3000 + k, 3000): 0.1 * k for k in range(1, 6)}
    edges |= {(4000, 4000): 0.45, (4001, 4000): 0.95, (4001, 4001): 0.45, (5000, 5000): 0.0}
    df = spark.createDataFrame([(*k, g) for k, g in edges.items()], "idx_a bigint, idx_b bigint, confidence double")
    got = [(x.idx_a, x.idx_b) for x in assignment.assign(df).collect()]
    assert len({i for i, _ in got}) == len(got) == len({j for _, j in got})
    whole = assignment.solve_component([i for i, _ in edges], [j for _, j in edges], list(edges.values()))
    assert sum(edges[p] for p in got) == pytest.approx(sum(edges[p] for p in whole))
    assert {(4001, 4000), (5000, 5000), (2000, 2005), (3005, 3000)} <= set(got) and (4000, 4000) not in got
    assert assignment.assign(df.limit(0)).count() == 0


def test_identical_tables_match(spark):
    df = spark.createDataFrame(feature_table(30))
    r = align(df, df, require_intensity_corr=False, stat_params=QUICK)
    assert (r.matched.count(), r.unique_a.count(), r.unique_b.count()) == (30, 0, 0)


def test_perturbed_tables_match_and_report(spark, tmp_path):
    a = feature_table(50)
    df_a, df_b = spark.createDataFrame(a), spark.createDataFrame(perturbed(a))
    r = align(df_a, df_b, tol=Tolerances(mz_ppm=15, rt_seconds=20), stat_params=QUICK)
    assert r.diagnostics["n_matched"] >= 40
    assert {"n_features_a", "n_features_b", "n_matched", "n_unique_a", "n_unique_b", "n_candidates_evaluated", "n_fdr_significant"} == set(r.diagnostics)
    assert "Matched" in r.summary() and "Tier 1" in r.triage_summary()
    t = r.triage()
    assert sum(t[f"tier{k}"].count() for k in range(1, 5)) == r.diagnostics["n_matched"] and t["summary"].count() == 4
    assert r.significant_matches(2.0).count() == r.diagnostics["n_matched"]
    assert r.matched.columns[:2] == ["mz_A", "mzmin_A"] and r.matched.columns[-1] == "_stat_notes"
    r.to_excel(str(tmp_path / "o.xlsx"))
    with zipfile.ZipFile(tmp_path / "o.xlsx") as z:
        ns = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        assert [s.get("name") for s in book.iter(f"{ns}sheet")] == ["matched", "unique_A", "unique_B"]
        sheet = ElementTree.fromstring(z.read("xl/worksheets/sheet1.xml"))
        rows = list(sheet.iter(f"{ns}row"))
        assert len(rows) == r.diagnostics["n_matched"] + 1
        assert [c.find(f"{ns}is/{ns}t").text for c in rows[0]] == r.matched.columns
    r.to_excel_tiered(str(tmp_path / "t.xlsx"))
    with zipfile.ZipFile(tmp_path / "t.xlsx") as z:
        assert len([n for n in z.namelist() if "worksheets/" in n]) == 7
    r.write(str(tmp_path / "out"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "out/matched")).count() == r.diagnostics["n_matched"]
    assert 0 < r.recovery()["matched_a"] <= 100


def test_disjoint_tables_stay_apart(spark):
    r = align(spark.createDataFrame(feature_table(10, (100, 200), seed=1)), spark.createDataFrame(feature_table(10, (800, 900), seed=2)))
    assert (r.matched.count(), r.unique_a.count(), r.unique_b.count()) == (0, 10, 10)
    assert r.triage()["summary"].count() == 4 and r.significant_matches().count() == 0 and re.search(r"Matched pairs +: 0\n", r.summary())


def test_wider_windows_match_no_fewer(spark):
    a = feature_table(20)
    df_a, df_b = spark.createDataFrame(a), spark.createDataFrame(perturbed(a, 50))
    none = StatTestParams(run_stats=False)
    tight = align(df_a, df_b, tol=Tolerances(rt_seconds=5), stat_params=none, rt_drift_correction=False)
    loose = align(df_a, df_b, tol=Tolerances(rt_seconds=120), stat_params=none, rt_drift_correction=False)
    assert loose.diagnostics["n_matched"] >= tight.diagnostics["n_matched"]
    assert loose.triage()["tier4"].count() == loose.diagnostics["n_matched"]


def test_two_samples_are_too_few_to_test(spark):
    a = feature_table(20, samples=2)
    r = align(spark.createDataFrame(a), spark.createDataFrame(perturbed(a)), require_intensity_corr=False)
    assert r.diagnostics["n_matched"] > 0
    assert {x._stat_notes for x in r.matched.collect()} == {"no_shared_samples"}


def test_odd_column_names_ids_and_labels(spark):
    a = feature_table(25).rename(columns={"Sample_1": "S.1", "Sample_2": "s.1", "Sample_3": "a`b", "mz": "m/z"})
    a["key"] = range(100, 125)
    df = spark.createDataFrame(a)
    keys = {"intensity_cols_a": ["S.1", "s.1", "a`b"], "intensity_cols_b": ["S.1", "s.1", "a`b"]}
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        r = align(df, df, stat_params=QUICK, id_col_a="key", id_col_b="key", keep_original_rt=True, **keys)
        rows = r.matched.collect()
    finally:
        spark.conf.unset("spark.sql.caseSensitive")
    assert len(rows) == 25 and all(x["key_A"] == x["key_B"] for x in rows) and "rt_uncorrected_A" in rows[0].asDict()
    with pytest.raises(ValueError, match="labels"):
        align(df, df, label_a="X", label_b="X", **keys)


def test_positions_do_not_depend_on_partitions(spark):
    df = spark.range(37).repartition(5)
    rows = ingest.numbered(df).collect()
    assert sorted(x._idx for x in rows) == list(range(37))


def test_ids_of_any_type_and_of_no_use(spark):
    a = feature_table(25)
    a["key"] = [f"f{k}" for k in range(25)]
    df = spark.createDataFrame(a)
    r = align(df, df, stat_params=QUICK, id_col_a="key", id_col_b="key")
    rows = r.matched.collect()
    assert len(rows) == 25 and all(x["key_A"] == x["key_B"] for x in rows)
    assert sorted(x._idx for x in ingest.numbered(df, "key").collect()) == list(range(25))
    for bad in ([(1,), (1,)], [(1,), (None,)]):
        with pytest.raises(ValueError, match="not unique"):
            ingest.numbered(spark.createDataFrame(bad, "id bigint"), "id")


def test_pandas_frames_are_taken(spark):
    a = feature_table(25)
    a["adduct"], a["note"] = None, [None] * 24 + ["x"]
    r = align(a, perturbed(a).set_index("pcgroup", drop=False), tol=Tolerances(mz_ppm=15), stat_params=QUICK)
    plain = align(spark.createDataFrame(feature_table(25)), spark.createDataFrame(perturbed(feature_table(25))), tol=Tolerances(mz_ppm=15), stat_params=QUICK)
    assert r.diagnostics == plain.diagnostics and r.diagnostics["n_matched"] >= 20
    assert "adduct_A" in r.matched.columns and r.matched.where("adduct_A IS NOT NULL").isEmpty()
    assert ingest.as_frame(a.iloc[:0]).count() == 0


def test_a_huge_mass_does_not_widen_the_cells_of_others(spark):
    row = lambda k, mz: (k, mz, 10.0)
    frame = spark.createDataFrame([row(k, 100.0 + 3 * k) for k in range(50)] + [row(99, 1e9)], "idx bigint, mz double, rt double")
    tol = Tolerances(mz_ppm=5, mz_da=0.4)
    pairs = band_join.candidate_pairs(frame, frame, tol)
    assert sorted((x.idx_a, x.idx_b) for x in pairs.collect()) == [(k, k) for k in [*range(50), 99]]
    cells = frame.select(F.floor(band_join._mz_place(F.col("mz"), tol)).alias("c")).distinct().count()
    assert cells == 51


def test_contested_groups_equal_brute_force(spark, tmp_path):
    r = random.Random(4)
    # Groups of parts at one position with alike profiles contest each other; the last part of each hundred stands alone.
    keys = [100 * g + k for g in range(1, 9) for k in (*range(2, 6), 50)]
    part = [(k, 500.0 + k // 100 if k % 100 < 50 else 700.0 + k // 100, 5 + k // 100) for k in keys]
    line = [(k, s, (s + 1) * 1000.0 * r.uniform(0.8, 1.2)) for k in keys for s in range(6)]
    spark.createDataFrame(part, "p_partkey bigint, p_retailprice double, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame(line, "l_partkey bigint, l_suppkey bigint, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    edges = {(e.idx_a, e.idx_b): e.confidence for e in linkage._edges(spark, str(tmp_path)).collect()}
    groups = [{p: c for p, c in edges.items() if p[0] // 100 == g} for g in range(1, 9)]
    assert max(len(g) for g in groups) > 8
    r = linkage._linked(spark, str(tmp_path), linkage.PLAIN, QUICK)
    matched = [(m.id_A, m.id_B) for m in r.matched.collect()]
    assert len({a for a, _ in matched}) == len(matched) == len({b for _, b in matched}) == r.diagnostics["n_matched"]
    assert sum(edges[p] for p in matched) == pytest.approx(sum(heaviest(g) for g in groups))
    for side, rest in enumerate((r.unique_a, r.unique_b)):
        have = {t.id for t in linkage.feature_tables(spark, str(tmp_path))[side].collect()}
        assert {x.id for x in rest.collect()} == have - {p[side] for p in matched}
