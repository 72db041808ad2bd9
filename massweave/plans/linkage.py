"""Queries of the linkage's own operators, on pairs of feature tables made from the star schema.

One row for each part: m/z is its price, RT twenty times its size, six samples are revenues by
supplier residue.  The second table is a perturbed copy, and each side lacks another tenth of
the rows.  Three variants:

=========  ==============================================================================
plain      as described: parts of one price compete, never one side's rows alone
raw        some values of the last sample are tiny, so the tests take logarithms
crowded    m/z repeats every 89 parts and a lower correlation is enough, so stars and
           contested groups are common; with bounds of RT
=========  ==============================================================================
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from massweave.config import StatTestParams, Tolerances
from massweave.functions.arrays import log1p_if, row_mean_imputed, with_correlation
from massweave.operators import assignment, band_join, drift, ingest, results, roles, scoring, significance
from massweave.plans import linkage_sql
from massweave.plans.align import align
from massweave.plans.linkage_sql import CROWDED, PLAIN, RAW, RESAMPLES, SAMPLES, SHUFFLES, TWO_SAMPLES, Case
from massweave.plans.runtime import cut_lineage, query, shared_folder, table
from massweave.sources.readers import read_delimited

TOL = Tolerances()
NO_TESTS = StatTestParams(run_stats=False)
SPEARMAN = StatTestParams(corr_method="spearman", n_permutations=200, n_bootstrap=100)


def feature_tables(spark: SparkSession, directory: str, case: Case = PLAIN) -> tuple[DataFrame, DataFrame]:
    """Both tables: ``id, mz, rt, s0 ... s5``, in the crowded case with ``rtmin`` and ``rtmax``."""
    residue = F.col("l_suppkey") % 6
    sums = table(spark, directory, "lineitem").groupBy(F.col("l_partkey").alias("id"), residue.alias("s")).agg(F.round(F.sum("l_extendedprice"), 2).alias("v"))
    wide = sums.groupBy("id").agg(*[F.max(F.when(F.col("s") == k, F.col("v"))).alias(f"s{k}") for k in range(6)])
    part = table(spark, directory, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("mz"), (F.col("p_size").cast("double") * 20).alias("rt"))
    x = part.join(wide, "id")
    n = F.col("id")
    cast = lambda c: c.cast("double")
    if case.kind == "crowded":
        x = x.withColumn("mz", 200 + cast(n * 37 % 89) * 0.5 + cast(F.floor(n / 2000)) * 50)
    if case.kind == "raw":
        x = x.withColumn("s5", F.when(n % 50 == 5, F.col("s5") * 1e-5).otherwise(F.col("s5")))
    b = x.where(n % 10 != 0).select(
        "id",
        (F.col("mz") * (1 + cast(n % 7 - 3) * F.lit(1e-6))).alias("mz"),
        (F.col("rt") + cast(n % 5 - 2) * 3).alias("rt"),
        *[(F.col(f"s{k}") * (1 + cast((n * 31 + k) % 11 - 5) / 100)).alias(f"s{k}") for k in range(6)],
    )
    out = (x.where(n % 10 != 1), b)
    if case.kind != "crowded":
        return out
    return tuple(t.withColumn("rtmin", F.col("rt") - cast(4 + n % 3)).withColumn("rtmax", F.col("rt") + cast(5 + n % 4)) for t in out)


def _map(case: Case) -> roles.ColumnMap:
    bounds = {"rt_min": "rtmin", "rt_max": "rtmax"} if case.kind == "crowded" else {}
    return roles.ColumnMap("mz", "rt", SAMPLES[: case.samples], **bounds)


def _slim(spark: SparkSession, directory: str, case: Case = PLAIN) -> tuple[DataFrame, DataFrame]:
    return tuple(ingest.slim(ingest.numbered(t, "id"), _map(case), SAMPLES[: case.samples]) for t in feature_tables(spark, directory, case))


def _pairs(spark: SparkSession, directory: str, tol: Tolerances = TOL, case: Case = PLAIN) -> DataFrame:
    a, b = _slim(spark, directory, case)
    return band_join.candidate_pairs(a, b, tol, ("x",), ("x",))


def _edges(spark: SparkSession, directory: str, case: Case = PLAIN) -> DataFrame:
    """Filtered pairs, written once as the whole plan does: several steps read them."""
    return cut_lineage(scoring.correlation_filter(scoring.scored(_pairs(spark, directory, case.tol, case), case.tol), case.tol, case.samples))


def _chosen(spark: SparkSession, directory: str, case: Case = PLAIN) -> tuple[DataFrame, DataFrame]:
    """Pairs of the optimal assignment, with all metrics, and all edges."""
    edges = _edges(spark, directory, case)
    return cut_lineage(edges.join(assignment.assign(edges), ["idx_a", "idx_b"])), edges


def _linked(spark: SparkSession, directory: str, case: Case, params: StatTestParams | None = None, **options) -> results.MatchResult:
    """The whole linkage of a case."""
    a, b = feature_tables(spark, directory, case)
    return align(a, b, map_a=_map(case), map_b=_map(case), tol=case.tol, rt_drift_correction=case.drift, stat_params=params, id_col_a="id", id_col_b="id", **options)


def _six(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if c in names else F.col(c) for c in df.columns])


@query
def feature_table_a(spark, directory):
    return feature_tables(spark, directory)[0]


@query
def feature_table_b(spark, directory):
    b = feature_tables(spark, directory)[1]
    return _six(b, *SAMPLES).withColumn("mz", F.round("mz", 9))


@query
def role_stats(spark, directory):
    a = feature_tables(spark, directory)[0]
    return roles.column_stats(a, ["mz", "rt", *SAMPLES])


@query
def mz_tolerance(spark, directory):
    a = feature_tables(spark, directory)[0]
    of = lambda tol: F.round(band_join.mz_tolerance(F.col("mz"), tol), 9)
    return a.select("id", of(TOL).alias("tol_ppm"), of(Tolerances(mz_da=0.0095)).alias("tol_wider"))


@query
def candidate_pairs(spark, directory):
    return _pairs(spark, directory).select("idx_a", "idx_b")


@query
def candidate_pairs_mz_da(spark, directory):
    return _pairs(spark, directory, Tolerances(mz_ppm=5, mz_da=0.15, rt_seconds=10)).select("idx_a", "idx_b")


@query
def delta_ppm(spark, directory):
    return _pairs(spark, directory).select("idx_a", "idx_b", F.round(scoring.delta_mz_ppm(F.col("mz_a"), F.col("mz_b")), 6).alias("ppm"), (F.col("rt_b") - F.col("rt_a")).alias("delta_rt"))


@query
def gaussian_similarity(spark, directory):
    sim = scoring.gaussian_similarity(F.col("rt_b") - F.col("rt_a"), 15.0)
    return _pairs(spark, directory).select("idx_a", "idx_b", F.round(sim, 6).alias("similarity"))


def _pair_corr(spark, directory, method):
    return _six(with_correlation(_pairs(spark, directory), "x_a", "x_b", "r", method).select("idx_a", "idx_b", "r"), "r")


@query
def pair_corr_pearson(spark, directory):
    return _pair_corr(spark, directory, "pearson")


@query
def pair_corr_spearman(spark, directory):
    return _pair_corr(spark, directory, "spearman")


@query
def embedding_corr(spark, directory):
    """Correlation of every embedding with the next one by id."""
    e = table(spark, directory, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("x"))
    pairs = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y")), "vec_id")
    return _six(with_correlation(pairs, "x", "y", "r").select("vec_id", "r"), "r")


@query
def confidence_score(spark, directory):
    return _six(scoring.scored(_pairs(spark, directory), TOL), "delta_mz_ppm", "intensity_corr", "confidence")


@query
def confidence_null_corr(spark, directory):
    p = _pairs(spark, directory).withColumn("x_a", F.slice("x_a", 1, 2)).withColumn("x_b", F.slice("x_b", 1, 2))
    return _six(scoring.scored(p, TOL), "delta_mz_ppm", "confidence").select("idx_a", "idx_b", "delta_mz_ppm", "confidence")


@query
def corr_filter(spark, directory):
    return _edges(spark, directory).select("idx_a", "idx_b")


def _fitted(spark, directory, model):
    fit = drift.fit_drift(_pairs(spark, directory), model)
    return spark.createDataFrame([(round(fit.intercept, 5), round(fit.slope, 7), round(fit.curve, 9))], "intercept double, slope double, curve double")


@query
def drift_linear(spark, directory):
    return _fitted(spark, directory, "linear")


@query
def drift_ridge2(spark, directory):
    return _fitted(spark, directory, "ridge2")


@query
def drift_rejoin(spark, directory):
    a, b = _slim(spark, directory)
    fit = drift.fit_drift(band_join.candidate_pairs(a, b, TOL))
    moved = a.withColumn("rt", fit.corrected(F.col("rt")))
    return _six(band_join.candidate_pairs(moved, b, TOL).select("idx_a", "idx_b", "rt_a"), "rt_a")


@query
def drift_bounds(spark, directory):
    """Retention times and bounds of the first table as the linkage returns them, of unmatched rows too."""
    r = _linked(spark, directory, Case("crowded", CROWDED.tol, drift=True), NO_TESTS)
    names = ["id", "rt", "rtmin", "rtmax"]
    rows = r.matched.select(*[F.col(f"{c}_A").alias(c) for c in names]).unionByName(r.unique_a.select(*names))
    return _six(rows, *names[1:])


@query
def isolated_matches(spark, directory):
    return assignment.isolated(assignment.with_degrees(_edges(spark, directory, CROWDED))).select("idx_a", "idx_b")


@query
def star_matches(spark, directory):
    return assignment.best_of_stars(assignment.with_degrees(_edges(spark, directory, CROWDED))).select("idx_a", "idx_b")


@query
def contested_pairs(spark, directory):
    return assignment.contested(assignment.with_degrees(_edges(spark, directory, CROWDED))).select("idx_a", "idx_b")


@query
def component_labels(spark, directory):
    """The connected component of every contested pair."""
    hard = assignment.contested(assignment.with_degrees(_edges(spark, directory, CROWDED)))
    return assignment.components(hard).select("idx_a", "idx_b", "component")


@query
def bipartite_matches(spark, directory):
    return assignment.assign(_edges(spark, directory))


@query
def bipartite_crowded(spark, directory):
    return assignment.assign(_edges(spark, directory, CROWDED))


@query
def specificity(spark, directory):
    chosen, edges = _chosen(spark, directory, CROWDED)
    return _six(significance.specificity(chosen, edges).select("idx_a", "idx_b", "_specificity"), "_specificity")


@query
def log_detect(spark, directory):
    """Whether the values of all candidate pairs look untransformed, plain and raw."""
    rows = []
    for case in (PLAIN, RAW):
        n, span, raw = significance.intensity_span(_pairs(spark, directory, TOL, case))
        rows.append((case.kind, n, None if span is None else round(span, 6), raw))
    return spark.createDataFrame(rows, "kind string, n bigint, span double, raw boolean")


@query
def impute_matrix(spark, directory):
    a, _ = _slim(spark, directory)
    filled = row_mean_imputed(log1p_if(F.col("x"), True))
    return a.select("idx", F.posexplode(filled).alias("k", "v")).select("idx", "k", F.round("v", 6).alias("v"))


def _small_tests(spark, directory, case: Case, method: str = "pearson") -> DataFrame:
    """Both tests with few fixed shuffles and resamples, over the whole assignment."""
    chosen, _ = _chosen(spark, directory, case)
    p = _pairs(spark, directory, case.tol, case).join(chosen.select("idx_a", "idx_b"), ["idx_a", "idx_b"])
    positions = (np.array(SHUFFLES), np.array(RESAMPLES))
    return significance.resampling_tests(significance.matrices(p, False), case.samples, StatTestParams(corr_method=method), positions)


@query
def perm_pvalue_small(spark, directory):
    return _six(_small_tests(spark, directory, PLAIN).select("idx_a", "idx_b", "_perm_pvalue"), "_perm_pvalue")


@query
def bootstrap_ci_small(spark, directory):
    return _six(_small_tests(spark, directory, PLAIN).select("idx_a", "idx_b", "_corr_ci_low", "_corr_ci_high"), "_corr_ci_low", "_corr_ci_high")


@query
def spearman_tests_small(spark, directory):
    tests = _small_tests(spark, directory, CROWDED, "spearman").select("idx_a", "idx_b", "_perm_pvalue", "_corr_ci_low", "_corr_ci_high")
    return _six(tests, "_perm_pvalue", "_corr_ci_low", "_corr_ci_high")


@query
def bh_fdr(spark, directory):
    p = table(spark, directory, "part").select("p_partkey", F.when(F.col("p_partkey") % 13 != 0, (F.col("p_partkey") * 7919 % 97 + 1) / 100).alias("p"))
    return _six(significance.bh_qvalues(p, "p", "q"), "q")


def _evidence(spark, directory) -> DataFrame:
    """Columns of evidence from arithmetic on part keys, with unknown and extreme values."""
    k = F.col("p_partkey")
    low = (k * 31 % 200 - 60) / 100
    width = F.when(k % 11 == 0, F.lit(None)).when(k % 17 == 0, 2.0).otherwise(k * 17 % 90 / 100)
    q = F.when(k % 19 != 0, k * 37 % 80 / 1000)
    return table(spark, directory, "part").select(
        "p_partkey",
        F.round(k * 13 % 1000 / 1000, 6).alias("_intensity_corr"),
        F.round(k * 7 % 1000 / 1000, 6).alias("_confidence"),
        F.round(k * 3 % 100 / 10, 6).alias("_delta_mz_ppm"),
        F.round((k * 29 % 600 - 300) / 10, 6).alias("_delta_rt"),
        q.alias("_perm_qvalue"),
        F.coalesce(q < 0.05, F.lit(False)).alias("_fdr_significant"),
        F.round(k * 11 % 100 / 100, 6).alias("_specificity"),
        low.alias("_corr_ci_low"),
        (low + width).alias("_corr_ci_high"),
        width.cast("double").alias("_ci_width"),
        (k % 23 != 0).alias("valid"),
        F.lit(False).alias("constant"),
    )


def _evidence_result(spark, directory) -> results.MatchResult:
    m = _evidence(spark, directory)
    m = m.withColumn("_stat_notes", significance.notes(False, StatTestParams())).drop("valid", "constant")
    return results.MatchResult(m, m.limit(0), m.limit(0), {})


@query
def stat_notes(spark, directory):
    return _evidence_result(spark, directory).matched.select("p_partkey", "_stat_notes")


@query
def triage_tiers(spark, directory):
    return _evidence(spark, directory).select("p_partkey", results.tier_of().alias("tier"))


@query
def triage_summary(spark, directory):
    return results.tier_summary(_evidence(spark, directory))


@query
def significant(spark, directory):
    return _evidence_result(spark, directory).significant_matches(0.03).select("p_partkey")


@query
def suspicious(spark, directory):
    return _evidence_result(spark, directory).suspicious_matches().select("p_partkey")


def _rounded(matched: DataFrame) -> DataFrame:
    """A table of matches with its numbers rounded, so that two engines can be compared."""
    return matched.select(*[F.round(c, 9 if c == "mz_B" else 6).alias(c) if t == "double" else F.col(c) for c, t in matched.dtypes])


@query
def align_matched(spark, directory):
    """The whole linkage with default settings: drift, assignment, 1,000 shuffles, 500 resamples."""
    return _rounded(_linked(spark, directory, Case("plain", TOL, drift=True)).matched)


@query
def align_crowded(spark, directory):
    """The same where rows have many candidates."""
    return _rounded(_linked(spark, directory, Case("crowded", CROWDED.tol, drift=True)).matched)


@query
def align_raw_spearman(spark, directory):
    """Raw intensities, rank correlation in the tests."""
    return _rounded(_linked(spark, directory, RAW, SPEARMAN).matched)


@query
def align_two_samples(spark, directory):
    """Too few shared samples: no filter and no tests but the specificity.

    Without correlations many assignments are equally good, so what they share is reported.
    """
    m = _rounded(_linked(spark, directory, TWO_SAMPLES).matched)
    return m.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("id_A").alias("n_a"),
        F.count_distinct("id_B").alias("n_b"),
        F.round(F.sum("_confidence"), 4).alias("total"),
        (F.count("_perm_pvalue") + F.count("_perm_qvalue") + F.count("_ci_width")).alias("n_tested"),
        F.count("_specificity").alias("n_specificity"),
        F.min("_stat_notes").alias("least_note"),
        F.max("_stat_notes").alias("last_note"),
    )


@query
def matched_wide(spark, directory):
    """Without tests."""
    return _rounded(_linked(spark, directory, CROWDED, NO_TESTS).matched)


@query
def unique_a(spark, directory):
    return _linked(spark, directory, CROWDED, NO_TESTS).unique_a


@query
def unique_b(spark, directory):
    b = _linked(spark, directory, CROWDED, NO_TESTS).unique_b
    return _six(b, *SAMPLES).withColumn("mz", F.round("mz", 9))


@query
def match_summary(spark, directory):
    metrics = _linked(spark, directory, CROWDED).summary_metrics()
    return _six(metrics, *[c for c, t in metrics.dtypes if t == "double"])


@query
def summary_lines(spark, directory):
    """The report as text, without the rules around it."""
    lines = [x for x in _linked(spark, directory, CROWDED).summary().splitlines() if x.startswith("  ")]
    return spark.createDataFrame([(x,) for x in lines], "line string")


@query
def diagnostics(spark, directory):
    return spark.createDataFrame(list(_linked(spark, directory, CROWDED).diagnostics.items()), "name string, n bigint")


@query
def recovery_report(spark, directory):
    shares = _linked(spark, directory, CROWDED).recovery()
    return spark.createDataFrame([(k, round(v, 6)) for k, v in shares.items()], "name string, pct double")


@query
def align_triage(spark, directory):
    """Tiers of a real linkage."""
    return _linked(spark, directory, CROWDED).triage()["summary"]


@query
def column_roles(spark, directory):
    """Roles read from the names of another export, blanks, prefixes, an empty and an all-zero column included."""
    a = feature_tables(spark, directory, CROWDED)[0]
    names = {"mz": " Precursor Mz", "rt": "Best Retention Time", "rtmin": "Start.RT", "rtmax": "end rt", "id": "Feature ID"} | {s: f"Area_{s}" for s in SAMPLES}
    df = a.toDF(*[names[c] for c in a.columns]).withColumn("zero", F.lit(0.0)).withColumn("Area_zero", F.lit(0)).withColumn("Height_none", F.lit(None).cast("double"))
    m = roles.infer_column_map(df)
    rows = [(r, getattr(m, r)) for r in ("mz", "rt", "mz_min", "mz_max", "rt_min", "rt_max")]
    rows += [("intensity", c) for c in m.intensity_cols] + [("annotation", c) for c in m.annotation_cols]
    return spark.createDataFrame(rows, "role string, column_name string")


@query
def csv_source(spark, directory):
    """A result table written as CSV and read back as a feature table."""
    r = _linked(spark, directory, CROWDED, NO_TESTS)
    folder = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    r.write(folder, "csv")
    back = read_delimited(spark, f"{folder}/unique_a")
    return back.select(F.col("id").cast("bigint").alias("id"), *[F.col(c).cast("double").alias(c) for c in ("mz", "rt", *SAMPLES)])


SQL = linkage_sql.SQL

QUERIES = {
    name: f
    for name, f in list(globals().items())
    if hasattr(f, "__wrapped__") and getattr(f, "__module__", None) == __name__ and not name.startswith("_")
}
