"""Linking two feature tables: the whole plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from massweave.config import StatTestParams, Tolerances
from massweave.operators import assignment, band_join, drift, ingest, scoring, significance
from massweave.operators.results import MatchResult
from massweave.operators.roles import ColumnMap, infer_column_map, shared_samples
from massweave.plans.runtime import cut_lineage, ship_package, small_enough

EDGE_METRICS = (("confidence", "_confidence"), ("delta_mz_ppm", "_delta_mz_ppm"), ("delta_rt", "_delta_rt"), ("intensity_corr", "_intensity_corr"))


def _wide(df: DataFrame, label: str) -> DataFrame:
    """All columns with the table's label behind their names, and ``_idx_<label>``."""
    return df.toDF(*[f"{c}_{label}" if c != "_idx" else f"_idx_{label}" for c in df.columns])


def _shifted(df: DataFrame, columns: ColumnMap, fit: drift.Drift | None, keep_original: bool) -> DataFrame:
    """A's table with its RT and RT bounds corrected."""
    if fit is None:
        return df
    names = df.columns
    times = [c for c in (columns.rt, columns.rt_min, columns.rt_max) if c is not None]
    flat = df.toDF(*[f"c{i}" for i in range(len(names))])
    out = []
    for i, n in enumerate(names):
        c = F.col(f"c{i}")
        out.append(fit.corrected(c.cast("double")).alias(n) if n in times else c.alias(n))
    if keep_original:
        out += [F.col(f"c{names.index(t)}").alias(f"{t}_uncorrected") for t in times]
    return flat.select(*out)


class PeakMatcher:
    """Runs all steps of the linkage with one set of settings.

    ``stat_params=None`` means the default tests; ``StatTestParams(run_stats=False)`` leaves
    them out.  ``drift_model`` is ``ridge2`` or ``linear``.
    """

    def __init__(
        self,
        tol: Tolerances | None = None,
        stat_params: StatTestParams | None = None,
        rt_drift_correction: bool = True,
        require_intensity_corr: bool = True,
        drift_model: str = "ridge2",
        keep_original_rt: bool = False,
    ):
        self.tol = tol or Tolerances()
        self.stat_params = stat_params or StatTestParams()
        self.rt_drift_correction = rt_drift_correction
        self.require_intensity_corr = require_intensity_corr
        self.drift_model = drift_model
        self.keep_original_rt = keep_original_rt

    def candidates(self, a: DataFrame, b: DataFrame) -> tuple[DataFrame, drift.Drift | None]:
        """Candidate pairs of slim frames with both vectors, after the correction of drift.

        The first join only fits the drift and carries no vectors.
        """
        fit = None
        if self.rt_drift_correction:
            anchors = cut_lineage(band_join.candidate_pairs(a, b, self.tol))
            if not small_enough(anchors, drift.LEAST_PAIRS - 1):
                fit = drift.fit_drift(anchors, self.drift_model)
        moved = a if fit is None else a.withColumn("rt", fit.corrected(F.col("rt")))
        return cut_lineage(band_join.candidate_pairs(moved, b, self.tol, ("x",), ("x",))), fit

    def match(
        self,
        df_a: DataFrame,
        df_b: DataFrame,
        map_a: ColumnMap,
        map_b: ColumnMap,
        label_a: str = "A",
        label_b: str = "B",
        id_col_a: str | None = None,
        id_col_b: str | None = None,
    ) -> MatchResult:
        """Link two tables; A's retention times come out corrected for drift."""
        if label_a == label_b:
            raise ValueError("the labels of the two tables must differ")
        df_a, df_b = ingest.as_frame(df_a), ingest.as_frame(df_b)
        map_a.validate_against(df_a)
        map_b.validate_against(df_b)
        ship_package(df_a.sparkSession)
        samples = shared_samples(map_a, map_b)
        a, b = ingest.numbered(df_a, id_col_a), ingest.numbered(df_b, id_col_b)
        slim_a, slim_b = ingest.slim(a, map_a, samples), ingest.slim(b, map_b, samples)

        pairs, fit = self.candidates(slim_a, slim_b)
        a = _shifted(a, map_a, fit, self.keep_original_rt)
        edges = scoring.correlation_filter(scoring.scored(pairs, self.tol), self.tol, len(samples), self.require_intensity_corr)
        edges = cut_lineage(edges)
        chosen = cut_lineage(edges.join(assignment.assign(edges), ["idx_a", "idx_b"]))
        vectors = pairs.select("idx_a", "idx_b", "x_a", "x_b").join(chosen.select("idx_a", "idx_b"), ["idx_a", "idx_b"])
        tested = cut_lineage(significance.tested(chosen, edges, vectors, len(samples), self.stat_params))
        return self._result(a, b, tested, edges, label_a, label_b)

    def _result(self, a: DataFrame, b: DataFrame, tested: DataFrame, edges: DataFrame, label_a: str, label_b: str) -> MatchResult:
        stats = [n for n, _ in significance.STAT_COLUMNS]
        if not self.stat_params.run_stats:
            stats = [n for n in stats if n not in ("_fdr_significant", "_stat_notes")] + ["_fdr_significant", "_stat_notes"]
        metrics = tested.select(
            F.col("idx_a").alias("_pair_a"), F.col("idx_b").alias("_pair_b"), *[F.col(c).alias(n) for c, n in EDGE_METRICS], *stats
        )
        wide_a, wide_b = _wide(a, label_a), _wide(b, label_b)
        joined = metrics.join(wide_a, metrics["_pair_a"] == wide_a[f"`_idx_{label_a}`"]).join(wide_b, metrics["_pair_b"] == wide_b[f"`_idx_{label_b}`"])
        of = lambda w, label: [w[f"`{c.replace('`', '``')}`"] for c in w.columns if c != f"_idx_{label}"]
        matched = joined.select(*of(wide_a, label_a), *of(wide_b, label_b), *[metrics[n] for _, n in EDGE_METRICS], *[metrics[n] for n in stats])
        lonely_a = a.join(tested.select(F.col("idx_a").alias("_idx")), "_idx", "left_anti").drop("_idx")
        lonely_b = b.join(tested.select(F.col("idx_b").alias("_idx")), "_idx", "left_anti").drop("_idx")
        counts = tested.agg(F.count(F.lit(1)).alias("n"), F.count_if("_fdr_significant").alias("sig")).first()
        n_a, n_b = a.count(), b.count()
        diagnostics = {
            "n_features_a": n_a,
            "n_features_b": n_b,
            "n_matched": counts["n"],
            "n_unique_a": n_a - counts["n"],
            "n_unique_b": n_b - counts["n"],
            "n_candidates_evaluated": edges.count(),
            "n_fdr_significant": counts["sig"],
        }
        return MatchResult(matched, lonely_a, lonely_b, diagnostics)


def align(
    df_a: DataFrame,
    df_b: DataFrame,
    mz_col: str | None = None,
    rt_col: str | None = None,
    mz_min_col: str | None = None,
    mz_max_col: str | None = None,
    rt_min_col: str | None = None,
    rt_max_col: str | None = None,
    intensity_cols_a: list[str] | None = None,
    intensity_cols_b: list[str] | None = None,
    map_a: ColumnMap | None = None,
    map_b: ColumnMap | None = None,
    tol: Tolerances | None = None,
    rt_drift_correction: bool = True,
    require_intensity_corr: bool = True,
    stat_params: StatTestParams | None = None,
    label_a: str = "A",
    label_b: str = "B",
    **options,
) -> MatchResult:
    """Link two feature tables, Spark or pandas frames.

    Column overrides hold for both tables, sample lists for one each; a map given makes the
    overrides moot for its table.  ``options`` are those of :class:`PeakMatcher`
    (``drift_model``, ``keep_original_rt``) and of its ``match`` (``id_col_a``, ``id_col_b``:
    unique ids of any type; integer ones spare numbering the rows).
    """
    df_a, df_b = ingest.as_frame(df_a), ingest.as_frame(df_b)
    roles = {"mz_col": mz_col, "rt_col": rt_col, "mz_min_col": mz_min_col, "mz_max_col": mz_max_col, "rt_min_col": rt_min_col, "rt_max_col": rt_max_col}
    map_a = map_a or infer_column_map(df_a, intensity_cols=intensity_cols_a, **roles)
    map_b = map_b or infer_column_map(df_b, intensity_cols=intensity_cols_b, **roles)
    ids = {k: options.pop(k) for k in ("id_col_a", "id_col_b") if k in options}
    matcher = PeakMatcher(tol, stat_params, rt_drift_correction, require_intensity_corr, **options)
    return matcher.match(df_a, df_b, map_a, map_b, label_a=label_a, label_b=label_b, **ids)
