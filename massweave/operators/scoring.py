"""Scores of candidate pairs: deviations, correlation, confidence, and the filter on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from massweave.config import Tolerances
from massweave.functions.arrays import with_correlation
from massweave.plans.runtime import computed_once


def delta_mz_ppm(mz_a: Column, mz_b: Column) -> Column:
    """Distance in ppm of the mean of both; NULL where the mean is zero."""
    return F.try_divide(F.abs(mz_a - mz_b), (mz_a + mz_b) / F.lit(2.0)) * F.lit(1e6)


def gaussian_similarity(delta: Column, sigma: float) -> Column:
    """1 at no deviation, falling as a normal density does."""
    return F.exp(F.lit(-0.5) * F.pow(F.try_divide(delta, F.lit(float(sigma))), F.lit(2.0)))


def confidence(ppm: Column, seconds: Column, corr: Column, tol: Tolerances) -> Column:
    """Weighted mean of the similarities; an unknown correlation leaves its weight to the other two, half each."""
    w = tol.confidence_weights
    mz = gaussian_similarity(ppm, tol.mz_ppm * 0.5)
    rt = gaussian_similarity(seconds, tol.rt_seconds * 0.5)
    half = w["intensity"] / 2
    known = F.lit(w["mz"]) * mz + F.lit(w["rt"]) * rt + F.lit(w["intensity"]) * (corr + 1) / 2
    unknown = F.lit(w["mz"] + half) * mz + F.lit(w["rt"] + half) * rt
    score = F.coalesce(known, unknown)
    return F.when(score.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def scored(pairs: DataFrame, tol: Tolerances) -> DataFrame:
    """``(idx_a, idx_b, delta_mz_ppm, delta_rt, intensity_corr, confidence)`` from pairs with ``x_a`` and ``x_b``."""
    with_r = computed_once(with_correlation(pairs, "x_a", "x_b", "intensity_corr", tol.corr_method).drop("x_a", "x_b"))
    slim = with_r.select(
        "idx_a",
        "idx_b",
        delta_mz_ppm(F.col("mz_a"), F.col("mz_b")).alias("delta_mz_ppm"),
        (F.col("rt_b") - F.col("rt_a")).alias("delta_rt"),
        "intensity_corr",
    )
    return slim.withColumn("confidence", confidence(F.col("delta_mz_ppm"), F.col("delta_rt"), F.col("intensity_corr"), tol))


def correlation_filter(edges: DataFrame, tol: Tolerances, n_shared: int, required: bool = True) -> DataFrame:
    """Drop pairs whose known correlation is too low; only where at least three samples are shared."""
    if not required or n_shared < 3:
        return edges
    return edges.where(F.col("intensity_corr").isNull() | (F.col("intensity_corr") >= F.lit(float(tol.min_intensity_corr))))
