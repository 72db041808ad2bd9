"""Statistical evidence for matched pairs.

Permutation p-values and bootstrap intervals of the correlation need the same shuffles for
all pairs.  The index matrices depend on seed, number of samples and counts only, so they are
drawn once on the driver and sent along; p-values and intervals are then the same for any
partitioning.  The numeric work runs on Arrow batches of pairs; everything else are column
expressions, aggregates over at most ``n_permutations`` distinct p-values, and windows over
the pairs of one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from massweave.config import StatTestParams
from massweave.functions.arrays import log1p_if, row_mean_imputed
from massweave.plans.runtime import cut_lineage, small_enough

#: Raw data span at least this factor between their largest and smallest positive value.
RAW_RANGE = 1e4

#: Samples that both sides must have for a pair to be tested.
LEAST_VALID = 3

#: Limits of the notes.
WIDE_CI, LOW_SPECIFICITY = 0.4, 0.1

#: Pairs whose permutations are held in memory at once.
_PAIRS_AT_ONCE = 256

STAT_COLUMNS = (
    ("_perm_pvalue", "double"),
    ("_perm_qvalue", "double"),
    ("_fdr_significant", "boolean"),
    ("_specificity", "double"),
    ("_corr_ci_low", "double"),
    ("_corr_ci_high", "double"),
    ("_ci_width", "double"),
    ("_stat_notes", "string"),
)


def intensity_span(pairs: DataFrame) -> tuple[int, float | None, bool]:
    """Number of positive intensities of all pairs, both sides together, their span, and whether they look untransformed."""
    values = pairs.select(F.explode(F.concat("x_a", "x_b")).alias("v")).where("v > 0")
    row = values.agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    span = row["hi"] / row["lo"] if row["n"] else None
    return row["n"], span, row["n"] >= 2 and span >= RAW_RANGE


def is_raw(pairs: DataFrame) -> bool:
    """Whether the intensities of all matched pairs, both sides together, look untransformed."""
    return intensity_span(pairs)[2]


def matrices(pairs: DataFrame, raw: bool) -> DataFrame:
    """Replace ``x_a`` and ``x_b`` by complete vectors and add ``valid``.

    ``log1p`` of everything if the data are raw; missing values become the mean of their own
    row after that, 0 in a row without any; ``valid`` says whether enough samples are present
    on both sides.
    """
    both = F.filter(F.zip_with("x_a", "x_b", lambda a, b: a.isNotNull() & b.isNotNull()), lambda ok: ok)
    step = pairs.withColumn("valid", F.size(both) >= LEAST_VALID)
    step = step.withColumn("x_a", log1p_if(F.col("x_a"), raw)).withColumn("x_b", log1p_if(F.col("x_b"), raw))
    return step.withColumn("x_a", row_mean_imputed(F.col("x_a"))).withColumn("x_b", row_mean_imputed(F.col("x_b")))


def index_matrices(n_samples: int, params: StatTestParams) -> tuple[np.ndarray, np.ndarray]:
    """Shuffles and resamples of the sample positions: all shuffles are drawn before all resamples."""
    rng = np.random.default_rng(params.random_seed)
    shuffles = np.array([rng.permutation(n_samples) for _ in range(params.n_permutations)], dtype=np.int64).reshape(-1, n_samples)
    resamples = np.array([rng.integers(0, n_samples, size=n_samples) for _ in range(params.n_bootstrap)], dtype=np.int64).reshape(-1, n_samples)
    return shuffles, resamples


def average_ranks(x: np.ndarray) -> np.ndarray:
    """Ranks along the last axis, ties averaged."""
    less = (x[..., None, :] < x[..., :, None]).sum(-1)
    same = (x[..., None, :] == x[..., :, None]).sum(-1)
    return less + (same + 1) / 2


def _standardised(x: np.ndarray) -> np.ndarray:
    """Rows with mean 0 and length 1; NaN where a row is constant."""
    centred = x - x.mean(-1, keepdims=True)
    length = np.sqrt((centred**2).sum(-1, keepdims=True))
    constant = x.max(-1, keepdims=True) == x.min(-1, keepdims=True)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(constant, np.nan, centred / length)


def correlations(a: np.ndarray, b: np.ndarray, method: str) -> np.ndarray:
    """Row-wise correlation, NaN where a row is constant, never beyond [-1, 1]."""
    if method == "spearman":
        a, b = average_ranks(a), average_ranks(b)
    return np.clip((_standardised(a) * _standardised(b)).sum(-1), -1.0, 1.0)


def permutation_pvalues(a: np.ndarray, b: np.ndarray, valid: np.ndarray, shuffles: np.ndarray, method: str, slack: float) -> np.ndarray:
    """Share of shuffles that reach the observed correlation, at least one shuffle's worth; NaN where not valid.

    A constant row has no correlation, so no shuffle reaches it and it gets the smallest
    p-value.
    """
    out = np.full(len(a), np.nan)
    if not len(shuffles):
        return out
    if method == "spearman":
        a, b = average_ranks(a), average_ranks(b)
    a, b = _standardised(a), _standardised(b)
    observed = np.clip((a * b).sum(-1), -1.0, 1.0)
    for lo in range(0, len(a), _PAIRS_AT_ONCE):
        part = slice(lo, lo + _PAIRS_AT_ONCE)
        null = np.einsum("ks,kps->kp", a[part], b[part][:, shuffles])
        with np.errstate(invalid="ignore"):
            reached = (np.clip(null, -1.0, 1.0) >= observed[part, None] - slack).sum(1)
        out[part] = np.maximum(reached, 1) / len(shuffles)
    return np.where(valid, out, np.nan)


def _resampled(a: np.ndarray, b: np.ndarray, resamples: np.ndarray, method: str) -> np.ndarray:
    """Correlations of pairs over resampled positions, ``(pairs, resamples)``."""
    x, y = a[:, resamples], b[:, resamples]
    if method == "spearman":
        # Rank within each resample.
        x, y = average_ranks(x), average_ranks(y)
    return np.clip((_standardised(x) * _standardised(y)).sum(-1), -1.0, 1.0)


def bootstrap_interval(a: np.ndarray, b: np.ndarray, valid: np.ndarray, resamples: np.ndarray, method: str, level: float = 0.95) -> tuple[np.ndarray, np.ndarray]:
    """Percentile interval over the resamples that have a correlation; NaN where none has one or the pair is not valid."""
    low, high = np.full(len(a), np.nan), np.full(len(a), np.nan)
    tail = (1 - level) / 2
    step = max(1, _PAIRS_AT_ONCE // (a.shape[1] if method == "spearman" else 1)) if a.ndim == 2 and a.shape[1] else _PAIRS_AT_ONCE
    for lo in range(0, len(a), step):
        r = _resampled(a[lo : lo + step], b[lo : lo + step], resamples, method) if len(resamples) else np.zeros((len(a[lo : lo + step]), 0))
        r = np.sort(r, axis=1)  # NaN last
        n = np.isfinite(r).sum(1)
        for q, out in ((tail, low), (1 - tail, high)):
            at = q * np.maximum(n - 1, 0)
            k = np.floor(at).astype(int)
            rows = np.arange(len(r))
            ok = n > 0
            below = r[rows[ok], k[ok]]
            above = r[rows[ok], np.minimum(k[ok] + 1, n[ok] - 1)]
            part = np.full(len(r), np.nan)
            part[ok] = below + (above - below) * (at[ok] - k[ok])
            out[lo : lo + step] = part
    return np.where(valid, low, np.nan), np.where(valid, high, np.nan)


def resampling_tests(
    pairs: DataFrame, n_samples: int, params: StatTestParams, positions: tuple[np.ndarray, np.ndarray] | None = None
) -> DataFrame:
    """``(idx_a, idx_b, valid, _perm_pvalue, _corr_ci_low, _corr_ci_high, constant)`` from :func:`matrices`.

    ``positions`` replaces the drawn shuffles and resamples.  What is broadcast has as many
    numbers as samples times shuffles and resamples, whatever the number of pairs.
    """
    shared = pairs.sparkSession.sparkContext.broadcast(index_matrices(n_samples, params) if positions is None else positions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shuffles, resamples = shared.value
        for batch in batches:
            a, b = (np.asarray(batch.column(k).flatten().to_numpy(zero_copy_only=False), float).reshape(-1, n_samples) for k in (2, 3))
            valid = np.asarray(batch.column(4).to_numpy(zero_copy_only=False), bool)
            p = permutation_pvalues(a, b, valid, shuffles, params.corr_method, params.tie_slack)
            low, high = bootstrap_interval(a, b, valid, resamples, params.corr_method)
            constant = (a.max(1) == a.min(1)) | (b.max(1) == b.min(1))
            columns = [pa.array(v, pa.float64(), mask=np.isnan(v)) for v in (p, low, high)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(4), *columns, pa.array(constant)],
                names=["idx_a", "idx_b", "valid", "_perm_pvalue", "_corr_ci_low", "_corr_ci_high", "constant"],
            )

    return pairs.select("idx_a", "idx_b", "x_a", "x_b", "valid").mapInArrow(
        run, "idx_a bigint, idx_b bigint, valid boolean, _perm_pvalue double, _corr_ci_low double, _corr_ci_high double, constant boolean"
    )


#: Distinct p-values that are ranked in one task; more are ranked in ranges.
MOST_PVALUES = 200_000


def _ranked_pvalues(counts: DataFrame, q: str, most: int) -> DataFrame:
    """``(_p, q)`` from ``(_p, _n)``: one task ranks few distinct values, ranges of values rank many."""
    if small_enough(counts, most):
        ranged = counts.withColumn("_range", F.lit(0))
    else:
        # The ranges hold about equally many values; writing them once keeps them as they are.
        ranged = cut_lineage(counts.repartitionByRange("_p").withColumn("_range", F.spark_partition_id()))
    upto, onward = (W.unboundedPreceding, W.currentRow), (W.unboundedPreceding, -1)
    # One row for each range.
    sums = ranged.groupBy("_range").agg(F.sum("_n").alias("_sum"))
    sums = sums.select("_range", F.coalesce(F.sum("_sum").over(W.partitionBy().orderBy("_range").rowsBetween(*onward)), F.lit(0)).alias("_before"), F.sum("_sum").over(W.partitionBy()).alias("_m"))
    inside = W.partitionBy("_range").orderBy("_p").rowsBetween(*upto)
    raw = ranged.join(sums, "_range").withColumn("_rank", F.col("_before") + F.sum("_n").over(inside)).withColumn("_raw", F.col("_p") * F.col("_m") / F.col("_rank"))
    raw = raw.select("_range", "_p", "_raw")
    later = W.partitionBy().orderBy(F.desc("_range")).rowsBetween(*onward)
    least = raw.groupBy("_range").agg(F.min("_raw").alias("_own")).select("_range", F.min("_own").over(later).alias("_later"))
    down = W.partitionBy("_range").orderBy(F.desc("_p")).rowsBetween(*upto)
    return raw.join(least, "_range").select("_p", F.least(F.min("_raw").over(down), F.col("_later"), F.lit(1.0)).alias(q))


def bh_qvalues(df: DataFrame, p: str = "_perm_pvalue", q: str = "_perm_qvalue", most: int = MOST_PVALUES) -> DataFrame:
    """Add Benjamini-Hochberg q-values; NULL (and NaN) p-values stay without one.

    Tied p-values share the q-value of the largest rank among them, so one row for each
    distinct p-value is enough.  A permutation test has few of them.  Of a continuous column
    they may be as many as rows: beyond ``most`` they are cut into ranges, with ranks and
    minima carried from range to range; the result is the same.
    """
    value = F.when(~F.isnan(p), F.col(p))
    counts = df.where(value.isNotNull()).groupBy(F.col(p).alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    ranked = _ranked_pvalues(counts, q, most)
    return df.join(ranked, value == F.col("_p"), "left").drop("_p")


def specificity(matched: DataFrame, edges: DataFrame) -> DataFrame:
    """Add ``_specificity``: confidence minus that of the best other candidate of either row, within [0, 1].

    Only the two best candidates of a row can matter, so both are kept by one aggregate each.
    """

    def two_best(side: str) -> DataFrame:
        other = "idx_b" if side == "idx_a" else "idx_a"
        order = W.partitionBy(side).orderBy(F.desc("confidence"), other)
        return (
            edges.select(side, other, "confidence")
            .withColumn("_k", F.row_number().over(order))
            .where("_k <= 2")
            .groupBy(F.col(side).alias(f"_{side}"))
            .agg(
                F.max(F.when(F.col("_k") == 1, F.col(other))).alias(f"_first_{side}"),
                F.max(F.when(F.col("_k") == 1, F.col("confidence"))).alias(f"_best_{side}"),
                F.max(F.when(F.col("_k") == 2, F.col("confidence"))).alias(f"_next_{side}"),
            )
        )

    rival = lambda side, other: F.when(F.col(f"_first_{side}") == F.col(other), F.col(f"_next_{side}")).otherwise(F.col(f"_best_{side}"))
    joined = matched.join(two_best("idx_a"), F.col("idx_a") == F.col("_idx_a"), "left").join(two_best("idx_b"), F.col("idx_b") == F.col("_idx_b"), "left")
    best = F.coalesce(F.greatest(rival("idx_a", "idx_b"), rival("idx_b", "idx_a")), F.lit(0.0))
    gap = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence") - best))
    return joined.select(*matched.columns, gap.alias("_specificity"))


def notes(raw: bool, params: StatTestParams) -> Column:
    """The flags of a pair, joined by ``|``; empty where nothing is to be said."""
    return F.concat_ws(
        "|",
        F.when(F.lit(raw), "internal_log1p_applied"),
        F.when(F.col("_ci_width") > WIDE_CI, "wide_ci"),
        F.when(F.col("_specificity") < LOW_SPECIFICITY, "low_specificity"),
        F.when(~F.col("valid"), "insufficient_valid_samples"),
        F.when(F.lit(params.flag_constant) & F.col("valid") & F.col("constant"), "constant_intensity"),
    )


def tested(matched: DataFrame, edges: DataFrame, vectors: DataFrame, n_samples: int, params: StatTestParams) -> DataFrame:
    """Matched pairs with the columns of :data:`STAT_COLUMNS`.

    ``vectors`` has ``idx_a, idx_b, x_a, x_b`` of the matched pairs.  Without tests all
    columns are NULL, False and ''.  With fewer than three shared samples only the
    specificity is known, and the note says so.
    """
    null = lambda kind: F.lit(None).cast(kind)
    if not params.run_stats:
        values = {n: null(k) for n, k in STAT_COLUMNS} | {"_fdr_significant": F.lit(False), "_stat_notes": F.lit("")}
        return matched.select(*matched.columns, *[values[n].alias(n) for n, _ in STAT_COLUMNS])
    with_gap = specificity(matched, edges)
    if n_samples < LEAST_VALID:
        values = {n: null(k) for n, k in STAT_COLUMNS} | {
            "_fdr_significant": F.lit(False),
            "_specificity": F.col("_specificity"),
            "_stat_notes": F.lit("no_shared_samples"),
        }
        return with_gap.select(*matched.columns, *[values[n].alias(n) for n, _ in STAT_COLUMNS])
    raw = params.auto_log_transform and is_raw(vectors)
    tests = resampling_tests(matrices(vectors, raw), n_samples, params)
    rows = bh_qvalues(with_gap.join(tests, ["idx_a", "idx_b"])).withColumn("_ci_width", F.col("_corr_ci_high") - F.col("_corr_ci_low"))
    rows = rows.withColumn("_fdr_significant", F.coalesce(F.col("_perm_qvalue") < F.lit(params.fdr_alpha), F.lit(False)))
    return rows.withColumn("_stat_notes", notes(raw, params)).select(*matched.columns, *[n for n, _ in STAT_COLUMNS])
