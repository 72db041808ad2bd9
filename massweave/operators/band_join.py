"""Two-dimensional tolerance join of two feature tables on m/z and RT.

The window is the first table's: ``|mz_b - mz_a| <= tolerance(mz_a)`` and
``|rt_b - rt_a| <= rt_seconds``, both inclusive.  Spark plans such a condition as a nested
loop over all pairs.  Here both tables are cut into cells on both axes: each row of the
second table lies in one cell, each row of the first is sent to the one or two cells per axis
that its window touches, and the cells are joined by equality with the exact condition on
top.  No pair can appear twice, since a row of the second table has one cell only.

Cells on m/z are as wide as the window at every m/z: linear in m/z below the point where the
absolute window gives way to the ppm window, logarithmic above it.  So no row widens the
cells of others, and nothing has to be known about the table beforehand.

Rows whose m/z or RT is missing, or whose m/z is not positive, never match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from massweave.config import Tolerances

#: Relative slack for rounding at the edge of a cell.
_SLACK = 1e-12


def mz_tolerance(mz: Column, tol: Tolerances) -> Column:
    """Half-width of the m/z window in Da: the wider of the ppm and the absolute one."""
    ppm = mz * F.lit(float(tol.mz_ppm)) / F.lit(1e6)
    return ppm if tol.mz_da is None else F.greatest(ppm, F.lit(float(tol.mz_da)))


def _mz_place(mz: Column, tol: Tolerances) -> Column:
    """Position of an m/z in cells of four half-widths; continuous and increasing."""
    ppm, da = max(float(tol.mz_ppm), 0.0) * 1e-6, max(float(tol.mz_da or 0.0), 0.0)
    if ppm == 0:
        return mz / F.lit(4 * da if da else 1e-6)
    if da == 0:
        return F.ln(mz) / F.lit(4 * ppm)
    turn = da / ppm
    linear = mz / F.lit(4 * da)
    return F.when(mz <= turn, linear).otherwise(F.lit(turn / (4 * da)) + F.ln(mz / F.lit(turn)) / F.lit(4 * ppm))


def _touched(low: Column, high: Column) -> Column:
    return F.explode(F.sequence(F.floor(low), F.floor(high)))


def candidate_pairs(a: DataFrame, b: DataFrame, tol: Tolerances, keep_a: tuple[str, ...] = (), keep_b: tuple[str, ...] = ()) -> DataFrame:
    """``(idx_a, idx_b, mz_a, mz_b, rt_a, rt_b)`` and the columns kept, suffixed, of all pairs in the window."""
    tolerance = mz_tolerance(F.col("mz"), tol)
    usable = F.col("mz").isNotNull() & F.col("rt").isNotNull() & (F.col("mz") > 0)
    left = a.where(usable & (tolerance >= 0)).withColumn("_tol", tolerance)
    right = b.where(usable)
    if tol.rt_seconds < 0:
        left = left.limit(0)
    # A window that reaches below zero touches the cells down to a thousandth of its own m/z, or all from zero on where they are linear.
    least = F.lit(0.0) if (tol.mz_da or 0) > 0 else F.col("mz") * F.lit(1e-3)
    low = _mz_place(F.greatest(F.col("mz") - F.col("_tol"), least), tol)
    high = _mz_place(F.col("mz") + F.col("_tol"), tol)
    slack = _SLACK * (1 + F.abs(high))
    wide = 4.0 * max(tol.rt_seconds, 1e-6)
    left = left.select(
        F.col("idx").alias("idx_a"),
        F.col("mz").alias("mz_a"),
        F.col("rt").alias("rt_a"),
        "_tol",
        *[F.col(c).alias(f"{c}_a") for c in keep_a],
        _touched(low - slack, high + slack).alias("_mz_cell"),
    ).select("*", _touched((F.col("rt_a") - tol.rt_seconds) / wide - _SLACK, (F.col("rt_a") + tol.rt_seconds) / wide + _SLACK).alias("_rt_cell"))
    right = right.select(
        F.col("idx").alias("idx_b"),
        F.col("mz").alias("mz_b"),
        F.col("rt").alias("rt_b"),
        *[F.col(c).alias(f"{c}_b") for c in keep_b],
        F.floor(_mz_place(F.col("mz"), tol)).alias("_mz_cell"),
        F.floor(F.col("rt") / wide).alias("_rt_cell"),
    )
    exact = (F.abs(F.col("mz_b") - F.col("mz_a")) <= F.col("_tol")) & (F.abs(F.col("rt_b") - F.col("rt_a")) <= F.lit(float(tol.rt_seconds)))
    return left.join(right, ["_mz_cell", "_rt_cell"]).where(exact).drop("_mz_cell", "_rt_cell", "_tol")
