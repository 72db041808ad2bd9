"""Overlapping and gapped intervals: merge per entity and axis, list the gaps.

Sort by start, compare each start with the running maximum of the previous ends,
label islands by a running sum of the breaks, aggregate the islands to periods and
derive the gaps.  An entity may hold a large part of all rows, so no window ever runs
over a whole entity:

1. starts that coincide are reduced to their furthest end (map-side combine), so a
   *cell* of ``cell_width`` integer positions holds at most ``cell_width`` rows;
2. windows run inside one cell; the furthest end of everything before the cell comes
   from a running maximum over the (small) per-cell maxima.

The island number is therefore the number of breaks in the earlier cells plus the
running number of breaks in the own cell.

Defined results
  * a bound that is NULL, NaN, infinite or negative makes the interval unusable on that
    axis only; bounds in the wrong order are swapped;
  * an interval of length zero is a period of its own if nothing else covers it;
  * intervals that touch leave no gap;
  * of rows with one identity the one loaded last counts; rows loaded at the same time
    are ordered by their content, a NULL load time comes first;
  * rows without an entity or without an identity are left out;
  * an empty table gives an empty result, extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Axis:
    """One axis of the intervals: its name, bound columns and positions per unit."""

    name: str
    low: str
    high: str
    scale: int


SEGMENT_AXES = (Axis("rt", "rtmin", "rtmax", 1_000), Axis("mz", "mzmin", "mzmax", 100_000))


def _usable(c: Column) -> Column:
    c = c.cast("double")
    return F.coalesce((c >= 0) & (c < F.lit(float("inf"))) & ~F.isnan(c), F.lit(False))


def latest_rows(df: DataFrame, identity: str, loaded: str, columns: list[str]) -> DataFrame:
    """The row loaded last for each identity, by one aggregate that is formed in part before the shuffle; no window holds all rows of an identity."""
    order = F.struct(F.col(loaded), *[F.col(c) for c in columns])
    return (
        df.where(F.col(identity).isNotNull())
        .groupBy(identity)
        .agg(F.max(order).alias("_last"))
        .select(identity, *[F.col("_last")[c].alias(c) for c in columns])
    )


def interval_starts(
    df: DataFrame, entity: str, axes: tuple[Axis, ...] = SEGMENT_AXES, cell_width: int = 4096
) -> DataFrame:
    """Integer intervals ``(entity, axis, cell, s, e)``, one row for each distinct start."""
    sides = []
    for a in axes:
        lo, hi = F.col(a.low).cast("double"), F.col(a.high).cast("double")
        pos = lambda c: F.round(c * F.lit(float(a.scale))).cast("long")
        sides.append(
            F.when(
                _usable(lo) & _usable(hi),
                F.struct(F.lit(a.name).alias("axis"), pos(F.least(lo, hi)).alias("s"), pos(F.greatest(lo, hi)).alias("e")),
            )
        )
    return (
        df.where(F.col(entity).isNotNull())
        .select(F.col(entity), F.explode(F.array_compact(F.array(*sides))).alias("_i"))
        .select(entity, "_i.axis", F.expr(f"_i.s div {int(cell_width)}").alias("cell"), "_i.s", "_i.e")
        # Never NULL; said here so that both readers of the starts get the same plan and share its shuffle.
        .where("axis IS NOT NULL AND cell IS NOT NULL AND s IS NOT NULL")
        .groupBy(entity, "axis", "cell", "s")
        .agg(F.max("e").alias("e"))
    )


def label_breaks(starts: DataFrame, entity: str) -> DataFrame:
    """Add ``reach``, the furthest end before each start: NULL at the first start of all."""
    cell = [entity, "axis", "cell"]
    inside = W.partitionBy(*cell).orderBy("s").rowsBetween(W.unboundedPreceding, -1)
    earlier = W.partitionBy(entity, "axis").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    carry = (
        starts.groupBy(*cell).agg(F.max("e").alias("_e")).select(*cell, F.max("_e").over(earlier).alias("_carry"))
    )
    return (
        starts.withColumn("_own", F.max("e").over(inside))
        .join(carry, cell)
        .select(*cell, "s", "e", F.greatest("_own", "_carry").alias("reach"))
    )


def gaps(df: DataFrame, entity: str, axes: tuple[Axis, ...] = SEGMENT_AXES, cell_width: int = 4096) -> DataFrame:
    """Stretches of positive length between neighbouring periods: ``(entity, axis, gap_from, gap_to)``."""
    return (
        label_breaks(interval_starts(df, entity, axes, cell_width), entity)
        .where(F.col("s") > F.col("reach"))
        .select(entity, "axis", F.col("reach").alias("gap_from"), F.col("s").alias("gap_to"))
    )


def periods(df: DataFrame, entity: str, axes: tuple[Axis, ...] = SEGMENT_AXES, cell_width: int = 4096) -> DataFrame:
    """Continuous periods ``(entity, axis, period_no, period_from, period_to, n_starts)``.

    ``n_starts`` counts the distinct starts in the period.
    """
    cell = [entity, "axis", "cell"]
    marked = label_breaks(interval_starts(df, entity, axes, cell_width), entity).withColumn(
        "_new", (F.col("reach").isNull() | (F.col("s") > F.col("reach"))).cast("long")
    )
    before = W.partitionBy(entity, "axis").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    upto = W.partitionBy(*cell).orderBy("s").rowsBetween(W.unboundedPreceding, W.currentRow)
    offset = (
        marked.groupBy(*cell)
        .agg(F.sum("_new").alias("_n"))
        .select(*cell, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    return (
        marked.withColumn("_upto", F.sum("_new").over(upto))
        .join(offset, cell)
        .groupBy(entity, "axis", (F.col("_before") + F.col("_upto")).alias("period_no"))
        .agg(F.min("s").alias("period_from"), F.max("e").alias("period_to"), F.count(F.lit(1)).alias("n_starts"))
    )
