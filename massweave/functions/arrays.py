"""Row-wise statistics on pairs of arrays, evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def _ranks(values: Column) -> Column:
    """Average ranks: the number of smaller values plus half the number of equal ones and one."""
    return F.transform(
        values,
        lambda x: F.aggregate(
            values, F.lit(0.0), lambda a, y: a + F.when(y < x, 1.0).when(y == x, 0.5).otherwise(0.0)
        )
        + 0.5,
    )


def with_correlation(df: DataFrame, left: str, right: str, out: str = "r", method: str = "pearson", least: int = 3) -> DataFrame:
    """Add the correlation of two array columns over the places where both have a value.

    NULL where fewer than ``least`` places are left or one side is constant; never beyond
    [-1, 1].  Each step is a column of its own, so the arrays are walked a fixed number of
    times.
    """
    both = F.filter(F.zip_with(left, right, lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.struct(a.alias("a"), b.alias("b")))), lambda p: p.isNotNull())
    step = df.withColumn("_p", both).withColumn("_a", F.col("_p.a")).withColumn("_b", F.col("_p.b"))
    usable = (F.size("_p") >= least) & (F.array_max("_a") > F.array_min("_a")) & (F.array_max("_b") > F.array_min("_b"))
    step = step.withColumn("_ok", usable)
    if method == "spearman":
        step = step.withColumn("_a", F.when(F.col("_ok"), _ranks(F.col("_a")))).withColumn("_b", F.when(F.col("_ok"), _ranks(F.col("_b"))))
    step = step.withColumn("_ma", F.try_divide(_sum(F.col("_a")), F.size("_p"))).withColumn("_mb", F.try_divide(_sum(F.col("_b")), F.size("_p")))
    zero = F.struct(F.lit(0.0).alias("ab"), F.lit(0.0).alias("aa"), F.lit(0.0).alias("bb"))
    sums = F.aggregate(
        F.arrays_zip("_a", "_b"),
        zero,
        lambda s, p: F.struct(
            (s["ab"] + (p["_a"] - F.col("_ma")) * (p["_b"] - F.col("_mb"))).alias("ab"),
            (s["aa"] + (p["_a"] - F.col("_ma")) * (p["_a"] - F.col("_ma"))).alias("aa"),
            (s["bb"] + (p["_b"] - F.col("_mb")) * (p["_b"] - F.col("_mb"))).alias("bb"),
        ),
    )
    step = step.withColumn("_s", F.when(F.col("_ok"), sums))
    r = F.try_divide(F.col("_s.ab"), F.sqrt(F.col("_s.aa")) * F.sqrt(F.col("_s.bb")))
    # ``greatest`` and ``least`` pass over NULL, so an unknown correlation must not reach them.
    return step.withColumn("_r", r).withColumn(out, F.when(F.col("_r").isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), "_r")))).drop("_r", "_p", "_a", "_b", "_ok", "_ma", "_mb", "_s")


def log1p_if(values: Column, raw: bool) -> Column:
    """``log1p`` of all values if the data are raw."""
    return F.transform(values, lambda v: F.log1p(v)) if raw else values


def row_mean_imputed(values: Column) -> Column:
    """Missing values replaced by the mean of the row's others, 0 where there are none."""
    present = F.filter(values, lambda v: v.isNotNull())
    mean = F.when(F.size(present) > 0, _sum(present) / F.size(present)).otherwise(0.0)
    return F.transform(values, lambda v: F.coalesce(v, mean))
