"""From a wide feature table to the slim frame that the linkage works on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from massweave.operators.roles import ColumnMap
from massweave.plans.runtime import broadcast_if_small, cut_lineage


def finite(c: Column) -> Column:
    """A double, NULL for NaN and infinite values."""
    c = c.cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


#: Partitions whose sizes are sent to all executors as a table.
MOST_PARTITIONS = 1_000_000


def as_frame(table) -> DataFrame:
    """A Spark frame; a pandas one is taken over by its columns, its index is dropped.

    Columns without any value become text columns of NULLs.
    """
    if isinstance(table, DataFrame):
        return table
    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    plain = table.reset_index(drop=True)
    plain.columns = [str(c) for c in plain.columns]
    empty = [c for c in plain.columns if plain[c].isna().all() and plain[c].dtype == object]
    frame = spark.createDataFrame(plain.drop(columns=empty)) if len(plain) else spark.createDataFrame([], ", ".join(f"`{c}` {_kind(plain[c])}" for c in plain.columns))
    if not len(plain):
        return frame
    names = frame.columns
    flat = frame.toDF(*[f"c{i}" for i in range(len(names))])
    return flat.select(*[F.col(f"c{names.index(c)}").alias(c) if c in names else F.lit(None).cast("string").alias(c) for c in plain.columns])


def _kind(column) -> str:
    return {"f": "double", "i": "bigint", "u": "bigint", "b": "boolean"}.get(column.dtype.kind, "string")


def _positions(df: DataFrame) -> DataFrame:
    fixed = cut_lineage(df.withColumn("_row", F.monotonically_increasing_id()))
    part, place = F.shiftright("_row", 33), F.col("_row").bitwiseAND((1 << 33) - 1)
    before = W.partitionBy().orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # one row for each partition
    sizes = fixed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    joined = fixed.withColumn("_part", part).join(broadcast_if_small(offsets, MOST_PARTITIONS), "_part")
    return joined.withColumn("_idx", F.col("_offset") + place).drop("_row", "_part", "_offset")


def numbered(df: DataFrame, id_col: str | None = None, check: bool = True) -> DataFrame:
    """Add ``_idx``: an integer id column of the table, or else the row's position.

    Positions are the running numbers within the partitions plus the sizes of the partitions
    before, fixed by writing the table once; an integer id column avoids that.  Ids of any
    other type are kept as a column, and the rows are numbered.  Ids that are NULL or occur
    twice would multiply rows in the joins, so they raise ``ValueError``; ``check=False``
    spares the one aggregate for ids known to be unique.
    """
    if id_col is None:
        return _positions(df)
    own = df[f"`{id_col.replace('`', '``')}`"]
    if check and not df.groupBy(own.alias("_id")).agg(F.count(F.lit(1)).alias("_n")).where("_id IS NULL OR _n > 1").isEmpty():
        raise ValueError(f"the ids in column {id_col!r} are not unique, or some are NULL")
    if isinstance(df.schema[id_col].dataType, T.IntegralType):
        return df.withColumn("_idx", own.cast("long"))
    return _positions(df)


def slim(df: DataFrame, columns: ColumnMap, samples: list[str]) -> DataFrame:
    """``(idx, mz, rt, x)``: coordinates and the vector of shared samples.

    Missing is NULL throughout: NaN and infinite coordinates; NaN, infinite, zero and negative
    intensities.
    """
    names = df.columns
    flat = df.toDF(*[f"c{i}" for i in range(len(names))])
    of = lambda name: F.col(f"c{names.index(name)}")
    positive = lambda c: F.when(finite(c) > 0, c.cast("double"))
    vector = F.array(*[positive(of(s)) for s in samples]) if samples else F.array().cast("array<double>")
    return flat.select(of("_idx").alias("idx"), finite(of(columns.mz)).alias("mz"), finite(of(columns.rt)).alias("rt"), vector.alias("x"))
