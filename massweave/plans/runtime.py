"""Session helpers shared by the plans: table access, lineage cuts, size-checked broadcasts."""

from __future__ import annotations

import functools
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from massweave.sources.readers import read_parquet

_CLEAN = "spark.cleaner.referenceTracking.cleanCheckpoints"


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """One Parquet table of a data directory."""
    return read_parquet(spark, f"{directory}/{name}.parquet")


def ship_package(spark: SparkSession) -> None:
    """Send this package to the session's Python workers, once; they need not have it installed."""
    context, root = spark.sparkContext, Path(__file__).resolve().parents[1]
    if getattr(context, "_massweave_shipped", False) or not root.is_dir():
        return
    path = os.path.join(tempfile.mkdtemp(prefix="massweave-"), f"{root.name}.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for file in sorted(root.rglob("*.py")):
            z.write(file, file.relative_to(root.parent))
    context.addPyFile(path)
    context._massweave_shipped = True


def query(build):
    """Mark a builder ``(spark, directory) -> DataFrame`` of the catalogue."""

    @functools.wraps(build)
    def run(spark: SparkSession, directory: str) -> DataFrame:
        ship_package(spark)
        return build(spark, directory)

    return run


def _checkpoint_folder(spark: SparkSession) -> None:
    """Have the session checkpoint into the shared folder that it names."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
        folder = tempfile.mkdtemp(prefix="massweave-")  # one machine only, as in tests
    context.setCheckpointDir(folder)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, for tables of passage."""
    _checkpoint_folder(spark)
    return spark.sparkContext.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it back.

    The folder is the one the session names in ``spark.checkpoint.dir``.  What is written is
    removed when nothing refers to it any more, unless the session says otherwise.
    """
    _checkpoint_folder(df.sparkSession)
    conf = df.sparkSession.sparkContext._jsc.sc().conf()
    if not conf.contains(_CLEAN):
        conf.set(_CLEAN, "true")
    return df.checkpoint(eager=True)


def small_enough(df: DataFrame, most_rows: int) -> bool:
    """Whether ``df`` has at most ``most_rows`` rows; reads no more than that."""
    return df.limit(most_rows + 1).count() <= most_rows


def broadcast_if_small(df: DataFrame, most_rows: int) -> DataFrame:
    """Hint a broadcast only behind a check of the size; else the planner's choice stays."""
    return F.broadcast(df) if small_enough(df, most_rows) else df


#: Rows of one key that a join leaves in one task; keys with more are split.
HOT_ROWS = 200_000

#: Largest table of hot keys that is sent to all executors.
MOST_HOT_KEYS = 100_000


def split_hot(many: DataFrame, one: DataFrame, keys: list[str], identity: str, hot_rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join on ``keys`` with a further key ``_salt``, which splits keys that hold very many rows of ``many``.

    Keys are never NULL.  Rows of ``many`` are dealt out by ``identity``, rows of ``one`` are
    repeated for each part; a key of few rows has one part, so nothing is repeated for it.
    """
    hot_rows = hot_rows or HOT_ROWS
    hot = many.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > hot_rows)
    hot = cut_lineage(hot.select(*keys, F.ceil(F.col("_rows") / hot_rows).alias("_parts")))
    if hot.isEmpty():
        return many.withColumn("_salt", F.lit(0)), one.withColumn("_salt", F.lit(0))
    hot = broadcast_if_small(hot, MOST_HOT_KEYS)
    parts = F.coalesce("_parts", F.lit(1))
    salt = F.pmod(F.xxhash64(identity), parts).cast("int")
    return (
        many.join(hot, keys, "left").withColumn("_salt", salt).drop("_parts"),
        one.join(hot, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), (parts - 1).cast("int")))).drop("_parts"),
    )


def computed_once(df: DataFrame) -> DataFrame:
    """Keep the optimiser from inlining the columns of ``df`` into later filters.

    A predicate is never pushed through a generator whose output it reads, so a generator of
    exactly one row keeps expensive expressions from being evaluated again in every filter.
    """
    return df.select(F.inline(F.array(F.struct(*df.columns))))
