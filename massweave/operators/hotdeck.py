"""Filling missing values from similar records of the same group: nearest-neighbour hot deck.

A missing intensity is copied from donors: records of the same study that hold a real value
in the field.  Records are hash-blocked, by a hash of 64 bits, on their observed mixed features: study and field, and
inside them ionisation mode and the rounded level of another group's sample.  The distance of
two records is the difference of their log levels in a companion sample, plus ``OTHER_BLOCK``
if mode or rounded level differ; the closest donors are found exactly, without forming pairs:

1. of donors at one level only the first few by identity can be among the closest, and all
   records asking at one level get the same donors, so both are reduced to a few rows for each
   level, before they are shuffled;
2. levels are cut into narrow cells; inside a cell the donors next to a level are looked up
   in the order of levels; the few last donors of the cells before and the few first of the
   cells after are carried over, so no border hides a donor;
3. the donors found in the own block and in the whole study are merged by distance.

The value is the median of the donors weighted by closeness.  A record without a level, or
without a donor within ``FARTHEST``, gets the study's own median.  A missing mode is the
majority of the same study and group of peaks, then of the study.

What is missing
  * an intensity that is NULL, NaN, infinite, zero or negative, or a stand-in: a value that a
    study writes again and again, far more often than values of that size repeat by chance;
  * a mode text that names no mode.
  A sample of a group of which a study measured no sample at all is not missing but absent,
  and stays NULL.

Defined results
  * repeated deliveries of a record count once, the one loaded last;
  * rows without an identity are left out, a NULL study is a study of its own;
  * equally close donors are ordered by identity, equally distant ones of the own block and others too;
  * a value for which no donor exists anywhere stays NULL, still marked as missing;
  * an empty table gives an empty result, extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from massweave.operators.intervals import latest_rows
from massweave.plans.runtime import broadcast_if_small, cut_lineage, split_hot

#: Spellings of the two ionisation modes, in lower case.
POSITIVE = ("positive", "pos", "p", "+", "+ve", "pos.", "esi+", "positiv")
NEGATIVE = ("negative", "neg", "n", "-", "-ve", "neg.", "esi-", "negativ")

#: A stand-in occurs at least so often in a study, and so many times more often than chance.
LEAST_REPEATS = 3
OVER_CHANCE = 20.0

#: Smallest difference between two written intensities.
RESOLUTION = 1e-4

#: Donors copied from.
DONORS = 5

#: Added to the distance of a donor of another mode or another rounded level.
OTHER_BLOCK = 0.125

#: Largest difference of log levels of a donor.
FARTHEST = 1.0

#: Largest table of studies, or of groups of peaks, that is sent to all executors.
MOST_STUDIES = 200_000

#: Cells to one unit of log level.
CELLS = 16

DONOR_LIST = "array<struct<level:double,feature_id:bigint,value:double>>"

DONOR_NEAR = "array<struct<gap:double,feature_id:bigint,value:double>>"


@dataclass(frozen=True)
class Field:
    """An intensity field, the samples of its group, and its companions in order of preference."""

    name: str
    group: tuple[str, ...]
    companions: tuple[str, ...]


def sample_field(name: str, groups: tuple[str, ...] = ("BS4", "BS80", "LL", "LP", "Mix", "VN"), replicates: int = 3) -> Field:
    """The field of a sample called ``<group>_<number>``."""
    own = name.rsplit("_", 1)[0]
    group = tuple(f"{own}_{k + 1}" for k in range(replicates))
    others = tuple(f"{g}_{k + 1}" for g in groups if g != own for k in reversed(range(replicates)))
    return Field(name, group, tuple(c for c in group if c != name) + others)


def mode(c: Column) -> Column:
    """The ionisation mode a text names, NULL where it names none."""
    text = F.lower(F.trim(c))
    return F.when(text.isin(*POSITIVE), F.lit("positive")).when(text.isin(*NEGATIVE), F.lit("negative"))


def measured(c: Column) -> Column:
    """The value if it is positive and finite, else NULL."""
    c = c.cast("double")
    return F.when((c > 0) & ~F.isnan(c) & (c < F.lit(float("inf"))), c)


def stand_ins(rows: DataFrame, fields: list[str], study: str = "study") -> DataFrame:
    """``(study, value)`` of values a study writes again and again.

    Chance is judged by the study's own values of about the same size: their number over the
    number of values that can be written in that range.
    """
    values = (
        rows.select(study, F.explode(F.array(*[measured(F.col(f)) for f in fields])).alias("value"))
        .where("value IS NOT NULL")
        .groupBy(study, "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    step = 0.05
    cell = F.floor(F.ln("value") / F.lit(step))
    often = values.where(F.col("n") >= LEAST_REPEATS).withColumn("cell", cell)
    around = values.groupBy(study, cell.alias("cell")).agg(F.sum("n").alias("all"))
    chance = (F.col("all") - F.col("n")) * F.lit(RESOLUTION) / (F.exp(F.col("cell") * step) * F.lit(step))
    same = F.col("a." + study).eqNullSafe(F.col("b." + study)) & (F.col("a.cell") == F.col("b.cell"))
    return (
        often.alias("a")
        .join(around.alias("b"), same)
        .select(F.col("a." + study).alias(study), "value", "n", F.col("b.all").alias("all"), F.col("a.cell").alias("cell"))
        .where(F.col("n") > F.lit(OVER_CHANCE) * chance)
        .select(study, "value")
    )


def _weighted_median(near: Column) -> Column:
    """Value at which the summed weights pass one half, of ``array<struct<value, weight>>``."""
    ordered = F.array_sort(near)
    half = F.aggregate(near, F.lit(0.0), lambda a, d: a + d["weight"]) / 2
    state = F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("value"))
    return F.aggregate(
        ordered,
        state,
        lambda a, d: F.struct(
            (a["sum"] + d["weight"]).alias("sum"),
            F.when(a["value"].isNull() & (a["sum"] + d["weight"] >= half), d["value"]).otherwise(a["value"]).alias("value"),
        ),
        lambda a: a["value"],
    )


def _nearest(entries: DataFrame) -> DataFrame:
    """``(_block, level, _near)``: up to ``DONORS`` closest donors of a block for every level asked.

    ``entries`` are donors (``value`` not NULL) and records that ask, each in its blocks.
    """
    # Few rows of a level survive, on the near side of the shuffle already.
    few = F.row_number().over(W.partitionBy("_block", "level", "_asks").orderBy("feature_id"))
    rows = entries.withColumn("_k", few).where(F.col("_k") <= DONORS).where(~F.col("_asks") | (F.col("_k") == 1)).drop("_k")
    rows = rows.withColumn("_cell", F.floor(F.col("level") * CELLS))
    donor = F.when(~F.col("_asks"), F.struct("level", "feature_id", "value"))
    # Donors come first in this order, so records that ask take up no places.
    cell = W.partitionBy("_block", "_cell")
    donors_first, by_level = cell.orderBy("_asks", "level", "feature_id"), cell.orderBy("level", "_asks", "feature_id")
    # The closest lie on at most so many places on a side: all but one of them, and the donors at the level of the last.
    reach = 2 * DONORS - 1
    around = F.collect_list(donor).over(donors_first.rowsBetween(1 - reach, reach))
    gap = lambda d: F.abs(d["level"] - F.col("level"))
    near = lambda found: F.slice(
        F.array_sort(F.transform(F.filter(found, lambda d: gap(d) <= FARTHEST), lambda d: F.struct(gap(d).alias("gap"), d["feature_id"].alias("feature_id"), d["value"].alias("value")))), 1, DONORS
    )
    marked = (
        rows.withColumn("_around", F.when(~F.col("_asks"), around))
        .withColumn("_place", F.row_number().over(donors_first))
        .withColumn("_donors", F.count(donor).over(cell))
        .withColumn("_before", F.last("_around", ignorenulls=True).over(by_level.rowsBetween(W.unboundedPreceding, 0)))
        .withColumn("_first", F.max(F.when((F.col("_place") == 1) & ~F.col("_asks"), F.col("_around"))).over(cell))
        .withColumn("_head", ~F.col("_asks") & (F.col("_place") <= DONORS))
        .withColumn("_tail", ~F.col("_asks") & (F.col("_place") > F.col("_donors") - DONORS))
        .where("_asks OR _head OR _tail")
    )
    # What is left of a cell: its asking levels with their closest donors inside, and the few donors at its ends.
    inside = F.when(F.col("_asks"), near(F.coalesce("_before", "_first", F.array().cast(DONOR_LIST))))
    kept = cut_lineage(marked.select("_block", "_cell", "level", "_asks", inside.alias("_inside"), donor.alias("_donor"), "_head", "_tail"))
    edges = kept.groupBy("_block", "_cell").agg(F.collect_list(F.when(F.col("_head"), F.col("_donor"))).alias("_firsts"), F.collect_list(F.when(F.col("_tail"), F.col("_donor"))).alias("_lasts"), F.max("_asks").alias("_wants"))
    some = lambda c: F.when(F.size(c) > 0, F.col(c))
    # Cells without donors hold nothing to carry but need what is carried, so distances count donor cells only.
    upto = W.partitionBy("_block").orderBy("_cell").rowsBetween(W.unboundedPreceding, 0)
    by_count = W.partitionBy("_block").orderBy("_n")
    place = lambda d: F.floor(d["level"] * CELLS)
    closest = lambda c, sign, other: F.transform(
        F.slice(F.array_sort(F.transform(F.filter(c, other), lambda d: F.struct((d["level"] * sign).alias("by"), d["feature_id"].alias("feature_id"), d["value"].alias("value")))), 1, DONORS),
        lambda d: F.struct((d["by"] * sign).alias("level"), d["feature_id"].alias("feature_id"), d["value"].alias("value")),
    )
    # A cell with donors has the number _n itself, one without shares the number of the last one before.
    left = F.flatten(F.collect_list(some("_lasts")).over(by_count.rangeBetween(-DONORS, 0)))
    right = F.flatten(F.collect_list(some("_firsts")).over(by_count.rangeBetween(0, DONORS)))
    carried = (
        edges.withColumn("_n", F.sum((F.size("_lasts") > 0).cast("long")).over(upto))
        .withColumn("_left", left)
        .withColumn("_right", right)
        .where("_wants")
        .select("_block", "_cell", closest("_left", -1.0, lambda d: place(d) < F.col("_cell")).alias("_left"), closest("_right", 1.0, lambda d: place(d) > F.col("_cell")).alias("_right"))
    )
    return (
        kept.where("_asks")
        .join(carried, ["_block", "_cell"])
        .select("_block", "level", F.slice(F.array_sort(F.array_distinct(F.concat("_inside", near(F.array_distinct(F.concat("_left", "_right")))))), 1, DONORS).alias("_near"))
    )


def prepare(rows: DataFrame, fields: list[Field], study: str = "study", polarity: str = "polarity") -> DataFrame:
    """One row for each record: real values of the fields, levels, mode, and what is missing."""
    columns = sorted({c for f in fields for c in (f.name, *f.group, *f.companions)})
    latest = latest_rows(rows, "feature_id", "loaded_at", [study, polarity, "pcgroup", *columns])
    names = [f.name for f in fields]
    repeated = cut_lineage(stand_ins(latest, names, study).groupBy(F.col(study).alias("_s")).agg(F.collect_list("value").alias("_repeated")))
    joined = (
        latest.join(broadcast_if_small(repeated, MOST_STUDIES), F.col(study).eqNullSafe(F.col("_s")), "left")
        .drop("_s")
        .withColumn("_repeated", F.coalesce("_repeated", F.array().cast("array<double>")))
    )
    real = {c: measured(F.col(c)) for c in columns}
    for n in names:
        real[n] = F.when(~F.array_contains("_repeated", real[n]), real[n])
    return joined.select(
        "feature_id", F.col(study).alias("study"), "pcgroup", mode(F.col(polarity)).alias("_mode"), *[real[c].alias(c) for c in columns]
    )


def fill(rows: DataFrame, fields: list[Field], polarity: str = "polarity") -> DataFrame:
    """``(feature_id, field, filled_number, filled_text, depth, donors)`` of every missing field.

    ``depth`` is 0 if all donors are of the own block, 1 if all are of the study and about as
    close, 2 if some are farther, 3 for the study's own median, NULL where nothing could be
    filled.
    """
    ready = cut_lineage(prepare(rows, fields, polarity=polarity))
    absent = ready.groupBy(F.col("study").alias("_s")).agg(
        *[F.max(F.coalesce(*[F.col(c) for c in f.group]).isNotNull()).alias(f"_has_{f.name}") for f in fields],
        *[F.percentile_approx(f.name, 0.5).alias(f"_median_{f.name}") for f in fields],
    )
    # One row for each study: beside a crowded one its rows stay where they are.
    joined = ready.join(broadcast_if_small(cut_lineage(absent), MOST_STUDIES), F.col("study").eqNullSafe(F.col("_s"))).drop("_s")
    sides = []
    for f in fields:
        level = F.ln(F.coalesce(*[F.col(c) for c in f.companions]))
        side = F.ln(F.coalesce(*[F.col(c) for c in f.companions[len(f.group) - 1 :]]))
        sides.append(
            F.struct(
                F.lit(f.name).alias("field"),
                F.col(f.name).alias("value"),
                F.col(f"_has_{f.name}").alias("wanted"),
                F.col(f"_median_{f.name}").alias("median"),
                level.alias("level"),
                F.coalesce(F.floor(side), F.lit(-1000)).alias("_side"),
            )
        )
    # A study without a name has a mark of its own.
    study = F.coalesce(F.concat(F.lit("="), F.col("study").cast("string")), F.lit("")).alias("_study")
    cells = joined.select("feature_id", study, F.coalesce("_mode", F.lit("")).alias("_mode"), F.explode(F.array(*sides)).alias("_c")).select("feature_id", "_study", "_mode", "_c.*")
    cells = cut_lineage(cells.where("value IS NOT NULL OR wanted"))
    # Every record stands in its own block (depth 0) and in its study (depth 1); a block is known by its hash.
    own, whole = F.xxhash64(F.lit(0), "_study", "field", "_mode", "_side"), F.xxhash64(F.lit(1), "_study", "field")
    both = F.explode(F.array(F.struct(F.lit(0).alias("_depth"), own.alias("_block")), F.struct(F.lit(1).alias("_depth"), whole.alias("_block")))).alias("_b")
    placed = cells.where("level IS NOT NULL").select("feature_id", "field", "level", "value", F.col("value").isNull().alias("_asks"), both)
    placed = placed.select("feature_id", "field", "level", "value", "_asks", "_b.*")
    near = _nearest(placed.drop("field", "_depth"))
    asking = placed.where("_asks").select("feature_id", "field", "_depth", "_block", "level")
    asking, near = split_hot(asking, near, ["_block", "level"], "feature_id")
    # Two short lists for each record.
    lists = asking.join(near, ["_block", "level", "_salt"]).groupBy("feature_id", "field").agg(
        F.max(F.when(F.col("_depth") == 0, F.col("_near"))).alias("_own"), F.max(F.when(F.col("_depth") == 1, F.col("_near"))).alias("_all")
    )
    none = F.array().cast(DONOR_NEAR)
    entry = lambda d, own: F.struct((d["gap"] + (0.0 if own else OTHER_BLOCK)).alias("distance"), d["feature_id"].alias("feature_id"), d["value"].alias("value"), F.lit(own).alias("own"))
    others = F.filter("_all", lambda d: ~F.array_contains(F.transform("_own", lambda o: o["feature_id"]), d["feature_id"]))
    merged = (
        lists.withColumn("_own", F.coalesce("_own", none))
        .withColumn("_all", F.coalesce("_all", none))
        .withColumn("_near", F.concat(F.transform("_own", lambda d: entry(d, True)), F.transform(others, lambda d: entry(d, False))))
        .withColumn("_near", F.slice(F.array_sort("_near"), 1, DONORS))
        .select(
            "feature_id",
            "field",
            _weighted_median(F.transform("_near", lambda d: F.struct(d["value"].alias("value"), (1 / (d["distance"] + F.lit(0.01))).alias("weight")))).alias("filled"),
            F.when(F.forall("_near", lambda d: d["own"]), 0).when(F.forall("_near", lambda d: d["distance"] <= 2 * OTHER_BLOCK), 1).otherwise(2).alias("depth"),
            F.transform("_near", lambda d: d["feature_id"]).alias("donors"),
        )
    )
    numbers = (
        cells.where("value IS NULL")
        .select("feature_id", "field", "median")
        .join(merged, ["feature_id", "field"], "left")
        .select(
            "feature_id",
            "field",
            F.coalesce("filled", "median").alias("filled_number"),
            F.lit(None).cast("string").alias("filled_text"),
            F.when(F.col("filled").isNotNull(), F.col("depth")).when(F.col("median").isNotNull(), 3).alias("depth"),
            F.coalesce("donors", F.array().cast("array<bigint>")).alias("donors"),
        )
    )
    return numbers.unionByName(_fill_mode(ready, polarity))


def _fill_mode(ready: DataFrame, polarity: str) -> DataFrame:
    """Majority of the same study and group of peaks, then of the study."""

    def majority(keys: list[str], out: str) -> DataFrame:
        votes = ready.where("_mode IS NOT NULL").groupBy(*keys, "_mode").agg(F.count(F.lit(1)).alias("n"), F.min("feature_id").alias("_one"))
        best = votes.groupBy(*keys).agg(F.max(F.struct(F.col("n"), -F.col("_one"), F.col("_mode"))).alias("_b"))
        return best.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_b._mode").alias(out), (-F.col("_b.col2")).alias(f"{out}_donor"))

    group, study = (broadcast_if_small(cut_lineage(majority(*of)), MOST_STUDIES) for of in ((["study", "pcgroup"], "_by_group"), (["study"], "_by_study")))
    return (
        ready.where("_mode IS NULL")
        .select("feature_id", "study", "pcgroup")
        .join(group, F.col("study").eqNullSafe(F.col("_k_study")) & (F.col("pcgroup") == F.col("_k_pcgroup")), "left")
        .drop("_k_study", "_k_pcgroup")
        .join(study, F.col("study").eqNullSafe(F.col("_k_study")), "left")
        .select(
            "feature_id",
            F.lit(polarity).alias("field"),
            F.lit(None).cast("double").alias("filled_number"),
            F.coalesce("_by_group", "_by_study").alias("filled_text"),
            F.when(F.col("_by_group").isNotNull(), 0).when(F.col("_by_study").isNotNull(), 3).alias("depth"),
            F.array_compact(F.array(F.coalesce("_by_group_donor", "_by_study_donor"))).alias("donors"),
        )
    )
