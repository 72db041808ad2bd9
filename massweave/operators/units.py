"""Quantities recorded in different units and notations: bring times to seconds.

Two physical identities are used.  ``recorded value x unit factor = retention time of the
standard``: every record belongs to an internal standard known by its m/z (and by its name),
whose nominal time in seconds is known to a few percent.  And among the columns of a record
``rtmin <= rt <= rtmax``.  All readings of the written numbers (decimal comma or thousands
mark) are combined with all units, and the combination of the three columns with the smallest
sum of log residuals wins, whatever labels say: that of rt against the nominal time, those of
the bounds against rt, with ``WRONG_ORDER`` added for a bound on the wrong side.  Bounds do
not depend on each other once rt is fixed, so the sum is minimised over each on its own for
every reading of rt, which is exact.  A record without rt has its bounds judged against the
nominal time.  Combinations that come within ``SAME_SECONDS`` of the best (``880,463`` is
880.463 s or 880 463 ms) are flagged as not unique and settled by the unit written beside the
number, then by the unit most other fields of the file use, then in favour of the thousands
mark.

Notations that mix units (``3:09.4``, ``PT3M9.4S``, ``3 min 9.4 s``) are parsed as such.

Defined results
  * NULL, blank, ``NaN``, ``-`` and any text without a readable time give NULL seconds, a
    NULL unit and no case;
  * negative and zero times are unreadable;
  * without a standard within the m/z window the standard's name counts, without either
    the geometric middle of all nominal times; without any standards plain numbers are taken
    as seconds, flagged as not unique;
  * repeated rows of a record count once, the smallest content wins;
  * an empty table gives an empty result, extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from massweave.plans.runtime import broadcast_if_small, computed_once, cut_lineage, split_hot

#: Seconds in a unit.
UNIT_SECONDS = {"s": 1.0, "min": 60.0, "h": 3600.0, "ms": 0.001}

#: Spellings of the units, in lower case and without full stops.
UNIT_WORDS = {
    "s": "s sec secs second seconds sek sekunde sekunden",
    "min": "min mins minute minutes minuten",
    "h": "h hr hrs hour hours std stunde stunden",
    "ms": "ms msec msecs millisec millisecs millisecond milliseconds millisekunden",
}

#: Largest table of standards that is sent to all executors.
MOST_STANDARDS = 20_000

#: A second combination this close (natural log) to the best one makes it not unique.
SAME_SECONDS = 1e-3

#: Added to the residual of a bound on the wrong side of rt.
WRONG_ORDER = 0.05

#: White space of any kind, no-break and thin spaces included.
BLANKS = r"[\s\u00A0\u2000-\u200B\u202F\u205F\u3000\uFEFF]+"

#: A number that is read with a decimal comma and with a thousands mark.
TWO_READINGS = r"^[1-9]\d{0,2},\d{3}$"

#: Numbers that can be read in one way only, without any unit.
_PLAIN = r"^\d+\.?\d*$"

#: Seconds alone in the ISO notation.
_ISO_SECONDS = r"^pt(\d+(?:[.,]\d+)?)s$"

_ISO = r"^pt(?:(\d+)h)?(?:(\d+)m)?(?:(\d+(?:[.,]\d+)?)s)?$"
_CLOCK = r"^(?:(\d+):)?(\d+):(\d+(?:[.,]\d+)?)$"
_WORDS = r"^(?:(\d+) ?h(?:ours?|rs?)? ?)?(?:(\d+) ?min(?:s|utes?)?\.? ?)?(\d+(?:[.,]\d+)?) ?s(?:ec|econds?)?\.?$"

#: Notations that mix units, their hours, minutes and seconds in groups.
MIXED_NOTATIONS = (_ISO, _CLOCK, _WORDS)

#: A number, and a word for its unit.
WRITTEN_NUMBER = r"^([+]?[0-9][0-9.,]*(?:e[+-]?[0-9]+)?) ?([a-z]+)?\.?$"


def _decimal(text: Column) -> Column:
    return F.regexp_replace(text, ",", ".").try_cast("double")


def _group(text: Column, pattern: str, k: int) -> Column:
    found = F.regexp_extract(text, pattern, k)
    return F.when(found != "", found)


def clean_text(raw: Column) -> Column:
    """Lower case, every kind of blank as one plain blank, no blanks at the ends."""
    return F.trim(F.lower(F.regexp_replace(raw.cast("string"), BLANKS, " ")))


def mixed_seconds(text: Column) -> Column:
    """Seconds of a notation that mixes units; NULL for any other text."""
    parts = []
    for pattern in MIXED_NOTATIONS:
        h, m, s = (_decimal(_group(text, pattern, k)) for k in (1, 2, 3))
        total = F.coalesce(h, F.lit(0.0)) * 3600 + F.coalesce(m, F.lit(0.0)) * 60 + F.coalesce(s, F.lit(0.0))
        parts.append(F.when(text.rlike(pattern) & (h.isNotNull() | m.isNotNull()), total))
    # Most texts are a number and at most one word; they need no further look.
    several = text.contains(":") | text.startswith("pt") | text.rlike(r"[a-z]\.? ?\d")
    return F.when(several, F.coalesce(*parts))


def _bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def number_readings(number: Column) -> Column:
    """Readings of a written number as ``struct<marked, plain>``: with thousands marks, and without."""
    both = lambda marked, plain: F.struct(marked.alias("marked"), plain.alias("plain"))
    none = F.lit(None).cast("double")
    comma, dot = number.contains(","), number.contains(".")
    no_comma = F.regexp_replace(number, ",", "").try_cast("double")
    no_dot = F.regexp_replace(number, r"\.", "")
    comma_last = F.locate(",", F.reverse(number)) < F.locate(".", F.reverse(number))
    one_of_each = F.when(comma_last, _decimal(no_dot)).otherwise(no_comma)
    return (
        F.when(~comma & ~number.rlike(r"\..*\."), both(none, number.try_cast("double")))
        .when(comma & dot, both(one_of_each, none))
        .when(number.rlike(r"^\d{1,3}(,\d{3}){2,}$"), both(no_comma, none))
        .when(number.rlike(r"^\d{1,3}(\.\d{3}){2,}$"), both(no_dot.try_cast("double"), none))
        .when(number.rlike(TWO_READINGS), both(no_comma, _decimal(number)))
        .when(comma, both(none, _decimal(number)))
        .otherwise(both(none, number.try_cast("double")))
    )


def parsed(raw: Column) -> Column:
    """A written time as ``struct<mixed, marked, plain, written>``: seconds of a mixed notation, readings of a number, unit beside it."""
    none, no_unit = F.lit(None).cast("double"), F.lit(None).cast("string")
    whole = lambda mixed, marked, plain, unit: F.struct(mixed.alias("mixed"), marked.alias("marked"), plain.alias("plain"), unit.alias("written"))
    read = lambda number, unit: _bound(number_readings(number), lambda r: whole(none, r["marked"], r["plain"], unit))
    single = lambda text: _bound(F.regexp_extract(text, WRITTEN_NUMBER, 1), lambda n: read(n, unit_of_word(_group(text, WRITTEN_NUMBER, 2))))
    slow = lambda text: F.when(text.rlike(_ISO_SECONDS), read(F.regexp_extract(text, _ISO_SECONDS, 1), F.lit("s"))).otherwise(
        _bound(mixed_seconds(text), lambda m: F.when(m > 0, whole(m, none, none, no_unit)).otherwise(single(text)))
    )
    # About half of all texts are plain numbers and need no more than one look.
    return F.when(raw.rlike(_PLAIN), whole(none, none, raw.try_cast("double"), no_unit)).when(raw.isNotNull(), _bound(clean_text(raw), slow))


def unit_of_word(word: Column) -> Column:
    """The unit a spelling stands for; NULL for an unknown one."""
    w = F.regexp_replace(F.lower(F.trim(word)), r"\.", "")
    out = F.lit(None).cast("string")
    for unit, words in UNIT_WORDS.items():
        out = F.when(w.isin(*words.split()), F.lit(unit)).otherwise(out)
    return out


_OPTION = "array<struct<log:double,unit:string,marked:boolean,seconds:double>>"


def _options(time: Column) -> Column:
    """All combinations of reading and unit of a parsed time that give a usable number of seconds."""
    option = lambda v, unit, factor, marked: F.struct(
        F.ln(v * factor).alias("log"), F.lit(unit).alias("unit"), F.lit(marked).alias("marked"), (v * factor).alias("seconds")
    )
    ways = [option(time[field], unit, F.lit(f), marked) for field, marked in (("marked", True), ("plain", False)) for unit, f in UNIT_SECONDS.items()]
    usable = lambda o: (o["seconds"] > 0) & (o["seconds"] < float("inf"))
    plain_only = F.filter(F.array(*ways[len(UNIT_SECONDS) :]), usable)
    return (
        F.when(time["mixed"] > 0, F.array(option(time["mixed"], "mixed", F.lit(1.0), False)))
        .when(time["marked"].isNull(), F.coalesce(plain_only, F.array().cast(_OPTION)))
        .otherwise(F.filter(F.array(*ways), usable))
    )


def solve(df: DataFrame, fields: tuple[str, str, str], nominal: str) -> DataFrame:
    """Replace the parsed times ``fields`` (middle, low, high) by ``<field>_close`` and ``<field>_written``.

    ``close`` holds the combinations of reading and unit that occur in a solution for all
    three fields within ``SAME_SECONDS`` of the best.  Each step is a column of its own, so
    that nothing is computed twice.
    """
    rest = [c for c in df.columns if c not in fields]
    middle, low, high = fields
    step = df.select(*rest, *[F.col(f)["written"].alias(f"{f}_written") for f in fields], *[_options(F.col(f)).alias(f"_o_{f}") for f in fields])
    away = lambda d: F.when(d >= 0, d).otherwise(F.lit(WRONG_ORDER) - d)
    off = {low: lambda r, o: F.coalesce(away(r["log"] - o["log"]), F.lit(0.0)), high: lambda r, o: F.coalesce(away(o["log"] - r["log"]), F.lit(0.0))}
    best = lambda r, f: F.coalesce(F.array_min(F.transform(f"_o_{f}", lambda o: off[f](r, o))), F.lit(0.0))
    log = F.ln(F.col(nominal))
    # Without a middle the nominal time stands for it.
    anchor = F.array(F.struct(log.alias("log"), F.lit(None).cast("string").alias("unit"), F.lit(False).alias("marked"), F.lit(None).cast("double").alias("seconds"))).cast(_OPTION)
    scored = F.transform(
        F.when(F.size(f"_o_{middle}") > 0, F.col(f"_o_{middle}")).otherwise(anchor),
        lambda r: F.struct(r["log"].alias("log"), r["unit"].alias("unit"), r["marked"].alias("marked"), r["seconds"].alias("seconds"),
                           F.coalesce(F.abs(r["log"] - log), F.lit(0.0)).alias("own"), best(r, low).alias("low"), best(r, high).alias("high")),
    )
    total = lambda s: s["own"] + s["low"] + s["high"]
    step = computed_once(step.withColumn("_scored", scored)).withColumn("_least", F.array_min(F.transform("_scored", total)))
    step = step.withColumn("_near", F.filter("_scored", lambda s: total(s) <= F.col("_least") + SAME_SECONDS))
    kept = lambda f, part: F.filter(f"_o_{f}", lambda o: F.exists("_near", lambda s: off[f](s, o) <= s[part] + SAME_SECONDS))
    own = F.transform(F.filter("_near", lambda s: s["unit"].isNotNull()), lambda s: F.struct(s["log"].alias("log"), s["unit"].alias("unit"), s["marked"].alias("marked"), s["seconds"].alias("seconds")))
    return step.select(*rest, *[f"{f}_written" for f in fields], own.alias(f"{middle}_close"), kept(low, "low").alias(f"{low}_close"), kept(high, "high").alias(f"{high}_close"))


def settle(df: DataFrame) -> DataFrame:
    """Replace ``close`` by ``seconds`` and ``unit``; ``usual`` is the file's usual unit."""
    rank = lambda unit: F.element_at(F.create_map(*[F.lit(x) for k, u in enumerate([*UNIT_SECONDS, "mixed"]) for x in (u, k)]), unit)
    key = lambda o: F.struct(
        F.coalesce((o["unit"] != F.col("written")).cast("int"), F.lit(0)).alias("k1"),
        F.coalesce((o["unit"] != F.col("usual")).cast("int"), F.lit(0)).alias("k2"),
        (~o["marked"]).alias("k3"),
        rank(o["unit"]).alias("k4"),
        o["unit"].alias("unit"),
        o["seconds"].alias("seconds"),
    )
    one = F.get("close", F.lit(0))
    return (
        df.withColumn("_best", F.when(F.size("close") > 1, F.array_min(F.transform("close", key))))
        .withColumn("seconds", F.coalesce(F.col("_best.seconds"), one["seconds"]))
        .withColumn("unit", F.coalesce(F.col("_best.unit"), one["unit"]))
        .drop("_best", "close")
    )


def standard_times(standards: DataFrame, window_ppm: float) -> tuple[DataFrame, DataFrame, float | None]:
    """Nominal seconds by m/z cell and by name, and their geometric middle."""
    usable = standards.where((F.col("rt_seconds") > 0))
    middle = usable.agg(F.avg(F.ln("rt_seconds"))).first()[0]
    cell = F.floor(F.ln("mz") / F.lit(window_ppm * 1e-6))
    by_mz = usable.where(F.col("mz") > 0).select(
        F.explode(F.array(cell - 1, cell, cell + 1)).alias("_cell"), F.col("mz").alias("_mz"), F.col("rt_seconds").alias("_by_mz")
    )
    by_name = usable.groupBy(clean_text(F.col("standard_name")).alias("_name")).agg(F.min("rt_seconds").alias("_by_name"))
    return by_mz, by_name, middle


def field_seconds(
    records: DataFrame,
    standards: DataFrame,
    fields: tuple[str, str, str] = ("rt", "rtmin", "rtmax"),
    identity: str = "record_id",
    file: str = "file_name",
    window_ppm: float = 20.0,
) -> DataFrame:
    """One row for each field of each record; ``fields`` are a middle and its lower and upper bound.

    ``(identity, field, seconds, unit, unique, label_agrees)``: ``unit`` is ``s``, ``min``,
    ``h``, ``ms``, ``mixed`` or NULL; ``label_agrees`` is NULL where no unit is written,
    neither beside the number nor in ``rt_unit``.
    """
    by_mz, by_name, middle = standard_times(standards, window_ppm)
    mz = F.col("mz").cast("double")
    off = F.abs(F.col("mz") - F.col("_mz"))
    near = off <= F.col("_mz") * F.lit(window_ppm * 1e-6)
    rows = records.where(F.col(identity).isNotNull()).select(identity, file, "mz", "standard_label", "rt_unit", *fields)
    joined = (
        rows.withColumn("_cell", F.when(mz > 0, F.floor(F.ln(mz) / F.lit(window_ppm * 1e-6))))
        .withColumn("_name", clean_text(F.col("standard_label")))
        .join(broadcast_if_small(by_mz, 3 * MOST_STANDARDS), "_cell", "left")
        .join(broadcast_if_small(by_name, MOST_STANDARDS), "_name", "left")
    )
    # The first field puts rows without a close standard last, so the minimum is the nearest.
    best = F.struct(
        F.coalesce(~near, F.lit(True)).alias("far"),
        F.when(near, off).alias("off"),
        F.when(near, F.col("_by_mz")).alias("by_mz"),
        F.col("_by_name").alias("by_name"),
        F.col(file).alias("file"),
        F.col("rt_unit").alias("label"),
        *[F.col(f).cast("string").alias(f"f_{f}") for f in fields],
    )
    wide = joined.groupBy(identity).agg(F.min(best).alias("r")).select(
        identity,
        F.col("r.file").alias("_file"),
        F.col("r.label").alias("_label"),
        F.coalesce("r.by_mz", "r.by_name", F.lit(None if middle is None else math.exp(middle)).cast("double")).alias("_nominal"),
        *[parsed(F.col(f"r.f_{f}")).alias(f) for f in fields],
    )
    solved = solve(computed_once(wide), fields, "_nominal")
    each = [F.struct(F.lit(f).alias("field"), F.col(f"{f}_close").alias("close"), F.col(f"{f}_written").alias("written")) for f in fields]
    long = solved.select(identity, "_file", "_label", F.explode(F.array(*each)).alias("_f")).select(identity, "_file", "_label", "_f.*")
    # Solved once: the files' habits and the results are both read from what is written.
    long = cut_lineage(long.withColumn("unique", F.when(F.size("close") > 0, F.size("close") == 1)))
    sure = F.when(F.col("unique"), F.get("close", F.lit(0))["unit"])
    counts = [F.count_if(sure == u) for u in UNIT_SECONDS]
    usual = (
        long.groupBy("_file")
        .agg(
            F.array_max(F.array(*[F.struct(n.alias("n"), F.lit(u).alias("u")) for n, u in zip(counts, UNIT_SECONDS)])).alias("_m"),
            F.count_if(~F.col("unique")).alias("_open"),
        )
        .where("_open > 0 AND _file IS NOT NULL")
        .select("_file", F.when(F.col("_m.n") > 0, F.col("_m.u")).alias("usual"))
    )
    # Only fields that are not unique ask for the habits of their file.
    open_, usual = split_hot(long.where("NOT unique AND _file IS NOT NULL"), usual, ["_file"], identity)
    asked = open_.join(usual, ["_file", "_salt"], "left").drop("_salt")
    rest = long.where("unique OR unique IS NULL OR _file IS NULL").withColumn("usual", F.lit(None).cast("string"))
    return settle(rest.unionByName(asked)).select(
        identity,
        "field",
        "seconds",
        "unit",
        "unique",
        (F.coalesce(F.col("written"), unit_of_word(F.col("_label"))) == F.col("unit")).alias("label_agrees"),
    )


def to_seconds(solved: DataFrame, fields: tuple[str, ...] = ("rt", "rtmin", "rtmax"), identity: str = "record_id") -> DataFrame:
    """One row for each record from :func:`field_seconds`: seconds, unit and uniqueness by field."""
    of = lambda f, c: F.max(F.when(F.col("field") == f, F.col(c)))
    return solved.groupBy(identity).agg(
        *[of(f, c).alias(f"{f}_{c}") for f in fields for c in ("seconds", "unit", "unique", "label_agrees")]
    )


def not_in_seconds(solved: DataFrame, identity: str = "record_id") -> DataFrame:
    """Fields recorded in anything but plain seconds: ``(identity, field)``."""
    return solved.where(F.col("unit") != "s").select(identity, "field")
