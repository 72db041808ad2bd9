"""Matching features of two tables that share no key: a deterministic rule cascade.

Both tables describe the features of the same studies by noisy attributes: study name, m/z,
retention time, bounds and peak areas.  The second table's coordinates are shifted and drift,
its areas have another scale.  So the first step calibrates each study on pairs that agree in
all attributes, and moves the first table into the second table's frame.  Then rules of
decreasing strength follow, each an exact join on cells of the attributes it uses; resolved
rows are anti-joined before the next rule:

====  ==============================  ===========================================
rule  attributes joined               for
====  ==============================  ===========================================
1     study, m/z, RT, areas           rows with everything
2     study, m/z, RT                  too few common areas
3     study, m/z, areas               no RT on one side (bounds only, or nothing)
4     study, RT, areas                no m/z on one side (bounds only, or nothing)
5     m/z, RT, areas                  no study name on one side
6     m/z, areas                      no study name, no RT on one side
7     study, bounds, areas            a coordinate known from its bounds only
8     bounds, areas                   the same without study name
9     m/z, RT                         no study name, too few common areas
10    study, bounds                   bounds only, too few common areas
====  ==============================  ===========================================

Within a rule a pair must be the best of both its rows (least cost, then smallest ids); rows
whose best partner went to another are tried again until no pair is added.

*Confidence.*  Pairs of rule 1 whose rows have one candidate each are the labelled pairs.  All
of them are put through every rule with the attributes masked that the rule does without;
rules that take the middle of bounds get the middle of the labelled rows' bounds.  Each
labelled row is counted twice: with its partner among the candidates, where the label is the
right answer, and with the partner taken out, where every answer is wrong, weighted by the
share of rows that rule 1 finds no partner for.  So a rule is also charged for answering where
there is nothing to be found, which labels alone never show.  The precision, smoothed as
(right + 1) / (answers + 2), is the confidence of the rule's pairs.  Pairs of studies compared
in wider windows have a precision of their own, measured in those windows and with the shift
of all studies together.

Defined results
  * rows delivered again count once (the last by ``loaded_at``, ``exported_at``); rows without
    an id are left out; each feature gets at most one partner;
  * study names are the same if their numbers are (else their letters); a row of the first
    table without a study is compared like those of a study without a calibration;
  * a study with fewer than ``LEAST_ANCHORS`` anchors keeps the shift of all studies
    together and is compared in a wider window;
  * NULL, NaN, infinite and non-positive coordinates and areas are missing; missing
    coordinates are taken from the middle of usable bounds, in a wider window;
  * empty tables give an empty result, extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from massweave.operators.hotdeck import measured
from massweave.operators.intervals import latest_rows
from massweave.plans.runtime import broadcast_if_small, computed_once, cut_lineage, split_hot

#: Samples both tables have, unless others are given.
SAMPLES = ("BS4_1", "BS4_2", "BS80_1", "BS80_2", "LL_1", "LL_2", "LP_1", "Mix_1", "VN_1")


@dataclass(frozen=True)
class Limits:
    """Windows and noise of the comparison."""

    wide_ppm: float = 25.0
    wide_seconds: float = 60.0
    ppm: float = 6.5
    seconds: float = 6.5
    loose_ppm: float = 25.0
    loose_seconds: float = 25.0
    spread: float = 0.3
    level: float = 0.4
    sigma_ppm: float = 1.5
    sigma_seconds: float = 1.3
    sigma_level: float = 0.06
    sigma_spread: float = 0.09
    anchor_seconds: float = 20.0


#: Anchors a study needs for a calibration of its own.
LEAST_ANCHORS = 8

#: Areas needed to compare profiles.
LEAST_AREAS = 3


@dataclass(frozen=True)
class Rule:
    """Which attributes a rule joins on, and which it masks when its precision is measured."""

    number: int
    study: bool
    mz: bool
    rt: bool
    areas: bool
    bounds: bool = False


RULES = (
    Rule(1, True, True, True, True),
    Rule(2, True, True, True, False),
    Rule(3, True, True, False, True),
    Rule(4, True, False, True, True),
    Rule(5, False, True, True, True),
    Rule(6, False, True, False, True),
    Rule(7, True, True, True, True, True),
    Rule(8, False, True, True, True, True),
    Rule(9, False, True, True, False),
    Rule(10, True, True, True, False, True),
)


def study_key(name: Column) -> Column:
    """What spellings of one study have in common; NULL for a blank name."""
    digits = F.ltrim(F.regexp_extract(name, r"(\d+)\D*$", 1), F.lit("0"))
    letters = F.regexp_replace(F.lower(name), r"[^\p{L}]", "")
    return F.when(digits != "", digits).when(letters != "", letters)


def _side(df: DataFrame, identity: str, study: str, prefix: str, loaded: str, samples: tuple[str, ...]) -> DataFrame:
    """``(id, study, mz, rt, has_mz, has_rt, mid_mz, mid_rt, areas)`` of one table; m/z and ``areas`` are logarithms, ``mid`` the middles of bounds."""
    columns = [study, "mz", "mzmin", "mzmax", "rt", "rtmin", "rtmax", *[prefix + s for s in samples]]
    rows = latest_rows(df, identity, loaded, columns)
    middle = lambda c: (measured(F.col(f"{c}min")) + measured(F.col(f"{c}max"))) / 2
    return rows.select(
        F.col(identity).alias("id"),
        study_key(F.col(study)).alias("study"),
        F.ln(F.coalesce(measured(F.col("mz")), middle("mz"))).alias("mz"),
        F.coalesce(measured(F.col("rt")), middle("rt")).alias("rt"),
        measured(F.col("mz")).isNotNull().alias("has_mz"),
        measured(F.col("rt")).isNotNull().alias("has_rt"),
        F.ln(middle("mz")).alias("mid_mz"),
        middle("rt").alias("mid_rt"),
        F.array(*[F.ln(measured(F.col(prefix + s))) for s in samples]).alias("areas"),
    )


def _renamed(df: DataFrame, side: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{side}_{c}") for c in df.columns])


#: Width of a cell in windows: wider ones send fewer rows into two cells, narrower ones have fewer pairs to look at.
CELL_WINDOWS = 8


def _cells(value: Column, window: float) -> Column:
    """The one or two cells that values within ``window`` lie in."""
    wide = CELL_WINDOWS * window
    return F.array_distinct(F.array(F.floor((value - window) / wide), F.floor((value + window) / wide)))


def _cell(value: Column, window: float) -> Column:
    return F.floor(value / (CELL_WINDOWS * window))


def _median(c: str) -> Column:
    return F.when(F.size(c) > 0, (F.get(c, F.expr(f"size({c}) div 2")) + F.get(c, F.expr(f"(size({c}) - 1) div 2"))) / 2)


def _profiled(pairs: DataFrame, n: str, level: str, spread: str, areas: int | None = None) -> DataFrame:
    """Add the number of common areas (of the first ``areas``), and level and spread of the logarithms of their ratios."""
    ratio = lambda x, y: y - x
    both = F.zip_with("a_areas", "b_areas", ratio) if areas is None else F.zip_with(F.slice("a_areas", 1, areas), F.slice("b_areas", 1, areas), ratio)
    return (
        pairs.withColumn("_r", F.array_sort(F.filter(both, lambda d: d.isNotNull())))
        .withColumn(level, _median("_r"))
        .withColumn("_d", F.array_sort(F.transform("_r", lambda d: F.abs(d - F.col(level)))))
        .withColumn(n, F.size("_r"))
        .withColumn(spread, _median("_d") * 1.4826)
        .drop("_r", "_d")
    )


def _may_fit(most: float, areas: int) -> Column:
    """Whether at least half of the common areas differ by at most ``most``; much cheaper than a profile."""
    apart = [F.abs(F.get("b_areas", F.lit(k)) - F.get("a_areas", F.lit(k))) for k in range(areas)]
    return reduce(lambda n, d: n + F.when(d <= most, 1).when(d > most, -1).otherwise(0), apart, F.lit(0)) >= 0


def _pairs(
    a: DataFrame, b: DataFrame, study: bool, ppm: float | None, seconds: float | None, lacking: str | None = None, many: str | None = None,
    measured_by: tuple[Rule, ...] = (), fitting: Column | None = None,
) -> DataFrame:
    """Pairs of rows that share the cells of the attributes used, with their deviations.

    ``lacking`` names the coordinates (columns ``has_...``, joined by a comma) of which at least
    one has to be missing on a side.  ``pr`` in ppm, ``rr`` in seconds, ``n`` common areas, ``level`` and ``spread`` of the
    logarithms of their ratios (median, and 1.48 times the median distance from it).
    ``many`` is the side whose rows of crowded cells are dealt out to several tasks.
    ``measured_by``: the second table are labelled rows that these rules are measured on; pairs
    come with the label and what the rules see with attributes masked.  ``fitting`` is a condition
    that pairs are held to before their profiles are computed.
    """
    left, right, keys, on = _renamed(a, "a"), _renamed(b, "b"), [], []
    if study:
        left, right = left.where("a_study IS NOT NULL").withColumn("_study", F.col("a_study")), right.where("b_study IS NOT NULL").withColumn("_study", F.col("b_study"))
        keys.append("_study")
    for c, window in (("mz", None if ppm is None else ppm * 1e-6), ("rt", seconds)):
        if window is not None:
            here, there = (_cell, _cells) if measured_by else (_cells, _cell)
            spread = lambda side, f, c=c, window=window: F.explode(f(F.col(f"{side}_{c}"), window)) if f is _cells else f(F.col(f"{side}_{c}"), window)
            left = left.where(f"a_{c} IS NOT NULL").withColumn(f"_{c}", spread("a", here))
            right = right.where(f"b_{c} IS NOT NULL").withColumn(f"_{c}", spread("b", there))
            keys.append(f"_{c}")
            on.append(F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")) <= window)
    if lacking:
        on.append(~reduce(lambda x, y: x & y, [F.col(f"{side}_{c}") for side in "ab" for c in lacking.split(",")]))
    if many == "a":
        left, right = split_hot(left, right, keys, "a_id")
    elif many == "b":
        right, left = split_hot(right, left, keys, "b_id")
    if many:
        keys.append("_salt")
    if fitting is not None:
        on.append(fitting)
    joined = _profiled(left.join(right, keys).where(reduce(lambda x, y: x & y, on, F.lit(True))), "n", "level", "spread")
    more = []
    if not all(r.areas for r in measured_by):
        joined = _profiled(joined, "few_n", "few_level", "few_spread", LEAST_AREAS - 1)
        more = ["few_n", "few_level", "few_spread"]
    if measured_by:
        more += [
            F.col("b_label").alias("label"), "a_own_ppm", "a_own_seconds", "a_own_level", (F.col("a_study") == F.col("b_study")).alias("same_study"),
            ((F.col("b_mid_mz") - F.col("a_mz")) * 1e6).alias("mid_pr"), (F.col("b_mid_rt") - F.col("a_rt")).alias("mid_rr"),
        ]
    return computed_once(
        joined.select(
            F.col("a_id").alias("feature_id"),
            F.col("b_id").alias("peak_id"),
            F.col("a_study").alias("study"),
            F.col("a_rt").alias("rt"),
            ((F.col("b_mz") - F.col("a_mz")) * 1e6).alias("pr"),
            (F.col("b_rt") - F.col("a_rt")).alias("rr"),
            (F.col("a_has_mz") & F.col("b_has_mz")).alias("has_mz"),
            (F.col("a_has_rt") & F.col("b_has_rt")).alias("has_rt"),
            "n",
            "level",
            "spread",
            *more,
        )
    )


def calibration(pairs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """``(study, shift_ppm, level, d0, d1, d2, anchors)`` of each study from its wide pairs.

    The shift and the level are medians; the drift of RT is a least-squares parabola in
    RT / 1000 through the anchors near the median drift.  Few anchors give a constant.
    """
    # Looked for once, read twice.
    anchors = cut_lineage(pairs.where((F.col("n") > LEAST_AREAS) & (F.col("spread") < limits.spread)).select("study", "rt", "pr", "rr", "level"))
    middle = lambda c: F.percentile_approx(c, 0.5, 1000)
    medians = anchors.groupBy("study").agg(middle("pr").alias("shift_ppm"), middle("rr").alias("_drift"), middle("level").alias("_level"))
    x, y = F.col("rt") / 1000, F.col("rr")
    sums = [F.count(F.lit(1)).alias("s0"), *[F.sum(x**k).alias(f"s{k}") for k in range(1, 5)], *[F.sum(y * x**k).alias(f"t{k}") for k in range(3)]]
    near = anchors.join(medians, "study").where(
        (F.abs(y - F.col("_drift")) <= limits.anchor_seconds) & (F.abs(F.col("pr") - F.col("shift_ppm")) <= limits.loose_ppm) & (F.abs(F.col("level") - F.col("_level")) <= 1.0)
    )
    fit = near.groupBy("study").agg(*sums, middle("pr").alias("shift_ppm"), middle("level").alias("level"), middle("rr").alias("_drift"), F.max("rt").alias("_to"), F.min("rt").alias("_from"))
    s0, s1, s2, s3, s4, t0, t1, t2 = (F.col(c).cast("double") for c in ("s0", "s1", "s2", "s3", "s4", "t0", "t1", "t2"))
    det3 = lambda m: (
        m[0][0] * (m[1][1] * m[2][2] - m[1][2] * m[2][1]) - m[0][1] * (m[1][0] * m[2][2] - m[1][2] * m[2][0]) + m[0][2] * (m[1][0] * m[2][1] - m[1][1] * m[2][0])
    )
    rows, right = [[s0, s1, s2], [s1, s2, s3], [s2, s3, s4]], [t0, t1, t2]
    swapped = lambda k: [[right[i] if j == k else rows[i][j] for j in range(3)] for i in range(3)]
    whole = det3(rows)
    curved = (F.col("s0") >= 3 * LEAST_ANCHORS) & (F.abs(whole) > 1e-6) & (F.col("_to") - F.col("_from") > 300)
    drift = [F.when(curved, F.try_divide(det3(swapped(k)), whole)).otherwise(F.col("_drift") if k == 0 else F.lit(0.0)).alias(f"d{k}") for k in range(3)]
    return fit.select("study", "shift_ppm", "level", *drift, F.col("s0").alias("anchors"))


def _study_sample(a: DataFrame, rows: int) -> DataFrame:
    """A hash sample of every study of more than ``rows`` rows, all rows of the others."""
    every = a.groupBy("study").agg(F.count(F.lit(1)).alias("_n")).select("study", F.ceil(F.col("_n") / rows).alias("_every"))
    return a.join(broadcast_if_small(every, 1_000_000), "study").where(F.pmod(F.xxhash64("id"), F.col("_every")) == 0).drop("_every")


def _moved(a: DataFrame, calibrated: DataFrame) -> DataFrame:
    """The first table in the second one's frame.

    ``sure`` marks studies with a calibration of their own; ``own_...`` says how far that is
    from the one of all studies together.
    """
    together = calibrated.agg(
        F.percentile_approx("shift_ppm", 0.5), F.percentile_approx("level", 0.5), F.percentile_approx(F.col("d0") + F.col("d1") + F.col("d2"), 0.5)
    ).first()
    ppm, level, drift = (F.lit(v if v is not None else 0.0) for v in together)
    own = calibrated.where(F.col("anchors") >= LEAST_ANCHORS).withColumn("sure", F.lit(True)).withColumnRenamed("level", "own")
    x = F.col("rt") / 1000
    rows = (
        a.join(broadcast_if_small(own, 1_000_000), "study", "left")
        .withColumn("_ppm", F.coalesce("shift_ppm", ppm))
        .withColumn("_seconds", F.coalesce(F.col("d0") + F.col("d1") * x + F.col("d2") * x * x, drift))
        .withColumn("_level", F.coalesce("own", level))
    )
    return rows.select(
        "id",
        "study",
        (F.col("mz") + F.col("_ppm") * 1e-6).alias("mz"),
        (F.col("rt") + F.col("_seconds")).alias("rt"),
        "has_mz",
        "has_rt",
        F.transform("areas", lambda v: v + F.col("_level")).alias("areas"),
        F.coalesce("sure", F.lit(False)).alias("sure"),
        (F.col("_ppm") - ppm).alias("own_ppm"),
        (F.col("_seconds") - drift).alias("own_seconds"),
        (F.col("_level") - level).alias("own_level"),
    )


def _verdict(rule: Rule, limits: Limits, c: dict[str, Column]) -> tuple[Column, Column]:
    """Whether a pair with the deviations ``c`` meets a rule, and its cost."""
    enough = c["n"] >= LEAST_AREAS
    fits = enough & (c["spread"] <= limits.spread) & (F.abs(c["level"]) <= limits.level)
    level_fits = (c["n"] == 0) | (F.abs(c["level"]) <= limits.level)
    mz = F.abs(c["pr"]) <= F.when(c["has_mz"], limits.ppm).otherwise(limits.loose_ppm)
    rt = F.abs(c["rr"]) <= F.when(c["has_rt"], limits.seconds).otherwise(limits.loose_seconds)
    ok = fits if rule.areas else ~enough & level_fits
    ok = ok & (mz if rule.mz else c["pr"].isNull() | mz)
    ok = ok & (rt if rule.rt else c["rr"].isNull() | rt)
    part = lambda k, s: F.coalesce(F.pow(c[k] / s, 2), F.lit(4.0))
    cost = part("pr", limits.sigma_ppm) + part("rr", limits.sigma_seconds) + part("level", limits.sigma_level) + part("spread", limits.sigma_spread)
    return F.coalesce(ok, F.lit(False)), cost


_DEVIATIONS = ("pr", "rr", "has_mz", "has_rt", "n", "level", "spread")


def _accepted(pairs: DataFrame, rule: Rule, limits: Limits) -> DataFrame:
    """Pairs that meet a rule, with their cost."""
    ok, cost = _verdict(rule, limits, {c: F.col(c) for c in _DEVIATIONS})
    return pairs.where(ok).select("feature_id", "peak_id", cost.alias("cost"))


def _marked(pairs: DataFrame) -> DataFrame:
    """Add ``best``: best of both rows; ``alone``: the only pair of both rows."""
    of_a, of_b = W.partitionBy("feature_id"), W.partitionBy("peak_id")
    return (
        pairs.withColumn("_a", F.row_number().over(of_a.orderBy("cost", "peak_id")))
        .withColumn("_na", F.count(F.lit(1)).over(of_a))
        .withColumn("_b", F.row_number().over(of_b.orderBy("cost", "feature_id")))
        .withColumn("_nb", F.count(F.lit(1)).over(of_b))
        .select(*pairs.columns, F.expr("_a = 1 AND _b = 1").alias("best"), F.expr("_na = 1 AND _nb = 1").alias("alone"))
    )


def _mutual(pairs: DataFrame) -> DataFrame | None:
    """Pairs that are the best of both their rows, over and over among the rows still free; None where there is no pair.

    Every round is written once; the pair of least cost is always taken, so it ends.
    """
    out, rest = None, pairs
    while True:
        marked = cut_lineage(_marked(rest))
        taken, left = marked.where("best").drop("best"), marked.where("NOT best").select(*pairs.columns)
        some, all_ = marked.agg(F.max("best"), F.min("best")).first()
        if not some:
            return out
        out = taken if out is None else out.unionByName(taken)
        if all_:
            return out
        rest = left.join(taken.select("feature_id"), "feature_id", "left_anti").join(taken.select("peak_id"), "peak_id", "left_anti")


def _rule_pairs(a: DataFrame, b: DataFrame, rule: Rule, limits: Limits) -> DataFrame:
    """Candidates of a rule between unresolved rows."""
    if rule.bounds:
        return _accepted(_pairs(a, b, rule.study, limits.loose_ppm, limits.loose_seconds, "has_mz,has_rt"), rule, limits)
    if rule.mz and rule.rt:
        # The middle of bounds stands in for a missing coordinate in later rules only.
        left, right = a.where("has_mz AND has_rt"), b.where("has_mz AND has_rt")
        return _accepted(_pairs(left, right, rule.study, limits.ppm, limits.seconds), rule, limits)
    if rule.mz:
        return _accepted(_pairs(a.where("has_mz"), b.where("has_mz"), rule.study, limits.ppm, None, "has_rt", many="a"), rule, limits)
    # Many rows share a cell of RT alone, so only those that lack m/z are compared with all, crowded cells in parts.
    a, b = a.where("has_rt"), b.where("has_rt")
    one = _pairs(a.where("NOT has_mz"), b, rule.study, None, limits.seconds, many="b")
    two = _pairs(a.where("has_mz"), b.where("NOT has_mz"), rule.study, None, limits.seconds, many="a")
    return _accepted(one.unionByName(two), rule, limits)


def _candidates(a: DataFrame, b: DataFrame, rule: Rule, limits: Limits, loose: bool) -> DataFrame:
    """Candidates of a rule in one group of studies; rules without study need it unknown on a side."""
    if rule.study:
        pairs = _rule_pairs(a, b, rule, limits)
    else:
        pairs = _rule_pairs(a, b.where("study IS NULL"), rule, limits)
        if loose:
            pairs = pairs.unionByName(_rule_pairs(a.where("study IS NULL"), b.where("study IS NOT NULL"), rule, limits))
    return pairs.withColumn("loose", F.lit(loose))


def match(
    features_a: DataFrame,
    features_b: DataFrame,
    limits: Limits = Limits(),
    labelled_rows: int | None = None,
    samples: tuple[str, ...] = SAMPLES,
    area_prefix: str = "Area_",
    anchor_rows: int | None = None,
) -> DataFrame:
    """``(feature_id, peak_id, rule, cost, confidence)`` of every pair.

    ``samples`` are those of the first table that the second one has under ``area_prefix``.
    Calibration and confidence are measured on all rows, unless the caller asks for a hash
    sample of about ``anchor_rows`` rows of a study or ``labelled_rows`` labelled rows.
    """
    a = cut_lineage(_side(features_a, "feature_id", "study", "", "loaded_at", samples).drop("mid_mz", "mid_rt"))
    b = cut_lineage(_side(features_b, "peak_id", "study_name", area_prefix, "exported_at", samples))
    full = lambda df: df.where("has_mz AND has_rt AND study IS NOT NULL")
    anchored = full(a) if anchor_rows is None else _study_sample(full(a), anchor_rows)
    wide = _pairs(anchored, full(b), True, limits.wide_ppm, limits.wide_seconds)
    # No more than a projection of what is written already.
    moved = _moved(a, cut_lineage(calibration(wide, limits)))

    # Studies without a calibration of their own are compared in wider windows.
    loose = Limits(ppm=limits.loose_ppm / 2, seconds=limits.loose_seconds, level=10.0, spread=limits.spread)
    groups = [(True, limits)] if moved.where("NOT sure").isEmpty() else [(True, limits), (False, loose)]

    rest_a, rest_b = moved, b
    matched, later, rules = None, None, {}
    for rule in RULES:
        # What rule 1 leaves is written once; what the later rules resolve is little.
        open_a, open_b = (df if later is None else df.join(later.select(F.col(c).alias("id")), "id", "left_anti") for df, c in ((rest_a, "feature_id"), (rest_b, "peak_id")))
        of = [_candidates(open_a.where("sure" if sure else "NOT sure"), open_b, rule, w, not sure) for sure, w in groups]
        found = _mutual(reduce(DataFrame.unionByName, of))
        if found is None:
            continue
        if rule.number == 1:
            rest_a = cut_lineage(rest_a.join(found.select(F.col("feature_id").alias("id")), "id", "left_anti"))
            rest_b = cut_lineage(rest_b.join(found.select(F.col("peak_id").alias("id")), "id", "left_anti"))
            labelled = found.where("alone AND NOT loose").select("feature_id", F.col("peak_id").alias("id"))
            if labelled_rows is not None:
                every = max(1, labelled.count() // max(1, labelled_rows))
                labelled = labelled.where(F.pmod(F.xxhash64("id"), F.lit(every)) == 0)
            usable = F.expr(f"has_mz AND has_rt AND study IS NOT NULL AND size(filter(areas, x -> x IS NOT NULL)) >= {LEAST_AREAS}")
            all_rows, without = (df.agg(F.count_if(usable)).first()[0] for df in (b, rest_b))
            rules = precision(moved.where("sure"), b, labelled, without / max(1, all_rows - without), dict(groups), len(samples))
        found = found.withColumn("rule", F.lit(rule.number)).select("feature_id", "peak_id", "rule", "cost", "loose")
        if rule.number > 1:
            later = found if later is None else later.unionByName(found)
        matched = found if matched is None else matched.unionByName(found)
    if matched is None:
        return a.limit(0).select(F.col("id").alias("feature_id"), F.col("id").alias("peak_id"), F.lit(0).alias("rule"), F.lit(0.0).alias("cost"), F.lit(0.0).alias("confidence"))
    entries = [F.lit(x) for (number, sure), r in rules.items() for x in (2 * number + (not sure), r.confidence)]
    confidence = F.try_element_at(F.create_map(*entries), 2 * F.col("rule") + F.col("loose").cast("int")) if entries else F.lit(None).cast("double")
    return matched.withColumn("confidence", F.coalesce(confidence, F.lit(0.5))).drop("loose")


@dataclass(frozen=True)
class RulePrecision:
    """How often a rule was right on labelled rows; ``wrong`` answers of rows without their partner count with a weight."""

    rule: int
    right: int
    answers: float

    @property
    def confidence(self) -> float:
        return (self.right + 1) / (self.answers + 2)


def _as_measured(rule: Rule, sure: bool) -> dict[str, Column]:
    """Deviations of a labelled pair as the rule sees them with the other attributes masked."""
    c = {k: F.col(k) for k in _DEVIATIONS}
    if rule.bounds:
        c |= {"pr": F.col("mid_pr"), "rr": F.col("mid_rr"), "has_mz": F.lit(False), "has_rt": F.lit(False)}
    if not rule.areas:
        c |= {"n": F.col("few_n"), "level": F.col("few_level"), "spread": F.col("few_spread")}
    if not sure:
        # With the shift of all studies together instead of the own one.
        c |= {"pr": c["pr"] + F.col("a_own_ppm"), "rr": c["rr"] + F.col("a_own_seconds"), "level": c["level"] + F.col("a_own_level")}
    if not rule.mz:
        c |= {"pr": F.lit(None).cast("double"), "has_mz": F.lit(False)}
    if not rule.rt:
        c |= {"rr": F.lit(None).cast("double"), "has_rt": F.lit(False)}
    return c


def precision(
    moved: DataFrame, b: DataFrame, labelled: DataFrame, absent: float, groups: dict[bool, Limits], areas: int = len(SAMPLES)
) -> dict[tuple[int, bool], RulePrecision]:
    """Precision of each rule, by its number and whether the study has a calibration of its own.

    ``absent`` is the number of rows without a partner to one with a partner.  All labelled rows
    meet all rows of ``moved`` twice, over m/z and over study and RT; every rule looks at the
    same pairs, and a few counts are collected.
    """
    rows = cut_lineage(b.join(labelled.select("id", F.col("feature_id").alias("label")), "id"))
    with_mz, without_mz = tuple(r for r in RULES if r.mz), tuple(r for r in RULES if not r.mz)
    near = _pairs(moved.where("has_mz"), rows, False, max(w.loose_ppm for w in groups.values()), None, many="b", measured_by=with_mz)
    # Rules without m/z have many candidates and need fitting areas: half of those lie as near to the level as the spread says.
    fitting = None if False in groups else _may_fit(groups[True].level + groups[True].spread / 1.4826 + 1e-9, areas)
    at_once = _pairs(moved.where("has_rt"), rows, True, None, max(w.seconds for w in groups.values()), many="b", measured_by=without_mz, fitting=fitting)
    out = {}
    for pairs, rules in ((near, with_mz), (at_once, without_mz)):
        best, wanted, met = [], [], F.lit(False)
        for rule in rules:
            for sure, limits in groups.items():
                ok, cost = _verdict(rule, limits, _as_measured(rule, sure))
                if rule.mz and rule.rt and not rule.bounds:
                    ok = ok & F.col("has_mz") & F.col("has_rt")
                if rule.study:
                    ok = ok & F.coalesce(F.col("same_study"), F.lit(False))
                name, answer = f"r{rule.number}_{int(sure)}", F.struct(cost.alias("cost"), "feature_id")
                best += [F.min(F.when(ok, answer)).alias(name), F.min(F.when(ok & (F.col("feature_id") != F.col("label")), answer)).alias(f"{name}_absent")]
                wanted.append((rule.number, sure, name))
                met = met | ok
        # Pairs that meet no rule are no answers.
        seen = pairs.where(met).groupBy("peak_id", "label").agg(*best)
        counts = []
        for _, _, name in wanted:
            counts += [
                F.count_if(F.col(f"{name}.feature_id") == F.col("label")).alias(f"{name}_right"),
                F.count(name).alias(f"{name}_answers"),
                F.count(f"{name}_absent").alias(f"{name}_wrong"),
            ]
        row = seen.agg(*counts).first()
        for number, sure, name in wanted:
            out[number, sure] = RulePrecision(number, row[f"{name}_right"], row[f"{name}_answers"] + absent * row[f"{name}_wrong"])
    return out
