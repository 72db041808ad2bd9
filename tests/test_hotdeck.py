"""Hot-deck filling."""

from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from massweave.operators import hotdeck as H
from massweave.plans import runtime

SAMPLES = [f"{g}_{k}" for g in ("BS4", "BS80", "LL", "LP", "Mix", "VN") for k in (1, 2, 3)]
KIND = ", ".join(["feature_id bigint", "study string", "pcgroup bigint", "polarity string", "loaded_at timestamp_ntz", *[f"{s} double" for s in SAMPLES], "field string", "value double"])
DAY = datetime(2024, 1, 1)


def table(spark, n=400, missing=(), changes=None, seed=3, study="A"):
    r = np.random.default_rng(seed)
    level = r.lognormal(9, 1, n)
    rows = []
    for k in range(n):
        values = {s: float(level[k] * r.uniform(0.95, 1.05)) for s in SAMPLES}
        row = {"feature_id": k, "study": study, "pcgroup": k % 9, "polarity": "pos" if k % 9 < 5 else "Negative", "loaded_at": DAY, **values, "field": "x", "value": 1.0}
        row |= (changes or {}).get(k, {})
        rows.append(tuple(row.values()))
    return spark.createDataFrame(rows, KIND), level


def fields():
    return [H.sample_field(f) for f in ("BS4_1", "LL_1", "Mix_1")]


def test_missing_values_are_found_and_filled_closely(spark):
    bad = [None, float("nan"), float("inf"), 0.0, -3.0]
    changes = {k: {"LL_1": bad[k % 5]} for k in range(0, 50)} | {60: {"polarity": None}, 61: {"polarity": "?"}, 62: {"polarity": " POSITIVE "}}
    changes |= {k: {"BS4_1": 55.5} for k in range(100, 104)}
    df, level = table(spark, changes=changes)
    got = {(r.feature_id, r.field): r for r in H.fill(df.unionByName(df.limit(20)), fields()).collect()}
    want = {(k, "LL_1") for k in range(50)} | {(60, "polarity"), (61, "polarity")} | {(k, "BS4_1") for k in range(100, 104)}
    assert set(got) == want
    errors = [abs(np.log(got[k, "LL_1"].filled_number / level[k])) for k in range(50)]
    close = [e for k, e in enumerate(errors) if got[k, "LL_1"].depth < 3]
    assert np.median(errors) < 0.1 and max(close) < 1.0 and len(close) >= 45
    assert got[60, "polarity"].filled_text == "negative" if 60 % 9 >= 5 else got[60, "polarity"].filled_text == "positive"
    assert all(r.donors or r.depth == 3 for r in got.values())
    assert all(k not in r.donors for (k, _), r in got.items() if r.field != "polarity")


@pytest.mark.parametrize("seed", range(3))
def test_donors_are_the_closest_of_the_study(spark, monkeypatch, seed):
    monkeypatch.setattr(runtime, "HOT_ROWS", 20)
    r = np.random.default_rng(seed)
    n = 500
    # Levels repeat and cross the borders of cells and blocks; stretches of records lack the value.
    changes = {}
    for k in range(n):
        value = float(np.exp(9 + r.integers(0, 60) * 0.013 if r.random() < 0.7 else 9 + r.normal(0, 1)))
        held = r.random() < 0.4 and not 9.2 < np.log(value) < 9.4
        changes[k] = {s: value for s in SAMPLES} | {"LL_1": 5000.0 + k if held else None, "BS4_1": 9000.0 + k, "Mix_1": 7000.0 + k, "BS80_3": value * float(r.uniform(0.5, 2))}
        changes[k]["polarity"] = "pos" if k % 2 else "neg"
    df, _ = table(spark, n, changes=changes)
    rows = {x.feature_id: x for x in df.collect()}
    level = {k: np.log(x.LL_2) for k, x in rows.items()}
    f = H.sample_field("LL_1")
    side = {k: np.floor(np.log(next(v for c in f.companions[2:] if (v := getattr(x, c)) is not None))) for k, x in rows.items()}
    got = {x.feature_id: x for x in H.fill(df, [f]).where("field = 'LL_1'").collect()}
    donors = [k for k, x in rows.items() if x.LL_1 is not None]
    assert set(got) == set(rows) - set(donors)
    for k, x in got.items():
        far = lambda d: abs(level[d] - level[k]) + (0 if side[d] == side[k] and d % 2 == k % 2 else H.OTHER_BLOCK)
        want = sorted((round(far(d), 9), d) for d in donors if abs(level[d] - level[k]) <= H.FARTHEST)[: H.DONORS]
        assert [round(far(d), 9) for d in x.donors] == [g for g, _ in want]
        if not want:
            assert x.depth == 3
            continue
        weights = sorted((rows[d].LL_1, 1 / (far(d) + 0.01)) for d in x.donors)
        total, upto = sum(w for _, w in weights), 0.0
        for value, w in weights:
            upto += w
            if upto >= total / 2 - 1e-12:
                break
        assert x.filled_number == value
        assert x.depth == (0 if all(far(d) == abs(level[d] - level[k]) for d in x.donors) else 1 if max(map(far, x.donors)) <= 2 * H.OTHER_BLOCK else 2)


def test_absent_groups_are_no_cases(spark):
    gone = {"LL_1": None, "LL_2": float("nan"), "LL_3": 0.0}
    df, _ = table(spark, 30, changes={k: gone for k in range(30)})
    assert H.fill(df, fields()).where("field = 'LL_1'").count() == 0
    # One measured sample of the group anywhere in the study makes all others cases.
    df, _ = table(spark, 30, changes={k: gone for k in range(29)})
    assert H.fill(df, fields()).where("field = 'LL_1'").count() == 29


def test_no_donor_and_null_keys(spark):
    alone = {k: {"Mix_1": None, "study": None} for k in range(3)}
    df, _ = table(spark, 3, changes=alone)
    rows = H.fill(df, fields()).where("field = 'Mix_1'").collect()
    assert [r.filled_number for r in rows] == [None] * 3 and [r.depth for r in rows] == [None] * 3
    df, _ = table(spark, 3, changes={k: {"polarity": None, "pcgroup": None} for k in range(3)})
    assert [r.filled_text for r in H.fill(df, fields()).where("field = 'polarity'").collect()] == [None] * 3
    assert H.fill(df.limit(0), fields()).count() == 0


def test_stand_ins_are_told_from_chance(spark):
    r = np.random.default_rng(5)
    # Values written coarsely in a narrow range repeat by chance alone.
    rows = [("dense", float(v)) for v in r.integers(10_000, 10_400, 6000) / 1e4] + [("once", float(v)) for v in r.lognormal(9, 1, 500)] + [("once", 77.7)] * 4 + [("once", 78.7)] * 2
    df = spark.createDataFrame(rows, "study string, v double")
    assert [(x.study, x.value) for x in H.stand_ins(df, ["v"]).collect()] == [("once", 77.7)]


def test_weighted_median(spark):
    near = F.array(*[F.struct(F.lit(v).alias("value"), F.lit(w).alias("weight")) for v, w in ((1.0, 1.0), (5.0, 3.0), (2.0, 1.0))])
    assert spark.range(1).select(H._weighted_median(near)).first()[0] == pytest.approx(5.0)


def test_records_without_a_value_take_up_no_places(spark):
    # One block: levels of 50 steps, many records at each, one in twelve of them with a value.
    step = lambda k: k * 37 % 50
    n, held = 1200, [k for k in range(1200) if k % 12 == 5 or step(k) == 20 and k % 3 == 0]
    changes = {}
    for k in range(n):
        value = float(np.exp(9.02 + step(k) ** 2 * 3e-5))
        changes[k] = {s: value for s in SAMPLES} | {"polarity": "pos", "LL_1": 5000.0 + k if k in held else None, "BS4_1": 9000.0 + k, "Mix_1": 7000.0 + k}
    df, _ = table(spark, n, changes=changes)
    got = H.fill(df, fields()).where("field = 'LL_1'").collect()
    assert len(got) == n - len(held) and {r.depth for r in got} <= {0, 1}
    block = lambda k: np.floor(9.02 + step(k) ** 2 * 3e-5)
    gap = lambda k, d: round(abs(step(k) ** 2 - step(d) ** 2) * 3e-5 + (block(k) != block(d)) * H.OTHER_BLOCK, 9)
    for r in got:
        want = sorted((gap(r.feature_id, d), d) for d in held)[:5]
        assert [gap(r.feature_id, d) for d in r.donors] == [g for g, _ in want]
        for d in r.donors:
            assert all(e in r.donors for e in held if step(e) == step(d) and e < d)
