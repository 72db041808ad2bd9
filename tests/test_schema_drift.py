"""Schema drift between files."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from massweave.operators import schema_drift as D

FILES = "file_id bigint, stream string, software string, file_name string, exported_at timestamp_ntz, received_at timestamp_ntz, n_rows int"
ROWS = "file_id bigint, row_no int, payload string"


def files(spark, listed):
    return spark.createDataFrame([(i, s, None, None, t, r, None) for i, s, t, r in listed], FILES)


def at(hour, day=1):
    return datetime(2024, 1, day, hour)


def rows(spark, contents):
    return spark.createDataFrame([(i, n, p if p is None or isinstance(p, str) else json.dumps(p)) for i, n, p in contents], ROWS)


@pytest.mark.parametrize(
    "name,role",
    [("m/z", "mz"), ("exact mass", "mz"), ("mz max", "mz_max"), ("max_mz", "mz_max"), ("end_rt", "rt_max"), ("Best Retention Time", "rt"), ("Area_LL-1", "sample:ll_1"),
     ("peak_area_BS80.3", "sample:bs80_3"), ("Mix_2", "sample:mix_2"), ("bs4_1", "sample:bs4_1"), ("LL1", "sample:ll_1"), ("Height_QC12", "sample:qc12"), ("MS2", "annotation:msms"),
     ("z", "annotation:charge"), ("Feature ID", "annotation:feature_id"), ("something new", "other:somethingnew"), ("??", "other:??")],
)
def test_roles_of_names(spark, name, role):
    assert spark.range(1).select(D.column_role(F.lit(name))).first()[0] == role


def test_all_kinds_of_change(spark):
    one = {"mz": 1.0, "rt": 2.0, "LL_1": 5.0, "flag": True, "name": "a", "adduct": "[M+H]+"}
    two = {"M/Z": 1.0, "rt": "2,0", "LL_1": 5.0, "flag": 1, "name": ["a"], "ion": "[M+Na]+", "new": None}
    content = [(1, 1, one), (1, 2, one), (1, 2, one), (2, 1, two), (2, 2, {**two, "rt": "NA"}), (2, 3, {"LL_1": "stray"}), (2, 4, {"LL_1": 7}), (2, 5, None), (2, 6, "no json"), (2, 7, "[1]")]
    listed = [(2, "s", at(5), at(9)), (1, "s", at(3), at(20)), (1, "s", at(3), at(22)), (3, None, at(4), at(4)), (4, "other", at(4), None)]
    got = sorted((r.file_id, r.change, r.old_name, r.new_name) for r in D.changes(files(spark, listed), rows(spark, content)).collect())
    assert got == [
        (2, "added", "", "new"), (2, "renamed", "adduct", "ion"), (2, "renamed", "mz", "M/Z"),
        (2, "retyped", "flag", "flag"), (2, "retyped", "name", "name"), (2, "retyped", "rt", "rt"),
    ]


def test_boolean_to_number_is_a_change_and_renamed_twice_gives_two_rows(spark):
    content = [(1, 1, {"RT": 1.0, "flag": True}), (2, 1, {"rt": "1.0", "flag": 0}), (3, 1, {"rt": "x", "flag": 0})]
    listed = [(k, "s", at(k), None) for k in (1, 2, 3)]
    got = sorted((r.file_id, r.change, r.old_name, r.new_name) for r in D.changes(files(spark, listed), rows(spark, content)).collect())
    assert got == [(2, "renamed", "RT", "rt"), (2, "retyped", "RT", "rt"), (2, "retyped", "flag", "flag")]


def test_order_across_days_ties_and_missing_times(spark):
    name = lambda k: {f"LL_{k}": 1.0}
    listed = [(1, "s", at(23, 1), None), (2, "s", at(1, 5), None), (3, "s", at(1, 5), None), (4, "s", None, at(9, 9)), (5, "s", None, None), (6, "s", at(2, 5), at(1, 1)), (7, "s", at(0, 12), None)]
    content = [(k, 1, name(k)) for k in (1, 2, 3, 4, 5, 6)] + [(99, 1, name(9))]
    pairs = D.consecutive(files(spark, listed), D.file_schemas(D.file_columns(D.distinct_records(rows(spark, content)))))
    assert sorted((r.file_id, r.before_id) for r in pairs.where("before_id IS NOT NULL").collect()) == [(2, 1), (3, 2), (4, 6), (6, 3), (7, 4)]
    steps = D.migration_steps(pairs).where("file_id = 7").collect()
    assert [(r.change, r.old_name) for r in steps] == [("removed", "LL_4")]


def test_versions_and_two_columns_of_one_role(spark):
    same = {"LL_1": 1.0, "Area_LL_1": 2.0, "rt": 1}
    listed = [(k, "s", at(k), None) for k in (1, 2, 3)]
    content = [(1, 1, same), (2, 1, dict(reversed(same.items()))), (3, 1, {"LL_1": 1.0, "rt": 1})]
    schemas = D.file_schemas(D.file_columns(D.distinct_records(rows(spark, content))))
    pairs = D.consecutive(files(spark, listed), schemas)
    assert sorted((r.n_files, r.n_columns) for r in D.schema_versions(pairs).collect()) == [(1, 2), (2, 3)]
    got = [(r.change, r.old_name, r.new_name) for r in D.migration_steps(pairs).collect()]
    assert sorted(got) == [("removed", "LL_1", ""), ("renamed", "Area_LL_1", "LL_1")]


def test_one_table(spark):
    content = [(1, 1, {"M/Z": "100,5", "RT": 3, "max_rt": None, "Area_LL-1": "7.5", "LL_2": "nd", "z": 2, "flag": [1]}), (2, 1, {}), (2, 2, None), (3, 1, {"mz": True, "LL_1": 1, "Area_LL_1": 2})]
    got = {(r.file_id, r.row_no): r for r in D.unified(D.distinct_records(rows(spark, content + content))).collect()}
    assert len(got) == 4
    r = got[1, 1]
    assert (r.mz, r.rt, r.rt_max, r.intensities, r.annotations["charge"]) == (100.5, 3.0, None, {"ll_1": 7.5, "ll_2": None}, "2")
    assert (r.n_cast, r.n_lost) == (2, 1)
    assert got[2, 1].mz is None and got[2, 2].intensities == {} and got[3, 1].mz is None and got[3, 1].n_lost == 1
    assert got[3, 1].intensities == {"ll_1": 2.0}
    assert D.unified(D.distinct_records(rows(spark, []))).count() == 0
    assert D.changes(files(spark, []), rows(spark, [])).count() == 0


def test_table_follows_the_schema_of_each_file(spark):
    content = [
        (1, 1, {"mz": 1.0, "ion seen": "[M+H]+", "Batch": "b1", "tags": ["x"], "none": None}),
        (2, 1, {"ion seen": "plain text", "Foo_1x": "p", "foo-1x": "q"}),
        (3, 1, {"adduct": "[M+H]+", "ion": "[M+Na]+"}),
    ]
    got = {r.file_id: r.annotations for r in D.unified(D.distinct_records(rows(spark, content))).collect()}
    # A role by looks holds for the file; unknown columns stay, and none displaces another.
    assert got[1] == {"adduct": "[M+H]+", "other:batch": "b1", "other:tags": '["x"]', "other:none": None}
    assert got[2] == {"other:ionseen": "plain text", "other:Foo_1x": "p", "other:foo-1x": "q"}
    assert got[3] == {"adduct": "[M+H]+", "other:ion": "[M+Na]+"}


def test_names_nobody_knows_take_over_roles_by_their_values(spark):
    def one(k, names):
        level = 1.0 + 0.37 * k
        values = (400.0 + 31 * k, 900.0 + 17 * k, 5e4 * level, "x" * (3 + k % 2), k % 2 == 0)
        return dict(zip(names, values))

    old = ("mz", "rt", "LL_1", "name", "flag")
    new = ("Masse", "Zeit", "Flaeche", "Bezeichnung", "ok?")
    listed = [(k, "s", at(k), None) for k in (1, 2, 3)] + [(4, "t", at(4), None)]
    content = [(f, n, one(n, old if f == 1 else new)) for f in (1, 2, 3, 4) for n in range(1, 9)]
    got = sorted((r.file_id, r.change, r.old_name, r.new_name) for r in D.changes(files(spark, listed), rows(spark, content)).collect())
    assert got == sorted((2, "renamed", a, b) for a, b in zip(old, new))
    table = {(r.file_id, r.row_no): r for r in D.table_of(files(spark, listed), rows(spark, content)).collect()}
    # The role is kept by the files after the step, and unknown to another stream.
    assert (table[3, 1].mz, table[3, 1].rt, table[3, 1].intensities) == (431.0, 917.0, {"ll_1": 5e4 * 1.37})
    assert set(table[4, 1].annotations) == {"other:masse", "other:zeit", "other:flaeche", "other:bezeichnung", "other:ok"} and table[4, 1].mz is None


def test_columns_of_alike_values_are_not_taken_for_each_other(spark):
    first = {"LL_1": 100.0, "LL_2": 101.0, "mz": 5.0}
    content = [(1, n, {k: v + n for k, v in first.items()}) for n in range(5)] + [(2, n, {"Neu": 100.5 + n, "mz": 5.0 + n}) for n in range(5)]
    got = sorted((r.change, r.old_name, r.new_name) for r in D.changes(files(spark, [(1, "s", at(1), None), (2, "s", at(2), None)]), rows(spark, content)).collect())
    assert got == [("added", "", "Neu"), ("removed", "LL_1", ""), ("removed", "LL_2", "")]


def test_chained_steps_come_to_the_routes(spark):
    content = [
        (1, 1, {"mz": 1.0, "RT": 2.0, "Area_LL_1": 3.0, "adduct": "[M+H]+"}), (2, 1, {"m/z": 1.0, "RT": "2,0", "Area_LL_1": 3.0, "ion": "[M+H]+"}),
        (3, 1, {"m/z": 1.0, "rt": 2.0, "ion": "[M+H]+", "z": 1}), (4, 1, {"mass": 1.0, "rt": 2.0, "LL-1": 3.0, "ion": "[M+H]+", "Charge": 1}),
    ]
    listed = [(k, "s", at(k), None) for k in (1, 2, 3, 4)]
    records = D.distinct_records(rows(spark, content))
    columns = D.file_columns(records)
    routes = {r.file_id: r._roles for r in D.file_routes(columns).collect()}
    steps = D.changes(files(spark, listed), rows(spark, content)).collect()
    route = dict(routes[1])
    for k in (2, 3, 4):
        mine = [s for s in steps if s.file_id == k]
        route = {n: r for n, r in route.items() if n not in {s.old_name for s in mine if s.change in ("removed", "renamed")}} | {
            s.new_name: route[s.old_name] for s in mine if s.change == "renamed"
        } | {s.new_name: routes[k][s.new_name] for s in mine if s.change == "added"}
        assert route == routes[k]


def test_long_names_that_differ_at_the_end_stay_apart(spark):
    names = ["Area_" + "x" * 300 + end for end in "ab"]
    got = D.unified(D.distinct_records(rows(spark, [(1, 1, {names[0]: 1.0, names[1]: 2.0, "Mass (m/z)": 3.5, "Sample Alpha": 4.5})]))).first()
    assert sorted(got.intensities.values()) == [1.0, 2.0] and got.annotations == {"other:massmz": "3.5", "other:samplealpha": "4.5"}
