"""Merged periods and gaps against a plain sweep."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from massweave.operators import intervals as I

KIND = "segment_id bigint, trace_id bigint, rtmin double, rtmax double, mzmin double, mzmax double, loaded_at timestamp_ntz, axis string, cell bigint"
DAY = [datetime(2024, 1, d) for d in range(1, 28)]


def usable(x):
    return x is not None and x == x and 0 <= x < float("inf")


def sweep(rows):
    """Periods by entity and axis from rows ``(id, trace, rtmin, rtmax, mzmin, mzmax, loaded)``."""
    last = {}
    for r in rows:
        key = (r[6] is not None, r[6], *[(x is not None, x) for x in r[1:6]])
        if r[0] not in last or key > last[r[0]][0]:
            last[r[0]] = (key, r)
    spans = {}
    for _, r in last.values():
        for axis, lo, hi, scale in (("rt", r[2], r[3], 1000), ("mz", r[4], r[5], 100000)):
            if r[1] is not None and usable(lo) and usable(hi):
                a, b = sorted((round(lo * scale), round(hi * scale)))
                spans.setdefault((r[1], axis), []).append((a, b))
    out = {}
    for key, s in spans.items():
        merged = []
        for a, b in sorted(s):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        out[key] = [tuple(m) for m in merged]
    return out


def check(spark, rows, width):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], KIND)
    latest = I.latest_rows(df, "segment_id", "loaded_at", ["trace_id", "rtmin", "rtmax", "mzmin", "mzmax"])
    want = sweep(rows)
    got = {}
    for r in I.periods(latest, "trace_id", cell_width=width).collect():
        got.setdefault((r.trace_id, r.axis), []).append((r.period_no, r.period_from, r.period_to))
    for v in got.values():
        v.sort()
        assert [n for n, _, _ in v] == list(range(1, len(v) + 1))
    assert {k: [(a, b) for _, a, b in v] for k, v in got.items()} == want
    gaps = sorted((r.trace_id, r.axis, r.gap_from, r.gap_to) for r in I.gaps(latest, "trace_id", cell_width=width).collect())
    assert gaps == sorted((t, x, a[1], b[0]) for (t, x), p in want.items() for a, b in zip(p, p[1:]))


@pytest.mark.parametrize("width", [1, 7, 4096])
@pytest.mark.parametrize("seed", [1, 2])
def test_random_segments(spark, seed, width):
    r = random.Random(seed)
    value = lambda scale, top: r.choice([None, float("nan"), float("inf"), -1.0]) if r.random() < 0.05 else r.randint(0, top) / scale
    rows = []
    for k in range(300):
        lo, m = value(1000, 400), value(100000, 300)
        hi = lo if lo is None or r.random() < 0.1 else lo + r.randint(-3, 12) / 1000
        trace = 1 if r.random() < 0.4 else r.choice([2, 3, None])
        rows.append((r.randint(1, 220), trace, lo, hi, m, value(100000, 300) if r.random() < 0.2 else (m if m is None else m + 0.00002), r.choice([*DAY, None])))
    rows += rows[:30]
    check(spark, rows, width)


def test_touching_nested_and_point_segments(spark):
    rows = [(1, 9, 0.0, 1.0, 5.0, 5.0, DAY[0]), (2, 9, 1.0, 2.0, 5.0, 5.0, DAY[0]), (3, 9, 0.2, 0.3, 7.0, 6.0, DAY[0]), (4, 9, 3.0, 3.0, None, 1.0, DAY[0]), (5, 9, 5.0, 4.0, 6.5, 8.0, DAY[0])]
    check(spark, rows, 16)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], KIND)
    got = sorted((r.axis, r.gap_from, r.gap_to) for r in I.gaps(df, "trace_id").collect())
    assert got == [("mz", 500000, 600000), ("rt", 2000, 3000), ("rt", 3000, 4000)]


def test_row_loaded_last_counts_even_if_unusable(spark):
    rows = [(1, 1, 0.0, 1.0, 1.0, 1.0, DAY[0]), (2, 1, 2.0, 3.0, 1.0, 1.0, DAY[0]), (2, 1, None, 3.0, 1.0, 1.0, DAY[1])]
    check(spark, rows, 64)


def test_empty_table(spark):
    df = spark.createDataFrame([], KIND)
    assert I.gaps(df, "trace_id").count() == 0 and I.periods(df, "trace_id").count() == 0


def test_one_trace_is_never_one_task(spark):
    df = spark.range(200_000).select(F.col("id").alias("segment_id"), F.lit(1).alias("trace_id"), *[((F.col("id") * 7 % 200_000) / 100).alias(c) for c in ("rtmin", "rtmax", "mzmin", "mzmax")])
    marked = I.label_breaks(I.interval_starts(df, "trace_id"), "trace_id")
    largest = marked.groupBy("trace_id", "axis", "cell").count().agg(F.max("count")).first()[0]
    assert largest <= 4096
