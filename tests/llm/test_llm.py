"""Operators for language-model data."""

import base64
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

bpe = pytest.importorskip("massweave.llm.bpe")
from massweave.llm import match, mix, truncation as T  # noqa: E402
from massweave.operators.hotdeck import measured  # noqa: E402
from massweave.plans import runtime  # noqa: E402

PATH = bpe.rank_file("byte_bpe_50k")
ODD = [
    "", None, " ", "a", "  a\x1c b　c  \x85d", "a" * 5000, " " * 3000, "日本" * 800, "don't I'LL we'll\r\n\t x", "  \xa0 x", "\U0001f9ea" * 50, "<|endoftext|>",
    "x\n\n  \n y", "１２３ ²³ ⅷ", "\x1f\x1e a", "áé", " a  ​ c\x1d x᠎ y﻿ z", "9" * 999 + "x" * 999, "\x00\x01",
]


@pytest.fixture(scope="module")
def tiktoken_encoding():
    tiktoken = pytest.importorskip("tiktoken")
    public = pytest.importorskip("public_tokenizers")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_equal_a_public_encoder(spark, tiktoken_encoding):
    r = random.Random(7)
    alphabet = "abc deE'fgst\n\t 12éß日\U0001f600.,;(){}\xa0 _-+/*"
    texts = ODD + ["".join(r.choice(alphabet) for _ in range(r.randint(0, 300))) for _ in range(300)]
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(texts)], "doc_id bigint, text string, ids string, n_tokens int")
    got = {x.doc_id: x.ids for x in bpe.encode(df).collect()}
    want = {k: tiktoken_encoding.encode_ordinary(t or "") for k, t in enumerate(texts)}
    assert got == want
    counted = bpe.count_tokens(df.select("doc_id", "text"), out="n")
    assert {x.doc_id: x.n for x in counted.collect()} == {k: len(v) for k, v in want.items()}
    assert bpe.encode(df.limit(0)).count() == 0


def test_another_vocabulary_and_its_memo(spark, monkeypatch):
    tiktoken = pytest.importorskip("tiktoken")
    public = pytest.importorskip("public_tokenizers")
    path = bpe.rank_file("byte_bpe_multi_50k")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    encoding = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    df = spark.createDataFrame([(k, t) for k, t in enumerate(ODD)], "doc_id bigint, text string")
    got = {x.doc_id: x.ids for x in bpe.encode(df, name="byte_bpe_multi_50k").collect()}
    assert got == {k: encoding.encode_ordinary(t or "") for k, t in enumerate(ODD)}
    monkeypatch.setattr(bpe, "MEMO_PIECES", 5)
    small = [list(map(int, x)) for t in ODD for x in bpe.encode_batch([t], path)]
    assert small == [got[k] for k in range(len(ODD))]
    with pytest.raises(ValueError, match="none of"):
        bpe.rank_file("word_bpe_49k")


def test_pre_tokens_give_the_text_again():
    for t in ODD:
        assert "".join(bpe.split_text(t or "")) == (t or "")


@pytest.mark.parametrize("n", [0, 1, 2, 3, 50, 3000])
def test_hash_is_perfect_and_minimal(n):
    keys = [f"key {k}".encode() for k in range(n)]
    h = bpe.PerfectHash(keys)
    assert sorted(h.slot_of.tolist()) == list(range(n))
    if n:
        assert (h.lookup(keys) == h.slot_of).all()
        other = h.lookup([b"unknown", b"", b"\xff" * 100])
        assert ((0 <= other) & (other < n)).all()


def sized(spark, rows):
    df = spark.createDataFrame(rows, "source string, doc_id bigint, n_tokens bigint")
    return df.withColumn("key", F.xxhash64("doc_id", F.lit(7)))


def test_mix_against_brute_force(spark):
    r = random.Random(2)
    rows = [(r.choice(["big"] * 6 + ["mid", "mid", "small", None]), k, r.choice([0, 1, 5, 40, 300])) for k in range(3000)]
    df = sized(spark, rows)
    targets = spark.createDataFrame([("BIG", 5.0, 1), ("mid", 2.0, 3), ("Small", 3.0, 4), ("none", 1.0, 2), ("bad", None, 1), (None, 1.0, 1)], "source string, target_weight double, max_repeats int")
    plan = mix.budgets(df, targets)
    by = {b.source: b for b in plan.collect()}
    totals = {s: sum(n for x, _, n in rows if x == s) for s in ("big", "mid", "small")}
    whole = min(m * totals[s] * 10 / w for s, w, m in (("big", 5, 1), ("mid", 2, 3), ("small", 3, 4)))
    assert by["big"].budget == pytest.approx(whole * 0.5) and by["none"].budget == 0 and by["bad"].budget == 0
    keys = {x.doc_id: x.key for x in df.collect()}
    used = {x.doc_id: x.uses for x in mix.mix(df, plan, cell_documents=50).collect()}
    for s in totals:
        b = by[s]
        docs = sorted((keys[k], k, n) for x, k, n in rows if x == s and n > 0)
        end = 0
        for _, k, n in docs:
            start, end = end, end + n
            more = end <= b.rest or (start < b.rest and end - b.rest < b.rest - start)
            assert used.get(k, 0) == b.epochs + more
            assert used.get(k, 0) <= b.max_repeats
        assert abs(sum(n * used.get(k, 0) for _, k, n in docs) - b.budget) <= 300
    shares = {x.source: x for x in mix.shares(mix.mix(df, plan), plan).collect()}
    assert shares["big"].actual_share == pytest.approx(0.5, abs=0.02) and shares["none"].actual_share == 0
    assert sum(x.actual_share for x in shares.values()) == pytest.approx(1)


def test_mix_of_nothing_and_of_a_given_size(spark):
    targets = spark.createDataFrame([("a", 1.0, 1), ("b", 1.0, 2)], "source string, target_weight double, max_repeats int")
    empty = sized(spark, [])
    plan = mix.budgets(empty, targets)
    assert mix.mix(empty, plan).count() == 0 and mix.shares(mix.mix(empty, plan), plan).count() == 2
    assert mix.mix(empty, mix.budgets(empty, targets.limit(0))).count() == 0
    df = sized(spark, [("a", k, 10) for k in range(50)] + [("b", 100 + k, 10) for k in range(50)])
    plan = mix.budgets(df, targets, total_tokens=200)
    assert {b.source: b.budget for b in plan.collect()} == {"a": 100, "b": 100}
    assert mix.mix(df, plan).count() == 20
    # A size that one source cannot give its part of: the other's part stays, the shortfall is reported.
    plan = mix.budgets(df, targets, total_tokens=1800)
    got = {x.source: x for x in mix.shares(mix.mix(df, plan), plan).collect()}
    assert (got["a"].used_tokens, got["a"].shortfall_tokens, got["a"].most_uses) == (500, 400, 1)
    assert (got["b"].used_tokens, got["b"].shortfall_tokens, got["b"].most_uses) == (900, 0, 2)
    assert got["a"].target_share == got["b"].target_share == 0.5 and got["b"].actual_share == pytest.approx(900 / 1400)


def test_hot_sources_are_split(spark, monkeypatch):
    df = sized(spark, [("a" if k % 3 else "b", k, 1 + k % 7) for k in range(900)])
    targets = spark.createDataFrame([("a", 2.0, 1), ("b", 1.0, 2)], "source string, target_weight double, max_repeats int")
    plan = mix.budgets(df, targets)
    want = sorted(map(tuple, mix.mix(df, plan).collect()))
    monkeypatch.setattr(mix, "MOST_TARGETS", 0)
    monkeypatch.setattr(runtime, "HOT_ROWS", 50)
    assert sorted(map(tuple, mix.mix(df, plan).collect())) == want and len(want) > 300


def test_sized_documents(spark):
    df = spark.createDataFrame([(1, "a b", "X-y"), (1, "a b", "X-y"), (2, None, " "), (None, "q", "x")], "doc_id bigint, text string, source string")
    got = {x.doc_id: (x.source, x.n_tokens) for x in mix.sized_documents(df).collect()}
    assert got == {1: ("x_y", 2), 2: (None, 0)}


def test_lengths_as_stored(spark):
    texts = ["", "plain", 'a "b" & <c>\n\td\\e', "x\r\ny\n", "é日\U0001f9ea\n"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = df.select("text", *[c.alias(k) for k, c in T.lengths(F.col("text")).items()]).collect()
    import html

    for r in got:
        t = r.text
        lf = t.replace("\r\n", "\n").replace("\n", "\r\n")
        escaped = html.escape(t, quote=True).replace("&#x27;", "'")
        as_json = json.dumps(t, ensure_ascii=False)[1:-1]
        assert (r.chars, r.bytes) == (len(t), len(t.encode()))
        assert (r.entity_chars, r.entity_bytes) == (len(escaped), len(escaped.encode()))
        assert (r.json_chars, r.json_bytes) == (len(as_json), len(as_json.encode()))
        assert (r.crlf_chars, r.crlf_bytes) == (len(lf), len(lf.encode()))


WHOLE_HUNK = "commit 1234567890\n\n    say it\n\ndiff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1,2 +1,3 @@\n one\n-two\n+three\n+four\n"


@pytest.mark.parametrize(
    "text,broken",
    [(WHOLE_HUNK, False), (WHOLE_HUNK.rstrip(), False), (WHOLE_HUNK[:-6], True), (WHOLE_HUNK[:-15] + "\n", True), (WHOLE_HUNK + "diff --git a/y b", True), (WHOLE_HUNK + "ind", True),
     (WHOLE_HUNK + "@@ -9", True), ("commit 1234567890\nAuthor: x", True), ("From 12345678 Mon\nSubject: x\n\nbody\n-- \n2.3.1\n", False),
     ("From 12345678 Mon\r\n\r\nbody\r\n-- \r\n2.3.1", False), ("just words", False)],
)
def test_structure(text, broken):
    assert T.inspect(text)[1] is broken


def documents(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id bigint, source string, n_chars bigint, text string, cut int, reason string")


def test_cut_texts_are_found(spark):
    r = random.Random(4)
    words = "alpha beta gamma delta epsilon zeta".split()
    line = lambda: " ".join(r.choice(words) for _ in range(6)) + "\n"
    rows, cut = [], set()
    for k in range(400):
        t = "".join(line() for _ in range(r.randint(1, 20)))
        if k % 2 == 0 and len(t) > 300:
            t = t[:300]
            cut |= {k} if not t.endswith("\n") else set()
        rows.append((k, "Field Limit" if k % 4 else "field-limit", len(t), t))
    n = len(rows)
    rows += [(n, "free", 9, None), (n + 1, "free", None, ""), (n + 2, "free", 5, " \n \t "), (n + 3, "free", 3, "ok\n"), (n + 4, "free", None, "alpha beta\nalpha gam"), (n + 5, "free", None, "WIP gamma...\n")]
    rows += [(1000 + k, "free", None, line()) for k in range(60)] + [(n + 3, "free", 3, "ok\n")]
    rows += [(3000 + k, None, None, f"r{k} | me | today\n\n{line()}") for k in range(20)]
    rows += [(2000, "free", 900, "alpha beta …"), (2001, None, None, "r12 | me | today\n\nalpha beta\nalpha del")]
    got = {x.doc_id: x.reason for x in T.judged(documents(spark, rows)).where("cut").collect()}
    assert {k for k in got if k < n} == cut
    assert {k for k in got if k >= n} == {n + 4, 2000, 2001}
    assert got[2000] == "mark" and got[n + 4] == "ending"
    shares = {x.source: x for x in T.by_source(T.judged(documents(spark, rows))).collect()}
    assert shares["field_limit"].n_cut == len(cut) and shares["field_limit"].n_documents == 400
    assert T.judged(documents(spark, [])).count() == 0


def test_terminators_and_owners_of_beginnings_are_learned(spark):
    mail = lambda k, end: (k, "Any Mail", None, f"From {k:08x} Mon\nSubject: note {k}\n\nbody of it\n{end}")
    rows = [mail(k, "-- \n2.3.1\n") for k in range(200)] + [mail(200, ""), mail(201, "-- \r\n2.31\r\n"), mail(202, "more\n")]
    rows += [(203, None, None, "From 0abc1234 Mon\nSubject: other\n\nbody\n"), (204, "Any Mail", None, "just a message\n")]
    rows += [(1000 + k, "notes", None, f"first line {k}\nthe end\n") for k in range(100)]
    got = {x.doc_id: (x.source, x.reason) for x in T.judged(documents(spark, rows)).where("cut").collect()}
    # Texts of another beginning need no signature; a text without a source is judged by the source of its beginning.
    assert got == {k: ("any_mail", "terminator") for k in (200, 202, 203)}


def test_limits_are_not_exceeded_and_short_ones_are_found(spark):
    r = random.Random(2)
    rows = [(k, "brief", None, "".join(r.choice("abcdef gh") for _ in range(r.randint(20, 300)))[:72]) for k in range(400)]
    # Many texts of one length are no limit where more texts are longer.
    rows += [(1000 + k, "wide", None, "x" * 33 if k % 3 == 0 else "".join(r.choice("abcdef gh") for _ in range(r.randint(40, 5000)))) for k in range(600)]
    # Both sides of the border of two stretches are seen.
    rows += [(2000 + k, "long", None, "y" * min(4096, r.randint(100, 9000))) for k in range(400)]
    stored = documents(spark, rows).select("source", F.lit(False).alias("blank"), *[c.alias(f"len_{k}") for k, c in T.lengths(F.col("text")).items()])
    found = {(x.source, x.way, x.size) for x in T.hidden_limits(stored).collect()}
    assert {("brief", "chars", 72), ("long", "chars", 4096)} <= found and not any(s == "wide" for s, _, _ in found)


def test_marks_are_found_as_in_the_whole_text():
    for text, mark in (("a" * 500 + " …", "…"), ("line...\nlast [cut after " + "x" * 300 + "]\n", "[cut after " + "x" * 300 + "]"), ("more …\nand an end\n", None)):
        assert T.inspect(text)[2] == mark


def test_hidden_limits_in_bytes(spark):
    r = random.Random(9)
    rows = []
    for k in range(300):
        t = "".join(r.choice("abé日 \n") for _ in range(r.randint(50, 900)))
        b = t.encode()[:500]
        rows.append((k, "dump", None, b.decode(errors="ignore") if len(t.encode()) > 500 else t))
    stored = documents(spark, rows).select("source", F.lit(False).alias("blank"), *[c.alias(f"len_{k}") for k, c in T.lengths(F.col("text")).items()])
    found = {(x.way, x.size) for x in T.hidden_limits(stored).collect()}
    assert ("bytes", 500) in found and not any(way == "chars" for way, _ in found)


def features(n, study, r, shift=2e-6, drift=lambda t: 3 + t / 400, scale=0.6):
    """Features of one study on both sides, and the true pairs."""
    a, b, truth = [], [], set()
    for k in range(n):
        i = len(a) + study * 10_000
        mz, rt = r.uniform(100, 1000), r.uniform(50, 1800)
        areas = [r.lognormvariate(9, 1) for _ in match.SAMPLES]
        a.append([i, f"ST-{study:05d}", mz, mz - 0.002, mz + 0.002, rt, rt - 8, rt + 8, *areas, None])
        if k % 3:
            j = i + 5_000_000
            m, t = mz * (1 + shift + r.gauss(0, 1.5e-6)), rt + drift(rt) + r.gauss(0, 1.2)
            b.append([j, r.choice([f"st_{study:04d}", f"Study {study}", f"ST{study}"]), m, m - 0.002, m + 0.002, t, t - 8, t + 8, *[x * math.exp(scale + r.gauss(0, 0.08)) for x in areas], None])
            truth.add((i, j))
    return a, b, truth


def frames(spark, a, b):
    kind = lambda i, s, p, t: f"{i} bigint, {s} string, mz double, mzmin double, mzmax double, rt double, rtmin double, rtmax double, {', '.join(f'{p}{x} double' for x in match.SAMPLES)}, {t} timestamp_ntz"
    return spark.createDataFrame(a, kind("feature_id", "study", "", "loaded_at")), spark.createDataFrame(b, kind("peak_id", "study_name", "Area_", "exported_at"))


def test_features_are_matched_by_rules(spark):
    r = random.Random(6)
    a, b, truth = [], [], set()
    for s, shift in ((1, 3e-6), (2, -4e-6), (3, 0.0)):
        x, y, t = features(250, s, r, shift)
        a, b, truth = a + x, b + y, truth | t
    for k, row in enumerate(b):
        if k % 17 == 0:
            row[1] = None
        elif k % 19 == 0:
            row[5:8] = [None, None, None]
        elif k % 23 == 0:
            row[2:5] = [None, float("nan"), -1.0]
        elif k % 29 == 0:
            row[8:] = [None] * 10
    a[7][1] = None
    a[8][2] = None
    found = match.match(*frames(spark, a + a[:40], b + b[:40])).collect()
    got = {(x.feature_id, x.peak_id) for x in found}
    assert len({i for i, _ in got}) == len(got) == len({j for _, j in got})
    assert len(got & truth) / len(got) > 0.98 and len(got & truth) / len(truth) > 0.96
    assert {x.rule for x in found} >= {1, 2, 3, 4, 5} and all(0 < x.confidence < 1 for x in found)


def test_chains_of_contested_pairs_are_followed_to_the_end(spark):
    rows = [(k, k + 100, 2.0 * k - 1) for k in range(1, 5)] + [(k + 1, k + 100, 2.0 * k) for k in range(1, 4)]
    df = spark.createDataFrame(rows, "feature_id bigint, peak_id bigint, cost double")
    assert sorted((x.feature_id, x.peak_id) for x in match._mutual(df).collect()) == [(k, k + 100) for k in range(1, 5)]
    assert match._mutual(df.limit(0)) is None
    tied = df.withColumn("cost", F.lit(1.0))
    assert len(match._mutual(tied).collect()) == 4


def test_confidence_falls_where_answers_are_given_without_a_partner(spark):
    r = random.Random(12)
    a, b, _ = features(300, 1, r)
    full = {x.rule: x.confidence for x in match.match(*frames(spark, a, b)).collect()}
    half = {x.rule: x.confidence for x in match.match(*frames(spark, a[:150], b)).collect()}
    assert half[1] <= full[1] < 1


def test_rows_without_study_or_areas_find_their_partner(spark):
    r = random.Random(21)
    a, b, truth = features(300, 1, r)
    width = len(b[0]) - 8 - 1
    b[5][1], b[5][8 : 8 + width] = None, [None] * width
    a[10][1] = None
    rows = {x.peak_id: (x.feature_id, x.rule) for x in match.match(*frames(spark, a, b)).collect()}
    of_b = {j: i for i, j in truth}
    assert rows[b[5][0]] == (of_b[b[5][0]], 9)
    assert any(i == a[10][0] for i, _ in rows.values())


def test_other_samples_and_crowded_cells(spark, monkeypatch):
    r = random.Random(22)
    a, b, truth = features(200, 1, r)
    for k, row in enumerate(b):
        if k % 9 == 0:
            row[2:5] = [None, None, None]
    want = sorted((x.feature_id, x.peak_id) for x in match.match(*frames(spark, a, b)).collect())
    monkeypatch.setattr(runtime, "HOT_ROWS", 3)
    assert sorted((x.feature_id, x.peak_id) for x in match.match(*frames(spark, a, b)).collect()) == want
    few = match.match(*frames(spark, a, b), samples=match.SAMPLES[:5], anchor_rows=50)
    assert len({(x.feature_id, x.peak_id) for x in few.collect()} & truth) > 0.9 * len(truth)


def test_matching_of_a_small_study_and_of_nothing(spark):
    r = random.Random(3)
    a, b, truth = features(300, 1, r)
    x, y, t = features(6, 2, r)
    found = {(q.feature_id, q.peak_id) for q in match.match(*frames(spark, a + x, b + y)).collect()}
    assert t <= found and len(found & truth) > 0.97 * len(truth)
    one, two = frames(spark, a, b)
    assert match.match(one.limit(0), two).count() == 0 == match.match(one, two.limit(0)).count()


def test_calibration_and_confidence_are_measured_on_all_rows(spark, monkeypatch):
    r = random.Random(24)
    a, b, truth = features(150, 1, r, 1e-6)
    x, y, rare = features(18, 2, r, 18e-6)
    # 12 of the 5,018 rows of a study have a partner, and a shift far from that of the other study.
    more = [[30_000 + k, "ST-00002", 2000.0 + k, None, None, 500.0, None, None, *[None] * len(match.SAMPLES), None] for k in range(5000)]
    seen, precision = {}, match.precision
    monkeypatch.setattr(match, "precision", lambda moved, b, labelled, *args: seen.update(n=labelled.count(), rules=(out := precision(moved, b, labelled, *args))) or out)
    found = {(q.feature_id, q.peak_id): q.rule for q in match.match(*frames(spark, a + x + more, b + y)).collect()}
    assert len(rare) == 12 and all(found.get(pair) == 1 for pair in rare)
    assert seen["n"] > 100 and seen["rules"][4, True].right > 0.9 * seen["n"]


@pytest.mark.parametrize("name,key", [("ST-00001", "1"), ("st_001", "1"), ("Study 14", "14"), ("st2", "2"), ("Pilot", "pilot"), (" ", None), (None, None), ("ST-00000", "st")])
def test_study_names(spark, name, key):
    assert spark.range(1).select(match.study_key(F.lit(name).cast("string"))).first()[0] == key


def test_measured_values(spark):
    df = spark.createDataFrame([(v,) for v in (1.0, 0.0, -1.0, float("nan"), float("inf"), None)], "v double")
    assert [x.m for x in df.select(measured(F.col("v")).alias("m")).collect()] == [1.0, None, None, None, None, None]
    assert np.isfinite(1.0)
