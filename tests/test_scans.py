"""Segmented scans and folds against plain windows and plain loops, under one hot key."""

import random

import pytest
from pyspark.sql import Window, functions as F

from lodestone.operators import chunking, context, folds, scans, tasks


@pytest.fixture(scope="module")
def rows(spark):
    """One key with half of the rows, null keys, null values, and orders far apart."""
    rng = random.Random(7)
    data = [("hot" if rng.random() < 0.5 else rng.choice(["k0", "k1", "k2", None]), i * 10**9 if i % 3 else i * 10**9 + 7, rng.choice([None, 1, 2, 5, 9]), rng.randrange(1, 12), f"id{rng.randrange(10**6)}-{i}") for i in range(600)]
    return spark.createDataFrame(data, "k string, o long, v int, t int, s string").cache()


@pytest.fixture(scope="module", autouse=True)
def small_segments(spark):
    """Keep every range partition, so that small tables have several segments."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.set(name, "true")


def same(a, b):
    assert sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.collect()), key=str)


def test_a_key_is_spread_by_rows(rows):
    held = scans.ranged(rows, ["k"], ["o"])
    assert held.filter("k = 'hot'").select("_seg").distinct().count() > 1


def test_running_equals_plain_windows(rows):
    values = {"sum": ("sum", F.col("v")), "c": ("count", F.col("v")), "hi": ("max", F.col("v")), "lo": ("min", F.col("v")), "z": ("last", F.col("v"))}
    plain = Window.partitionBy("k").orderBy("o").rowsBetween(Window.unboundedPreceding, 0)
    calls = {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min, "last": lambda v: F.last(v, ignorenulls=True)}
    want = rows.withColumns({n: calls[kind](value).over(plain) for n, (kind, value) in values.items()})
    same(scans.running(rows, ["k"], ["o"], values).select("k", "o", *values), want.select("k", "o", *values))


def test_previous_equals_lag(rows):
    cut = scans.previous(rows, ["k"], ["o"], {"p": F.col("v"), "q": F.col("o")})
    plain = rows.withColumns({"p": F.lag("v").over(Window.partitionBy("k").orderBy("o")), "q": F.lag("o").over(Window.partitionBy("k").orderBy("o"))})
    same(cut.select("k", "o", "p", "q"), plain.select("k", "o", "p", "q"))


def test_row_numbers_by_score_and_text_ties(rows):
    plain = F.row_number().over(Window.partitionBy("k").orderBy(F.desc("v"), "s")).cast("long")
    same(scans.row_numbers(rows, ["k"], F.col("v"), "s", "r").select("k", "s", "r"), rows.withColumn("r", plain).select("k", "s", "r"))


def test_first_rows_is_the_first_by_order(rows):
    first = {r.k: r.o for r in scans.first_rows(rows, ["k"], ["o"]).collect()}
    expected = {}
    for r in sorted(rows.collect(), key=lambda r: r.o):
        expected.setdefault(r.k, r.o)
    assert first == expected


def loop_pack(items, size):
    out, open_, pack = {}, 0, None
    for o, t in items:
        if t > size:
            out[o], open_, pack = o, 0, None
        elif open_ and open_ + t <= size:
            out[o], open_ = pack, open_ + t
        else:
            out[o], open_, pack = o, t, o
    return out


def test_packing_fold_in_segments(rows):
    fold = chunking._packing(10)
    out = folds.segmented_fold(rows.select("k", "o", "t"), ["k"], ["o"], ["t"], fold, "starts", "boolean")
    held = rows.collect()
    got = {(r.k, r.o): r.starts for r in out.collect()}
    for k in {r.k for r in rows.collect()}:
        items = sorted((r.o, r.t) for r in held if r.k == k)
        for o, pack in loop_pack(items, 10).items():
            assert got[(k, o)] == (pack == o)


def test_budget_fold_in_segments(rows, monkeypatch):
    monkeypatch.setattr(folds, "BLOCK", 2)
    out = folds.segmented_fold(rows.select("k", "o", "t"), ["k"], ["o"], ["t"], context._spending(90), "fits", "boolean")
    held = rows.collect()
    got = {(r.k, r.o): r.fits for r in out.collect()}
    for k in {r.k for r in rows.collect()}:
        spent = 0
        for o, t in sorted((r.o, r.t) for r in held if r.k == k):
            fits = spent + t <= 90
            spent += t if fits else 0
            assert got[(k, o)] == fits


def test_rate_window_fold_across_days(spark):
    rng = random.Random(3)
    day = tasks.DAY
    seconds = sorted({rng.randrange(day - 300, day + 300) for _ in range(120)} | {rng.randrange(3 * day) for _ in range(60)} | {2 * day + 5, 40 * day})
    df = spark.createDataFrame([("hot", s) for s in seconds], "k string, s long")
    out = folds.segmented_fold(df, ["k"], ["s"], ["s"], tasks._windows(60), "began", "bigint")
    began, expected = -(10**18), {}
    for s in seconds:
        began = s if s - began >= 60 else began
        expected[s] = began
    assert {r.s: r.began for r in out.collect()} == expected
